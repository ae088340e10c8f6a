"""Continuous ingest and streaming counts on Structured Streaming; the checkpoint is the write-ahead log."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..operators.metrics import bucket
from ..operators.search import select
from ..operators.store import Store
from ..plans.temql import parse
from ..sources.push import RAW, REQUEST, decode_protobuf, flatten, to_logs


def read_requests(spark: SparkSession, folder: str, max_files: int | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """JSON push requests, one a line, as files arrive; those that don't parse keep their text in the column raw.

    A micro-batch, and with it a block, takes at most flush_bytes of input (or max_files files)."""
    reader = spark.readStream.schema(REQUEST).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW)
    limit = ("maxFilesPerTrigger", max_files) if max_files else ("maxBytesPerTrigger", config.flush_bytes)
    return reader.option(*limit).json(folder)


def read_compressed(spark: SparkSession, folder: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Snappy-compressed protobuf requests, a file each, as they arrive: entries as flatten() gives them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxBytesPerTrigger", config.flush_bytes).load(folder)
    return decode_protobuf(files.select("content"), "content")


def start_ingest(requests: DataFrame, store: str, checkpoint: str, dead_letters: str | None = None, config: EngineConfig = EngineConfig(), once: bool = False) -> StreamingQuery:
    """Append every micro-batch to the store as one block. The block's id is that of the batch, so one that is run again
    after a failure replaces what it wrote before: each request counts once. requests: as read_requests() or
    read_compressed() give them. An idle stream writes nothing; a busy one cuts a block each block_ms or flush_bytes."""
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            good, bad = to_logs(flatten(batch) if "streams" in batch.columns else batch)
            Store(batch.sparkSession, store, config).append(good, f"stream-{name}-{number:012d}")
            if dead_letters:
                bad.write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
        finally:
            batch.unpersist()

    writer = requests.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{config.block_ms} milliseconds")).start()


def step_counts(logs: DataFrame, start: int, step: int, delay: str = "1 minute") -> DataFrame:
    """Streaming form of step counts: same buckets, each emitted when the watermark has passed it. logs: with ts."""
    rows = logs.withWatermark("ts", delay).withColumn("i", bucket(F.col("ts_ms"), start, step))
    # The window of the bucket's end carries the watermark, so that state goes when a bucket is over.
    end = (F.lit(start) + (F.col("i") + 1) * step).alias("bucket_end_ms")
    return rows.groupBy(F.window("ts", f"{step} milliseconds", startTime=f"{start % step + 1} milliseconds"), "series_key", end).agg(F.count("*").cast("double").alias("value")).select("series_key", "bucket_end_ms", "value")


def tumbling_counts(logs: DataFrame, window: str, delay: str = "1 minute") -> DataFrame:
    """(series_key, window_start_ms, n) of half-open windows, late lines up to the delay included. logs: with ts."""
    counts = logs.withWatermark("ts", delay).groupBy(F.window("ts", window), "series_key").agg(F.count("*").alias("n"))
    return counts.select("series_key", F.unix_millis(F.col("window.start")).alias("window_start_ms"), "n")


def without_repeats(logs: DataFrame, delay: str = "1 minute") -> DataFrame:
    """A line pushed again within the delay counts once. logs: with ts."""
    return logs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["series_key", "ts_ms", "line"])


def tail(logs: DataFrame, source: str) -> DataFrame:
    """Lines of a stream that a query selects, as they come."""
    return select(logs, parse(source)).select("series_key", "ts_ms", "line")
