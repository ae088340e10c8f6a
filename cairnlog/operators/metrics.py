"""Step counts over the grid start + step, start + 2 step, ...: bucket i holds (start + i step, start + (i+1) step], the
first one also start itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _check(step: int) -> None:
    if step <= 0:
        raise ValueError("step must be positive")


def step_grid(spark: SparkSession, start: int, end: int, step: int) -> DataFrame:
    """floor((end - start) / step) + 1 bucket ends, the last of which may lie beyond end."""
    _check(step)
    n = (end - start) // step + 1
    return spark.range(max(0, n)).select((F.lit(start) + (F.col("id") + 1) * step).alias("bucket_end_ms"))


def bucket(ts_ms: Column, start: int, step: int) -> Column:
    """Number of the bucket, by whole-number division."""
    past = ts_ms - start + (step - 1)
    return F.greatest(F.lit(0).cast("bigint"), ((past - F.pmod(past, F.lit(step))) / step).cast("bigint") - 1)


def step_count(lines: DataFrame, start: int, end: int, step: int, drop_last: bool = False) -> DataFrame:
    """(series_key, bucket_end_ms, value): lines of each series in each bucket that has any.

    drop_last leaves out the last such bucket of each series, as a reader that emits a bucket only when a later line
    closes it would."""
    _check(step)
    rows = lines.filter(F.col("ts_ms").between(start, end)).withColumn("i", bucket(F.col("ts_ms"), start, step))
    counts = rows.groupBy("series_key", "i").agg(F.count("*").cast("double").alias("value"))
    if drop_last:
        counts = counts.withColumn("last", F.max("i").over(Window.partitionBy("series_key"))).filter(F.col("i") < F.col("last"))
    return counts.select("series_key", (F.lit(start) + (F.col("i") + 1) * step).alias("bucket_end_ms"), "value")


def tumbling_count(lines: DataFrame, step_ms: int) -> DataFrame:
    """(series_key, window_start_ms, n) over half-open windows [start, start + step)."""
    _check(step_ms)
    start = (F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(step_ms))).alias("window_start_ms")
    return lines.groupBy("series_key", start).agg(F.count("*").alias("n"))
