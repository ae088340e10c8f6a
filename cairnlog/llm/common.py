"""Helpers shared by the training-data operators: table access, shared storage, clash-free column names."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver see: spark.checkpoint.dir.

    Only where the session names none and the master is local (tests) a folder of this process is set; on a cluster a
    session without the setting is an error, since a machine's own folder is not seen by the others."""
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_dir = held.get() if held.isDefined() else "file://" + os.path.join(tempfile.gettempdir(), f"cairnlog-{uuid.uuid4().hex}")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: lineage ends, lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """A Parquet table in the shared folder (columnar, compressed), read again by whoever needs it twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table.stored_at = path
    _stored.append(path)
    return table


#: Folders that stored() has written and that are still there.
_stored: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what stored() wrote inside: for results that are written whole before that."""
    before = len(_stored)
    try:
        yield
    finally:
        for path in _stored[before:]:
            remove(spark, path)
        del _stored[before:]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)
        _stored.remove(t.stored_at)


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """crc32 of the id's decimal text modulo folds equals fold; a null id counts as held out (it is never learnt from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so columns an input has besides cannot clash with those an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of fewer rows, so that what Python makes of a batch is bounded; Spark bounds the batches
    themselves by bytes (spark.sql.execution.arrow.maxBytesPerBatch)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


#: Groups up to which their counts are broadcast (some 10 MB at most).
BROADCAST_GROUPS = 200_000


def hash_sample(df: DataFrame, key: str, n: int, by: str | None = None, margin: int = 8) -> DataFrame:
    """At most n rows (of each value of by), the first by hash of the key.

    Counts come first, so that only about margin * n rows a group are left before the rows meet in a task, however many
    tasks and rows there are. Bounded samples are for fitting models alone."""
    sort, room = F.xxhash64(key), 1 << 30
    share = F.pmod(sort, F.lit(room))
    if by is None:
        total = df.count()
        near = df.filter(share < room * margin * n // total) if total > margin * n else df
        return near.orderBy(share, sort, key).limit(n)
    counts = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_rows"))
    if counts.count() <= BROADCAST_GROUPS:
        # Two numbers a group and a checked number of groups: the filter then needs no shuffle of the rows.
        near = df.join(F.broadcast(counts), F.col(by) == F.col("_by")).filter(share < room * margin * n / F.col("_rows")).drop("_by", "_rows")
    else:
        part = Window.partitionBy(by, F.pmod(F.shiftright(sort, 32), F.lit(64))).orderBy(share, sort, key)
        near = df.withColumn("_place", F.row_number().over(part)).filter(F.col("_place") <= n).drop("_place")
    place = F.row_number().over(Window.partitionBy(by).orderBy(share, sort, key))
    return near.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")
