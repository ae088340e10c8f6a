"""Where intermediate stores go: the folder that spark.checkpoint.dir names, which all executors and the driver share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; a temporary folder only on a local master that names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held, master = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext.master
        if not held.isDefined() and not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = held.get() if held.isDefined() else "file://" + os.path.join(tempfile.gettempdir(), "cairnlog")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
