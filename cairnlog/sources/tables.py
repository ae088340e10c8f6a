"""Tables as logs: (log_id, series_key, labels, ts_ms, line), the label columns kept as lbl_<name> for pushdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import quoted
from ..functions.scalars import ts_to_ms

#: Start of the synthetic clock of tables that have no time of their own.
START_MS = 1704067200000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_logs(df: DataFrame, log_id: Column, labels: dict[str, Column], ts_ms: Column, line: Column) -> DataFrame:
    """labels: by name; the series key is written from the columns themselves, without going through the map."""
    names = sorted(labels)
    texts = {n: labels[n].cast("string") for n in names}
    key = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f"{n}="), quoted(texts[n])) for n in names]), F.lit("}"))
    return df.select(
        log_id.cast("bigint").alias("log_id"), key.alias("series_key"), F.create_map(*[x for n in names for x in (F.lit(n), texts[n])]).alias("labels"), ts_ms.cast("bigint").alias("ts_ms"), line.alias("line"), *[texts[n].alias(f"lbl_{n}") for n in names]
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    line = F.concat_ws(" ", "event_type", F.concat(F.lit("user"), F.col("user_id").cast("string")), "props")
    return as_logs(df, F.col("event_id"), {"event_type": F.col("event_type"), "user_id": F.col("user_id")}, ts_to_ms(F.col("ts")), line)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents")
    return as_logs(df, F.col("doc_id"), {"lang": F.col("lang"), "source": F.col("source")}, F.lit(START_MS) + F.col("doc_id") * 1000, F.col("text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations")
    return as_logs(df, F.col("conv_id") * 1000 + F.col("turn"), {"role": F.col("role")}, F.lit(START_MS) + F.col("conv_id") * 60000 + F.col("turn") * 1000, F.col("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return as_logs(df, F.col("page_id"), {"host": host}, F.lit(START_MS) + F.col("page_id") * 1000, F.col("html"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders")
    return as_logs(df, F.col("o_orderkey"), {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")}, ts_to_ms(F.col("o_orderdate")), F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
