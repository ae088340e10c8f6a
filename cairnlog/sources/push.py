"""Push requests: streams of (label text, entries) to logs.

JSON requests are decoded by Spark itself; snappy-compressed protobuf by an Arrow-batched decoder, since reading
protobuf in the JVM needs a package that Spark does not carry. What cannot be taken goes to a dead-letter table instead
of failing the batch: a request that does not parse as it came (raw), an entry whose label set does not parse or is
empty with its label text, time and line. A stream without entries gives no row."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import canonical, parse

ENTRY = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("line", T.StringType())])
STREAM = T.StructType([T.StructField("labels", T.StringType()), T.StructField("entries", T.ArrayType(ENTRY))])
#: raw: where Spark's JSON reader puts a record that it can't read.
RAW = "raw"
REQUEST = T.StructType([T.StructField("streams", T.ArrayType(STREAM)), T.StructField(RAW, T.StringType())])


def decode_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """(streams, raw) from a text column of requests; raw is the text of one that does not parse, else null."""
    request = F.from_json(F.col(column), REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW})
    return raw.select(request.alias("request")).select("request.streams", f"request.{RAW}")


def flatten(requests: DataFrame) -> DataFrame:
    """(stream_labels, ts, line, raw, labels, series_key): one row per entry of every stream, and one of raw alone per
    broken request. Label text is parsed once a stream."""
    raw = F.col(RAW) if RAW in requests.columns else F.lit(None).cast("string")
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("labels"), F.array(F.lit(None).cast(ENTRY)).alias("entries")))
    streams = requests.select(raw.alias(RAW), F.explode(F.when(raw.isNotNull(), nothing).otherwise(F.col("streams"))).alias("s"))
    return _labelled(streams.select(F.col("s.labels").alias("stream_labels"), F.col("s.entries").alias("entries"), RAW)).select("*", F.explode("entries").alias("e")).select("stream_labels", "e.ts", "e.line", RAW, "labels", "series_key")


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("labels", parse(F.col("stream_labels"))).withColumn("series_key", canonical(F.col("labels")))


def to_logs(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Logs without ids (the store gives them), and the dead letters (stream_labels, ts, line, raw)."""
    if RAW not in entries.columns:
        entries = entries.withColumn(RAW, F.lit(None).cast("string"))
    parsed = entries if "labels" in entries.columns else _labelled(entries)
    # In one piece: a part on labels alone would go below the entries, and with it a second parsing.
    good = F.coalesce((F.size("labels") > 0) & F.col("ts").isNotNull(), F.lit(False))
    logs = parsed.filter(good).select("series_key", "labels", F.unix_millis("ts").alias("ts_ms"), F.coalesce("line", F.lit("")).alias("line"))
    return logs, parsed.filter(~good).select("stream_labels", "ts", "line", RAW)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _snappy(data: bytes) -> bytes:
    import pyarrow as pa

    size, _ = _varint(data, 0)
    return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True)


def decode_request(data: bytes) -> list[tuple[str, int, str]]:
    """(label text, nanoseconds, line) of every entry of one compressed request.

    Fixed by the wire format: request field 1 is a stream; stream fields are 1 labels, 2 entry; entry fields are
    1 timestamp (1 seconds, 2 nanoseconds), 2 line."""
    rows = []
    for number, stream in _fields(_snappy(data)):
        if number != 1:
            continue
        labels, entries = "", []
        for n, value in _fields(stream):
            if n == 1:
                labels = value.decode()
            elif n == 2:
                seconds = nanos = 0
                line = ""
                for k, v in _fields(value):
                    if k == 1:
                        for j, x in _fields(v):
                            seconds, nanos = (_signed(x), nanos) if j == 1 else (seconds, _signed(x))
                    elif k == 2:
                        line = v.decode()
                entries.append((seconds * 1_000_000_000 + nanos, line))
        rows += [(labels, ns, line) for ns, line in entries]
    return rows


def decode_protobuf(raw: DataFrame, column: str = "value") -> DataFrame:
    """(stream_labels, ts, line, raw) from a binary column of compressed requests; a broken one is a row of raw, in base64."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for data in frame[column]:
                try:
                    rows += [(*r, None) for r in decode_request(bytes(data))]
                except Exception:  # a request that cannot be read goes on as a dead letter
                    rows.append((None, None, None, base64.b64encode(bytes(data or b"")).decode()))
            yield pd.DataFrame(rows, columns=["stream_labels", "ns", "line", RAW]).astype({"ns": "Int64"})

    decoded = raw.select(column).mapInPandas(run, f"stream_labels string, ns long, line string, {RAW} string")
    # Whole-number division: nanoseconds of today are beyond what a double holds.
    return decoded.select("stream_labels", F.timestamp_micros(F.expr("(ns - pmod(ns, 1000)) div 1000")).alias("ts"), "line", RAW)
