"""Time-partitioned blocks: assignment, metadata, pruning, compaction and retention."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig


def block_start(ts_ms: Column, block_ms: int) -> Column:
    return ts_ms - F.pmod(ts_ms, F.lit(block_ms))


def with_block(logs: DataFrame, block_ms: int = EngineConfig.block_ms) -> DataFrame:
    return logs.withColumn("block_start", block_start(F.col("ts_ms"), block_ms))


def meta(blocked: DataFrame) -> DataFrame:
    """(block_start, min_ts, max_ts, total, n_series)"""
    by_series = blocked.groupBy("block_start", "series_key").agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"), F.count("*").alias("n"))
    return by_series.groupBy("block_start").agg(F.min("lo").alias("min_ts"), F.max("hi").alias("max_ts"), F.sum("n").alias("total"), F.count("*").alias("n_series"))


def stats(blocked: DataFrame) -> DataFrame:
    return blocked.groupBy("block_start").agg(F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"), F.count("*").alias("total"))


def overlapping(blocks: DataFrame, mint: int, maxt: int) -> DataFrame:
    return blocks.filter((F.col("min_ts") <= maxt) & (F.col("max_ts") >= mint))


def log_offsets(blocks: DataFrame, group_ms: int = 86_400_000) -> DataFrame:
    """(block_start, total, log_offset): lines before each block. The running sum goes in two levels, days and blocks of
    a day, so the only unpartitioned window is over days."""
    day = blocks.withColumn("_day", block_start(F.col("block_start"), group_ms))
    totals = day.groupBy("_day").agg(F.sum("total").alias("_n"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("total").over(Window.partitionBy("_day").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return day.withColumn("_inside", inside).join(before, "_day").select("block_start", "total", (F.col("_before") + F.col("_inside")).cast("bigint").alias("log_offset"))


def assign_log_ids(logs: DataFrame, block_ms: int = EngineConfig.block_ms) -> DataFrame:
    """Consecutive ids from 1 in order of (ts_ms, series_key, line): a place within the block plus the block's offset."""
    blocked = with_block(logs, block_ms)
    offsets = log_offsets(stats(blocked)).select("block_start", "log_offset")
    place = F.row_number().over(Window.partitionBy("block_start").orderBy("ts_ms", "series_key", "line"))
    return blocked.withColumn("_place", place).join(offsets, "block_start").withColumn("log_id", F.col("_place") + F.col("log_offset")).drop("_place", "log_offset", "block_start")


def retained(logs: DataFrame, retention_ms: int = EngineConfig.retention_ms) -> DataFrame:
    """Lines not older than the newest one by more than the retention."""
    newest = logs.agg(F.max("ts_ms").alias("newest"))
    return logs.join(F.broadcast(newest), F.col("ts_ms") >= F.col("newest") - retention_ms).drop("newest")  # one row


@dataclass(frozen=True)
class Block:
    block_id: int | str
    min_ts: int
    max_ts: int
    level: int = 1


def compaction_groups(blocks: list[Block], range_ms: int, aligned: bool = True) -> list[list[Block]]:
    """Blocks that one window of range_ms takes together.

    Aligned: windows start at the multiples of range_ms, and a window's group are the blocks that lie in it, both ends
    included; a block that reaches over an end, or is longer, is a group of its own. Every block is in one group.
    Otherwise (compatible form): a window starts at its first block, a block that is not shorter than the range is passed
    over, and the block that does not fit any more closes one group and opens the next, so that it is in both."""
    rest = sorted(blocks, key=lambda b: (b.min_ts, b.max_ts, str(b.block_id)))
    groups: list[list[Block]] = []
    if aligned:
        held: dict[int, list[Block]] = {}
        for b in rest:
            window = b.min_ts // range_ms
            if b.max_ts > (window + 1) * range_ms:
                groups.append([b])
            else:
                held.setdefault(window, []).append(b)
        return sorted([*groups, *held.values()], key=lambda g: (g[0].min_ts, g[0].max_ts, str(g[0].block_id)))
    at = 0
    while at < len(rest):
        end = rest[at].min_ts + range_ms
        fits = next((k for k in range(at, len(rest)) if rest[k].max_ts >= end), len(rest))
        if fits > at:
            groups.append(rest[at : fits + 1])
        at = max(fits, at + 1)
    return groups


def plan_compaction(blocks: list[Block], ranges_ms: tuple[int, ...], aligned: bool = True) -> list[Block]:
    """The first group of two blocks or more, smallest range first, that fills its window or that a newer block has passed."""
    if not blocks:
        return []
    newest = max(b.min_ts for b in blocks)
    for size in ranges_ms[1:]:
        for group in compaction_groups(blocks, size, aligned):
            lo, hi = min(b.min_ts for b in group), max(b.max_ts for b in group)
            if len(group) >= 2 and (hi - lo >= size or hi <= newest):
                return group
    return []


def delete_series(logs: DataFrame, series_keys: list[str]) -> DataFrame:
    """What is left without the series."""
    return logs.filter(~F.col("series_key").isin(series_keys))
