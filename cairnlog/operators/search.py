"""Log search: one plan from query to lines, totals and per-series limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.labels import sorted_entries
from ..functions.tokenizers import DEFAULT
from ..plans.predicate import gated, labels_match, line_matches
from ..plans.temql import Query, parse
from .blocks import with_block

RESULT = "series_key string, ts_ms bigint, log_id bigint, line string, total_count bigint"
SEMANTICS = ("record", "series")


def in_range(logs: DataFrame, mint: int | None, maxt: int | None) -> DataFrame:
    """Both ends belong to the range."""
    if mint is not None:
        logs = logs.filter(F.col("ts_ms") >= mint)
    return logs if maxt is None else logs.filter(F.col("ts_ms") <= maxt)


def select(logs: DataFrame, query: Query | None, mint: int | None = None, maxt: int | None = None, semantics: str = "record", tokenizer: str = DEFAULT, scope: tuple[str, ...] = ()) -> DataFrame:
    """The lines that a query selects."""
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}")
    if query is None:
        return logs.filter(F.lit(False))
    rows = in_range(logs.filter(labels_match(query.matchers, logs.columns)), mint, maxt)
    if semantics == "series" and query.expr is not None:
        return gated(rows, query.expr, tokenizer, scope)
    return rows.filter(line_matches(query.expr, F.col("line"), tokenizer))


def search(logs: DataFrame, source: str, mint: int | None = None, maxt: int | None = None, count: int | None = None, direction: str = "forward", semantics: str = "record", include_empty: bool = False, tokenizer: str = DEFAULT, gate_scope: str = "range", block_ms: int = EngineConfig.block_ms, known: DataFrame | None = None) -> DataFrame:
    """Lines of each series in time order, at most ``count`` a series, with the series' total of all hits.

    The total is a pre-aggregated count, the limit a ranked window that Spark also applies before the shuffle; so a
    series with very many hits is never gathered in one task. Series semantics decide over the range as a whole or, with
    gate_scope="block", within each block. With include_empty a series whose labels match but that
    has no hit gives a row without a line and total 0; known: the keys of such series, else taken from all of logs."""
    if direction not in ("forward", "backward"):
        raise ValueError("direction must be forward or backward")
    if gate_scope not in ("range", "block"):
        raise ValueError("gate_scope must be range or block")
    query = parse(source)
    by_block = semantics == "series" and gate_scope == "block"
    hits = select(with_block(logs, block_ms) if by_block else logs, query, mint, maxt, semantics, tokenizer, ("block_start",) if by_block else ()).select("series_key", "ts_ms", "log_id", "line")
    totals = hits.groupBy("series_key").agg(F.count("*").alias("total_count"))
    if count is not None:
        order = (F.asc, F.asc) if direction == "forward" else (F.desc, F.desc)
        place = F.row_number().over(Window.partitionBy("series_key").orderBy(order[0]("ts_ms"), order[1]("log_id")))
        hits = hits.withColumn("_place", place).filter(F.col("_place") <= count).drop("_place")
    found = hits.join(totals, "series_key")
    if include_empty and query is not None:
        if known is None:
            known = logs.filter(labels_match(query.matchers, logs.columns)).select("series_key").distinct()
        found = known.join(found, "series_key", "left").withColumn("total_count", F.coalesce("total_count", F.lit(0).cast("bigint")))
    return found.select("series_key", "ts_ms", "log_id", "line", "total_count")


def ordered(found: DataFrame, direction: str = "forward") -> DataFrame:
    """For presentation: series by key, lines by time."""
    turn = F.asc if direction == "forward" else F.desc
    return found.orderBy("series_key", turn("ts_ms"), turn("log_id"))


def as_json(found: DataFrame) -> DataFrame:
    """One JSON text a series: metric, logs (timestamp, id, log) and total_count, from search()'s limited rows."""
    entry = F.struct(F.col("ts_ms").alias("timestamp"), F.col("log_id").alias("id"), F.col("line").alias("log"))
    logs = F.array_sort(F.collect_list(F.when(F.col("log_id").isNotNull(), entry)))
    grouped = found.groupBy("series_key", "total_count").agg(logs.alias("logs"))
    return grouped.select("series_key", F.to_json(F.struct(F.col("series_key").alias("metric"), "logs", "total_count")).alias("json"))


def series_in_order(logs: DataFrame) -> DataFrame:
    """(series_key, place): label sets in order, compared label by label, fewer labels first on a tie.

    Places go in two levels, by first label and within it, so only the values of the first label meet in one task."""
    known = logs.groupBy("series_key").agg(F.first("labels").alias("labels")).withColumn("e", sorted_entries(F.col("labels")))
    known = known.select("series_key", "e", F.get("e", F.lit(0)).alias("first"))
    sizes = known.groupBy("first").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("first").alias("_first"), F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("first").orderBy("e"))
    placed = known.withColumn("inside", inside).join(before, F.col("first").eqNullSafe(F.col("_first")))
    return placed.select("series_key", (F.col("before") + F.col("inside")).cast("bigint").alias("place"))


def by_ids(logs: DataFrame, ids: DataFrame) -> DataFrame:
    """Lines of the given log ids (column log_id)."""
    return logs.join(ids.select("log_id").distinct(), "log_id", "left_semi").select("log_id", "ts_ms", "line")
