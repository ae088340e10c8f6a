"""The persisted store: immutable blocks of log lines, each with its term and series index, and a table of blocks.

    blocks/block=<id>/    one row of metadata; its arrival makes the block visible, so a half-written block never is
    logs/block=<id>/      the lines, sorted by series and time within files, promoted labels as columns
    terms/block=<id>/     (term, series_key, n_lines, min_ts, max_ts), sorted by term: the postings
    series/block=<id>/    (series_key, labels, n_logs, min_ts, max_ts)

An append writes one block of whatever times its lines have; compaction merges blocks into larger ones of one window and
names its parents, which readers leave out from then on and vacuum() deletes. A search first prunes blocks by their
times, then blocks and series by the label and term index, and only then reads lines.

One writer at a time gives out consecutive log ids from 1: each block notes its first and last. Readers need no lock."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.tokenizers import DEFAULT
from ..plans.predicate import fold, labels_match
from ..plans.temql import Query, terms
from ..storage import delete, exists
from . import blocks, index

VERSION = 1
META = "version int, block_id string, level int, parents array<string>, min_ts bigint, max_ts bigint, total bigint, n_series bigint, first_id bigint, last_id bigint, promoted array<string>"
LOGS = "log_id bigint, series_key string, labels map<string,string>, ts_ms bigint, line string"
TERMS = "term string, series_key string, n_lines bigint, min_ts bigint, max_ts bigint"
SERIES = "series_key string, labels map<string,string>, n_logs bigint, min_ts bigint, max_ts bigint"
LINES = "series_key string, labels map<string,string>, ts_ms bigint, line string"
#: How monotonically_increasing_id() numbers rows: the partition above these bits, the place in it below.
PLACE_BITS = 33
#: Candidate (block, series) pairs up to which they are broadcast against the lines; beyond, blocks alone are pruned.
CANDIDATES = 100_000


@dataclass(frozen=True)
class Meta:
    version: int
    block_id: str
    level: int
    parents: tuple[str, ...]
    min_ts: int
    max_ts: int
    total: int
    n_series: int
    first_id: int
    last_id: int
    promoted: tuple[str, ...] = field(default=())


class Store:
    def __init__(self, spark: SparkSession, path: str, config: EngineConfig = EngineConfig()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    # Blocks

    def metas(self) -> list[Meta]:
        """Every block that is there, parents included: one row a block, the planner's input."""
        if not exists(self.spark, f"{self.path}/blocks"):
            return []
        rows = self.spark.read.schema(META).option("recursiveFileLookup", "true").json(f"{self.path}/blocks").collect()
        for r in rows:
            if r.version != VERSION:
                raise ValueError(f"block {r.block_id} is of version {r.version}, not {VERSION}")
        found = [Meta(**{**r.asDict(), "parents": tuple(r.parents or ()), "promoted": tuple(r.promoted or ())}) for r in rows]
        return sorted(found, key=lambda m: (m.min_ts, m.max_ts, m.block_id))

    def live(self, mint: int | None = None, maxt: int | None = None) -> list[Meta]:
        """The blocks that readers use: no parents of another block, and only those that share a point with the range."""
        held = self.metas()
        gone = {p for m in held for p in m.parents}
        return [m for m in held if m.block_id not in gone and (maxt is None or m.min_ts <= maxt) and (mint is None or m.max_ts >= mint)]

    def _folder(self, kind: str, block_id: str) -> str:
        return f"{self.path}/{kind}/block={block_id}"

    def _read(self, kind: str, schema: str, held: list[Meta]) -> DataFrame:
        """The rows of some blocks, with the column block."""
        if not held:
            return self.spark.createDataFrame([], f"{schema}, block string")
        reader = self.spark.read.schema(f"{schema}, block string").option("basePath", f"{self.path}/{kind}")
        return reader.parquet(*[self._folder(kind, m.block_id) for m in held])

    @staticmethod
    def _indexed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Series and postings of lines."""
        by_series = lines.groupBy("series_key").agg(F.first("labels").alias("labels"), F.count("*").alias("n_logs"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"), F.min("log_id").alias("_lo"), F.max("log_id").alias("_hi"))
        return by_series, index.posting_stats(lines).select("term", "series_key", F.col("doc_freq").alias("n_lines"), "min_ts", "max_ts")

    def _merged(self, held: list[Meta]) -> tuple[DataFrame, DataFrame]:
        """Series and postings of all lines of some blocks, from their own: no line is read."""
        ends = (F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
        series = self._read("series", f"{SERIES}, _lo bigint, _hi bigint", held)
        by_series = series.groupBy("series_key").agg(F.first("labels").alias("labels"), F.sum("n_logs").alias("n_logs"), *ends, F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        return by_series, self._read("terms", TERMS, held).groupBy("term", "series_key").agg(F.sum("n_lines").alias("n_lines"), *ends)

    def _commit(self, by_series: DataFrame, postings: DataFrame, block_id: str, level: int, parents: list[str], last_id: int = 0) -> Meta | None:
        """Write the index of a block whose lines are written and make it visible. last_id: the least to note as given out."""
        by_series.repartitionByRange("series_key").sortWithinPartitions("series_key").write.mode("overwrite").parquet(self._folder("series", block_id))
        known = self.spark.read.parquet(self._folder("series", block_id))
        r = known.agg(F.min("min_ts").alias("lo"), F.max("max_ts").alias("hi"), F.sum("n_logs").alias("n"), F.count("*").alias("s"), F.min("_lo").alias("first"), F.max("_hi").alias("last")).first()
        postings.repartitionByRange("term", "series_key").sortWithinPartitions("term", "series_key").write.mode("overwrite").parquet(self._folder("terms", block_id))
        if r.n is None and not parents:
            return None
        row = (VERSION, block_id, level, parents, r.lo or 0, r.hi if r.hi is not None else -1, r.n or 0, r.s, r.first or 0, max(r.last or 0, last_id), list(self.config.promoted))
        self.spark.createDataFrame([row], META).coalesce(1).write.mode("overwrite").json(self._folder("blocks", block_id))
        return Meta(*row[:3], tuple(parents), *row[4:10], tuple(row[10]))

    def _write_lines(self, rows: DataFrame, block_id: str, laid_out: bool) -> DataFrame:
        """The lines of a block: files of a stretch of time each (as many as Spark's sizes ask for), sorted by series and
        time within; promoted labels get columns of their own, which a filter reaches in the scan."""
        rows = rows.select("log_id", "series_key", "labels", "ts_ms", "line", *[F.col("labels")[n].alias(f"lbl_{n}") for n in self.config.promoted])
        if not laid_out:
            rows = rows.repartitionByRange("ts_ms", "series_key", "log_id")
        folder = self._folder("logs", block_id)
        rows.sortWithinPartitions("series_key", "ts_ms", "log_id").write.mode("overwrite").option("maxRecordsPerFile", self.config.max_records_per_file).parquet(folder)
        return self.spark.read.parquet(folder)

    def append(self, logs: DataFrame, block_id: str | None = None) -> Meta | None:
        """Write lines without ids as one block; None where there are none. A block id that is written again (a batch
        that is run once more) replaces its block and gets the ids it would have got."""
        block_id = block_id or uuid.uuid4().hex
        others = [m for m in self.metas() if m.block_id != block_id]
        first = max([m.last_id for m in others], default=0) + 1
        try:
            lines = self._write_lines(self._numbered(logs, block_id, first), block_id, True)
        finally:
            for kind in ("incoming", "placed"):
                delete(self.spark, self._folder(kind, block_id))
        return self._commit(*self._indexed(lines), block_id, 1, [])

    def _numbered(self, logs: DataFrame, block_id: str, first_id: int) -> DataFrame:
        """Consecutive ids from first_id in order of (ts_ms, series_key, line). What comes in is made once, into a table.
        From there lines are dealt out by sampled ranges of that order, so that neither a hot time nor a hot series meets
        in one task, and written with their places; an id is a place behind the lines of the ranges before."""
        def table(rows: DataFrame, kind: str, schema: str) -> DataFrame:
            rows.write.mode("overwrite").parquet(self._folder(kind, block_id))
            return self.spark.read.schema(schema).parquet(self._folder(kind, block_id))

        order = ("ts_ms", "series_key", "line")
        rows = table(logs.select("series_key", "labels", "ts_ms", "line"), "incoming", LINES)
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        placed = table(rows, "placed", f"{LINES}, _at bigint").withColumn("_part", F.shiftright("_at", PLACE_BITS))
        # One row a task of the write, so small enough for one window and a broadcast.
        ahead = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = placed.groupBy("_part").agg(F.count("*").alias("n")).select(F.col("_part").alias("_p"), (ahead + first_id).alias("_before"))
        placed = placed.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
        return placed.withColumn("log_id", F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1) + F.col("_before"))

    # Reading

    def logs(self, mint: int | None = None, maxt: int | None = None, held: list[Meta] | None = None) -> DataFrame:
        """Lines of the range; only blocks that can have some are listed."""
        held = self.live(mint, maxt) if held is None else held
        names = sorted(set.intersection(*[set(m.promoted) for m in held])) if held else []
        rows = self._read("logs", LOGS + "".join(f", lbl_{n} string" for n in names), held)
        rows = rows if mint is None else rows.filter(F.col("ts_ms") >= mint)
        return rows if maxt is None else rows.filter(F.col("ts_ms") <= maxt)

    def series(self, query: Query | None = None, mint: int | None = None, maxt: int | None = None) -> DataFrame:
        """(series_key, labels, n_logs, min_ts, max_ts) from the series tables; no line is read. A range keeps the series
        of which a block's stretch of time shares a point with it."""
        rows = self._overlap(self._read("series", SERIES, self.live(mint, maxt)), mint, maxt)
        if query is not None:
            rows = rows.filter(labels_match(query.matchers, rows.columns))
        return rows.groupBy("series_key").agg(F.first("labels").alias("labels"), F.sum("n_logs").alias("n_logs"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))

    @staticmethod
    def _overlap(rows: DataFrame, mint: int | None, maxt: int | None) -> DataFrame:
        rows = rows if mint is None else rows.filter(F.col("max_ts") >= mint)
        return rows if maxt is None else rows.filter(F.col("min_ts") <= maxt)

    def candidates(self, query: Query, held: list[Meta], mint: int | None, maxt: int | None, any_term: bool = False) -> DataFrame | None:
        """(block, series_key) in which the index can find a hit; None where the query has nothing to look up.

        A line that holds a tree of terms lies in a block and series whose terms do; where the tree is decided over
        several lines (any_term) only that one of the terms is there counts."""
        found = None
        if query.matchers:
            rows = self._overlap(self._read("series", SERIES, held), mint, maxt)
            found = rows.filter(labels_match(query.matchers, rows.columns)).select("block", "series_key")
        if query.expr is not None:
            wanted = terms(query.expr)
            rows = self._overlap(self._read("terms", TERMS, held).filter(F.col("term").isin(wanted)), mint, maxt)
            if any_term:
                hits = rows.select("block", "series_key").distinct()
            else:
                flags = rows.groupBy("block", "series_key").agg(*[F.max(F.col("term") == t).alias(f"_has{i}") for i, t in enumerate(wanted)])
                hits = flags.filter(fold(query.expr, lambda t: F.col(f"_has{wanted.index(t)}"))).select("block", "series_key")
            found = hits if found is None else hits.join(found, ["block", "series_key"], "left_semi")
        return found

    def scan(self, query: Query | None, mint: int | None = None, maxt: int | None = None, tokenizer: str = DEFAULT, semantics: str = "record") -> DataFrame:
        """Lines among which are all that the query selects: index first, then the blocks and series it leaves."""
        held = self.live(mint, maxt)
        if query is None:
            return self.logs(mint, maxt, [])
        if tokenizer != DEFAULT:
            query = Query(None, query.matchers)
        found = self.candidates(query, held, mint, maxt, semantics == "series")
        if found is None:
            return self.logs(mint, maxt, held)
        found = found.persist()
        try:
            # One row a block at most comes to the driver, as with partition pruning.
            counts = found.groupBy("block").agg(F.count("*").alias("n")).collect()
            total, hit = sum(r.n for r in counts), {r.block for r in counts}
            lines = self.logs(mint, maxt, [m for m in held if m.block_id in hit])
            if not 0 < total <= CANDIDATES:
                return lines
            pairs = self.spark.createDataFrame(found.toPandas(), "block string, series_key string")
            return lines.join(F.broadcast(pairs.withColumnsRenamed({"block": "_b", "series_key": "_k"})), (F.col("block") == F.col("_b")) & (F.col("series_key") == F.col("_k")), "left_semi")
        finally:
            found.unpersist()

    # Upkeep

    def _replace(self, rows: DataFrame, parents: list[Meta], level: int, whole: bool = False) -> Meta | None:
        """whole: the rows are all lines of the parents, so that their index is the parents' put together."""
        block_id = uuid.uuid4().hex
        lines = self._write_lines(rows, block_id, False)
        tables = self._merged(parents) if whole else self._indexed(lines)
        return self._commit(*tables, block_id, level, [m.block_id for m in parents], max(m.last_id for m in parents))

    def compact(self) -> Meta | None:
        """Merge the next group of blocks that the planner names; None where there is none."""
        held = {m.block_id: m for m in self.live() if m.total}
        group = blocks.plan_compaction([blocks.Block(m.block_id, m.min_ts, m.max_ts, m.level) for m in held.values()], self.config.ranges_ms)
        if not group:
            return None
        parents = [held[b.block_id] for b in group]
        return self._replace(self.logs(held=parents), parents, 1 + max(m.level for m in parents), True)

    def vacuum(self) -> list[str]:
        """Delete the blocks that a newer one names as its parents. Metadata goes last and parents before their children,
        so that an interrupted run leaves no block visible again."""
        held = {m.block_id: m for m in self.metas()}
        gone = {p for m in held.values() for p in m.parents if p in held}
        out: list[str] = []
        while gone:
            first = [b for b in sorted(gone) if not gone.intersection(held[b].parents)]
            for block_id in first:
                self._drop(block_id)
            out += first
            gone.difference_update(first)
        return out

    def _drop(self, block_id: str) -> None:
        for kind in ("logs", "terms", "series", "blocks"):
            delete(self.spark, self._folder(kind, block_id))

    def retain(self) -> list[str]:
        """Delete blocks whose newest line is older than the newest of all by more than the retention."""
        held = self.live()
        newest = max((m.max_ts for m in held if m.total), default=0)
        old = [m.block_id for m in held if m.total and m.max_ts < newest - self.config.retention_ms]
        for block_id in old:
            self._drop(block_id)
        return old

    def delete_series(self, query: Query) -> list[Meta]:
        """Rewrite the blocks that hold series of the matchers without them; vacuum() then deletes the old ones."""
        out = []
        for m in self.live():
            known = self._read("series", SERIES, [m])
            if known.filter(labels_match(query.matchers, known.columns)).isEmpty():
                continue
            rows = self.logs(held=[m])
            out.append(self._replace(rows.filter(~labels_match(query.matchers, rows.columns)), [m], m.level))
        return out
