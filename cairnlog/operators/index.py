"""The inverted index as tables: terms, postings and their statistics; series and label catalogues.

The flat terms table (term, series_key, ts_ms, log_id, pos) is the working form. Nested postings are built on request
and by series, since the posting list of a common term is too large for one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokenizers import DEFAULT, tokenize

#: Bytes of a series' lines in a chunk up to which one task makes their postings, and bytes of lines for a task to get.
TOGETHER, TASK = 64 << 20, 8 << 20
#: Larger chunks of series than that are broadcast up to this number; beyond, the terms of all are dealt out.
LARGE = 100_000


def terms(logs: DataFrame, tokenizer: str = DEFAULT) -> DataFrame:
    """One row per token; pos counts from 1 within the line."""
    return logs.select("series_key", "ts_ms", "log_id", F.posexplode(tokenize(F.col("line"), tokenizer)).alias("p", "term")).select("term", "series_key", "ts_ms", "log_id", (F.col("p") + 1).alias("pos"))


def term_freq(logs: DataFrame, tokenizer: str = DEFAULT) -> DataFrame:
    """(term, log_id, freq): how often a term stands in a line, for lines unique by id. Counted within the row, as runs of
    its sorted tokens: no shuffle."""
    rows = logs.select("log_id", F.sort_array(tokenize(F.col("line"), tokenizer)).alias("_s")).filter(F.size("_s") > 0)
    new = lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1))
    rows = rows.withColumn("_at", F.filter(F.sequence(F.lit(0), F.size("_s") - 1), new))
    ends = F.concat(F.slice("_at", 2, F.size("_at")), F.array(F.size("_s")))
    runs = rows.select("log_id", "_s", F.explode(F.arrays_zip(F.col("_at").alias("lo"), ends.alias("hi"))).alias("_r"))
    return runs.select(F.get("_s", F.col("_r.lo")).alias("term"), "log_id", (F.col("_r.hi") - F.col("_r.lo")).cast("bigint").alias("freq"))


def line_terms(logs: DataFrame, tokenizer: str = DEFAULT) -> DataFrame:
    """One row per distinct term of a line with its positions, made within the row: no shuffle."""
    tokens = tokenize(F.col("line"), tokenizer)
    return logs.select("series_key", "ts_ms", "log_id", F.explode(F.array_distinct(tokens)).alias("term"))


def posting_stats(logs: DataFrame, tokenizer: str = DEFAULT) -> DataFrame:
    """(term, series_key, doc_freq, min_ts, max_ts). Lines are unique by id, so lines count without a distinct."""
    return line_terms(logs, tokenizer).groupBy("term", "series_key").agg(F.count("*").alias("doc_freq"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"))


def line_postings(lines: DataFrame, tokenizer: str = DEFAULT) -> DataFrame:
    """One row per distinct term of a line with its positions, beside the line's other columns. Made within the row, as
    runs of its sorted tokens: no shuffle."""
    tokens = F.transform(tokenize(F.col("line"), tokenizer), lambda t, i: F.struct(t.alias("term"), (i + 1).alias("pos")))
    rows = lines.withColumn("_s", F.sort_array(tokens)).drop("line")
    new = lambda i: (i == 0) | (F.get("_s", i)["term"] != F.get("_s", i - 1)["term"])
    rows = rows.withColumn("_at", F.filter(F.transform("_s", lambda _, i: i), new))
    ends = F.concat(F.slice("_at", 2, F.size("_at")), F.array(F.size("_s")))
    run = lambda lo, hi: F.struct(F.get("_s", lo)["term"].alias("term"), F.slice("_s", lo + 1, hi - lo)["pos"].alias("positions"))
    # A line without tokens has an end but no start. To leave it out before would make its tokens twice.
    return rows.select(*[c for c in rows.columns if c not in ("_s", "_at")], F.inline(F.zip_with("_at", ends, run))).filter("term IS NOT NULL")


def postings(logs: DataFrame, chunk_ms: int = 86_400_000, tokenizer: str = DEFAULT, together: int = TOGETHER, task_bytes: int = TASK) -> DataFrame:
    """Nested postings by (term, series, chunk). A chunk is a stretch of time, so a hot term's list in a hot series takes
    many rows, and none grows with the store.

    Lines go to the task of their series and chunk, where all of their lists are made: text is shuffled once, terms never
    are. The terms of a series' chunk of more than together bytes are dealt out instead, so that no task gets all of it."""
    lines = logs.select("series_key", F.expr(f"(ts_ms - pmod(ts_ms, {chunk_ms}L)) div {chunk_ms}L").alias("chunk"), "ts_ms", "log_id", "line")
    sizes = lines.groupBy("series_key", "chunk").agg(F.sum(F.octet_length("line")).alias("_n"))
    r = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count_if(F.col("_n") > together).alias("large")).first()
    parts = -(-r.n // task_bytes)
    # As many tasks as the text needs, by its size and not by the session's settings; Spark puts small ones together.
    deal = lambda rows, *keys: rows.repartition(parts, *keys) if parts > 1 else rows.repartition(*keys)

    def lists(rows: DataFrame) -> DataFrame:
        entry = F.struct("ts_ms", "log_id", F.size("positions").alias("freq"), "positions")
        return rows.groupBy("term", "series_key", "chunk").agg(F.count("*").alias("doc_freq"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"), F.array_sort(F.collect_list(entry)).alias("entries"))

    gathered = lambda rows: lists(line_postings(deal(rows, "series_key", "chunk"), tokenizer))
    dealt_out = lambda rows: lists(deal(line_postings(rows, tokenizer), "term", "series_key", "chunk"))
    if not r.large:
        return gathered(lines)
    if r.large > LARGE:
        return dealt_out(lines)
    large = F.broadcast(sizes.filter(F.col("_n") > together).select("series_key", "chunk"))
    return gathered(lines.join(large, ["series_key", "chunk"], "left_anti")).union(dealt_out(lines.join(large, ["series_key", "chunk"], "left_semi")))


def index_summary(logs: DataFrame, tokenizer: str = DEFAULT) -> DataFrame:
    """(term, n_series, n_lines, n_tokens) over the whole index. A line's sorted tokens tell by themselves which are the
    first of their term, so that lines and tokens are counted by (term, series) at once, on the map side."""
    rows = logs.select("series_key", F.sort_array(tokenize(F.col("line"), tokenizer)).alias("_s"))
    pairs = F.arrays_zip(F.col("_s").alias("term"), F.concat(F.array(F.lit(None).cast("string")), F.col("_s")).alias("last"))
    tokens = rows.select("series_key", F.explode(pairs).alias("_p")).select("series_key", "_p.term", "_p.last").filter("term IS NOT NULL")
    first = F.when(F.col("term").eqNullSafe(F.col("last")), 0).otherwise(1).cast("bigint")
    by_series = tokens.groupBy("term", "series_key").agg(F.sum(first).alias("l"), F.count("*").alias("t"))
    return by_series.groupBy("term").agg(F.count("*").alias("n_series"), F.sum("l").alias("n_lines"), F.sum("t").alias("n_tokens"))


def posting_deltas(logs: DataFrame, chunk_ms: int = 86_400_000, tokenizer: str = DEFAULT) -> DataFrame:
    """Gaps of log id and time between successive lines of a term in a series, chunk by chunk (see postings); the first
    row of a chunk has none."""
    lines = line_terms(logs, tokenizer).withColumn("chunk", F.expr(f"(ts_ms - pmod(ts_ms, {chunk_ms}L)) div {chunk_ms}L"))
    order = Window.partitionBy("term", "series_key", "chunk").orderBy("log_id")
    return lines.select("term", "series_key", "chunk", "log_id", (F.col("log_id") - F.lag("log_id").over(order)).alias("id_gap"), (F.col("ts_ms") - F.lag("ts_ms").over(order)).alias("ts_gap"))


def lines_of(logs: DataFrame, term: str, tokenizer: str = DEFAULT) -> DataFrame:
    """A term's posting list: log ids, ascending by use."""
    from ..functions.tokenizers import has_term

    return logs.filter(has_term(F.col("line"), term, tokenizer)).select("log_id")


def union_of(logs: DataFrame, wanted: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.union(b), (lines_of(logs, t) for t in wanted)).distinct()


def intersection_of(logs: DataFrame, wanted: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), (lines_of(logs, t) for t in wanted))


def all_of(flat: DataFrame, wanted: list[str]) -> DataFrame:
    """Log ids that hold every term, by one grouping of the terms table."""
    rows = flat.filter(F.col("term").isin(wanted))
    return rows.groupBy("log_id").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(set(wanted))).select("log_id")


def term_series(logs: DataFrame, tokenizer: str = DEFAULT) -> DataFrame:
    """(term, n_series, first_key, last_key): the series a term occurs in, in brief."""
    known = line_terms(logs, tokenizer).groupBy("term", "series_key").agg(F.count("*").alias("n"))
    return known.groupBy("term").agg(F.count("*").alias("n_series"), F.min("series_key").alias("first_key"), F.max("series_key").alias("last_key"))


def series_catalog(logs: DataFrame) -> DataFrame:
    """(series_key, n_logs, min_ts, max_ts)"""
    return logs.groupBy("series_key").agg(F.count("*").alias("n_logs"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"))


def series_with_labels(logs: DataFrame) -> DataFrame:
    """(series_key, labels, n_logs, min_ts, max_ts)"""
    return logs.groupBy("series_key").agg(F.first("labels").alias("labels"), F.count("*").alias("n_logs"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"))


def new_series(logs: DataFrame, known: DataFrame) -> DataFrame:
    """Series of logs that the catalogue does not have yet."""
    return logs.select("series_key", "labels").dropDuplicates(["series_key"]).join(known.select("series_key"), "series_key", "left_anti")


def label_values(logs: DataFrame) -> DataFrame:
    """(name, value, n_series): every label value, from the series alone."""
    known = logs.groupBy("series_key").agg(F.first("labels").alias("labels"))
    return known.select(F.explode("labels").alias("name", "value")).groupBy("name", "value").agg(F.count("*").alias("n_series"))


def label_names(logs: DataFrame) -> DataFrame:
    return label_values(logs).select("name").distinct()
