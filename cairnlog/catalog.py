"""Every operator as a query over the given tables, each with the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .engine import Engine
from .functions import labels, scalars
from .functions.tokenizers import tokenize
from .operators import blocks, index, metrics, search
from .plans.predicate import labels_match
from .plans.temql import Matcher, parse
from .sources import push, remote, tables
from .storage import shared_path

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

#: A range of the events' time: 2024-01-05 to 2024-01-20, and a step of a day.
LO, HI, DAY = 1704412800000, 1705708800000, 86_400_000
#: A time before which some series have no line yet.
EARLY = LO - 4 * DAY + 6 * 3_600_000

EV = """ev AS (SELECT event_id AS log_id, '{event_type="' || event_type || '",user_id="' || user_id || '"}' AS series_key, event_type,
  CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ts_ms, event_type || ' user' || user_id || ' ' || props AS line FROM events)"""
DOC = """doc AS (SELECT doc_id AS log_id, '{lang="' || lang || '",source="' || source || '"}' AS series_key, lang, source,
  1704067200000 + doc_id * 1000 AS ts_ms, text AS line FROM documents)"""
TOK = DOC + """, tok AS (SELECT log_id, series_key, ts_ms, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS term,
  unnest(range(1, len(regexp_extract_all(line, '[A-Za-z0-9_]+')) + 1)) AS pos FROM doc)"""
BLK = EV + ", blk AS (SELECT *, ts_ms - ts_ms % 20000 AS block_start FROM ev)"


def has(term: str) -> str:
    return f"list_contains(regexp_extract_all(line, '[A-Za-z0-9_]+'), '{term}')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(tables.events(spark, sf_dir), '(error and user8){event_type="error"}', LO - 4 * DAY, HI + 12 * DAY)


def _searched(source: str, where: str, cte: str = DOC, table: str = "doc", semantics: str = "record", **options) -> tuple[Query, str]:
    """A search over one of the log tables, and the SQL of the same lines with their totals."""
    logs = tables.documents if table == "doc" else tables.events

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(logs(spark, sf_dir), source, semantics=semantics, **options)

    sql = f"WITH {cte} SELECT series_key, ts_ms, log_id, line, count(*) OVER (PARTITION BY series_key) AS total_count FROM {table} WHERE {where}"
    return run, sql


def _gate(condition: str, wanted: tuple[str, ...]) -> str:
    flags = ", ".join(f"max(CASE WHEN {has(t)} THEN 1 ELSE 0 END) AS h_{t}" for t in wanted)
    return f"({' OR '.join(has(t) for t in wanted)}) AND series_key IN (SELECT series_key FROM (SELECT series_key, {flags} FROM doc GROUP BY series_key) WHERE {condition})"


for _name, (_run, _sql) in {
    "label_eq": _searched('{lang="en"}', "lang = 'en'"),
    "label_and": _searched('{lang="en",source="src1"}', "lang = 'en' AND source = 'src1'"),
    "label_neq": _searched('{lang!="en"}', "lang <> 'en'"),
    "label_re": _searched('{source=~"src1[0-4]?"}', "regexp_full_match(source, 'src1[0-4]?')"),
    "label_nre": _searched('{source!~"src1.*"}', "NOT regexp_full_match(source, 'src1.*')"),
    "label_only_search": _searched('{event_type="error"}', "event_type = 'error'", EV, "ev"),
    "label_missing": _searched('{nosuch="x"}', "false"),
    "term_search": _searched("the", has("the")),
    "term_and": _searched("(the and are)", f"{has('the')} AND {has('are')}"),
    "term_or": _searched("(les or das)", f"{has('les')} OR {has('das')}"),
    "term_nested": _searched("((les or das) and (de or die) or from and this)", f"({has('les')} OR {has('das')}) AND ({has('de')} OR {has('die')}) OR {has('from')} AND {has('this')}"),
    "terms_any": _searched("(idiot or moron or token)", f"{has('idiot')} OR {has('moron')} OR {has('token')}"),
    "term_and_label": _searched('(the and with){source="src3"}', f"{has('the')} AND {has('with')} AND source = 'src3'"),
    "term_and_series": _searched("(the and are)", _gate("h_the = 1 AND h_are = 1", ("the", "are")), semantics="series"),
    "term_or_series": _searched("(les or das)", _gate("h_les = 1 OR h_das = 1", ("les", "das")), semantics="series"),
    "time_range": _searched('{event_type=~"click|view"}', f"event_type IN ('click', 'view') AND ts_ms BETWEEN {LO} AND {HI}", EV, "ev", mint=LO, maxt=HI),
    "empty_query": _searched("", "false"),
}.items():
    _queries[_name], _oracles[_name] = _run, _sql


def _limited(order: str) -> str:
    return f"""WITH {EV} SELECT series_key, ts_ms, log_id, line, total_count FROM (SELECT *, count(*) OVER (PARTITION BY series_key) AS total_count,
      row_number() OVER (PARTITION BY series_key ORDER BY ts_ms {order}, log_id {order}) AS n FROM ev WHERE event_type = 'error' AND ts_ms BETWEEN {LO} AND {HI}) WHERE n <= 2"""


@query("flagship", f"""WITH {EV} SELECT series_key, ts_ms, log_id, line, count(*) OVER (PARTITION BY series_key) AS total_count FROM ev
  WHERE event_type = 'error' AND {has('error')} AND {has('user8')} AND ts_ms BETWEEN {LO - 4 * DAY} AND {HI + 12 * DAY}""")  # fmt: skip
def _(spark, d):
    return flagship(spark, d)


@query("search_limit", _limited("ASC"))
def _(spark, d):
    return search.search(tables.events(spark, d), '{event_type="error"}', LO, HI, count=2)


@query("search_backward", _limited("DESC"))
def _(spark, d):
    return search.search(tables.events(spark, d), '{event_type="error"}', LO, HI, count=2, direction="backward")


@query("search_total_count", f"WITH {EV} SELECT series_key, count(*) AS total_count FROM ev WHERE event_type = 'error' AND ts_ms BETWEEN {LO} AND {HI} GROUP BY 1")
def _(spark, d):
    hits = search.select(tables.events(spark, d), parse('{event_type="error"}'), LO, HI)
    return hits.groupBy("series_key").agg(F.count("*").alias("total_count"))


@query("search_include_empty", f"""WITH {EV}, hit AS (SELECT * FROM ev WHERE event_type = 'error' AND ts_ms BETWEEN {LO} AND {LO + DAY})
  SELECT k.series_key, h.ts_ms, h.log_id, h.line, count(h.log_id) OVER (PARTITION BY k.series_key) AS total_count
  FROM (SELECT DISTINCT series_key FROM ev WHERE event_type = 'error') k LEFT JOIN hit h USING (series_key)""")  # fmt: skip
def _(spark, d):
    return search.search(tables.events(spark, d), '{event_type="error"}', LO, LO + DAY, include_empty=True)


@query("search_json", f"""WITH {EV}, l AS (SELECT *, count(*) OVER (PARTITION BY series_key) AS total_count, row_number() OVER (PARTITION BY series_key ORDER BY ts_ms, log_id) AS n
  FROM ev WHERE event_type = 'error' AND ts_ms BETWEEN {LO} AND {HI})
  SELECT series_key, CAST(to_json({{'metric': series_key, 'logs': list({{'timestamp': ts_ms, 'id': log_id, 'log': line}} ORDER BY ts_ms, log_id), 'total_count': total_count}}) AS VARCHAR) AS json
  FROM l WHERE n <= 3 GROUP BY series_key, total_count""")  # fmt: skip
def _(spark, d):
    return search.as_json(search.search(tables.events(spark, d), '{event_type="error"}', LO, HI, count=3))


@query("series_semi_join", f"WITH {EV} SELECT log_id, series_key FROM ev WHERE series_key IN (SELECT series_key FROM ev WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 3)")
def _(spark, d):
    logs = tables.events(spark, d)
    chosen = logs.filter(labels_match((Matcher("event_type", "=", "purchase"),), logs.columns)).groupBy("series_key").count().filter("count >= 3")
    return logs.join(chosen, "series_key", "left_semi").select("log_id", "series_key")


@query("series_ordered", f"WITH {DOC} SELECT series_key, row_number() OVER (ORDER BY lang, source) AS place FROM (SELECT DISTINCT series_key, lang, source FROM doc)")
def _(spark, d):
    return search.series_in_order(tables.documents(spark, d))


@query("fetch_logs_by_id", f"WITH {EV} SELECT log_id, ts_ms, line FROM ev WHERE log_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, d):
    ids = tables.read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("log_id"))
    return search.by_ids(tables.events(spark, d), ids)


@query("step_grid", f"SELECT {LO} + (i + 1) * {DAY} AS bucket_end_ms FROM range(({HI} - {LO}) // {DAY} + 1) t(i)")
def _(spark, d):
    return metrics.step_grid(spark, LO, HI, DAY)


_STEP = f"""WITH {EV}, b AS (SELECT series_key, greatest((ts_ms - {LO} + {DAY} - 1) // {DAY} - 1, 0) AS i FROM ev WHERE ts_ms BETWEEN {LO} AND {HI}),
  c AS (SELECT series_key, i, CAST(count(*) AS DOUBLE) AS value, max(i) OVER (PARTITION BY series_key) AS last FROM b GROUP BY 1, 2)
  SELECT series_key, {LO} + (i + 1) * {DAY} AS bucket_end_ms, value FROM c"""


@query("step_count", _STEP)
def _(spark, d):
    return metrics.step_count(tables.events(spark, d), LO, HI, DAY)


@query("step_count_compat", _STEP + " WHERE i < last")
def _(spark, d):
    return metrics.step_count(tables.events(spark, d), LO, HI, DAY, drop_last=True)


@query("step_count_matchers", _STEP.replace("WHERE ts_ms", "WHERE event_type = 'click' AND ts_ms"))
def _(spark, d):
    return Engine(spark, logs=tables.events(spark, d)).read([Matcher("event_type", "=", "click")], LO, HI, DAY)


@query("tumbling_count", f"WITH {EV} SELECT series_key, ts_ms - ts_ms % 3600000 AS window_start_ms, count(*) AS n FROM ev GROUP BY 1, 2")
def _(spark, d):
    return metrics.tumbling_count(tables.events(spark, d), 3_600_000)


@query("tokenize", f"WITH {DOC} SELECT log_id, len(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS n_tokens, array_to_string(regexp_extract_all(line, '[A-Za-z0-9_]+'), ' ') AS tokens FROM doc")
def _(spark, d):
    terms = tokenize(F.col("line"))
    return tables.documents(spark, d).select("log_id", F.size(terms).cast("bigint").alias("n_tokens"), F.array_join(terms, " ").alias("tokens"))


@query("term_positions", f"WITH {TOK} SELECT term, log_id, pos FROM tok")
def _(spark, d):
    return index.terms(tables.documents(spark, d)).select("term", "log_id", F.col("pos").cast("bigint").alias("pos"))


@query("term_freq", f"WITH {TOK} SELECT term, log_id, count(*) AS freq FROM tok GROUP BY 1, 2")
def _(spark, d):
    return index.term_freq(tables.documents(spark, d))


@query("posting_stats", f"WITH {TOK} SELECT term, series_key, count(DISTINCT log_id) AS doc_freq, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts FROM tok GROUP BY 1, 2")
def _(spark, d):
    return index.posting_stats(tables.documents(spark, d))


@query("inverted_index_summary", f"WITH {TOK} SELECT term, count(DISTINCT series_key) AS n_series, count(DISTINCT log_id) AS n_lines, count(*) AS n_tokens FROM tok GROUP BY 1")
def _(spark, d):
    return index.index_summary(tables.documents(spark, d))


@query("postings", f"""WITH {TOK}, l AS (SELECT term, series_key, log_id, ts_ms // 86400000 AS chunk, count(*) AS freq, array_to_string(list(pos ORDER BY pos), ' ') AS p FROM tok GROUP BY 1, 2, 3, 4)
  SELECT term, series_key, chunk, count(*) AS doc_freq, array_to_string(list(log_id || ':' || freq || ':' || p ORDER BY log_id), ',') AS entries FROM l GROUP BY 1, 2, 3""")  # fmt: skip
def _(spark, d):
    logs = tables.documents(spark, d)
    entry = lambda e: F.concat_ws(":", e["log_id"].cast("string"), e["freq"].cast("string"), F.array_join(e["positions"].cast("array<string>"), " "))
    return index.postings(logs).select("term", "series_key", "chunk", "doc_freq", F.array_join(F.transform("entries", entry), ",").alias("entries"))


@query("posting_deltas", f"""WITH {TOK}, l AS (SELECT DISTINCT term, series_key, ts_ms, log_id, ts_ms // 86400000 AS chunk FROM tok)
  SELECT term, series_key, chunk, log_id, log_id - lag(log_id) OVER w AS id_gap, ts_ms - lag(ts_ms) OVER w AS ts_gap FROM l WINDOW w AS (PARTITION BY term, series_key, chunk ORDER BY log_id)""")  # fmt: skip
def _(spark, d):
    return index.posting_deltas(tables.documents(spark, d))


@query("term_series", f"WITH {TOK} SELECT term, count(DISTINCT series_key) AS n_series, min(series_key) AS first_key, max(series_key) AS last_key FROM tok GROUP BY 1")
def _(spark, d):
    return index.term_series(tables.documents(spark, d))


@query("label_values", f"""WITH {DOC} SELECT name, value, count(DISTINCT series_key) AS n_series FROM
  (SELECT series_key, 'lang' AS name, lang AS value FROM doc UNION ALL SELECT series_key, 'source', source FROM doc) GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    return index.label_values(tables.documents(spark, d))


@query("label_names", "SELECT unnest(['lang', 'source']) AS name")
def _(spark, d):
    return index.label_names(tables.documents(spark, d))


@query("series_catalog", f"WITH {DOC} SELECT series_key, count(*) AS n_logs, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts FROM doc GROUP BY 1")
def _(spark, d):
    return index.series_catalog(tables.documents(spark, d))


@query("series_stats", f"WITH {EV} SELECT series_key, count(*) AS n_logs, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts FROM ev GROUP BY 1")
def _(spark, d):
    return index.series_catalog(tables.events(spark, d))


@query("new_series", f"WITH {EV} SELECT DISTINCT series_key FROM ev WHERE ts_ms > {EARLY} AND series_key NOT IN (SELECT series_key FROM ev WHERE ts_ms <= {EARLY})")
def _(spark, d):
    logs = tables.events(spark, d)
    return index.new_series(logs.filter(F.col("ts_ms") > EARLY), index.series_catalog(logs.filter(F.col("ts_ms") <= EARLY))).select("series_key")


@query("posting_union", f"WITH {DOC} SELECT log_id FROM doc WHERE {has('idiot')} UNION SELECT log_id FROM doc WHERE {has('moron')}")
def _(spark, d):
    return index.union_of(tables.documents(spark, d), ["idiot", "moron"])


@query("posting_intersect", f"WITH {DOC} SELECT log_id FROM doc WHERE {has('the')} INTERSECT SELECT log_id FROM doc WHERE {has('this')}")
def _(spark, d):
    return index.intersection_of(tables.documents(spark, d), ["the", "this"])


@query("term_and_postings", f"WITH {TOK} SELECT log_id FROM tok WHERE term IN ('the', 'are', 'with') GROUP BY 1 HAVING count(DISTINCT term) = 3")
def _(spark, d):
    return index.all_of(index.terms(tables.documents(spark, d)), ["the", "are", "with"])


@query("postings_with_labels", f"""WITH {TOK} SELECT t.term, s.lang, s.source, t.doc_freq FROM (SELECT term, series_key, count(DISTINCT log_id) AS doc_freq FROM tok GROUP BY 1, 2) t
  JOIN (SELECT DISTINCT series_key, lang, source FROM doc) s USING (series_key)""")  # fmt: skip
def _(spark, d):
    logs = tables.documents(spark, d)
    stats = index.posting_stats(logs)
    series = logs.select("series_key", "labels").dropDuplicates(["series_key"])
    return stats.join(series, "series_key").select("term", F.col("labels")["lang"].alias("lang"), F.col("labels")["source"].alias("source"), "doc_freq")


@query("multi_block_union", f"""WITH {EV} SELECT series_key, log_id FROM ev WHERE ts_ms <= {LO} UNION ALL SELECT series_key, log_id FROM ev WHERE ts_ms > {LO} AND ts_ms <= {HI}
  UNION ALL SELECT series_key, log_id FROM ev WHERE ts_ms > {HI}""")  # fmt: skip
def _(spark, d):
    logs = tables.events(spark, d)
    parts = (logs.filter(F.col("ts_ms") <= LO), search.in_range(logs, LO + 1, HI), logs.filter(F.col("ts_ms") > HI))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("series_key", "log_id")


@query("block_assign", f"WITH {BLK} SELECT log_id, block_start FROM blk")
def _(spark, d):
    return blocks.with_block(tables.events(spark, d)).select("log_id", "block_start")


@query("block_meta", f"WITH {BLK} SELECT block_start, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(*) AS total, count(DISTINCT series_key) AS n_series FROM blk GROUP BY 1")
def _(spark, d):
    return blocks.meta(blocks.with_block(tables.events(spark, d)))


@query("block_stats", f"WITH {BLK} SELECT block_start, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(*) AS total FROM blk GROUP BY 1")
def _(spark, d):
    return blocks.stats(blocks.with_block(tables.events(spark, d)))


@query("block_overlap", f"WITH {BLK} SELECT block_start, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(*) AS total FROM blk GROUP BY 1 HAVING min(ts_ms) <= {HI} AND max(ts_ms) >= {LO}")
def _(spark, d):
    return blocks.overlapping(blocks.stats(blocks.with_block(tables.events(spark, d))), LO, HI)


@query("block_log_offset", f"WITH {BLK} SELECT block_start, total, CAST(coalesce(sum(total) OVER (ORDER BY block_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS log_offset FROM (SELECT block_start, count(*) AS total FROM blk GROUP BY 1)")
def _(spark, d):
    return blocks.log_offsets(blocks.stats(blocks.with_block(tables.events(spark, d))))


@query("assign_log_ids", f"WITH {EV} SELECT ts_ms, series_key, line, row_number() OVER (ORDER BY ts_ms, series_key, line) AS log_id FROM ev")
def _(spark, d):
    return blocks.assign_log_ids(tables.events(spark, d).drop("log_id")).select("ts_ms", "series_key", "line", "log_id")


@query("retention", f"WITH {EV} SELECT log_id, ts_ms FROM ev WHERE ts_ms >= (SELECT max(ts_ms) FROM ev) - 43200000")
def _(spark, d):
    return blocks.retained(tables.events(spark, d)).select("log_id", "ts_ms")


def _pushed(logs: DataFrame) -> DataFrame:
    """Push requests as they arrive: a stream for each series and hour, its label text and its entries."""
    entry = F.struct(F.timestamp_millis("ts_ms").alias("ts"), "line")
    streams = logs.groupBy("series_key", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(3_600_000))).alias("hour")).agg(F.collect_list(entry).alias("entries"))
    return streams.select(F.array(F.struct(F.col("series_key").alias("labels"), "entries")).alias("streams"))


def _event_store(spark: SparkSession, d: str, compacted: bool) -> Engine:
    """Events pushed in three parts into a store of their own; the first two are of one window of twenty days, which the
    third one has passed."""
    engine = Engine(spark, store=shared_path(spark, "store"), config=EngineConfig(ranges_ms=(20_000, 20 * DAY, 40 * DAY), promoted=("event_type",)))
    logs = tables.events(spark, d)
    for lo, hi in ((LO - 400 * DAY, LO + 2 * DAY), (LO + 2 * DAY + 1, LO + 12 * DAY), (LO + 12 * DAY + 1, LO + 400 * DAY)):
        engine.index(_pushed(search.in_range(logs, lo, hi)))
    if compacted:
        engine.compact()
    return engine


@query("compact_preserves_rows", f"WITH {EV} SELECT series_key, count(*) AS total, CAST(sum(ts_ms) AS BIGINT) AS ts_sum, count(DISTINCT line) AS texts FROM ev GROUP BY 1")
def _(spark, d):
    logs = _event_store(spark, d, True).logs()
    return logs.groupBy("series_key").agg(F.count("*").alias("total"), F.sum("ts_ms").alias("ts_sum"), F.count_distinct("line").alias("texts"))


@query("store_search", f"""WITH {EV} SELECT series_key, ts_ms, line, count(*) OVER (PARTITION BY series_key) AS total_count FROM ev
  WHERE event_type = 'error' AND {has('user8')} AND ts_ms BETWEEN {LO + 25_000} AND {HI}""")  # fmt: skip
def _(spark, d):
    return _event_store(spark, d, True).search('user8{event_type="error"}', LO + 25_000, HI).drop("log_id")


@query("store_ids_unique", "SELECT count(*) AS n, count(*) AS n_ids, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id FROM events")
def _(spark, d):
    return _event_store(spark, d, False).logs().agg(F.count("*").alias("n"), F.count_distinct("log_id").alias("n_ids"), F.min("log_id").alias("first_id"), F.max("log_id").alias("last_id"))


@query("compaction_lifecycle", f"""WITH {EV} SELECT CAST(2 AS BIGINT) AS n_blocks, CAST(CASE WHEN old THEN 2 ELSE 1 END AS INTEGER) AS level, CAST(CASE WHEN old THEN 2 ELSE 0 END AS INTEGER) AS n_parents,
  count(*) AS total, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(DISTINCT series_key) AS n_series FROM (SELECT *, ts_ms <= {LO + 12 * DAY} AS old FROM ev) GROUP BY old""")  # fmt: skip
def _(spark, d):
    held = _event_store(spark, d, True).store.metas()
    rows = [(len(held), m.level, len(m.parents), m.total, m.min_ts, m.max_ts, m.n_series) for m in held]
    return spark.createDataFrame(rows, "n_blocks bigint, level int, n_parents int, total bigint, min_ts bigint, max_ts bigint, n_series bigint")


@query("store_delete_series", f"WITH {EV} SELECT series_key, count(*) AS total FROM ev WHERE event_type <> 'view' GROUP BY 1")
def _(spark, d):
    engine = _event_store(spark, d, False)
    engine.delete_series('{event_type="view"}')
    return engine.logs().groupBy("series_key").agg(F.count("*").alias("total"))


@query("store_series", f"WITH {EV} SELECT series_key, count(*) AS n_logs, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts FROM ev WHERE event_type = 'click' GROUP BY 1")
def _(spark, d):
    return _event_store(spark, d, False).series([Matcher("event_type", "=", "click")]).drop("labels")


@query("indexed_search", f"""WITH {DOC} SELECT series_key, ts_ms, line, count(*) OVER (PARTITION BY series_key) AS total_count FROM doc
  WHERE ({has('idiot')} OR {has('the')} AND {has('with')}) AND source <> 'src3'""")  # fmt: skip
def _(spark, d):
    engine = Engine(spark, store=shared_path(spark, "store"))
    logs = tables.documents(spark, d)
    for k in range(3):
        engine.store.append(logs.filter(F.pmod("log_id", F.lit(3)) == k).drop("log_id"))
    return engine.search('(idiot or the and with){source!="src3"}').drop("log_id")


@query("remote_read", _STEP.replace("WHERE ts_ms", "WHERE event_type IN ('click', 'view') AND ts_ms"))
def _(spark, d):
    request = remote.encode_read([remote.ReadQuery(LO, HI, (Matcher("event_type", "=~", "click|view"),), DAY)])
    (result,) = remote.decode_response(Engine(spark, logs=tables.events(spark, d)).remote_read(request))
    rows = [(labels_, ms, value) for labels_, samples in result for ms, value in samples]
    return spark.createDataFrame(rows, "labels map<string,string>, bucket_end_ms bigint, value double").select(labels.canonical(F.col("labels")).alias("series_key"), "bucket_end_ms", "value")


@query("labels_escapes", r"""SELECT n_nationkey, '{app="aA' || chr(233) || chr(128512) || '\n",nation="' || n_name || '",q="it''s \"' || n_nationkey || '\""}' AS series_key FROM nation""")
def _(spark, d):
    text = F.format_string(r"""{ app='a\x41é\U0001F600\n', q="it's \"%d\"", nation=`%s`, }""", "n_nationkey", "n_name")
    return tables.read(spark, d, "nation").select("n_nationkey", labels.canonical(labels.parse(text)).alias("series_key"))


@query("dead_letters", """SELECT CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE '{app=' || n_name END AS stream_labels,
  CASE WHEN n_nationkey % 3 = 0 THEN '{"streams": [' || n_name END AS raw FROM nation WHERE n_nationkey % 3 < 2""")  # fmt: skip
def _(spark, d):
    label = F.concat(F.lit("{app="), F.when(F.col("n_nationkey") % 3 == 1, F.col("n_name")).otherwise('"x"}'))
    good = F.to_json(F.struct(F.array(F.struct(label.alias("labels"), F.array(F.struct(F.lit("2024-01-01T00:00:00Z").alias("ts"), F.col("n_name").alias("line"))).alias("entries"))).alias("streams")))
    text = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit('{"streams": ['), "n_name")).otherwise(good)
    return push.to_logs(push.flatten(push.decode_json(tables.read(spark, d, "nation").select(text.alias("value")))))[1].select("stream_labels", "raw")


@query("compaction_groups_overlap", """WITH b AS (SELECT CAST(n_nationkey AS BIGINT) AS block_id, CAST(n_nationkey * 7 AS BIGINT) AS lo, CAST(n_nationkey * 7 + (n_nationkey % 5) * 9 AS BIGINT) AS hi FROM nation),
  w AS (SELECT block_id, CASE WHEN hi > (lo // 30 + 1) * 30 THEN 'b' || block_id ELSE 'w' || (lo // 30) END AS g FROM b)
  SELECT block_id, count(*) OVER (PARTITION BY g) AS size, min(block_id) OVER (PARTITION BY g) AS first_id FROM w""")  # fmt: skip
def _(spark, d):
    rows = tables.read(spark, d, "nation").collect()  # 25 rows of the planner's input
    held = [blocks.Block(r.n_nationkey, r.n_nationkey * 7, r.n_nationkey * 7 + r.n_nationkey % 5 * 9) for r in rows]
    out = [(b.block_id, len(g), min(x.block_id for x in g)) for g in blocks.compaction_groups(held, 30) for b in g]
    return spark.createDataFrame(out, "block_id bigint, size bigint, first_id bigint")


@query("term_and_series_block", f"""WITH {EV}, b AS (SELECT *, ts_ms - ts_ms % {DAY} AS block_start FROM ev), g AS (SELECT series_key, block_start FROM b GROUP BY 1, 2 HAVING bool_or({has('click')}) AND bool_or({has('k')}))
  SELECT series_key, ts_ms, log_id, line, count(*) OVER (PARTITION BY series_key) AS total_count FROM b SEMI JOIN g USING (series_key, block_start) WHERE {has('click')} OR {has('k')}""")  # fmt: skip
def _(spark, d):
    return search.search(tables.events(spark, d), "(click and k)", semantics="series", gate_scope="block", block_ms=DAY)


@query("compaction_groups", f"""WITH {EV}, b AS (SELECT DISTINCT ts_ms - ts_ms % 3600000 AS block_start FROM ev), g AS (SELECT block_start, block_start // 10800000 AS w FROM b)
  SELECT dense_rank() OVER (ORDER BY w) - 1 AS group_no, block_start, count(*) OVER (PARTITION BY w) AS size FROM g""")  # fmt: skip
def _(spark, d):
    rows = blocks.stats(blocks.with_block(tables.events(spark, d), 3_600_000)).collect()  # one row a block: the planner's input
    held = [blocks.Block(r.block_start, r.min_ts, r.max_ts) for r in rows]
    groups = blocks.compaction_groups(held, 10_800_000)
    return spark.createDataFrame([(k, b.block_id, len(g)) for k, g in enumerate(groups) for b in g], "group_no bigint, block_start bigint, size bigint")


@query("delete_series", f"WITH {DOC} SELECT log_id FROM doc WHERE series_key <> '{{lang=\"en\",source=\"src1\"}}'")
def _(spark, d):
    return blocks.delete_series(tables.documents(spark, d), ['{lang="en",source="src1"}']).select("log_id")


@query("flatten_streams", f"WITH {EV} SELECT series_key, ts_ms, line FROM ev")
def _(spark, d):
    logs = tables.events(spark, d)
    return push.to_logs(push.flatten(_pushed(logs)))[0].select("series_key", "ts_ms", "line")


@query("decode_push_json", "SELECT '{app=\"db\",host=\"' || n_name || '\"}' AS series_key, 1704067200000 + CAST(n_nationkey AS BIGINT) AS ts_ms, 'hello ' || n_name AS line FROM nation")
def _(spark, d):
    ts = F.date_format(F.timestamp_millis(F.lit(tables.START_MS) + F.col("n_nationkey")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit('{host="'), F.col("n_name"), F.lit('", app="db"}')).alias("labels"), F.array(F.struct(ts.alias("ts"), F.concat(F.lit("hello "), "n_name").alias("line"))).alias("entries"))).alias("streams")))
    raw = tables.read(spark, d, "nation").select(text.alias("value"))
    return push.to_logs(push.flatten(push.decode_json(raw)))[0].select("series_key", "ts_ms", "line")


@query("labels_string", f"WITH {DOC} SELECT log_id, series_key AS text FROM doc")
def _(spark, d):
    return tables.documents(spark, d).select("log_id", labels.canonical(F.col("labels")).alias("text"))


@query("labels_canonical", "SELECT DISTINCT '{priority=\"' || o_orderpriority || '\",status=\"' || o_orderstatus || '\"}' AS series_key FROM orders")
def _(spark, d):
    texts = tables.read(spark, d, "orders").select(F.concat(F.lit('{ status = "'), "o_orderstatus", F.lit('", priority="'), "o_orderpriority", F.lit('", }')).alias("t")).distinct()
    return texts.select(labels.canonical(labels.parse(F.col("t"))).alias("series_key")).distinct()


@query("labels_serialized", f"WITH {DOC} SELECT DISTINCT 'lang|' || lang || '|source|' || source AS text FROM doc")
def _(spark, d):
    return tables.documents(spark, d).select(labels.serialised(F.col("labels"), "|").alias("text")).distinct()


@query("sanitize_label_name", "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g') AS name FROM pages")
def _(spark, d):
    return tables.read(spark, d, "pages").select("page_id", scalars.sanitize_label_name(F.col("url")).alias("name"))


@query("ts_to_ms", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def _(spark, d):
    return tables.read(spark, d, "events").select("event_id", scalars.ts_to_ms(F.col("ts")).alias("ms"))


@query("str2int64", "SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT), 0) AS n, CAST(0 AS BIGINT) AS bad FROM events")
def _(spark, d):
    df = tables.read(spark, d, "events")
    return df.select("event_id", scalars.str2int64(F.regexp_extract("props", "(-?[0-9]+)", 1)).alias("n"), scalars.str2int64(F.col("event_type")).alias("bad"))


@query("parse_time", "SELECT event_id, event_id * 1000 + 250 AS seconds, epoch_us(date_trunc('second', ts)) // 1000 AS dated, CAST(NULL AS BIGINT) AS bad FROM events")
def _(spark, d):
    df = tables.read(spark, d, "events")
    rfc = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return df.select("event_id", scalars.parse_time(F.concat(F.col("event_id").cast("string"), F.lit(".25"))).alias("seconds"), scalars.parse_time(rfc).alias("dated"), scalars.parse_time(F.col("event_type")).alias("bad"))


@query("valid_timestamp", "SELECT event_id, (event_id * 1000000000000 - 63000000000000 BETWEEN -62135596800000 AND 253402300799999) AS ok FROM events")
def _(spark, d):
    return tables.read(spark, d, "events").select("event_id", scalars.valid_timestamp(F.col("event_id") * 1_000_000_000_000 - 63_000_000_000_000).alias("ok"))


@query("format_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")
def _(spark, d):
    return tables.read(spark, d, "events").select("event_id", scalars.format_time(scalars.ts_to_ms(F.col("ts"))).alias("text"))


@query("highlight", f"WITH {EV} SELECT log_id, regexp_replace(line, '\\b(error|user8)\\b', '<em>\\1</em>', 'g') AS line FROM ev")
def _(spark, d):
    return tables.events(spark, d).select("log_id", scalars.highlight(F.col("line"), ["error", "user8"]).alias("line"))


@query("expr_link", "SELECT n_nationkey, '/graph?g0.expr=%7Bnation%3D%22' || replace(n_name, ' ', '+') || '%22%7D&g0.tab=0' AS link FROM nation")
def _(spark, d):
    return tables.read(spark, d, "nation").select("n_nationkey", scalars.expr_link(F.concat(F.lit('{nation="'), "n_name", F.lit('"}')), 0).alias("link"))


@query("interval_overlap", f"SELECT event_id, (epoch_us(ts) // 1000 <= {HI} AND {LO} <= epoch_us(ts) // 1000 + {DAY}) AS ok FROM events")
def _(spark, d):
    ms = scalars.ts_to_ms(F.col("ts"))
    return tables.read(spark, d, "events").select("event_id", scalars.overlaps(ms, ms + DAY, F.lit(LO), F.lit(HI)).alias("ok"))


@query("conversation_search", """SELECT '{role="' || role || '"}' AS series_key, 1704067200000 + conv_id * 60000 + turn * 1000 AS ts_ms, conv_id * 1000 + turn AS log_id, text AS line,
  count(*) OVER (PARTITION BY role) AS total_count FROM conversations WHERE role = 'user' AND list_contains(regexp_extract_all(text, '[A-Za-z0-9_]+'), 'the')""")  # fmt: skip
def _(spark, d):
    return search.search(tables.conversations(spark, d), 'the{role="user"}')


@query("page_hosts", "SELECT '{host=\"' || regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) || '\"}' AS series_key, count(*) AS n_logs, min(1704067200000 + page_id * 1000) AS min_ts, max(1704067200000 + page_id * 1000) AS max_ts FROM pages GROUP BY 1")
def _(spark, d):
    return index.series_catalog(tables.pages(spark, d))


@query("order_search", "SELECT '{priority=\"' || o_orderpriority || '\",status=\"' || o_orderstatus || '\"}' AS series_key, count(*) AS total_count FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus <> 'F' GROUP BY 1")
def _(spark, d):
    hits = search.select(tables.orders(spark, d), parse('SPECIFIED{priority="4-NOT SPECIFIED",status!="F"}'))
    return hits.groupBy("series_key").agg(F.count("*").alias("total_count"))
