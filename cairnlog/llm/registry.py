"""The ten queries of the training-data operators, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, langid, packing, secrets, simhash, tokenfile, topk, toxicity, urlfilter
from .common import table
from .tokens import public_path


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), keep=("doc_id",)).select("doc_id", "held_out", "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("hits").cast("long").alias("n_hits"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_dot_product(q.e, c.e) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
  GROUP BY 1, 2
), ranked AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the rows of pages; a page is taken to be fetched in 2024 at a second given by its id.

    The lists are a dated history made from the hosts by rule: each host is blocked from a day that its MD5 gives, and
    on a later day the entry is removed, or a path of the host allowed."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (F.lit(YEAR_MS) + F.pmod(F.col("page_id") * 7919, F.lit(31536000)) * 1000).alias("fetched"))
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    number = lambda at: F.conv(F.substring(F.md5("host"), at, 3), 16, 10).cast("long")
    day, later, kind = number(1) % 300, number(4) % 60 + 1, number(7) % 3
    since = lambda d: F.lit(YEAR_MS) + d * 86_400_000
    entries = hosts.select(
        F.inline(
            F.array(
                F.struct(F.lit("hosts").alias("list"), F.col("host").alias("key"), F.lit("block").alias("action"), since(day).alias("since")),
                F.struct(F.lit("hosts").alias("list"), F.when(kind == 0, F.concat("host", F.lit("/en"))).otherwise(F.col("host")).alias("key"), F.when(kind == 0, "allow").otherwise("remove").alias("action"), since(day + later).alias("since")),
                F.struct(F.lit("parents").alias("list"), F.regexp_replace("host", r"^[^.]*\.", "").alias("key"), F.when(kind == 1, "block").otherwise("remove").alias("action"), since(F.lit(200) + later).alias("since")),
            )
        )
    )
    return urlfilter.evaluate(captures, entries)


YEAR_MS = 1704067200000

OP9_SQL = r"""
WITH c AS (
  SELECT row_number() OVER () AS n_row, page_id, url, 1704067200000 + ((page_id * 7919) % 31536000) * 1000 AS fetched,
         coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') AS host,
         coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') AS segment
  FROM pages
), h AS (
  SELECT host, CAST('0x' || substr(md5(host), 1, 3) AS BIGINT) % 300 AS d, CAST('0x' || substr(md5(host), 4, 3) AS BIGINT) % 60 + 1 AS l,
         CAST('0x' || substr(md5(host), 7, 3) AS BIGINT) % 3 AS k
  FROM (SELECT DISTINCT host FROM c WHERE host <> '')
), entries AS (
  SELECT 'hosts' AS list, host AS key, 'block' AS action, 1704067200000 + d * 86400000 AS since FROM h
  UNION ALL SELECT 'hosts', CASE WHEN k = 0 THEN host || '/en' ELSE host END, CASE WHEN k = 0 THEN 'allow' ELSE 'remove' END, 1704067200000 + (d + l) * 86400000 FROM h
  UNION ALL SELECT 'parents', regexp_replace(host, '^[^.]*[.]', ''), CASE WHEN k = 1 THEN 'block' ELSE 'remove' END, 1704067200000 + (200 + l) * 86400000 FROM h
), held AS (
  SELECT *, lead(since) OVER (PARTITION BY list, key ORDER BY since, action) AS until FROM entries
), rules AS (
  SELECT * FROM held WHERE action <> 'remove' AND (until IS NULL OR until > since)
), met AS (
  SELECT c.n_row, r.list, r.key, r.action, r.since,
         row_number() OVER (PARTITION BY c.n_row
           ORDER BY contains(r.key, '/') DESC, length(r.key) DESC, (r.action = 'allow') DESC, r.since DESC, r.list DESC) AS n
  FROM c JOIN rules r ON c.fetched >= r.since AND (r.until IS NULL OR c.fetched < r.until)
    AND (c.host = r.key OR ends_with(c.host, '.' || r.key) OR (c.segment <> '' AND r.key = c.host || '/' || c.segment))
)
SELECT c.page_id, c.url, c.fetched, c.host, coalesce(m.action, 'pass') AS verdict, m.list AS rule_list, m.key AS rule_key, m.since AS rule_since
FROM c LEFT JOIN met m ON c.n_row = m.n_row AND m.n = 1
"""


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenfile.encode_and_read(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), end_id=2)
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = (op1_secret_scan, op2_language_id, op3_packing, op4_decontamination, op5_toxicity, op6_simhash, op7_topk, op8_html_text, op9_url_filter, op10_token_file)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op7_topk": OP7_SQL, "op9_url_filter": OP9_SQL}
