"""URL filters: a temporal join of captures with dated lists.

A list entry is a change: from its date on, key has the action (``block``, ``allow`` or ``remove``) in that list. The
next change of the same list and key ends it, so dated entries become validity intervals [since, until). A key is a
host, which covers its subdomains, or host/segment, which covers the URLs of that host below the first path segment.

A capture is joined as of its fetch time: it asks for every key that covers it, and of the entries active then the most
specific one decides (host/segment before host, a longer host before a shorter), on a tie ``allow`` before ``block``,
then the later entry, then the list's name. Intervals and captures meet on (key, time bucket), so one much-captured
host is spread over its buckets, and adaptive execution splits what is left.

Defined results: a URL that is null or has no host matches nothing and passes, as does a null fetch time; repeated
captures each get a row, an empty table none; very long URLs are read whole; other columns are not read; entries with a null list, key, action or date are ignored; changes of one list
and key at one instant count by their action's order allow, block, remove, the last one holding; no entries, all pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scheme, optional user, host: fixed by the URL syntax.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
SEGMENT = r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)"
BUCKET_MS = 30 * 86_400_000


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), HOST, 1)


def segment_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), SEGMENT, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action, since, until) of every entry that puts something in force; until is null while it lasts."""
    known = entries.select("list", F.lower("key").alias("key"), "action", "since").dropna()
    order = Window.partitionBy("list", "key").orderBy("since", "action")
    held = known.withColumn("until", F.lead("since").over(order))
    return held.filter((F.col("action") != "remove") & (F.col("until").isNull() | (F.col("until") > F.col("since"))))


def keys_of(host: Column, segment: Column) -> Column:
    """Every key that covers a URL: the host, its parent domains, and the host with the first path segment."""
    parts = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.when(segment == "", parents).otherwise(F.array_append(parents, F.concat(host, F.lit("/"), segment))))


def evaluate(captures: DataFrame, entries: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(page_id, url, fetched, host, verdict, rule_list, rule_key, rule_since) for captures (page_id, url, fetched)."""
    # Each capture is a row of its own, repeated or not; its number is that of its place in its partition.
    c = captures.select("page_id", "url", "fetched", F.monotonically_increasing_id().alias("_row")).withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    asked = c.withColumn("key", F.explode_outer(keys_of(F.col("host"), F.coalesce(segment_of(F.col("url")), F.lit(""))))).withColumn("bucket", F.floor(F.col("fetched") / bucket_ms))
    span = c.agg(F.min("fetched").alias("lo"), F.max("fetched").alias("hi")).first()
    lo, hi = span.lo or 0, span.hi or 0
    active = intervals(entries).filter((F.col("since") <= hi) & (F.coalesce("until", F.lit(hi + 1)) > lo))
    first = F.floor(F.greatest("since", F.lit(lo)) / bucket_ms)
    last = F.floor(F.least(F.coalesce(F.col("until") - 1, F.lit(hi)), F.lit(hi)) / bucket_ms)
    rules = active.select(F.col("list"), F.col("key").alias("_key"), "action", "since", "until", F.explode(F.sequence(first, last)).alias("_bucket"))
    met = asked.join(rules, (F.col("key") == F.col("_key")) & (F.col("bucket") == F.col("_bucket")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))), "left")
    rule = F.when(F.col("_key").isNotNull(), F.struct(F.contains(F.col("_key"), F.lit("/")).alias("path"), F.length("_key").alias("size"), (F.col("action") == "allow").alias("allow"), "since", F.col("list"), F.col("_key").alias("key"), "action"))
    best = met.groupBy("_row", "page_id", "url", "fetched", "host").agg(F.max(rule).alias("rule"))
    return best.select(
        "page_id", "url", "fetched", "host", F.coalesce(F.col("rule.action"), F.lit("pass")).alias("verdict"), F.col("rule.list").alias("rule_list"), F.col("rule.key").alias("rule_key"), F.col("rule.since").alias("rule_since")
    )
