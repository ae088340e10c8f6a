import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from cairnlog.engine import Engine
from cairnlog.functions.tokenizers import has_term, register_tokenizer, tokenize
from cairnlog.operators import index, metrics, search
from cairnlog.plans.temql import Both, Matcher, Term, TemQLSyntaxError, parse


def ids(df):
    return sorted(r.log_id for r in df.collect() if r.log_id is not None)


@pytest.mark.parametrize(
    "query, options, expected",
    [
        ("error", {}, [1, 3, 4]),
        ("(error and timeout)", {}, [3]),
        ("(error and timeout)", {"semantics": "series"}, [1, 2, 3]),
        ("(error or disk)", {}, [1, 3, 4, 5]),
        ("(error or disk)", {"semantics": "series"}, [1, 3, 4, 5]),
        ("(timeout or disk and ok)", {}, [2, 3, 5]),
        ('error{app="db"}', {}, [4]),
        ('{app="db"}', {"mint": 2000, "maxt": 3500}, [4, 5]),
        ('{app="nosuch"}', {}, []),
        ('{app!="db"}', {}, [1, 2, 3]),
        ('{app=~"d."}', {}, [4, 5, 6]),
        ('{app=~"d"}', {}, []),
        ('{app!~"w.*"}', {}, [4, 5, 6]),
        ('{nosuch=""}', {}, [1, 2, 3, 4, 5, 6]),
        ('{nosuch!="x"}', {}, [1, 2, 3, 4, 5, 6]),
        ("", {}, []),
        ("erro", {}, []),
        ("Error", {}, [6]),
    ],
)
def test_golden(golden, query, options, expected):
    assert ids(search.search(golden, query, **options)) == expected


def test_limit_and_total(golden):
    rows = search.search(golden, '{app="db"}', count=1).collect()
    assert [(r.log_id, r.total_count) for r in rows] == [(4, 3)]
    rows = search.search(golden, '{app="db"}', count=2, direction="backward").collect()
    assert sorted((r.log_id, r.total_count) for r in rows) == [(5, 3), (6, 3)]


def test_include_empty(golden):
    rows = search.search(golden, '{app="db"}', 1000, 1600, include_empty=True).collect()
    assert [(r.series_key, r.log_id, r.total_count) for r in rows] == [('{app="db"}', None, 0)]


def test_json(golden):
    found = search.as_json(search.search(golden, "error", count=1)).collect()
    web = json.loads(next(r.json for r in found if "web" in r.series_key))
    assert web["total_count"] == 2 and web["logs"] == [{"timestamp": 1000, "id": 1, "log": "error in login"}]


def test_bad_arguments(golden):
    with pytest.raises(TemQLSyntaxError):
        search.search(golden, "(a")
    with pytest.raises(ValueError):
        search.search(golden, "a", direction="up")
    with pytest.raises(ValueError):
        search.search(golden, "a", semantics="block")
    with pytest.raises(ValueError):
        metrics.step_count(golden, 0, 1, 0)


def test_term_facts(golden):
    flat = index.terms(golden).filter("term = 'error' and log_id = 3")
    assert sorted(r.pos for r in flat.collect()) == [1, 4]
    counts = {(r.term, r.log_id): r.freq for r in index.term_freq(golden).collect()}
    assert counts["error", 3] == 2 and counts["error", 1] == 1 and sum(counts.values()) == index.terms(golden).count()
    odd = golden.withColumn("line", F.when(F.col("log_id") == 1, F.lit(None)).when(F.col("log_id") == 2, " .").otherwise(F.col("line")))
    assert {r.log_id for r in index.term_freq(odd).collect()} == {3, 4, 5, 6}
    summary = {r.term: (r.n_series, r.n_lines, r.n_tokens) for r in index.index_summary(odd).collect()}
    assert summary["error"] == (2, 2, 3) and summary["disk"] == (1, 2, 2)


def test_step_counts(golden, spark):
    got = {(r.series_key[6:-2], r.bucket_end_ms): r.value for r in metrics.step_count(golden, 1000, 6000, 1000).collect()}
    assert got == {("web", 2000): 3, ("db", 2000): 1, ("db", 4000): 1, ("db", 6000): 1}
    last = {(r.series_key[6:-2], r.bucket_end_ms) for r in metrics.step_count(golden, 1000, 6000, 1000, True).collect()}
    assert last == {("db", 2000), ("db", 4000)}
    assert [r[0] for r in metrics.step_grid(spark, 1000, 6000, 1000).orderBy("bucket_end_ms").collect()] == [2000, 3000, 4000, 5000, 6000, 7000]


def test_step_count_against_the_loop(spark):
    rng = random.Random(4)
    for start, step in ((0, 7), (100, 13), (-50, 10), (5, 1000)):
        times = sorted(rng.randint(start, start + 300) for _ in range(60))
        logs = spark.createDataFrame([("s", t) for t in times], "series_key string, ts_ms bigint")
        want: dict[int, int] = {}
        edge = start + step
        for t in times:
            while t > edge:
                edge += step
            want[edge] = want.get(edge, 0) + 1
        got = {r.bucket_end_ms: r.value for r in metrics.step_count(logs, start, start + 300, step).collect()}
        assert got == want


def test_random_trees_against_plain_python(spark, golden):
    rng = random.Random(9)
    words = ["error", "timeout", "disk", "on", "ok", "none"]
    lines = [(r.log_id, r.series_key, r.line) for r in golden.collect()]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(words)
        return f"({tree(depth - 1)} {rng.choice(['and', 'or'])} {tree(depth - 1)})"

    def holds(expr, tokens):
        if isinstance(expr, Term):
            return expr.text in tokens
        a, b = holds(expr.left, tokens), holds(expr.right, tokens)
        return a and b if isinstance(expr, Both) else a or b

    for _ in range(12):
        text = tree(3)
        expr = parse(text).expr
        tokens = {i: set(re.findall(r"\w+", line)) for i, _, line in lines}
        assert ids(search.search(golden, text)) == [i for i, _, _ in lines if holds(expr, tokens[i])]
        by_series = {k: set().union(*(tokens[i] for i, _, _ in g)) for k, g in ((k, list(g)) for k, g in itertools.groupby(lines, lambda x: x[1]))}
        from cairnlog.plans.temql import terms

        wanted = [i for i, k, _ in lines if holds(expr, by_series[k]) and tokens[i] & set(terms(expr))]
        assert ids(search.search(golden, text, semantics="series")) == wanted


def test_tokenizers(spark):
    df = spark.createDataFrame([("a-b  c_1 é",), ("",), (None,)], "line string")
    assert [r[0] for r in df.select(tokenize(F.col("line"))).collect()] == [["a", "b", "c_1"], [], None]
    assert [r[0] for r in df.select(tokenize(F.col("line"), "whitespace")).collect()] == [["a-b", "c_1", "é"], [], None]
    register_tokenizer("comma", lambda c: F.split(c, ","))
    assert spark.createDataFrame([("x y, z",)], "line string").filter(has_term(F.col("line"), "x y", "comma")).count() == 1
    with pytest.raises(KeyError):
        tokenize(F.col("line"), "nosuch")


def test_engine(golden, spark, tmp_path):
    e = Engine(spark, logs=golden)
    assert ids(e.search("error", 1500, 6000)) == [3, 4]
    assert {r.series_key: r.n_logs for r in e.series().collect()} == {'{app="web"}': 3, '{app="db"}': 3}
    assert [r.name for r in e.label_names().collect()] == ["app"]
    assert {(r.name, r.value) for r in e.label_values().collect()} == {("app", "web"), ("app", "db")}
    assert e.read([Matcher("app", "=", "web")], 1000, 6000, 1000).collect()[0].value == 3
    with pytest.raises(ValueError):
        Engine(spark)


def test_set_operations(golden):
    assert ids(index.union_of(golden, ["error", "disk"])) == [1, 3, 4, 5]
    assert ids(index.intersection_of(golden, ["error", "timeout"])) == [3]
    assert ids(index.all_of(index.terms(golden), ["error", "timeout"])) == [3]


def test_predicates_reach_the_scan(spark, tmp_path):
    from cairnlog.sources import tables

    plan = search.select(tables.documents(spark, "/root/testdata/sf0.001"), parse('the{lang="en"}'))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "StringContains(text,the)" in plan
    assert "BatchEvalPython" not in plan
    counted = metrics.step_count(tables.events(spark, "/root/testdata/sf0.001"), 0, 10**15, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in counted.split("ReadSchema")[1].split("\n")[0]


def test_postings_shuffle_lines_once(golden):
    golden = golden.unionByName(golden.filter("log_id = 1").withColumns({"log_id": F.lit(7).cast("bigint"), "line": F.lit("--")}))
    want = {}
    for r in golden.collect():
        for at, term in enumerate(re.findall(r"\w+", r.line), 1):
            want.setdefault((term, r.series_key, r.ts_ms // 2000), {}).setdefault((r.ts_ms, r.log_id), []).append(at)
    found = {k: index.postings(golden, 2000, together=k, task_bytes=20) for k in (1 << 20, 28, 0)}
    plans = {k: made._jdf.queryExecution().executedPlan().toString() for k, made in found.items()}
    for made in found.values():
        rows = made.collect()
        assert len(rows) == len(want)
        for r in rows:
            lists = want[r.term, r.series_key, r.chunk]
            assert [(e.ts_ms, e.log_id, e.freq, e.positions) for e in r.entries] == [(*k, len(p), p) for k, p in sorted(lists.items())]
            assert (r.doc_freq, r.min_ts, r.max_ts) == (len(lists), min(lists)[0], max(lists)[0])
    # What is small is shuffled as lines and once; only a large chunk of a series has its terms dealt out.
    dealt = lambda plan, keys: len(re.findall(rf"Exchange hashpartitioning\({keys}", plan))
    assert plans[1 << 20].count(" Exchange ") == 1 == dealt(plans[1 << 20], "series_key")
    assert dealt(plans[28], "term") >= 1 <= dealt(plans[28], "series_key") and dealt(plans[0], "term") >= 1
