import base64
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlog.config import EngineConfig, exponential_ranges
from cairnlog.engine import Engine
from cairnlog.functions import labels, scalars
from cairnlog.operators import blocks, store
from cairnlog.plans.predicate import matches
from cairnlog.plans.temql import Matcher, TemQLSyntaxError, parse
from cairnlog.sources import push
from cairnlog.streaming import ingest


def test_config():
    assert exponential_ranges()[:3] == (20_000, 60_000, 180_000) and len(EngineConfig().ranges_ms) == 10


def test_compaction_groups():
    held = [blocks.Block(0, 0, 10), blocks.Block(1, 10, 20), blocks.Block(2, 50, 60), blocks.Block(3, 90, 100)]
    ids = lambda groups: [[b.block_id for b in g] for g in groups]
    assert ids(blocks.compaction_groups(held, 30)) == [[0, 1], [2], [3]]
    assert ids(blocks.compaction_groups(held, 30, aligned=False)) == [[0, 1, 2], [2, 3], [3]]
    odd = [blocks.Block(0, 0, 5), blocks.Block(1, 1, 100), blocks.Block(2, 6, 9), blocks.Block(3, 1, 100)]
    assert sorted(ids(blocks.compaction_groups(odd, 30))) == [[0, 2], [1], [3]]
    assert ids(blocks.compaction_groups(odd, 30, aligned=False)) == [[0, 1], [2]]
    assert blocks.plan_compaction([], (10, 30)) == []
    assert [b.block_id for b in blocks.plan_compaction(held, (10, 30))] == [0, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 80)), max_size=25), st.integers(1, 90))
def test_every_block_is_in_one_group(spans, size):
    held = [blocks.Block(k, lo, lo + n) for k, (lo, n) in enumerate(spans)]
    groups = blocks.compaction_groups(held, size)
    assert sorted(b.block_id for g in groups for b in g) == list(range(len(held)))
    assert all(len(g) == 1 or max(b.max_ts for b in g) - min(b.min_ts for b in g) <= size for g in groups)


def pushed(*entries, labels='{app="web"}'):
    from datetime import datetime, timedelta

    return {"streams": [{"labels": labels, "entries": [{"ts": datetime(2024, 1, 1) + timedelta(milliseconds=ms), "line": line} for ms, line in entries]}]}


START = 1704067200000


def test_store_pushes_compaction_and_search(spark, tmp_path):
    config = EngineConfig(ranges_ms=(20_000, 60_000, 86_400_000), promoted=("app",))
    e = Engine(spark, store=f"file://{tmp_path}/store", config=config)
    frame = lambda *r: spark.createDataFrame([(x["streams"],) for x in r], push.REQUEST.fieldNames()[0] + " array<struct<labels:string,entries:array<struct<ts:timestamp,line:string>>>>")
    assert e.search("a").count() == 0 and e.store.live() == []
    e.index(frame(pushed((1000, "a b"), (30_000, "c a"))))
    dead = e.index(frame(pushed((25_000, "a late one"), (26_000, "other")), pushed((3000, "b"), labels='{app="db",x="1"}'), pushed((1, "lost"), labels="{}")))
    assert [r.line for r in dead.collect()] == ["lost"]
    assert sorted(r.log_id for r in e.logs().collect()) == [1, 2, 3, 4, 5]
    assert [m.level for m in e.store.live()] == [1, 1]
    want = {"a": ["a b", "a late one", "c a"], "(a and b)": ["a b"], '{app="db"}': ["b"], '(a or other){app!="db"}': ["a b", "a late one", "c a", "other"]}
    before = {q: sorted(r.line for r in e.search(q).collect()) for q in want}
    assert before == want
    # Two blocks of the same day, the older one passed by a newer.
    e.index(frame(pushed((90_000_000, "next day a"))))
    made = e.compact()
    assert [(m.level, m.total, len(m.parents)) for m in made] == [(2, 5, 2)]
    assert {m.block_id for m in e.store.metas()} == {m.block_id for m in e.store.live()} and len(e.store.live()) == 2
    # A range that starts beyond the first block of the merged window.
    assert sorted(r.line for r in e.search("a", START + 25_000, START + 60_000).collect()) == ["a late one", "c a"]
    assert sorted(r.log_id for r in e.logs().collect()) == [1, 2, 3, 4, 5, 6]
    rows = e.search("(a and nosuch)")
    assert rows.count() == 0
    found = {(r.series_key, r.total_count) for r in e.search("nosuch", include_empty=True).collect()}
    assert found == {('{app="web"}', 0), ('{app="db",x="1"}', 0)}
    assert [r.series_key for r in e.series([Matcher("app", "=", "db")]).collect()] == ['{app="db",x="1"}']
    assert {r.name for r in e.label_names().collect()} == {"app", "x"}
    e.delete_series('{app="db"}')
    assert sorted(r.log_id for r in e.logs().collect()) == [1, 2, 4, 5, 6] or len(e.logs().collect()) == 5
    assert e.search('{app="db"}').count() == 0
    assert e.retain() and [r.line for r in e.logs().collect()] == ["next day a"]
    e.index(frame(pushed((90_000_001, "again"))))
    assert sorted(r.log_id for r in e.logs().collect()) == [6, 7]


def test_index_prunes_blocks_and_series(golden, spark, tmp_path):
    e = Engine(spark, store=f"file://{tmp_path}/store", config=EngineConfig(promoted=("app",)))
    for app in ("web", "db"):
        e.store.append(golden.filter(F.col("labels")["app"] == app).drop("log_id"))
    files = lambda df: len(df.inputFiles())
    scan = lambda q, **k: e.store.scan(parse(q), **k)
    assert files(scan("disk")) < files(e.logs()) and sorted(r.line for r in e.search("disk").collect()) == ["disk ok", "error on disk"]
    assert files(scan("(timeout and disk)")) == 0 and files(scan('error{app="web"}')) < files(scan("error"))
    assert sorted(r.line for r in e.search("(timeout and disk)", semantics="series").collect()) == []
    assert files(scan("ok", maxt=3000)) == 0 and files(scan("error", mint=1000)) > 0
    plan = e.search('error{app="web"}')._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lbl_app,web)" in plan
    for q in ("error", "(error and timeout)", "(error or disk)", '{app="db"}', "(timeout or disk and ok)"):
        for kind in ("record", "series"):
            plain = Engine(spark, logs=golden).search(q, semantics=kind)
            assert sorted(r.line for r in e.search(q, semantics=kind).collect()) == sorted(r.line for r in plain.collect())


def test_unknown_version_and_repeated_batch(golden, spark, tmp_path):
    e = Engine(spark, store=f"file://{tmp_path}/store")
    for _ in range(2):
        e.store.append(golden.drop("log_id"), "one")
    assert e.logs().count() == 6 and len(e.store.metas()) == 1
    (tmp_path / "store/blocks/block=x").mkdir()
    (tmp_path / "store/blocks/block=x/m.json").write_text('{"version": 2, "block_id": "x"}')
    with pytest.raises(ValueError, match="version 2"):
        e.logs()


def test_server(golden, spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from cairnlog import server
    from cairnlog.sources import remote

    spool, store = tmp_path / "spool", f"file://{tmp_path}/store"
    e = Engine(spark, store=store)
    s = server.serve(e, str(spool), 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_port}"
    post = lambda path, data: urllib.request.urlopen(urllib.request.Request(url + path, data)).read()
    try:
        assert post("/index", _request([('{app="nginx"}', [(1704067201, 0, "hello one"), (1704067202, 0, "two")])])) == b"ok"
        with pytest.raises(urllib.error.HTTPError) as bad:
            post("/index", b"broken")
        assert json.loads(bad.value.read())["status"] == 400
        ingest.start_ingest(ingest.read_compressed(spark, f"file://{spool}"), store, f"file://{tmp_path}/cp", once=True).awaitTermination(120)
        found = json.loads(urllib.request.urlopen(f"{url}/search?temql=hello&mint=0&maxt=9999999999999&count=10").read())
        assert [x["log"] for x in found[0]["logs"]] == ["hello one"] and found[0]["total_count"] == 1
        assert urllib.request.urlopen(f"{url}/search?temql=").read() == b""
        q = remote.ReadQuery(1704067200000, 1704067210000, (Matcher("app", "=", "nginx"),), 5000)
        (result,) = remote.decode_response(post("/prom/read", remote.encode_read([q])))
        assert result == [({"app": "nginx"}, [(1704067205000, 2.0)])]
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{url}/search?temql=a%20b")
    finally:
        s.shutdown()
        s.server_close()


def test_retention_and_ids(golden):
    assert sorted(r.log_id for r in blocks.retained(golden, 2500).collect()) == [5, 6]
    numbered = blocks.assign_log_ids(golden.drop("log_id"), 1000).orderBy("log_id").collect()
    assert [r.log_id for r in numbered] == [1, 2, 3, 4, 5, 6] and [r.ts_ms for r in numbered] == sorted(r.ts_ms for r in numbered)
    assert sorted(r.log_id for r in blocks.delete_series(golden, ['{app="db"}']).collect()) == [1, 2, 3]


def test_label_text_of_any_length_and_quote(spark):
    long = "x" * 1_000_000
    cases = {
        f'{{a="{long}"}}': {"a": long},
        '{a="' + r"\n" * 300_000 + '"}': {"a": "\n" * 300_000},
        r"""{a='it\'s', b=`raw\n`, c="\x41\u00e9\U0001F600\101\r"}""": {"a": "it's", "b": r"raw\n", "c": "Aé😀A\r"},
        r'{a="\xc3\xa9"}': {"a": "é"},
        '{a="\0"}': {"a": "\0"},
        r'{a="\q"}': None,
        r"""{a="\'"}""": None,
        '{a="1\n2"}': None,
        '{a="x=\\"1\\",y=\\"2\\""}': {"a": 'x="1",y="2"'},
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").coalesce(1)
    for text, r in zip(cases, df.select(labels.parse(F.col("t")).alias("m")).collect(), strict=True):
        assert r.m == cases[text], text[:60]
    tricky = 'a"b\\c\n\t\r\a\b\f\v é😀'
    back = spark.createDataFrame([(tricky,)], "v string").select(labels.unquoted(labels.quoted(F.col("v")))).first()[0]
    assert back == tricky


def test_expressions_and_highlight(spark, golden):
    df = spark.createDataFrame([("a( b $x a",), ("web\n",)], "t string")
    assert df.select(scalars.highlight(F.col("t"), ["a(", "$x"], "<$", "\\>")).first()[0] == "<$a(\\> b <$$x\\> a"
    assert not df.filter("t like 'web%'").select(matches(Matcher("t", "=~", "web"), F.col("t"))).first()[0]
    with pytest.raises(TemQLSyntaxError):
        Engine(spark, logs=golden).search('{app=~"("}')


def test_dead_letters_keep_what_came(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text('{"streams": [broken\n' + json.dumps(REQUESTS[1]) + "\n")
    store, dead = f"file://{tmp_path}/store", f"file://{tmp_path}/dead"
    ingest.start_ingest(ingest.read_requests(spark, f"file://{source}"), store, f"file://{tmp_path}/cp", dead, once=True).awaitTermination(120)
    assert [r.raw for r in spark.read.parquet(dead).collect()] == ['{"streams": [broken']
    # The engine and a stream share a store.
    e = Engine(spark, store=store)
    e.index(spark.createDataFrame([(json.dumps(REQUESTS[0]),)], "value string").transform(push.decode_json))
    assert sorted(r.line for r in e.logs().collect()) == ["a", "b", "c"] and sorted(r.log_id for r in e.logs().collect()) == [1, 2, 3]


def test_labels(spark):
    df = spark.createDataFrame([('{b="x", a="y\\"z\\\\n"}',), ("{}",), ("{a=1}",), ('{a="1",}',), (None,), ('{a="1",a="2"}',)], "t string")
    got = [r[0] for r in df.select(labels.parse(F.col("t"))).collect()]
    assert got == [{"b": "x", "a": 'y"z\\n'}, {}, None, {"a": "1"}, None, {"a": "2"}]
    text = [r[0] for r in df.select(labels.canonical(labels.parse(F.col("t")))).collect()]
    assert text[0] == '{a="y\\"z\\\\n",b="x"}' and text[1] == "{}" and text[3] == '{a="1"}'


@pytest.mark.parametrize("text, want", [("12", 12), ("-3", -3), ("x", 0), ("", 0), ("1.5", 0), (None, 0), ("99999999999999999999", 0)])
def test_str2int64(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(scalars.str2int64(F.col("t"))).first()[0] == want


def test_parse_time(spark):
    df = spark.createDataFrame([("1.5",), ("2024-01-01T00:00:01Z",), ("x",), (None,), ("-2",)], "t string")
    assert [r[0] for r in df.select(scalars.parse_time(F.col("t"))).collect()] == [1500, 1704067201000, None, None, -2000]


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, body):
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _request(streams):
    import pyarrow as pa

    body = b""
    for text, entries in streams:
        s = _field(1, text.encode())
        for seconds, nanos, line in entries:
            ts = _varint(8) + _varint(seconds & (1 << 64) - 1) + _varint(16) + _varint(nanos)
            s += _field(2, _field(1, ts) + _field(2, line.encode()))
        body += _field(1, s)
    return pa.compress(body, codec="snappy", asbytes=True)


def test_protobuf_requests(spark):
    data = _request([('{app="nginx"}', [(1, 500_000_000, "one"), (2, 999_999, "two · three")]), ("{}", [(3, 0, "lost")])])
    raw = spark.createDataFrame([(bytearray(data),), (bytearray(b"\x05broken"),)], "value binary")
    logs, dead = push.to_logs(push.decode_protobuf(raw))
    assert sorted((r.series_key, r.ts_ms, r.line) for r in logs.collect()) == [('{app="nginx"}', 1500, "one"), ('{app="nginx"}', 2000, "two · three")]
    assert sorted(str(r.line) for r in dead.collect()) == ["None", "lost"]
    assert [base64.b64decode(r.raw) for r in dead.collect() if r.raw] == [b"\x05broken"]


REQUESTS = [
    {"streams": [{"labels": '{app="web"}', "entries": [{"ts": "2024-01-01T00:00:01Z", "line": "a"}, {"ts": "2024-01-01T00:00:31Z", "line": "b"}]}, {"labels": "bad", "entries": [{"ts": "2024-01-01T00:00:01Z", "line": "x"}]}]},
    {"streams": [{"labels": '{app="db"}', "entries": []}, {"labels": '{app="db"}', "entries": [{"ts": "2024-01-01T00:01:00Z", "line": "c"}]}]},
]


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, r in enumerate(REQUESTS):
        (source / f"{k}.json").write_text(json.dumps(r) + "\n")
    url = f"file://{source}"
    store, dead = f"file://{tmp_path}/store", f"file://{tmp_path}/dead"
    query = ingest.start_ingest(ingest.read_requests(spark, url, 1), store, f"file://{tmp_path}/cp", dead, once=True)
    query.awaitTermination(120)
    streamed = Engine(spark, store=store).logs()
    batch, lost = push.to_logs(push.flatten(spark.read.schema(push.REQUEST).json(url)))
    key = lambda df: sorted((r.series_key, r.ts_ms, r.line) for r in df.collect())
    assert key(streamed) == key(batch) and len(key(batch)) == 3
    assert streamed.select("log_id").distinct().count() == 3
    assert [r.line for r in spark.read.parquet(dead).collect()] == [r.line for r in lost.collect()] == ["x"]


def test_streaming_counts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text("\n".join(json.dumps(r) for r in REQUESTS))
    entries = push.flatten(ingest.read_requests(spark, f"file://{source}"))
    logs = entries.select(F.col("stream_labels").alias("series_key"), "ts", F.unix_millis("ts").alias("ts_ms"), "line")
    query = ingest.tumbling_counts(logs, "30 seconds").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.series_key, r.window_start_ms % 100_000_000): r.n for r in spark.sql("select * from counts").collect()}
    assert sum(got.values()) == 4 and len(got) == 4


def test_tail(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text("\n".join(json.dumps(r) for r in REQUESTS))
    logs, _ = push.to_logs(push.flatten(ingest.read_requests(spark, f"file://{source}")))
    query = ingest.tail(logs, '(a or c){app=~"web|db"}').writeStream.format("memory").queryName("tailed").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.line for r in spark.sql("select * from tailed").collect()) == ["a", "c"]


def test_streaming_step_counts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text("\n".join(json.dumps(r) for r in REQUESTS))
    entries = push.flatten(ingest.read_requests(spark, f"file://{source}"))
    logs = entries.select(F.col("stream_labels").alias("series_key"), "ts", F.unix_millis("ts").alias("ts_ms"), "line")
    start = 1704067200000
    query = ingest.step_counts(logs, start, 30_000).writeStream.format("memory").queryName("steps").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.series_key, r.bucket_end_ms - start, r.value) for r in spark.sql("select * from steps").collect())
    assert got == [("bad", 30_000, 1.0), ('{app="db"}', 60_000, 1.0), ('{app="web"}', 30_000, 1.0), ('{app="web"}', 60_000, 1.0)]


def test_command_line(golden, spark, tmp_path, capsys):
    from cairnlog.__main__ import main

    store = f"file://{tmp_path}/store"
    Engine(spark, store=store).store.append(golden.drop("log_id"))
    main(["search", store, "error", "--count", "1"])
    assert [x.split("\t")[2] for x in capsys.readouterr().out.splitlines()] == ["3", "1"]
    main(["search", store, '{app="db"}', "--json"])
    assert json.loads(capsys.readouterr().out)["total_count"] == 3
    main(["read", store, '{app="web"}', "--start", "1000", "--end", "6000", "--step", "1000"])
    assert capsys.readouterr().out.split() == ['{app="web"}', "2000", "3.0"]


def test_append_makes_its_input_once_and_compaction_merges_the_index(spark, tmp_path):
    rows = [("web" if k % 3 else "db", 1000 * (k % 7), f"line {k % 5} of w{k % 11}") for k in range(200)]
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    config = EngineConfig(ranges_ms=(20_000, 60_000), promoted=("app",))
    e = Engine(spark, store=f"file://{tmp_path}/store", config=config)
    df = spark.createDataFrame(rows, "app string, ts_ms bigint, line string").repartition(4)
    logs = df.mapInPandas(counted, df.schema).select(F.concat(F.lit('{app="'), "app", F.lit('"}')).alias("series_key"), F.create_map(F.lit("app"), "app").alias("labels"), "ts_ms", "line")
    e.store.append(logs)
    assert seen.value == len(rows)
    # Ids follow (ts_ms, series_key, line), without gaps.
    held = sorted((r.log_id, r.ts_ms, r.series_key, r.line) for r in e.logs().collect())
    assert [r[0] for r in held] == list(range(1, 201)) and [r[1:] for r in held] == sorted((ts, f'{{app="{app}"}}', line) for app, ts, line in rows)
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if list(p.glob("block=*"))) == ["blocks", "logs", "series", "terms"]
    e.store.append(logs.filter("series_key like '%db%'"))
    e.store.append(logs.limit(1).withColumn("ts_ms", F.lit(90_000_000).cast("bigint")))
    of = lambda kind, m: sorted(tuple(r) for r in e.store._read(kind, {"terms": store.TERMS, "series": store.SERIES.replace("labels map<string,string>, ", "")}[kind], [m]).drop("block").collect())
    merged = e.store.compact()
    by_series, postings = e.store._indexed(e.store.logs(held=[merged]))
    assert of("terms", merged) == sorted(tuple(r) for r in postings.collect()) and merged.total == len(held) + sum(app == "db" for app, _, _ in rows)
    assert of("series", merged) == sorted(tuple(r) for r in by_series.select("series_key", "n_logs", "min_ts", "max_ts").collect())
    assert (merged.first_id, merged.last_id) == (1, merged.total)
