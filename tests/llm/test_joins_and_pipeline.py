"""Near-duplicates, components and exact search against brute force; the pipeline stage by stage."""

import math
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairnlog.llm import registry, simhash, topk
from cairnlog.llm.components import components

SMALL = "/root/testdata/sf0.001"


def brute_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingle_set(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("text", ["", None, "One", "one two", "A b c", "É a\xa0b c d e", "x y " * 500, "a\x0bb\tc\nd\r\x0ce f", "\x1ca b c"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def clustered(rng, centres, each):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for k in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << k
            out.add(x)
    return sorted(out)


def test_trie_join():
    rng = random.Random(1)
    v = np.array(clustered(rng, 40, 25), np.uint64)
    whole = np.array([[0, len(v)]])
    for budget, room in ((0, 1 << 18), (1, 100), (3, 1 << 18), (3, 50)):
        a, b = simhash.trie_pairs(v, whole, whole, 0, budget, room)
        want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= budget}
        got = sorted((min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True))
        assert got == sorted(want)


@pytest.mark.parametrize("held", [512, 3])
def test_links_and_components(spark, held):
    rng = random.Random(held)
    v = clustered(rng, 25, 30)
    signed = [x - (1 << 64) if x >> 63 else x for x in v]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    links = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    want = brute_components(signed, links)
    got = {r.node: r.root for r in components(simhash.links(df, 3, held)).collect()}
    assert got == {n: r for n, r in want.items() if any(n in x for x in links)}


@pytest.mark.parametrize("held", [400_000, 40])
def test_components_of_long_chains(spark, monkeypatch, held):
    from cairnlog.llm import components as module

    monkeypatch.setattr(module, "HELD", held)
    rng = random.Random(2)
    order = list(range(200))
    rng.shuffle(order)
    edges = list(zip(order[:150], order[1:151], strict=True)) + [(500, 501), (501, 500), (7000, 7000)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{n: min(order[:151]) for n in order[:151]}, 500: 500, 501: 500}
    assert components(df.limit(0)).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(500)]
    rows = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(300)]
        for c in range(rng.randint(1, 4)):
            copy = list(base)
            copy[rng.randrange(300)] = rng.choice(words)
            rows.append((len(rows), " ".join(copy if c else base)))
    rows += [(900, None), (901, ""), (902, " \n"), (5, rows[5][1]), (None, rows[3][1]), (None, "alone here now")]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id bigint, text string, fp int, component_id string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    nodes = list(range(len(rows)))
    same = [(i, j) for i in nodes for j in nodes[i + 1 :] if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = brute_components(nodes, same)
    least = {}
    for n, r in root.items():
        if rows[n][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[n][0])
    want = sorted((str(rows[n][0]), fps[n], str(least.get(root[n]))) for n in nodes)
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in got) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values())) and ids.count(None) == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def brute_top(rows, k=5, every=50):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        best = {}
        for i, a in usable:
            for j, b in usable:
                if i == q and j != q and len(a) == len(b):
                    best[j] = max(best.get(j, -topk.LONG), min(topk.LONG, sum(x * y for x, y in zip(a, b, strict=True))))
        out += [(q, n, j, s) for n, (s, j) in enumerate(sorted(((s, j) for j, s in best.items()), key=lambda x: (-x[0], x[1]))[:k], 1)]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_top_k(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(0, 0.2, 8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(60)]  # many equal vectors
    rows += [(2000, None), (2050, []), (2100, [float("nan")] * 8), (2150, [1.0, None] * 4), (2200, [float("inf")] * 8), (None, [0.0] * 8), (2250, [0.5] * 3), (2251, [0.25] * 3), (50, rows[50][1]), (51, rng.normal(0, 0.5, 8).tolist()), (2300, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, rank int, pivot int")
    want = brute_top(rows)
    for s in (topk.Settings(), topk.Settings(pivots=3, sample=10, annulus=16, shard=4, part=3, near=1, metas=4)):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, s).collect())
        assert got == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    """Sums beyond 2^53 and 2^63 stay exact."""
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.choice([1.2e6, 2.3e6, -1.7e6], 8) + rng.integers(0, 9, 8) / 256).tolist()) for i in range(120)]
    rows += [(200 + i, (rng.normal(0, 1e9, 8)).tolist()) for i in range(30)] + [(250 + i, [1e200] * 8) for i in range(3)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), topk.Settings(annulus=16, pivots=4)).collect())
    assert got == brute_top(rows)


def test_top_k_prunes_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, (centres[i * 7 % 40] + rng.normal(0, 0.03, 16)).tolist()) for i in range(6000)]
    seen = spark.sparkContext.accumulator(0)
    s = topk.Settings(annulus=32, shard=16)
    found = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), s, seen).collect()
    x = np.floor(256 * np.array([v for _, v in rows]))
    every = x[::50] @ x.T
    for r in found:
        assert every[r.query_id // 50, r.vec_id] == r.score
    every[np.arange(len(every)), np.arange(0, 6000, 50)] = -np.inf
    want = np.sort(every, 1)[:, ::-1][:, :5]
    assert all(want[r.query_id // 50, r["rank"] - 1] == r.score for r in found) and len(found) == 5 * len(every)
    share = seen.value / (len(every) * 6000 / s.annulus)
    assert share < 0.25, share


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    rows = registry.queries()[name](spark, SMALL)
    names = sorted(rows.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    assert sorted(repr([r[c] for c in names]) for r in rows.collect()) == sorted(repr([r[i] for i in at]) for r in rel.fetchall())


def test_ten_queries_and_the_pipeline():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert [n for n in found if n.startswith("op")] == sorted((n for n in found if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len([n for n in found if n.startswith("op")]) == 10 and "pipeline" in found


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    def step(name, rows):
        out = stages[name](spark, rows, SMALL)
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    labelled = step("language_id", docs)
    assert labelled.columns == docs.columns and labelled.count() >= 0.95 * docs.count()
    one = step("near_duplicates", labelled)
    ids = {r.doc_id for r in one.collect()}
    # The stage links five-word shingle sets of a similarity of 0.8 or more; op6's three bits are of op6's contract alone.
    sets = [(r.doc_id, shingle_set(r.text)) for r in labelled.collect()]
    near = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if 5 * len(x & y) >= 4 * len(x | y)]
    assert ids == set(brute_components([i for i, _ in sets], near).values())
    clean = step("decontamination", one)
    items = [" ".join(r.text.split()).lower() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = {r.doc_id: " ".join(r.text.split()).lower() for r in one.collect()}
    left = {r.doc_id for r in clean.collect()}
    assert left <= ids and not any(i in left for i, t in texts.items() if any(x in t for x in items))
    assert len(ids - left) <= sum(any(x[:40] in t for x in items) for t in texts.values()) + 2
    hidden = step("secret_scan", clean)
    assert hidden.count() == clean.count() and hidden.filter(F.col("text").rlike('token = "[0-9a-f]{20}')).count() == 0
    packed = step("packing", hidden)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left
    assert corpus_pipeline.run(spark, SMALL).count() == packed.count()


def test_hash_sample(spark, monkeypatch):
    from cairnlog.llm import common

    rows = [(k, "hot" if k % 3 else f"g{k % 30}") for k in range(3000)] + [(None, "hot"), (5, None)]
    df = spark.createDataFrame(rows, "id bigint, g string")
    found = []
    for limit in (200_000, 0):
        monkeypatch.setattr(common, "BROADCAST_GROUPS", limit)
        got = [tuple(r) for r in common.hash_sample(df, "id", 7, by="g").collect()]
        sizes = {g: sum(1 for _, x in got if x == g) for _, g in got}
        assert all(n == 7 for g, n in sizes.items() if g) and len([g for g in sizes if g]) == 11
        found.append(sorted((x for x in got if x[1]), key=repr))
    assert found[0] == found[1]
    one = [r.id for r in common.hash_sample(df, "id", 20).collect()]
    assert len(one) == 20 and one == [r.id for r in df.selectExpr("id", "xxhash64(id) h", "pmod(xxhash64(id), 1073741824) s").orderBy("s", "h", "id").limit(20).collect()]
