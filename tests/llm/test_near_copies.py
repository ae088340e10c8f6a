"""The pipeline's near-duplicates stage against brute-force similarity of five-word shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnlog.llm import nearcopies

SMALL = "/root/testdata/sf0.001"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_kept(rows):
    """Ids that stay of rows (id, text): the least of each group linked at 0.8 or more."""
    sets, up = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for j in range(len(rows)):
        for i in range(j):
            if similarity(sets[i], sets[j]) >= 0.8:
                up[top(j)] = top(i)
    least = {}
    for n, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(n)] = min(least.get(top(n), 1 << 60), doc_id)
    return sorted(set(least.values()))


def kept(spark, rows):
    docs = spark.createDataFrame([(t, i, 7) for i, t in rows], "text string, doc_id bigint, key int")
    out = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert out.columns == docs.columns
    return [r.doc_id for r in out.collect()]


def edited(rng, words, changes):
    out = list(words)
    for k in rng.sample(range(0, len(out), 6), changes):
        out[k] = f"new{rng.random()}"
    return out


def test_near_copies_between_080_and_097(spark):
    rng = random.Random(4)
    rows, seen = [], []
    for k in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(300)]
        copy = edited(rng, base, k % 12)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
        seen.append(similarity(brute_set(rows[-1][1]), brute_set(rows[-2][1])))
    assert sum(0.8 <= s < 0.97 for s in seen) > 20 and sum(0.6 < s < 0.8 for s in seen) > 10
    rows += [(900, None), (901, ""), (902, " \n"), (903, "Two words"), (904, "two  WORDS"), (5, rows[5][1]), (None, rows[3][1]), (None, "alone here now"), (7, "another text of the same id")]
    got = kept(spark, rows)
    assert got.count(None) == 2
    # Where an id is repeated, one of its rows stays as before; sets of ids are compared.
    assert sorted({i for i in got if i is not None}) == brute_kept(rows)


def test_large_group_and_common_passage(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(edited(rng, base, rng.randrange(4)))) for k in range(150)]
    rows += [(500 + k, " ".join(passage + [f"q{rng.randrange(9000)}" for _ in range(rng.randrange(5, 60))])) for k in range(150)]
    rng.shuffle(rows)
    want = brute_kept(rows)
    assert sorted(kept(spark, rows)) == want
    monkeypatch.setattr(nearcopies, "SAMPLE", 20)
    monkeypatch.setattr(nearcopies, "COMMON", 10)
    monkeypatch.setattr(nearcopies, "PART", 30)
    assert sorted(kept(spark, rows)) == want
    assert kept(spark, []) == []


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(6)
    common = np.unique(rng.integers(0, 400, 60)).astype(np.uint64)
    rank = rng.permutation(len(common))
    for _ in range(500):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 200))).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 400, rng.integers(0, 3)).astype(np.uint64)]))
        brute = similarity(set(a.tolist()), set(b.tolist())) >= 0.8
        assert nearcopies.similar(a, b) == brute
        if brute:
            shared = set(nearcopies.prefix(a, common, rank).tolist()) & set(nearcopies.prefix(b, common, rank).tolist())
            assert len(shared) >= max(nearcopies.least_shared(len(a)), nearcopies.least_shared(len(b)))


@pytest.mark.parametrize("part", [0, 7])
def test_last_round_rules_out_no_similar_pair(spark, part):
    """Small and large lists, and lists dealt out as parts, against all pairs."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 60, 150).astype(np.uint64)
    sets, rows = {}, []
    for k in range(130):
        found = np.unique(np.concatenate([base[rng.random(150) > rng.choice([0.03, 0.1, 0.3])], rng.integers(0, 1 << 60, rng.integers(0, 12)).astype(np.uint64)]))
        sets[k] = found
        assert len(nearcopies.parity(found)) == nearcopies.PARITY // 8
        rows += [(s, k, len(found), k % 60, bytearray(nearcopies.parity(found))) for s in ([1] if k < 90 else []) + ([2] if k % 9 == 0 else []) + [100 + k // 3]]
    df = spark.createDataFrame(rows, "shingle long, id long, n int, class long, bits binary")
    got = {(r.a, r.b) for r in nearcopies.not_ruled_out(df, part, True).collect()}
    met = {(a, b) for a in sets for b in sets if a < b and a % 60 != b % 60 and ((a < 90 and b < 90) or (a % 9 == 0 and b % 9 == 0) or a // 3 == b // 3)}
    want = {p for p in met if nearcopies.similar(sets[p[0]], sets[p[1]])}
    assert want <= got <= met and len(want) > 100 and len(got) < len(met)
    # Without every: fewer pairs, and for each class of a list that has a pair the nearest one at least.
    some = nearcopies.not_ruled_out(df, part).collect()
    assert {(r.a, r.b) for r in some} <= got and {r.a % 60 for r in some} | {r.b % 60 for r in some} == {a % 60 for p in got for a in p}
    assert part or len({(r.a, r.b) for r in some}) < len(got)


def test_simhash_links_are_similar(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(30):
        base = [f"w{rng.randrange(4000)}" for _ in range(400)]
        rows += [" ".join(edited(rng, base, k)) for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = nearcopies.sets_of(docs, nearcopies.common_shingles(docs)).withColumn("id", F.col("doc_id")).withColumnRenamed("doc_id", "rep")
    found = nearcopies.simhash_links(sets.select("rep", "key", "id", "fp"), nearcopies.whole_sets(docs, sets.select("rep", "key", "id")))
    pairs = {(r.a, r.b) for r in found.collect()}
    assert len(pairs) > 20 and all(a // 3 == b // 3 for a, b in pairs)


def test_stage_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert sorted(r.doc_id for r in out.select(F.col("doc_id")).collect()) == brute_kept(rows)


def test_every_stage_on_odd_tables(spark):
    """Nulls, repeats, clashing names and an empty table through all stages."""
    rng = random.Random(10)
    text = lambda: " ".join(rng.choice(("the", "and", "house", "with", "from", "there", "night", "morning")) + str(k % 7) * (k % 3 == 0) for k in range(80))
    rows = [(k, text(), ("en", "fr")[k % 2], None, None, 0.5, True, "x", k) for k in range(60)]
    rows += [(None, text(), None, "s", 3, None, None, None, None), (5, text(), "en", "s", 3, 1.0, False, "y", 1), (7, None, "en", None, None, None, None, None, None), (8, "", None, None, 0, 0.1, None, None, None), (9, rows[3][1], "en", None, 1, None, None, None, None)]
    rows += [(100, text() * 400, "en", "long", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean, lang_pred string, key long")
    for table in (docs, docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string"))):
        left = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, left, SMALL)
            assert out.schema.names == docs.schema.names, name
            left = spark.createDataFrame(out.collect(), docs.schema)
        ids = [r.doc_id for r in left.collect()]
        assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
        packed = corpus_pipeline.packing_stage(spark, left, SMALL).collect()
        assert {r.doc_id for r in packed} == set(ids) and all(len(r.ids) == 4 * r.length for r in packed)
        assert bool(ids) == bool(table.count())


def test_language_stage_rejects(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    strange = [(10001, "Это русский текст про погоду и всякое такое " * 5, None), (10002, "这是一个关于天气的中文文本" * 10, None), (10003, "12 34 -- ??", None), (10004, None, None)]
    for labels in (("en", "fr", "de", "es"), ("en", "fr")):
        mixed = docs.withColumn("lang", F.when(F.col("lang").isin(*labels), F.col("lang"))).unionByName(spark.createDataFrame(strange, docs.schema))
        out = {r.doc_id for r in corpus_pipeline.language(spark, mixed, SMALL).collect()}
        assert not out & {10001, 10002, 10003, 10004}
        clean = {r.doc_id for r in docs.filter(F.col("lang").isin(*labels)).collect()}
        assert len(out & clean) >= 0.97 * len(clean)


def test_whole_sets_are_checked_in_the_jvm(spark):
    """The sets of pairs fill no Arrow batches, and the border of 4/5 is exact."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 5000, 120)) for _ in range(6)] + ["one two", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = spark.createDataFrame([(k, nearcopies.key(nearcopies.shingles(t)), k) for k, t in enumerate(texts)], "rep long, key long, id long")
    whole = nearcopies.whole_sets(docs, wanted)
    assert {r.id: (r.shingles, bytes(r.bits)) for r in whole.collect()} == {k: (nearcopies.shingles(t).view(np.int64).tolist(), nearcopies.parity(nearcopies.shingles(t))) for k, t in enumerate(texts)}
    base = rng.integers(0, 1 << 60, 90)
    found = {k: [int(x) for x in base[:n]] for k, n in enumerate((90, 72, 71, 89, 1, 0, 0))} | {7: [int(x) for x in base[10:]] + [5, 6]}
    sets = spark.createDataFrame(list(found.items()), "id long, shingles array<long>")
    pairs = [(a, b) for a in found for b in found if a < b]
    got = nearcopies.checked(spark.createDataFrame(pairs, "a long, b long"), sets)
    want = {(a, b) for a, b in pairs if nearcopies.similar(np.array(sorted(found[a]), np.int64), np.array(sorted(found[b]), np.int64))}
    assert {(r.a, r.b) for r in got.collect()} == want and {(0, 1), (5, 6)} <= want and (0, 2) not in want
    bits = nearcopies.with_bits(wanted.select("id"), whole.select("id", "bits"))
    for plan in (got, bits):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "InArrow" not in text.split("Join", 1)[0]
