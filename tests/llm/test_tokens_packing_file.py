"""Token ids against the library's own, packing against its rules, token shards as exact round trips."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairnlog.llm import packing, tokenfile
from cairnlog.llm.tokens import CachedTokenizer, public_path

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ROWS = [(3, "Hello world, again"), (1, None), (2, ""), (7, "word " * 3000), (7, "word " * 3000), (None, "no id"), (5, "a"), (9, "été\n\nÜber  spaces\t<|endoftext|> x"), (8, "x" * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1, 2) for i, t in ROWS], "doc_id bigint, text string, lang string, start int, tier int").repartition(2)


@pytest.mark.parametrize("name", FILES)
def test_ids_as_the_library_gives_them(name):
    tok = CachedTokenizer(public_path(name))
    rng = random.Random(5)
    parts = ["a", "B", "é", "é", " ", "  ", "\n", "\t", "\x1c", "\xa0", " ", "　", "'s", "12", "###", "<|endoftext|>", "Σ", "ß", "​", "\r\n", "İ", ".", "的", "\U0001f600", "ﬁ", "\x85", "᠎", "\x00", "word,", "Straße.", "x" * 120]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    # Twice: the second time from the table.
    for _ in range(2):
        for text, ids in zip(texts, tok.ids(texts), strict=True):
            assert ids == np.array(tok.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    assert tok.ids([]) == [] and tok.ids(["", ""]) == [b"", b""]


def test_parts_that_share_a_slot(monkeypatch):
    """A table of few slots: parts push each other out, results stay right."""
    monkeypatch.setattr("cairnlog.llm.tokens.SLOTS", 16)
    tok = CachedTokenizer(public_path(FILES[0]))
    texts = [f"some word{k} and w{k % 7} again\nand again" for k in range(300)]
    want = [np.array(tok.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    fresh = CachedTokenizer(public_path(FILES[0]))
    for _ in range(2):
        assert [fresh.ids([t])[0] for t in texts] == want
        assert fresh.ids(texts) == want


def test_packing_rules(docs):
    rows = packing.pack(docs, public_path(FILES[0]), end_id=0).collect()
    t = Tokenizer.from_file(public_path(FILES[0]))
    want = sorted((str(i), tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x in ROWS)
    sequences = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    # Each document's pieces, put together, are its ids; a repeated row's twice.
    whole = {}
    for r in rows:
        whole.setdefault((str(r.doc_id), r.start, bytes(r.ids)), []).append(r)
    got = sum(r.length for r in rows)
    assert got == sum(len(ids) for _, ids in want)
    for key, ids in want:
        mine = sorted((r for r in rows if str(r.doc_id) == key), key=lambda r: r.start)
        joined = {}
        for r in mine:
            joined.update(dict(zip(range(r.start, r.start + r.length), np.frombuffer(r.ids, "<u4").tolist(), strict=True)))
            assert r.doc_tokens == len(ids)
        assert tuple(joined[k] for k in range(len(ids))) == ids
    full = [sum(p.length for p in s) for s in sequences.values()]
    assert sum(n not in (256, 512, 1024) for n in full) <= 2  # one open sequence a task


def test_packer_pads_one_sequence_a_task():
    rng = random.Random(2)
    p = packing.Packer(packing.Tiers(), 0)
    sizes = [rng.choice([1, 5, 200, 256, 257, 400, 700, 1024, 1025, 5000]) for _ in range(3000)]
    for k, n in enumerate(sizes):
        p.add(k, n)
        assert len(p.open) <= 65
    p.close()
    total, held = {}, {}
    for doc, start, length, sequence, offset, tier, step in p.out:
        total[sequence] = total.get(sequence, 0) + length
        held[doc] = held.get(doc, 0) + length
        assert total[sequence] == offset + length
    assert [held[k] for k in range(len(sizes))] == sizes
    assert sum(n not in (256, 512, 1024) for n in total.values()) <= 1


def test_step_groups_hold_as_many_tokens():
    p = packing.Packer(packing.Tiers(), 3)
    for k in range(4000):
        p.add(k, 100 + k % 900)
    steps = {}
    for r in p.out:
        steps.setdefault(r[6], []).append(r[2])
    sums = sorted(sum(v) for v in steps.values())
    assert sums[-1] == 16384 and sum(s != 16384 for s in sums) <= 3  # the last one of each tier


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(none, public_path(FILES[0])).count() == 0
    assert tokenfile.encode_and_read(none, public_path(FILES[1]), 2).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(8)
    for n, top in ((0, 5), (1, 1), (7, 2), (3000, 50000), (1025, 3), (600, 70000)):
        ids = rng.integers(0, top, n)
        m = tokenfile.WaveletMatrix.build(ids)
        data = tokenfile.to_file(m, [None] * 2, np.array([1, n - 1]))
        again, doc_ids, sizes = tokenfile.from_file(data)
        assert (again.decode() == ids).all() and doc_ids == [None, None] and sizes.tolist() == [1, n - 1]
        for i in rng.integers(0, n, 40) if n else []:
            assert again.access(int(i)) == ids[i]
        for token in {*ids[:20].tolist(), top + 1, 1 << 20}:
            where = np.flatnonzero(ids == token)
            assert again.count(token) == len(where)
            lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
            assert again.count(token, lo, hi) == ((where >= lo) & (where < hi)).sum()
            for k in range(min(len(where), 5)):
                assert again.select(token, k) == where[k]
            with pytest.raises(IndexError):
                again.select(token, len(where))
    with pytest.raises(ValueError):
        tokenfile.from_file(b"something else")


def test_shards_round_trip(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    tokenfile.write_shards(docs, public_path(FILES[1]), 2, folder, shard_tokens=100)
    rows = tokenfile.read_documents(spark, folder).orderBy("start").collect()
    t = Tokenizer.from_file(public_path(FILES[1]))
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (doc_id, text) in zip(rows, order, strict=True):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(r.ids) == ids.tobytes()
        at += len(ids)
    assert spark.read.parquet(folder).agg(F.max("shard")).first()[0] >= 1


def test_one_access_reads_little_of_the_file():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 49_408, 400_000)
    data = tokenfile.to_file(tokenfile.WaveletMatrix.build(ids), [7], np.array([len(ids)]))
    read = []

    def part(at, n):
        read.append(n)
        return data[at : at + n]

    shard = tokenfile.Shard(part)
    assert shard.access(123_456) == ids[123_456]
    assert sum(read) < 0.35 * len(data)
    where = np.flatnonzero(ids == ids[5])
    assert shard.count(int(ids[5])) == len(where) and shard.select(int(ids[5]), len(where) - 1) == where[-1]
    assert (shard.decode() == ids).all() and shard.documents()[0] == [7]


def test_new_plain_words_take_the_short_way():
    """Words of ASCII letters that are met first go to the library as they are, long and equally long ones among them."""
    import numpy as np

    from cairnlog.llm.tokens import CachedTokenizer, public_path

    tok = CachedTokenizer(public_path("word_bpe_49k.json"))
    tok.letters = None
    texts = ["Plain words, MIXED Case; twice: twice", "", "zqxj" * 40 + " " + "qzv" * 20, "ab cd"]
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.ids(texts)] == tok._whole(texts)
