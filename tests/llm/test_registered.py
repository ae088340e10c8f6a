"""Every registered query over the smallest tables against versions written plainly, and two operators' inner loops."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from cairnlog.llm import langid, registry, toxicity
from cairnlog.llm.tokens import public_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def run(spark, name):
    rows = registry.queries()[name](spark, SMALL)
    return [r.asDict() for r in rows.collect()]


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def test_secret_scan(spark, docs):
    rows = run(spark, "op1_secret_scan")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r["doc_id"]].text or ""
        assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(1 for x in found if x[1] == k) for k in range(3))
        assert set(base) <= set(r["spans"].split(","))


def test_language_id(spark, docs):
    rows = run(spark, "op2_language_id")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]].lang for r in out) >= 0.9 * len(out)


def test_packing(spark, docs):
    rows = run(spark, "op3_packing")
    t = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    ids = {d: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for d, r in docs.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d])
            at += r["length"]
        assert at == len(ids[d])
    assert set(by_doc) == set(docs)
    room = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        room += at if at & (at - 1) == 0 else 1024
    assert sum(map(len, ids.values())) >= 0.97 * room


def test_decontamination(spark, docs):
    rows = run(spark, "op4_decontamination")
    items = {r.item_id: re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    for d, r in docs.items():
        joined = f" {' '.join(re.findall(r'[^\W]+', (r.text or '').lower()))} "
        for k, words in items.items():
            if f" {' '.join(words)} " in joined:
                assert (d, k) in found
    for r in rows:
        part = re.findall(r"\w+", docs[r["doc_id"]].text[r["start"] : r["end"]].lower())
        assert distance(items[r["item_id"]], part) == r["distance"] <= 0.2 * len(items[r["item_id"]])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_toxicity(spark, docs):
    rows = run(spark, "op5_toxicity")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_simhash(spark, docs):
    rows = {r["doc_id"]: r for r in run(spark, "op6_simhash")}
    prints = {}
    for d, r in docs.items():
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), r.text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    assert {d: int(r["fingerprint"], 16) for d, r in rows.items()} == prints
    root = {d: d for d in docs}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {d: r["component_id"] for d, r in rows.items()} == {d: top(d) for d in docs}


def test_html_text(spark):
    rows = run(spark, "op8_html_text")
    assert len(rows) == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and r["text"] == r["text"].strip() and "<" not in r["text"] for r in rows)


def test_token_file(spark, docs):
    rows = sorted(run(spark, "op10_token_file"), key=lambda r: r["doc_id"])
    t, at = Tokenizer.from_file(public_path("word_bpe_49k.json")), 0
    for r in rows:
        ids = np.array([*t.encode(docs[r["doc_id"]].text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(rows) == len(docs)


def test_network_against_plain_loops():
    """The recurrence written out, one byte and one unit after the other."""
    net = langid.Network(["a", "b", "c"], 3, seed=5)
    rng = np.random.default_rng(6)
    for k in net.p:
        net.p[k] = (net.p[k] + rng.normal(0, 0.3, net.p[k].shape).astype(np.float32) * (net.mask if k == "U" else 1)).astype(np.float32)
    text, h = rng.integers(0, 256, 17), 3
    squash = lambda v: v / (1 + np.abs(v))

    def states(way, order):
        out, state = {}, np.zeros(h)
        rows = [np.arange(h) + (2 * gate + way) * h for gate in range(3)]
        for t in order:
            e = [net.p["E"][r, text[t]].astype(float) for r in rows]
            u = [net.p["U"][r][:, way * h : (way + 1) * h].astype(float) @ state for r in rows]
            z, r = (0.5 + 0.5 * squash(e[k] + u[k]) for k in (0, 1))
            cand = squash(e[2] + r * u[2])
            state = z * state + (1 - z) * cand
            out[t] = state
        return out

    forward, backward = states(0, range(17)), states(1, range(16, -1, -1))
    logits, _ = net.forward(text[:, None].astype(np.intp))
    for t in range(17):
        want = net.p["V"][:, :h] @ forward[t] + net.p["V"][:, h:] @ backward[t] + net.p["b"][:, 0]
        assert np.allclose(logits[t, :, 0], want, atol=1e-4)
    prob = np.exp(logits[:, :, 0]) / np.exp(logits[:, :, 0]).sum(1, keepdims=True)
    assert np.allclose(net.pooled([bytes(text.astype(np.uint8))], 64, 8)[0], prob.mean(0), atol=1e-4)


def test_lexicon_against_plain_search():
    rng = random.Random(8)
    lexicon = {toxicity.folded(w): x for w, x in (("idiot", 2.0), ("trash", 1.5), ("clown", 1.0), ("id", 0.5), ("rash", 0.7))}
    s = toxicity.Scorer(lexicon)
    parts = ["idiot", "1d10t", "ＩＤＩＯＴ", "іdiоt", "trash", "trash can", "clown", "class clown", "rash", "id", " ", " ", "x", "!", "$", "é", "\n", "-", "can"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        low = "".join(toxicity.folded(text))
        spared = [(a, a + len(p)) for p in map(toxicity.folded, toxicity.EXCEPTIONS) for a in range(len(low)) if low.startswith(p, a) and not (a and low[a - 1].isalnum()) and not low[a + len(p) : a + len(p) + 1].isalnum()]
        want = []
        for w, x in lexicon.items():
            for a in range(len(low)):
                b = a + len(w)
                if low.startswith(w, a) and not (a and low[a - 1].isalnum()) and not low[b : b + 1].isalnum() and not any(lo <= a and b <= hi for lo, hi in spared):
                    want.append((a, b, x))
        assert sorted(s.hits(text)) == sorted(want)
