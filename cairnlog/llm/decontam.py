"""Benchmark decontamination: pigeonhole edit matching over words.

A test item of m words may differ from a passage in e = floor(rate * m) word edits. Cut into e + 1 pieces, at least one
piece must stand in the passage unchanged. All pieces are searched for at once (Aho-Corasick), and around each hit the
whole item is verified with Myers' bit-parallel edit distance, its alphabet being words.

Words are runs of letters, digits and underscores, lower-cased, items and documents by the same function; everything
between them is ignored. In scripts that are written without spaces each character is a word. With the default rate a
passage is found from a similarity of 0.8; an item of fewer than five words has no budget and is found where it stands
unchanged.

Distinct items are taken in blocks of about ``block_chars`` characters, each one pass over the documents, however many
blocks there are; what was found is joined with the items afterwards, so an item that is repeated very often costs no
more. Defined results: null and empty texts, and items without a word, match nothing; repeated documents and items each
get their rows; very long texts and items are matched whole; of passages that overlap the best one is given, then the
first; no items, no rows; other columns than the ids and text are not read by leaks() and kept by without_leaks(),
whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices

# Thai to Lao, Burmese, Khmer, kana, and Chinese characters.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
WORD = re.compile(rf"[^\W{UNSPACED}]+|(?=[{UNSPACED}])\w")
FOUND = "doc_id long, key string, start long, end long, distance int, similarity double"


@dataclass(frozen=True)
class Settings:
    rate: float = 0.2
    block_chars: int = 16_000_000


def folded(text: str) -> str:
    """The words, lower-cased, each with a space on either side."""
    return " " + " ".join(WORD.findall(text)).lower() + " "


def masks(item: list[str]) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, w in enumerate(item):
        found[w] = found.get(w, 0) | 1 << i
    return found


def myers(peq: dict[str, int], m: int, text: list[str], anchored: bool = False) -> list[int]:
    """Edit distance of the whole pattern to the best text part ending at each word (anchored: to the text's prefix)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for word in text:
        eq = peq.get(word, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full | anchored
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        out.append(score)
    return out


class Matcher:
    """All items of a block: pieces in one automaton, masks for verification."""

    def __init__(self, items: list[tuple[str, str]], s: Settings):
        self.items: list[tuple] = []
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, set[int]] = {}
        for item_id, text in items:
            words = folded(text).split()
            if not words:
                continue
            e = int(s.rate * len(words))
            bounds = [round(k * len(words) / (e + 1)) for k in range(e + 2)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                pieces.setdefault(" " + " ".join(words[a:b]) + " ", set()).add(len(self.items))
            self.items.append((item_id, masks(words), masks(words[::-1]), len(words), e))
        for piece, where in pieces.items():
            self.automaton.add_word(piece, where)
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple]:
        """(key of the item, start, end, distance, words of the item) of each passage; code points, end exclusive."""
        if not text or not self.items:
            return []
        joined = folded(text)
        windows: dict[int, list[int]] = {}
        before, at = 1, 0
        for end, where in self.automaton.iter(joined):
            at += joined.count(" ", before, end + 1)  # words ended by the space that ends the piece
            before = end + 1
            for k in where:
                windows.setdefault(k, []).append(at)
        if not windows:
            return []
        low = joined.split()
        spans = [m.span() for m in WORD.finditer(text)]
        found = []
        for k, hits in windows.items():
            item_id, peq, back, m, e = self.items[k]
            # at counts the words ended by the piece's last one; the piece began at most m words before that.
            near = sorted((max(0, last - m - e), min(len(low), last + m + e)) for last in hits)
            merged = [near[0]]
            for a, b in near[1:]:
                if a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            for a, b in merged:
                part = low[a:b]
                scores, free, j = myers(peq, m, part), 0, 0
                while j < len(scores):
                    if scores[j] > e:
                        j += 1
                        continue
                    best = j
                    while j < len(scores) and scores[j] <= e and j - best <= m:
                        best = j if scores[j] < scores[best] else best
                        j += 1
                    ahead = myers(back, m, part[free : best + 1][::-1], True)
                    size = min(range(len(ahead)), key=lambda i: (ahead[i], abs(i + 1 - m))) + 1
                    if ahead[size - 1] <= e:
                        found.append((item_id, spans[a + best + 1 - size][0], spans[a + best][1], ahead[size - 1], m))
                        free = best + 1
                    # What ends next to the best one is looked at again, in the words after it alone.
                    j = best + 1
        return found


_built: dict[str, Matcher] = {}


def matcher(items: Broadcast, s: Settings) -> Matcher:
    """One per block and worker process; blocks are told apart by the name they were given."""
    name, rows = items.value
    if name not in _built:
        if len(_built) > 1:
            _built.clear()
        _built[name] = Matcher(rows, s)
    return _built[name]


def keyed(benchmark: DataFrame) -> DataFrame:
    return only(benchmark, "item_id", "text").filter(F.col("text").isNotNull()).withColumn("key", F.md5("text"))


def blocks(benchmark: DataFrame, s: Settings) -> Iterator[Broadcast]:
    """The distinct items in broadcasts of bounded size, each with a name of its own."""
    items = keyed(benchmark).select("key", "text").dropDuplicates(["key"])
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(chars // (s.block_chars // 2)) + 1
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == k).collect()
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sorted((r.key, r.text) for r in rows)))


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each passage of a document that matches an item."""
    out = None
    for items in blocks(benchmark, s):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            m = matcher(items, s)
            for batch in slices(batches):
                rows = [(doc_id, *r) for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in m.find(text)]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array([1 - d / n for d, n in zip(cols[4], cols[5], strict=True)], pa.float64())],
                    names=["doc_id", "key", "start", "end", "distance", "similarity"],
                )

        found = only(docs, "doc_id", "text").mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    ids = keyed(benchmark).select("item_id", F.col("key").alias("_key"))
    return out.join(ids, F.col("key") == F.col("_key")).select("doc_id", "item_id", "start", "end", "distance", "similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs without the rows in which an item is found; nothing is shuffled."""
    for items in blocks(benchmark, s):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            m = matcher(items, s)
            for batch in slices(batches):
                yield batch.filter(pa.array(np.array([not m.find(t) for t in batch.column("text").to_pylist()], bool)))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
