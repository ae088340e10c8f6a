"""Toxicity: a weighted lexicon, found by Aho-Corasick in folded text and normalised by length.

Folding maps look-alike letters, accents and digits that stand for letters onto plain letters, one code point for one,
so words keep their bounds. A lexicon word counts where it is a whole word and no exception phrase covers it. A text's
score is a logistic function of the summed weights and of their density in its words.

The lexicon and the logistic weights are fitted on at most ``fit_rows`` labelled rows of each class (a documented bound,
rows by hash of the id); near copies among them count once, so that words of one much-copied text don't enter.

Defined results: a null text counts as empty; empty texts score like any text without a hit. Where the labels hold no
two classes every score is 0. Null ids count as held out. A document labelled twice is toxic if one label says so;
of lexicon words that weigh the same the last in order is taken first. Very long texts are read whole; repeated rows each
get a row, an empty table none; other columns than the ids, text and toxic are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, held_out, only, slices

#: Letters of other scripts that look like Latin ones, and characters written for letters. l, 1 and | become i.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ո": "n", "ⅼ": "i",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ø": "o", "đ": "d", "ł": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "|": "i", "l": "i",
}
SIGNS = re.compile(r"(?<![$@!])[$@!](?=[^\W_])")
WORD = re.compile(r"[^\W_]+")
#: Harmless phrases that hold a lexicon word.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "clown fish", "clown nose", "circus clown", "class clown", "rodeo clown", "idiot proof", "pathetic fallacy")


def _table() -> dict[int, str]:
    table = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
        plain = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if plain.isascii() and plain.isalpha():
            table[c] = LOOK_ALIKES.get(plain, plain)
    for k, v in LOOK_ALIKES.items():
        table[ord(k)] = v
        if len(k.upper()) == 1:
            table[ord(k.upper())] = v
    return table | {c: LOOK_ALIKES.get(chr(c + 32), chr(c + 32)) for c in range(65, 91)}


FOLD = _table()
SIGN = {"$": "s", "@": "a", "!": "i"}


def folded(text: str) -> str:
    """As long as text: look-alikes become the letters they stand for."""
    if "$" in text or "@" in text or "!" in text:
        text = SIGNS.sub(lambda m: SIGN[m[0]], text)
    return text.translate(FOLD)


@dataclass(frozen=True)
class Settings:
    fit_rows: int = 1500
    least_share: float = 0.01
    least_rows: int = 3
    least_weight: float = 2.0
    words: int = 400


class Scorer:
    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.lexicon, self.exceptions = dict(lexicon), tuple(folded(x) for x in exceptions)
        self.theta = np.zeros(3)
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for w, x in self.lexicon.items():
                self._automaton.add_word(w, (len(w), x))
            for w in self.exceptions:
                self._automaton.add_word(w, (len(w), 0.0))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of every lexicon word that no exception phrase covers."""
        found = self.automaton()
        if not len(found):
            return []
        low = folded(text)
        out, spared = [], []
        for last, (size, weight) in found.iter(low):
            a, b = last + 1 - size, last + 1
            if (a and low[a - 1].isalnum()) or low[b : b + 1].isalnum():
                continue
            (out if weight else spared).append((a, b, weight))
        return [h for h in out if not any(a <= h[0] and h[1] <= b for a, b, _ in spared)] if spared else out

    def features(self, text: str, hits: list[tuple[int, int, float]] | None = None) -> tuple[float, float]:
        total = sum(w for _, _, w in (self.hits(text) if hits is None else hits)) if text else 0.0
        if not total:
            return 0.0, 0.0
        return math.log1p(total), math.log1p(100 * total / max(20, text.count(" ") + text.count("\n") + 1))

    def score(self, text: str | None, hits: list[tuple[int, int, float]] | None = None) -> float:
        x, y = self.features(text or "", hits)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.theta[0] + self.theta[1] * x + self.theta[2] * y)))))


def without_copies(rows: list[tuple[str, int]]) -> list[tuple[set[str], int]]:
    """Word sets of the texts, near copies (most of sixteen least word hashes alike) once."""
    seen: dict[tuple[int, int], int] = {}
    kept: list[tuple[set[str], int]] = []
    mix = np.random.default_rng(11).integers(1, 1 << 62, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for text, label in rows:
        words = set(WORD.findall(folded(text)))
        if not words:
            continue
        h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        least = (h[:, None] * mix >> np.uint64(16)).min(0).tolist()
        alike = Counter(seen[k] for k in enumerate(least) if k in seen)
        if alike and alike.most_common(1)[0][1] >= 8:
            continue
        for k in enumerate(least):
            seen.setdefault(k, len(kept))
        kept.append((words, label))
    return kept


def learn_lexicon(rows: list[tuple[set[str], int]], s: Settings) -> dict[str, float]:
    """Words by greedy cover: each one taken halves what the toxic rows that hold it still count for the next."""
    toxic, clean = [w for w, y in rows if y], [w for w, y in rows if not y]
    if not toxic or not clean:
        return {}
    t, c = Counter(x for w in toxic for x in w), Counter(x for w in clean for x in w)
    least = max(s.least_rows, s.least_share * len(toxic))
    weight = {x: math.log((n + 0.5) / (len(toxic) + 1) * (len(clean) + 1) / (c[x] + 0.5)) for x, n in t.items() if n >= least}
    open_ = {x for x, w in weight.items() if w >= s.least_weight and len(x) > 1}
    value = np.ones(len(toxic))
    where = {x: np.array([i for i, w in enumerate(toxic) if x in w]) for x in open_}
    found: dict[str, float] = {}
    while open_ and len(found) < s.words:
        best = max(open_, key=lambda x: (value[where[x]].sum() * weight[x], x))
        if value[where[best]].sum() < least / 2:
            break
        found[best] = weight[best]
        value[where[best]] *= 0.5
        open_.discard(best)
    return found


def fit(rows: list[tuple[str, int]], s: Settings = Settings(), exceptions: tuple[str, ...] = EXCEPTIONS) -> Scorer | None:
    """Lexicon, then the logistic weights by Newton steps; None where rows hold no two classes."""
    rows = sorted((t or "", int(y)) for t, y in rows)
    if len({y for _, y in rows}) < 2:
        return None
    scorer = Scorer(learn_lexicon(without_copies(rows), s), exceptions)
    x = np.array([(1.0, *scorer.features(t)) for t, _ in rows])
    y = np.array([v for _, v in rows], float)
    theta = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (y - p) - 0.01 * theta
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.01 * np.eye(3), grad)
        theta = theta + np.clip(step, -2, 2)
    scorer.theta = theta
    return scorer


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> list[tuple[str, int]]:
    """At most fit_rows texts of each class, first by hash of the id, of the rows that are not held out."""
    known = only(labels, "doc_id", "toxic").filter(F.col("toxic").isNotNull() & ~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    label = {}
    for value in (0, 1):
        for r in hash_sample(known.filter(F.col("toxic") == value), "doc_id", s.fit_rows).collect():
            label[r.doc_id] = r.toxic
    texts = only(docs, "doc_id", "text").filter(F.col("doc_id").isin(list(label))).collect() if label else []
    return [(r.text, label[r.doc_id]) for r in texts]


def score(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits) for every row of docs; hits are the counted spans."""
    scorer = fit(training_rows(docs, labels, s), s)
    held = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sc = held.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [sc.hits(t) if sc and t else [] for t in texts]
            scores = [sc.score(t, h) if sc else 0.0 for t, h in zip(texts, found, strict=True)]
            hits = [[{"start": a, "end": b, "weight": w} for a, b, w in h] for h in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(v >= 0.5) for v in scores], pa.int32()), pa.array(hits, kind)], names=["doc_id", "held_out", "score", "predicted", "hits"])

    source = docs.select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, hits array<struct<start: long, end: long, weight: double>>")
