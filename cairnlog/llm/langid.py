"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Every byte position of a text gets a label distribution; the distribution of a document is the mean over its
positions. Texts are read whole, in windows of ``window`` bytes that run side by side as one batch.

Defined results: a null text, or one with no letter, is ``und`` with score 0. Without any labelled row to learn from
every document is ``und``. Null ids are predicted like others but never learnt from. Repeated rows each get a row, an
empty table none. Of labels equally likely the first in order is taken. identify() adds held_out, lang_pred and score to
the columns that ``keep`` names, which must not hold those; recognised() keeps docs' columns, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, held_out, only, slices

LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    """docs_per_label bounds the labelled sample the network is fitted on, windows_per_doc what each one gives."""

    hidden: int = 8
    window: int = 128
    batch: int = 2048
    docs_per_label: int = 400
    windows_per_doc: int = 6
    train_window: int = 64
    train_batch: int = 256
    steps: int = 260
    rate: float = 0.02
    seed: int = 7
    #: recognised(): how far above chance the best label must be, of the way to certainty, and the greatest share of
    #: letters that no training window held.
    above_chance: float = 0.1
    foreign: float = 0.5


def squash(x: np.ndarray, room: np.ndarray) -> None:
    """x / (1 + |x|) in place: the network's bounded activation, ten times cheaper here than tanh."""
    np.abs(x, out=room)
    room += 1
    np.divide(x, room, out=x)


def slope(gate: np.ndarray) -> np.ndarray:
    """Derivative of a gate, (1 + squash(x)) / 2, by its own value."""
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


class Network:
    """Two gated recurrent layers, one per direction, in one set of arrays.

    Gate rows are ordered z (both directions), r (both), candidate (both); the recurrent matrix is block-diagonal, so
    one product serves both directions. Arrays are features x batch: each gate is one contiguous block."""

    def __init__(self, labels: list[str], hidden: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        self.letters: frozenset[str] = frozenset()
        g, c = 2 * hidden, len(labels)
        self.p = {
            "E": rng.normal(0, 0.3, (3 * g, 256)).astype(np.float32),
            "U": rng.normal(0, 0.4, (3 * g, g)).astype(np.float32),
            "V": rng.normal(0, 0.3, (c, g)).astype(np.float32),
            "b": np.zeros((c, 1), np.float32),
        }
        own = np.arange(g) // hidden
        self.mask = (np.tile(own, 3)[:, None] == own[None, :]).astype(np.float32)
        self.p["U"] *= self.mask

    def _tables(self) -> tuple[np.ndarray, ...]:
        """Per direction the input rows by byte (forward, backward), and the two recurrent blocks."""
        h, g = self.h, 2 * self.h
        fwd = np.tile(np.arange(g) < h, 3)
        u = self.p["U"]
        return np.ascontiguousarray(self.p["E"][fwd]), np.ascontiguousarray(self.p["E"][~fwd]), np.ascontiguousarray(u[fwd][:, :h]), np.ascontiguousarray(u[~fwd][:, h:])

    def forward(self, x: np.ndarray, keep: bool = False):
        """x: bytes, T x B. Logits C x T x B; with keep also what the backward pass needs."""
        steps, n = x.shape
        h, g, c = self.h, 2 * self.h, len(self.labels)
        ef, eb, uf, ub = self._tables()
        vf, vb = np.ascontiguousarray(self.p["V"][:, :h]), np.ascontiguousarray(self.p["V"][:, h:])
        logits = np.empty((2, steps, c, n), np.float32)
        state = np.zeros((g, n), np.float32)
        pre_f, pre_b, act_f, act_b = (np.empty((3 * h, n), np.float32) for _ in range(4))
        gates, cand, inner, room = np.empty((2 * g, n), np.float32), np.empty((g, n), np.float32), np.empty((g, n), np.float32), np.empty((2 * g, n), np.float32)
        z, r = gates[:g], gates[g:]
        saved = []
        for t in range(steps):
            np.take(ef, x[t], axis=1, out=pre_f, mode="clip")
            np.take(eb, x[steps - 1 - t], axis=1, out=pre_b, mode="clip")
            np.matmul(uf, state[:h], out=act_f)
            np.matmul(ub, state[h:], out=act_b)
            for k in (0, 1):
                np.add(pre_f[k * h : (k + 1) * h], act_f[k * h : (k + 1) * h], out=gates[k * g : k * g + h])
                np.add(pre_b[k * h : (k + 1) * h], act_b[k * h : (k + 1) * h], out=gates[k * g + h : (k + 1) * g])
            squash(gates, room)
            gates *= 0.5
            gates += 0.5
            inner[:h], inner[h:] = act_f[2 * h :], act_b[2 * h :]
            np.multiply(r, inner, out=cand)
            cand[:h] += pre_f[2 * h :]
            cand[h:] += pre_b[2 * h :]
            squash(cand, room[:g])
            if keep:
                saved.append((state.copy(), z.copy(), r.copy(), cand.copy(), inner.copy()))
            state -= cand
            state *= z
            state += cand
            np.matmul(vf, state[:h], out=logits[0, t])
            np.matmul(vb, state[h:], out=logits[1, steps - 1 - t])
            if keep:
                saved[-1] += (state.copy(),)
        return logits[0] + logits[1] + self.p["b"], saved

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross-entropy of every position against its window's label, and its gradient through time."""
        steps, n = x.shape
        h, g = self.h, 2 * self.h
        logits, saved = self.forward(x, keep=True)
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        loss = float(-np.log(prob[:, y, np.arange(n)] + 1e-9).mean())
        prob[:, y, np.arange(n)] -= 1
        prob /= steps * n
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["b"] = prob.sum((0, 2))[:, None]
        u = self.p["U"] * self.mask
        back = np.zeros((g, n), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, cand, inner, after = saved[t]
            df, db = prob[t], prob[steps - 1 - t]
            grad["V"][:, :h] += df @ after[:h].T
            grad["V"][:, h:] += db @ after[h:].T
            back[:h] += self.p["V"][:, :h].T @ df
            back[h:] += self.p["V"][:, h:].T @ db
            d_cand = back * (1 - z) * (1 - np.abs(cand)) ** 2
            d_z = back * (before - cand) * slope(z)
            d_r = d_cand * inner * slope(r)
            d_pre = np.concatenate([d_z, d_r, d_cand])
            d_rec = np.concatenate([d_z, d_r, d_cand * r])
            grad["U"] += d_rec @ before.T
            parts = d_pre.reshape(3, 2, h, n)
            for way, at in ((0, t), (1, steps - 1 - t)):
                rows = np.ascontiguousarray(parts[:, way].reshape(3 * h, n).T)
                one_hot = np.zeros((256, n), np.float32)
                one_hot[x[at], np.arange(n)] = 1
                grad["E"].reshape(3, 2, h, 256)[:, way] += (one_hot @ rows).T.reshape(3, h, 256)
            back = back * z + u.T @ d_rec
        grad["U"] *= self.mask
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, s: Settings) -> "Network":
        """Adam on batches that hold every label equally often. x: N windows of bytes, y: label indices."""
        rng = np.random.default_rng(s.seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        each = max(1, s.train_batch // len(self.labels))
        for step in range(1, s.steps + 1):
            pick = np.concatenate([rng.choice(rows, each) for rows in by])
            _, grad = self.loss_and_gradient(np.ascontiguousarray(x[pick].T), y[pick])
            norm = np.sqrt(sum(float((a * a).sum()) for a in grad.values()))
            rate = s.rate * min(1.0, 4 * (1 - (step - 1) / s.steps))
            for k, a in grad.items():
                a *= min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v2[k] = 0.99 * v2[k] + 0.01 * a * a
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def pooled(self, texts: list[bytes], window: int, batch: int) -> np.ndarray:
        """Mean label distribution over every byte of each text: len(texts) x C."""
        total = np.zeros((len(texts), len(self.labels)))
        sizes = np.array([len(t) for t in texts], np.int64)
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        per = -(-sizes // window)
        owner = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        start = first[owner] + nth * window
        length = np.minimum(window, sizes[owner] - nth * window)
        order = np.argsort(length, kind="stable")
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            longest = int(length[rows].max())
            at = start[rows] + np.minimum(np.arange(longest)[:, None], length[rows] - 1)
            logits, _ = self.forward(buffer[at].astype(np.intp))
            logits -= logits.max(1, keepdims=True)
            prob = np.exp(logits, out=logits)
            prob /= prob.sum(1, keepdims=True)
            if int(length[rows].min()) < longest:
                prob *= (np.arange(longest)[:, None] < length[rows])[:, None, :]
            np.add.at(total, owner[rows], prob.sum(0).T)
        return total / np.maximum(sizes, 1)[:, None]


def training_windows(docs: DataFrame, s: Settings) -> list[tuple[str, bytes]]:
    """At most docs_per_label documents of each language, by hash of the id, and of each a few windows of bytes.

    The sample is bounded by the settings; its ids are chosen over ids alone."""
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2))
    chosen = [r.doc_id for r in hash_sample(usable.select("doc_id", "lang"), "doc_id", s.docs_per_label, by="lang").select("doc_id").distinct().collect()]
    if not chosen:
        return []

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text, lang in zip(frame.doc_id, frame.text, frame.lang, strict=True):
                if not LETTER.search(text):
                    continue
                raw = text.encode("utf-8", "replace")
                rng = np.random.default_rng(abs(int(doc_id)))
                for _ in range(s.windows_per_doc):
                    at = int(rng.integers(0, max(1, len(raw) - s.train_window + 1)))
                    piece = raw[at : at + s.train_window]
                    out.append((int(doc_id), lang, (piece * -(-s.train_window // len(piece)))[: s.train_window]))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "piece"], dtype=object)

    rows = usable.filter(F.col("doc_id").isin(chosen)).select("doc_id", "text", "lang").mapInPandas(windows, "doc_id long, lang string, piece binary").collect()
    return sorted((r.lang, bytes(r.piece)) for r in rows)


def train(docs: DataFrame, s: Settings = Settings()) -> Network | None:
    """The fitted network, or None where no row can be learnt from."""
    rows = training_windows(docs, s)
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    x = np.frombuffer(b"".join(piece for _, piece in rows), np.uint8).reshape(len(rows), s.train_window)
    y = np.array([labels.index(lang) for lang, _ in rows])
    net = Network(labels, s.hidden, s.seed).fit(x, y, s)
    net.letters = frozenset(LETTER.findall("".join(piece.decode("utf-8", "ignore") for _, piece in rows).lower()))
    return net


def predict_texts(net: Network | None, texts: list[str | None], s: Settings) -> tuple[list[str], list[float]]:
    """Label and its pooled probability for each whole text."""
    label, score = ["und"] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)] if net is not None else []
    lo = 0
    while lo < len(known):
        hi, held = lo, 0
        while hi < len(known) and held < 1_000_000:
            held += len(texts[known[hi]])
            hi += 1
        rows = known[lo:hi]
        prob = net.pooled([texts[i].encode("utf-8", "replace") for i in rows], s.window, s.batch)
        for i, k, p in zip(rows, prob.argmax(1), prob.max(1), strict=True):
            label[i], score[i] = net.labels[k], float(min(1.0, p))
        lo = hi
    return label, score


def identify(docs: DataFrame, s: Settings = Settings(), keep: tuple[str, ...] = ("doc_id", "text"), net: Network | None = None) -> DataFrame:
    """The columns named in keep, with held_out, lang_pred and score, for every row of docs.

    Where no network is given one is fitted on docs' own labelled rows; lang is not read when predicting."""
    net = net or train(only(docs, "doc_id", "text", "lang"), s)
    held = docs.sparkSession.sparkContext.broadcast(net)
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])], held_out("doc_id", 4, 2).alias("held_out"))
    fields = [f for f in source.schema.fields if f.name in keep or f.name == "held_out"]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            label, score = predict_texts(held.value, batch.column("text").to_pylist(), s)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(label, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return source.mapInArrow(predict, schema)


def foreign_share(text: str, known: frozenset[str]) -> float:
    """The share of a text's letters that the network never met."""
    if text.isascii() and known.issuperset("abcdefghijklmnopqrstuvwxyz"):
        return 0.0
    counts = Counter(text.lower())
    letters = {c: n for c, n in counts.items() if LETTER.match(c)}
    return sum(n for c, n in letters.items() if c not in known) / max(1, sum(letters.values()))


def accepted(net: Network, texts: list[str | None], s: Settings) -> list[bool]:
    """Whether each text is in a language the network knows: it has letters, most of them met in training, and the best
    label's probability is above chance (one over the number of labels) by the share of the rest that s asks for."""
    chance = 1 / len(net.labels)
    least = chance + s.above_chance * (1 - chance)
    return [label != "und" and (score >= least or len(net.labels) == 1) and foreign_share(text, net.letters) <= s.foreign for text, label, score in zip(texts, *predict_texts(net, texts, s), strict=True)]


def recognised(docs: DataFrame, s: Settings = Settings(), net: Network | None = None) -> DataFrame:
    """docs without the rows whose text is in none of the languages learnt. Where no row is labelled nothing can be
    learnt, and every row stays."""
    net = net or train(only(docs, "doc_id", "text", "lang"), s)
    if net is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(accepted(held.value, batch.column("text").to_pylist(), s), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
