"""Exact top-k by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; rows sorted by that key are cut into annuli, blocks
of one pivot that also note the least and greatest distance of their rows to every pivot and their greatest norm. With
|q - x| >= | |q - p| - |x - p| | and q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 each pivot gives an annulus an upper bound.

Queries are rows of the table, so the task that cuts a query's own annulus expands from there, to the neighbours in the
order of the key: its k-th best score so far is the query's first threshold. Queries of one pivot are packed into shards
with the same intervals; an annulus goes to the shards whose bound reaches their least threshold, and nowhere else. A
group of a shard and at most ``part`` annuli scores them from the most promising one on and stops at the first whose
bound reaches no query's k-th best score. Bounds are widened by a rounding margin, so the result is exact.

A hot pivot or a vector that many rows share is no hot key: rows are dealt by ranges of (pivot, distance, hash of the
id), and the annuli of a shard in parts of bounded size.

How much is pruned depends on the data alone. Where vectors have no structure (the given ones are nearly isotropic in 64
dimensions) the distances to any pivot hardly differ, and every annulus goes to every shard; README has the figures.

Defined results: vectors that are null, or hold null or non-finite components (or some whose scaled value is beyond a
double), take no part; only vectors of one length are compared; an id's repeated rows count once, by their best score; a
query's own id is no candidate; ties go to the smaller id. Scores are exact; one beyond a long counts as the
nearest long. Fewer than k candidates give fewer rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, hash_sample, only, slices, stored

LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """shard: queries of one shard; part: annuli that meet a shard in one group; near: annuli on either side of a query's
    own one that give its first threshold; metas: shards whose intervals are broadcast at once (under 1 KB each)."""

    k: int = 5
    scale: int = 256
    every: int = 50
    pivots: int = 48
    sample: int = 2048
    annulus: int = 256
    shard: int = 1024
    part: int = 256
    near: int = 4
    metas: int = 20_000


def scaled(vectors: DataFrame, s: Settings) -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of every usable vector, as little-endian 64-bit floats that hold integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, dims, data = [], [], []
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if vec_id is None or not v or any(x is None for x in v):
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(s.scale * np.array(v, np.float64))
                if np.isfinite(x).all():
                    ids.append(vec_id)
                    dims.append(len(x))
                    data.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "dim", "v"])

    return only(vectors, "vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, v binary")


def matrix(rows: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(-1, dim)


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """A few rounds of k-means from spread-out starts."""
    pivots = x[:1]
    far = ((x - pivots[0]) ** 2).sum(1)
    while len(pivots) < min(n, len(x)) and far.max() > 0:
        pivots = np.concatenate([pivots, x[far.argmax()][None]])
        far = np.minimum(far, ((x - pivots[-1]) ** 2).sum(1))
    for _ in range(4):
        near = distances(x, pivots).argmin(1)
        pivots = np.stack([x[near == k].mean(0) if (near == k).any() else pivots[k] for k in range(len(pivots))])
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows too large for their squares get infinite or undefined distances, which bound nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T))


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(1))


def interval(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance to each pivot; everything where one is not finite."""
    ok = np.isfinite(d).all(0)
    return np.where(ok, d.min(0), 0.0), np.where(ok, d.max(0), np.inf)


def upper(norm: np.ndarray, low: np.ndarray, high: np.ndarray, norm_x: float, low_x: np.ndarray, high_x: np.ndarray) -> np.ndarray:
    """The greatest inner product that each row (norm at most, distances to the pivots between low and high) can have
    with any vector of an annulus (the same of it)."""
    with np.errstate(over="ignore", invalid="ignore"):
        slack = 1e-6 * (np.minimum(high, 1e300) + min(norm_x, 1e300) + 1)
        gap = np.maximum(0, np.maximum(low - high_x, low_x - high) - slack)
        squares = norm * norm + norm_x * norm_x
        bound = np.minimum((squares - (gap * gap).max(1)) / 2, norm * norm_x)
        return np.where(np.isfinite(bound), bound + 1e-6 * (squares + 1), np.inf)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers. Below 2^53 no sum of doubles rounds; beyond, whole numbers of any size."""
    if norms(q).max() * norms(x).max() < 1 << 53:
        return q @ x.T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -LONG, LONG)


INDEX = "annulus long, pivot int, near double, norm double, low binary, high binary, ids binary, v binary, first binary"


def build_index(points: DataFrame, dim: int, pivots: np.ndarray, s: Settings) -> DataFrame:
    """Annuli: every point of this length in one of them, ids and vectors packed; first: the thresholds of its queries."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = np.nan_to_num(distances(matrix(batch.column("v").to_pylist(), dim), pivots), nan=np.inf)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(d[np.arange(len(at)), at]), batch.column("vec_id"), batch.column("v")], names=["pivot", "r", "vec_id", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Annuli in the order of the key. One is given out when those after it, that its queries also try, are there."""
        task, number = TaskContext.get().partitionId() << 32, 0
        ring: list[dict] = []

        def done(upto: int) -> Iterator[pa.RecordBatch]:
            for n in range(a0[0], upto):
                a = ring[n]
                q = np.flatnonzero(a["ids"] % s.every == 0)
                best, names = nothing(len(q), s.k)
                if len(q):
                    for m in sorted(range(max(0, n - s.near), min(len(ring), n + s.near + 1)), key=lambda m: abs(m - n)):
                        if ring[m]["pivot"] == a["pivot"]:
                            best, names = better(best, names, a["ids"][q], a["x"][q], ring[m]["ids"], ring[m]["x"], s.k)
                low, high = interval(distances(a["x"], pivots))
                row = (a["number"], a["pivot"], float(low[a["pivot"]]), float(norms(a["x"]).max()), low.tobytes(), high.tobytes(), a["ids"].astype("<i8").tobytes(), a["x"].tobytes(), np.array(best[:, -1], np.float64).tobytes())
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["annulus", "pivot", "near", "norm", "low", "high", "ids", "v", "first"])
            a0[0] = max(a0[0], upto)
            drop = max(0, a0[0] - s.near)
            del ring[:drop]
            a0[0] -= drop

        a0 = [0]
        for batch in batches:
            pivot, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "vec_id"))
            x = matrix(batch.column("v").to_pylist(), dim)
            for p in np.unique(pivot):
                rows = np.flatnonzero(pivot == p)
                for lo in range(0, len(rows), s.annulus):
                    at = rows[lo : lo + s.annulus]
                    ring.append({"number": task + number, "pivot": int(p), "ids": ids[at], "x": x[at]})
                    number += 1
                    yield from done(max(a0[0], len(ring) - s.near))
        yield from done(len(ring))

    keyed = points.filter(F.col("dim") == dim).select("vec_id", "v").mapInArrow(key, "pivot int, r double, vec_id long, v binary")
    # Keys are written first: range partitioning samples its input, which would else be computed twice.
    keyed = stored(keyed, "topk-keys")
    dealt = keyed.repartitionByRange("pivot", "r", F.xxhash64("vec_id")).sortWithinPartitions("pivot", "r", "vec_id")
    index = stored(dealt.mapInArrow(cut, INDEX), "topk-index")
    forget(keyed)
    return index


def query_shards(index: DataFrame, dim: int, pivots: np.ndarray, s: Settings) -> DataFrame:
    """(shard, norm, low, high, least, ids, v, first): the queries of the annuli, packed by pivot; least: their least
    threshold. Queries of far apart keys are in one shard only where a task has no more of them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list[tuple[int, bytes, float]]] = {}

        def close(rows: list[tuple[int, bytes, float]]) -> pa.RecordBatch:
            x = matrix([r[1] for r in rows], dim)
            low, high = interval(distances(x, pivots))
            first = np.array([r[2] for r in rows])
            row = (task + number, float(norms(x).max()), low.tobytes(), high.tobytes(), float(first.min()), np.array([r[0] for r in rows], "<i8").tobytes(), x.tobytes(), first.tobytes())
            kinds = (pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["shard", "norm", "low", "high", "least", "ids", "v", "first"])

        for batch in slices(batches, 64):
            for pivot, ids, v, first in zip(*(batch.column(c).to_pylist() for c in ("pivot", "ids", "v", "first")), strict=True):
                ids, first = np.frombuffer(ids, "<i8"), np.frombuffer(first, np.float64)
                for at, floor in zip(np.flatnonzero(ids % s.every == 0).tolist(), first.tolist(), strict=True):
                    rows = held.setdefault(pivot, [])
                    rows.append((int(ids[at]), v[8 * dim * at : 8 * dim * (at + 1)], floor))
                    if len(rows) == s.shard:
                        yield close(held.pop(pivot))
                        number += 1
        left: list[tuple[int, bytes, float]] = []
        for pivot in sorted(held):
            left += held[pivot]
            if len(left) >= s.shard // 4 or pivot == max(held):
                for lo in range(0, len(left), s.shard):
                    yield close(left[lo : lo + s.shard])
                    number += 1
                left = []

    return stored(index.select("pivot", "ids", "v", "first").mapInArrow(pack, "shard long, norm double, low binary, high binary, least double, ids binary, v binary, first binary"), "topk-shards")


def merge(best: np.ndarray, names: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two score tables by (score descending, id ascending), an id once. Rows are queries."""
    s, n = np.concatenate([best, scores], 1), np.concatenate([names, ids], 1)
    if s.dtype == object:  # whole numbers beyond a double
        order = np.array([sorted(range(s.shape[1]), key=lambda j: (-s[i, j], n[i, j])) for i in range(len(s))], np.int64).reshape(s.shape)
    else:
        order = np.lexsort((n, -s), axis=1)
    s, n = np.take_along_axis(s, order, 1), np.take_along_axis(n, order, 1)
    width = min(s.shape[1], 4 * k)
    for i in np.flatnonzero((np.sort(n[:, :width], 1)[:, 1:] == np.sort(n[:, :width], 1)[:, :-1]).any(1)):
        _, first = np.unique(n[i], return_index=True)
        again = np.ones(s.shape[1], bool)
        again[first] = False
        s[i, again] = -np.inf
        row = np.array(sorted(range(s.shape[1]), key=lambda j: (-s[i, j], n[i, j])))
        s[i], n[i] = s[i, row], n[i, row]
    return s[:, :k], n[:, :k]


def nothing(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A score table of n queries before any candidate, its placeholder ids distinct."""
    return np.full((n, k), -np.inf), np.tile(np.iinfo(np.int64).max - np.arange(k), (n, 1))


def better(best: np.ndarray, names: np.ndarray, qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The score tables of queries after some more candidates."""
    found = scores(q, x)
    if found.dtype == object:
        best = best.astype(object)
    found[ids[None, :] == qid[:, None]] = -np.inf
    return merge(best, names, found, np.broadcast_to(ids, found.shape), k)


def search(qid: np.ndarray, q: np.ndarray, first: np.ndarray, annuli: list[dict], pivots: np.ndarray, dim: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best scores and ids of each query among the annuli, and how many (query, annulus) pairs were scored."""
    best, names = nothing(len(qid), k)
    away, norm, scored = distances(q, pivots), norms(q), 0
    low, high = np.nan_to_num(away, nan=0.0, posinf=0.0), np.where(np.isfinite(away), away, np.inf)
    bounds = np.stack([upper(norm, low, high, a["norm"], np.frombuffer(a["low"]), np.frombuffer(a["high"])) for a in annuli], 1)
    most = bounds.max(0)
    for n in np.argsort(-most):
        floor = np.maximum(first, best[:, -1].astype(float))
        if most[n] < floor.min():
            break  # the annuli after it are no better for any query
        go = np.flatnonzero(bounds[:, n] >= floor)
        if not len(go):
            continue
        scored += len(go)
        ids, x = np.frombuffer(annuli[n]["ids"], "<i8"), np.frombuffer(annuli[n]["v"], np.float64).reshape(-1, dim)
        part, part_names = better(best[go], names[go], qid[go], q[go], ids, x, k)
        if part.dtype == object:
            best = best.astype(object)
        best[go], names[go] = part, part_names
    return best, names, scored


def pairs_of(index: DataFrame, metas: list, s: Settings) -> DataFrame:
    """(shard, annulus): which annuli can hold a score that reaches the least threshold of a shard."""
    shard = np.array([m.shard for m in metas], np.int64)
    norm, least = np.array([m.norm for m in metas]), np.array([m.least for m in metas])
    low, high = (np.stack([np.frombuffer(m[c]) for m in metas]) for c in ("low", "high"))
    held = index.sparkSession.sparkContext.broadcast((shard, norm, least, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, norm, least, low, high = held.value
        for batch in batches:
            for annulus, n, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("annulus", "norm", "low", "high")), strict=True):
                go = upper(norm, low, high, n, np.frombuffer(lo), np.frombuffer(hi)) >= least
                yield pa.RecordBatch.from_arrays([pa.array(shard[go]), pa.array(np.full(go.sum(), annulus), pa.int64())], names=["shard", "annulus"])

    return index.select("annulus", "norm", "low", "high").mapInArrow(run, "shard long, annulus long")


def top_k(vectors: DataFrame, s: Settings = Settings(), scored=None) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries whose id is divisible by ``every``, against all other rows.

    scored: an accumulator that counts the (query, annulus) pairs that were scored."""
    spark = vectors.sparkSession
    points = stored(scaled(vectors, s), "topk-points")
    found = None
    for dim in sorted(r.dim for r in points.select("dim").distinct().collect()):
        sample = hash_sample(points.filter(F.col("dim") == dim), "vec_id", s.sample).collect()
        with np.errstate(over="ignore"):
            usable = [bytes(r.v) for r in sample if np.isfinite((np.frombuffer(r.v) ** 2).sum() * 4)]
        pivots = choose_pivots(matrix(usable, dim), s.pivots) if usable else np.zeros((1, dim))
        index = build_index(points, dim, pivots, s)
        shards = query_shards(index, dim, pivots, s)
        for block in range(shards.count() // (s.metas // 2) + 1):
            blocks = shards.count() // (s.metas // 2) + 1
            mine = shards.filter(F.pmod(F.xxhash64("shard"), F.lit(blocks)) == block)
            metas = mine.select("shard", "norm", "low", "high", "least").collect()
            if metas:
                part = meet(index, mine, metas, dim, pivots, s, scored)
                found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", place).filter(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")


def meet(index: DataFrame, shards: DataFrame, metas: list, dim: int, pivots: np.ndarray, s: Settings, scored) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each part of the annuli its shard meets."""
    pairs = stored(pairs_of(index, metas, s), "topk-pairs")
    parts = pairs.groupBy("shard").agg(F.ceil(F.count("*") / s.part).cast("int").alias("parts"))
    dealt = pairs.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("annulus"), F.col("parts")).cast("int")).drop("parts")
    right = dealt.join(index.select("annulus", "norm", "low", "high", "ids", "v"), "annulus")
    left = shards.select("shard", "ids", "v", "first").join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(queries: pa.Table, annuli: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        for ids, v, first in zip(*(queries.column(c).to_pylist() for c in ("ids", "v", "first")), strict=True):
            if not annuli.num_rows:
                continue
            qid, q = np.frombuffer(ids, "<i8"), np.frombuffer(v, np.float64).reshape(-1, dim)
            best, names, n = search(qid, q, np.frombuffer(first, np.float64), annuli.select(["norm", "low", "high", "ids", "v"]).to_pylist(), pivots, dim, s.k)
            if scored is not None:
                scored.add(n)
            i, j = np.nonzero(best.astype(float) > -np.inf)
            out["query_id"] += qid[i].tolist()
            out["vec_id"] += names[i, j].tolist()
            out["score"] += [max(-LONG, min(LONG, int(x))) for x in best[i, j]]
        return pa.table({k: pa.array(x, pa.int64()) for k, x in out.items()})

    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(run, "query_id long, vec_id long, score long")
