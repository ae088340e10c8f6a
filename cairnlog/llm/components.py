"""Connected components of a link table by alternating large and small stars.

Every round contracts each node's neighbourhood onto its smallest node, then lets tasks of bounded size contract what
links they hold among themselves, and is written to the shared folder. Rounds end when the links no longer change,
which is when each component is a star around its smallest node. Nothing but one sum and one count a round comes to the
driver. A node with very many links meets its minimum by a pre-aggregated shuffle and a plain join, which adaptive
execution splits. Links few enough for one such task need no round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that one task contracts at most (on average, as tasks are merged whole).
HELD = 400_000


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions the least one it hangs together with by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars around the least node of what hangs together in it."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if held:
        ends = np.concatenate([np.concatenate(x) for x in zip(*held, strict=True)])
        nodes, at = np.unique(ends, return_inverse=True)
        label = forest(len(nodes), at[: len(at) // 2], at[len(at) // 2 :])
        out = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[label[out]])], names=["a", "b"])


def _contracted(edges: DataFrame, n: int) -> DataFrame:
    return cut(edges.coalesce(n // HELD + 1).mapInArrow(_contract, "a long, b long").distinct())


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (a, b): b is joined to the smallest of a and all its b.

    The minima are written first: both sides of the join are then plain exchanges, of which a hot one can be split."""
    least = cut(pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")))
    return pairs.join(least, F.col("a") == F.col("k")).select("a", "b", "m")


def _state(edges: DataFrame) -> tuple[int, int]:
    # xxhash64 is cast to decimal so that sums can't overflow.
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return r.n, int(r.h or 0)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): undirected links. Gives (node, root) for every node that has a link; root is the least node."""
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = edges.count()
    edges = _contracted(edges, n)
    # Links that one task of bounded size has held all of are stars already.
    before = _state(edges) if n >= HELD else (0, 0)
    while before[0]:
        large = _star(_both_ways(edges)).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.filter("a <> b").distinct())
        small = _star(large)  # here a > b throughout: each a's neighbours below it
        edges = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        now = _state(edges)
        if now == before:
            break
        edges = _contracted(edges, now[0])
        before = _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
