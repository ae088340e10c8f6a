"""Near copies: SimHash links first, then every other pair of a Jaccard similarity of 4/5 or more in five-word shingles.

Fingerprints of the shingles are joined by simhash's trie; what it links is checked exactly and joined. 64 bits tell
texts of a similarity of 0.97 and more apart from others, not those of 0.8, so the rest is found by an exact set join:
in any one order of all shingles, the first n - ceil(4n/5) + k of a set of n hold k that the other's first ones hold
too (prefix filtering). With k a tenth of the set, a set fewer of whose first shingles occur in any other set has no
similar one; then the first n - ceil(4n/5) + 1 are enough to meet. The order puts the shingles that are common in a
sample last; it decides the cost alone.

Texts that share such a shingle are met in rounds. While lists of a shingle hold many pairs that no link joins yet, each
list's texts are checked against one of them only; what is then joined needs no further check, so a large group of near
copies costs no square of its size. In the last rounds every pair of a list that is still apart is compared by parity
bitmaps of the sets, whose difference is at most that of the sets themselves, and what these do not rule out is checked:
all such pairs of a list, or, where they are more than its rows, the nearest one that leaves each class, and again until
none is left over (all of them at last, should a round join nothing). Lists are dealt out as pairs of their parts, so no
task needs all of a long one.

Defined results: texts without a word are copies of each other; a text of fewer than five words is one shingle; texts
are read whole, however long; a null id is no component's id (a component of null ids alone has a null one); an empty
table gives no rows; other columns than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import BROADCAST_GROUPS, forget, only, slices, stored
from .components import components

WORDS = 5
#: The documents and shingles that the order is made from.
SAMPLE, COMMON = 20_000, 200_000
#: Bits of a parity bitmap, and rows of a list that one side of a comparison holds (some three megabytes).
PARITY, PART = 1024, 20_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles. Only A-Z are lower-cased."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    stop = ends[min(words, len(parts)) - 1 :].tolist()
    start = [0, *(ends[: max(1, len(parts) - words + 1) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(start, stop, strict=True)], np.uint64))


def key(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which a similar set's prefix holds one. common: sorted; rank: their places behind all others."""
    n = len(found)
    if not n:
        return found
    at = np.minimum(np.searchsorted(common, found), max(0, len(common) - 1))
    place = np.where(common[at] == found, rank[at] + 1, 0) if len(common) else np.zeros(n, np.int64)
    return found[np.lexsort((found, place))[: n - (4 * n + 4) // 5 + 1 + n // 10]]


def least_shared(n: int | Column) -> int | Column:
    """How many shingles the prefixes of a set of n and of any similar set share at least (its size is 4n/5 or more)."""
    least = F.floor((4 * n + 4) / 5) if isinstance(n, Column) else (4 * n + 4) // 5
    return 1 + (F.floor(least / 10) if isinstance(n, Column) else least // 10)


def parity(found: np.ndarray) -> bytes:
    """For each of PARITY bits whether an odd number of the set's hashes fall on it. A shingle that one of two sets has
    alone turns one bit, so two bitmaps differ in no more bits than their sets do in shingles."""
    return np.packbits(np.bincount((found % PARITY).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1).tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several documents of a sample have, and their order, the most common last."""
    total, room = docs.count(), 1 << 30
    near = only(docs, "doc_id", "text")
    if total > SAMPLE:
        near = near.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(room)) < room * SAMPLE // total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["shingle"])

    counts = near.select("text").distinct().mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    rows = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    value, n = rows.column("shingle").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(value)
    rank = np.empty(len(value), np.int64)
    rank[np.lexsort((value, n))] = np.arange(len(value))
    return value[order], rank[order]


def sets_of(docs: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, key, n, fp, prefix) for every row: the set of shingles by a hash, its size, fingerprint and prefix."""
    held = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = held.value
        for batch in slices(batches):
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            heads = [prefix(x, common, rank) for x in found]
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            heads = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *heads]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([key(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int32()), pa.array(np.array([simhash.majority(x) for x in found], np.uint64).view(np.int64)), heads], names=["doc_id", "key", "n", "fp", "prefix"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, key long, n int, fp long, prefix array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles, bits) of the sets wanted (rep, key, id), read from the rows of their documents; bits: parity."""
    ids = wanted.select(F.col("rep").alias("_rep")).filter("_rep IS NOT NULL").distinct()
    if wanted.count() <= BROADCAST_GROUPS:
        ids = F.broadcast(ids)
    texts = only(docs, "doc_id", "text")
    rows = texts.join(ids, F.col("doc_id") == F.col("_rep"), "left_semi").unionByName(texts.filter("doc_id IS NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([key(x) for x in found], pa.int64()), sets, pa.array([parity(x) for x in found], pa.binary())], names=["key", "shingles", "bits"])

    found = rows.mapInArrow(run, "key long, shingles array<long>, bits binary")
    named = found.join(wanted.select(F.col("key").alias("_key"), "id"), F.col("key") == F.col("_key"))
    return named.groupBy("id").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits"))


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose sets are similar. They are intersected in the JVM: whole sets, twice for each pair,
    would fill the Arrow batches of 10,000 rows, which both sides of the way to Python hold at once."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    # Similar: 5 common >= 4 (|x| + |y| - common).
    return two.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def simhash_links(reps: DataFrame, whole: DataFrame, budget: int = 3) -> DataFrame:
    """(a, b): links of ids whose fingerprints the trie join connects and whose sets are similar."""
    first = stored(reps.groupBy("fp").agg(F.min("id").alias("first")), "near-prints")
    alike = reps.join(first.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).filter(F.col("id") > F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"))
    of = lambda name: first.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_id"))
    near = simhash.links(first.select("fp"), budget).join(of("a"), "a").join(of("b"), "b")
    pairs = alike.unionByName(near.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")))
    found = stored(checked(pairs.distinct(), whole), "near-links")
    forget(first)
    return found


def compared(n: np.ndarray, kind: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The bits in which pairs of positions differ, over |A| + |B|; infinite where they are of one class or ruled out:
    sizes not within 4/5, or 9 |A - B| > |A| + |B| by the bits alone."""
    out = np.full(len(i), np.inf)
    at = np.flatnonzero((kind[i] != kind[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])))
    for lo in range(0, len(at), 1 << 16):
        part = at[lo : lo + (1 << 16)]
        apart, both = np.bitwise_count(bits[i[part]] ^ bits[j[part]]).sum(1, dtype=np.int64), n[i[part]] + n[j[part]]
        out[part] = np.where(9 * apart <= both, apart / np.maximum(both, 1), np.inf)
    return out


class Nearest:
    """Of the pairs of a group's rows: all of them while they are no more than the rows; beyond, for each class the
    nearest pair that leaves it, so that neither memory nor what goes out grows with the square of the group."""

    def __init__(self, kind: np.ndarray, room: int):
        self.of, self.room, self.count = np.unique(kind, return_inverse=True)[1], room, 0
        self.all: list[tuple[np.ndarray, np.ndarray]] | None = []
        k = self.of.max() + 1
        self.near, self.a, self.b = np.full(k, np.inf), np.zeros(k, np.int64), np.zeros(k, np.int64)

    def add(self, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> None:
        good = np.isfinite(apart)
        i, j, apart = i[good], j[good], apart[good]
        if not len(i):
            return
        self.count += len(i)
        if self.all is not None:
            self.all.append((i, j))
            if self.count > self.room:
                self.all = None
        for side in (i, j):
            c = self.of[side]
            order = np.lexsort((apart, c))
            first = order[np.concatenate([[True], c[order][1:] != c[order][:-1]])]
            first = first[apart[first] < self.near[c[first]]]
            self.near[c[first]], self.a[c[first]], self.b[c[first]] = apart[first], i[first], j[first]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, bool]:
        if self.all is not None:
            return *(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*self.all, strict=True) if self.all else ((), ()))), True
        ok = np.isfinite(self.near)
        return self.a[ok], self.b[ok], False


def pairs_within(group: np.ndarray, second: np.ndarray, cross: np.ndarray, ids: np.ndarray, n: np.ndarray, kind: np.ndarray, bits: np.ndarray, every: bool = False, small: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the pairs of each group that compared() lets through, and whether they are all of their group's. Groups are
    runs of rows; where cross, rows of the first part meet those of the second alone. every: all pairs in any case."""
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(edge, len(group)))
    left, right, whole = [], [], []

    def give(i: np.ndarray, j: np.ndarray, all_: bool) -> None:
        left.append(ids[i])
        right.append(ids[j])
        whole.append(np.full(len(i), all_))

    few = np.repeat((size <= small) & ~cross[edge], size)
    for step in range(1, min(small, int(size.max()))):
        i = np.flatnonzero(few[:-step] & (group[step:] == group[:-step]))
        good = np.isfinite(compared(n, kind, bits, i, i + step))
        give(i[good], i[good] + step, True)
    for at, width in zip(edge[(size > small) | cross[edge]].tolist(), size[(size > small) | cross[edge]].tolist(), strict=True):
        rows = np.arange(at, at + width)
        ours, theirs = (rows[~second[rows]], rows[second[rows]]) if cross[at] else (rows, rows)
        theirs = theirs[np.argsort(n[theirs], kind="stable")]
        sizes, nearest = n[theirs], Nearest(kind[rows], width)
        for r in ours.tolist():
            # Sizes within 4/5 are one stretch of those in order.
            lo, hi = np.searchsorted(sizes, [-(-4 * n[r] // 5), 5 * n[r] // 4 + 1])
            j = theirs[lo:hi]
            j = j if cross[at] else j[j > r]
            apart = compared(n, kind, bits, np.full(len(j), r), j)
            if every:
                give(np.full(np.isfinite(apart).sum(), r), j[np.isfinite(apart)], True)
            else:
                nearest.add(np.full(len(j), r - at), j - at, apart)
        if not every:
            i, j, all_ = nearest.pairs()
            give(i + at, j + at, all_)
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right]), np.concatenate([np.zeros(0, bool), *whole])


def not_ruled_out(rows: DataFrame, part: int = 0, every: bool = False) -> DataFrame:
    """(a, b, whole): pairs of one list (rows: shingle, id, n, class, bits) that are of two classes and may be similar.

    Where a list has more of them than rows it gives the nearest pair of each class instead, with whole false (every:
    all the same)."""
    part = part or PART
    sizes = rows.groupBy("shingle").agg(F.count("*").alias("_c")).filter(F.col("_c") > part)
    large = sizes.select(F.col("shingle").alias("_s"), F.ceil(F.col("_c") / part).cast("int").alias("_parts"))
    dealt = rows.join(large, F.col("shingle") == F.col("_s"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.select("shingle", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("second"), "id", "n", "class", "bits")
    keys = ("shingle", "p", "q")

    def go(b: pa.RecordBatch) -> pa.RecordBatch:
        col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c != "bits"}
        bits = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint64).reshape(b.num_rows, PARITY // 64)
        group = np.cumsum(np.concatenate([[0], np.any([col[k][1:] != col[k][:-1] for k in keys], axis=0)]))
        x, y, whole = pairs_within(group, col["second"].astype(bool), col["p"] != col["q"], col["id"], col["n"].astype(np.int64), col["class"], bits, every)
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y), whole.astype(np.int64)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(both[:, 2] == 1)], names=["a", "b", "whole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups at a time: what the last batch may not have ended waits for the next."""
        wait: list[pa.RecordBatch] = []
        for batch in batches:
            wait.append(batch)
            if sum(b.num_rows for b in wait) < 20_000:
                continue
            held = pa.Table.from_batches(wait).combine_chunks().to_batches()[0]
            change = np.flatnonzero(np.any([(c := held.column(k).to_numpy(zero_copy_only=False))[1:] != c[:-1] for k in keys], axis=0))
            wait = [held]
            if len(change):
                yield go(held.slice(0, int(change[-1]) + 1))
                wait = [held.slice(int(change[-1]) + 1)]
        if wait and sum(b.num_rows for b in wait):
            yield go(pa.Table.from_batches(wait).combine_chunks().to_batches()[0])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, whole boolean").distinct()


def with_bits(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """rows (with id) and each id's parity bitmap."""
    return rows.join(whole.select(F.col("id").alias("_b"), "bits"), F.col("id") == F.col("_b")).drop("_b")


def links(docs: DataFrame, sets: DataFrame, reps: DataFrame) -> DataFrame | None:
    """(a, b): links that connect exactly what similar sets connect; None where there are none."""
    distinct = sets.groupBy("key").agg(F.min("row").alias("id"), F.first("prefix").alias("prefix"))
    lists = distinct.select(F.posexplode("prefix").alias("place", "shingle"), "id")
    old: list[DataFrame] = []
    for _ in range(3):
        met = lists.withColumn("_n", F.count("*").over(Window.partitionBy("shingle"))).filter("_n > 1").drop("_n")
        met = stored(met.select("shingle", "id", "place"), "near-met")
        forget(*old)
        old = [met]
        shared = met.groupBy("id").agg(F.count("*").alias("_c")).withColumnRenamed("id", "_i")
        enough = reps.join(shared, F.col("id") == F.col("_i")).filter(F.col("_c") >= least_shared(F.col("n"))).select(F.col("id").alias("_i"), "n")
        lists = met.join(enough, F.col("id") == F.col("_i")).select("shingle", "id", "place", "n")
    # From here on one common shingle is enough to meet.
    lists = stored(lists.filter(F.col("place") <= F.col("n") - F.floor((4 * F.col("n") + 4) / 5)).select("shingle", "id", "n"), "near-lists")
    forget(*old)
    total = lists.count()
    if not total:
        forget(lists)
        return None
    ids = lists.select(F.col("id").alias("_i")).distinct()
    wanted = stored(reps.join(ids, F.col("id") == F.col("_i"), "left_semi").select("rep", "key", "id", "fp"), "near-wanted")
    whole = stored(whole_sets(docs, wanted), "near-sets")
    near = (5 * F.least("n", "m") >= 4 * F.greatest("n", "m")) & (F.col("class") != F.col("other"))
    found, last, step, few, stuck = simhash_links(wanted, whole), None, 0, False, False
    while True:
        roots = components(found).select(F.col("node").alias("_k"), "root")
        now = stored(lists.join(roots, F.col("id") == F.col("_k"), "left").select("shingle", "id", "n", F.coalesce("root", "id").alias("class")), "near-classes")
        # Pairs of rows of a list that are not connected yet.
        parts = now.groupBy("shingle", "class").agg(F.count("*").cast("double").alias("c"))
        apart = parts.groupBy("shingle").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")).filter("s * s > q")
        open_ = apart.agg(F.sum(F.expr("(s * s - q) / 2"))).first()[0]
        few = few or not open_ or open_ <= total or (last is not None and open_ > 0.9 * last)
        if few:
            if not open_:
                forget(now, lists, wanted, whole)
                return found
            left = now.join(apart.select(F.col("shingle").alias("_s")), F.col("shingle") == F.col("_s"), "left_semi")
            near_pairs = stored(not_ruled_out(with_bits(left, whole), every=stuck), "near-pairs")
            more = stored(checked(near_pairs.select("a", "b").distinct(), whole), "near-links")
            found = found.unionByName(more)
            over, stuck = stuck or near_pairs.filter("NOT whole").isEmpty(), more.isEmpty()
            forget(now, near_pairs)
            if over:
                forget(lists, wanted, whole)
                return found
            continue
        mark = F.struct(F.xxhash64("id", F.lit(step)).alias("h"), "id", "n", "class")
        hubs = stored(now.groupBy("shingle").agg(F.min(mark).alias("x")).select("shingle", F.col("x.id").alias("id2"), F.col("x.n").alias("m"), F.col("x.class").alias("other")), "near-hubs")
        pairs = now.join(hubs, "shingle").filter(near).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
        found = found.unionByName(stored(checked(pairs.distinct(), whole), "near-links"))
        forget(now, hubs)
        last, step = open_, step + 1


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of docs: the least id that similar texts reach."""
    sets = stored(sets_of(docs, common_shingles(docs)).withColumn("row", F.monotonically_increasing_id()), "near-docs")
    reps = stored(sets.groupBy("key").agg(F.min("row").alias("id"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp")), "near-reps")
    found = links(docs, sets, reps)
    if found is None:
        named = reps.select(F.col("key").alias("_key"), F.col("rep").alias("component_id"))
    else:
        roots = components(found)
        known = roots.join(reps, F.col("node") == F.col("id")).select("node", "root", "rep")
        least = known.groupBy("root").agg(F.min("rep").alias("component_id")).withColumnRenamed("root", "_r")
        classes = known.join(least, F.col("root") == F.col("_r")).select("node", "component_id")
        linked = reps.join(classes, F.col("id") == F.col("node"), "left")
        named = linked.select(F.col("key").alias("_key"), F.when(F.col("node").isNotNull(), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"))
    # Written first, so that both sides of the join are plain and a hot set can be split.
    named = stored(named, "near-named")
    return sets.select("doc_id", "key").join(named, F.col("key") == F.col("_key")).select("doc_id", "component_id")
