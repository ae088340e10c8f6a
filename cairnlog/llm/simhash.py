"""SimHash near-duplicates: a binary trie self-join over fingerprints.

Distinct fingerprints alone are joined; copies of a text cost one row. Two fingerprints within ``budget`` bits agree in
full on one of budget + 1 blocks of bits. Each fingerprint is written once for each block, rotated so that the block
leads, and fingerprints of one leading block make one trie. Inside a trie pairs of nodes are walked down together: a
pair carries the bits in which its paths differ so far and goes when they exceed the budget. A trie of more than
``held`` fingerprints (a few megabytes) is dealt out as pairs of its parts, so no task needs all of it.

What a task finds goes out as a forest (each fingerprint to the least one it hangs together with), which keeps every
connection without every pair.

Defined results: a null or empty text has fingerprint zero and links like any other; a null id is no component's id
(a component of null ids alone has a null one); repeated rows share a fingerprint and so a component; very long texts
count whole; an empty table gives no rows; near_duplicates() reads doc_id and text alone, least_of_each() keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, slices, stored
from .components import components, forest

BITS = 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the hashes of all shingles, repeats included. Only A-Z are lower-cased."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    stop = ends[min(words, len(parts)) - 1 :].tolist()
    start = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip(start, stop, strict=True)], "<u8"))


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is 1 where it is set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 8192):
        ones += np.unpackbits(h[lo : lo + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def trie_pairs(values: np.ndarray, tries: np.ndarray, others: np.ndarray | None, depth: int, budget: int, room: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs within the budget. values: sorted within each trie's range. tries: rows (lo, hi).

    others: for tries that are met with another one, its range; elsewhere the trie is met with itself. The leading
    ``depth`` bits are equal within and between the ranges."""
    ones = {}
    stack = [(depth, tries[:, 0], tries[:, 1], others[:, 0], others[:, 1], np.zeros(len(tries), np.int8))] if len(tries) else []
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while stack:
        d, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > room:
            for lo in range(0, len(alo), room):
                stack.append(tuple([d, *(x[lo : lo + room] for x in (alo, ahi, blo, bhi, diff))]))
            continue
        same = alo == blo
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if d == BITS or single.any():
            if d == BITS:
                single[:] = True
            at = single & ~same
            a, b = alo[at], blo[at]
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            left.append(a[near])
            right.append(b[near])
            go = ~single
            alo, ahi, blo, bhi, diff, same = (x[go] for x in (alo, ahi, blo, bhi, diff, same))
        if not len(alo):
            continue
        if d not in ones:
            bit = (values >> np.uint64(BITS - 1 - d) & np.uint64(1)).astype(np.int64)
            ones[d] = np.concatenate([[0], np.cumsum(bit)])
        c = ones[d]
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        # Below a node met with itself the two mixed pairs are one.
        parts = [(alo, am, blo, bm, diff, np.ones(len(alo), bool)), (am, ahi, bm, bhi, diff, np.ones(len(alo), bool)), (alo, am, bm, bhi, diff + 1, diff < budget), (am, ahi, blo, bm, diff + 1, ~same & (diff < budget))]
        below = []
        for x0, x1, y0, y1, e, ok in parts:
            ok = ok & (x1 > x0) & (y1 > y0) & ~((x0 == y0) & (x1 - x0 == 1))
            below.append(tuple(x[ok] for x in (x0, x1, y0, y1, e)))
        merged = [np.concatenate(x) for x in zip(*below, strict=True)]
        if len(merged[0]):
            stack.append((d + 1, *merged))
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, budget: int = 3, held: int = 200_000) -> DataFrame:
    """(a, b): links that connect exactly what fingerprints within the budget connect. distinct: column fp, no repeats."""
    width = BITS // (budget + 1)
    turned = [F.struct(F.lit(k).alias("block"), F.shiftleft("fp", k * width).bitwiseOR(F.shiftrightunsigned("fp", BITS - k * width) if k else F.lit(0).cast("long")).alias("turned")) for k in range(budget + 1)]
    rows = distinct.select(F.explode(F.array(*turned)).alias("x")).select("x.block", "x.turned", F.shiftrightunsigned("x.turned", BITS - width).alias("lead"))
    sizes = rows.groupBy("block", "lead").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > held).select(F.col("block").alias("_b"), F.col("lead").alias("_l"), F.ceil(F.col("n") / held).cast("int").alias("parts"))
    dealt = rows.join(large, (F.col("block") == F.col("_b")) & (F.col("lead") == F.col("_l")), "left").drop("_b", "_l")
    own = F.pmod(F.xxhash64("turned"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("block", "lead", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("second"), "turned")

    def meet(group: np.ndarray, second: np.ndarray, block: np.ndarray, cross: np.ndarray, turned: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])]))
        stop = np.append(edge[1:], len(turned))
        first = ~second[edge]
        alone = first & ~cross[edge]
        pair = np.flatnonzero(first[:-1] & ~first[1:] & (group[edge[:-1]] == group[edge[1:]])) if len(edge) > 1 else np.zeros(0, np.int64)
        tries = np.concatenate([np.stack([edge[alone], stop[alone]], 1), np.stack([edge[pair], stop[pair]], 1)])
        others = np.concatenate([np.stack([edge[alone], stop[alone]], 1), np.stack([edge[pair + 1], stop[pair + 1]], 1)])
        more = tries[:, 1] - tries[:, 0] > 1
        more |= tries[:, 0] != others[:, 0]
        a, b = trie_pairs(turned, tries[more], others[more], width, budget)
        root = forest(len(turned), a, b)
        node = np.flatnonzero(root != np.arange(len(turned)))
        turn = (block * width).astype(np.uint64)
        back = turned >> turn | np.where(turn > 0, turned << ((np.uint64(BITS) - turn) % np.uint64(BITS)), np.uint64(0))
        return pa.RecordBatch.from_arrays([pa.array(back[node].view(np.int64)), pa.array(back[root[node]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups at a time: what the last batch may not have ended waits for the next."""
        wait: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "lead", "p", "q", "second", "turned")]
            block, lead, p, q, second, turned = cols
            now = [block.astype(np.int64), lead.astype(np.int64), p.astype(np.int64), q.astype(np.int64), second.astype(bool), turned.astype(np.int64).view(np.uint64)]
            wait = now if wait is None else [np.concatenate(x) for x in zip(wait, now, strict=True)]
            if len(wait[0]) < 100_000:
                continue
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in wait[:4]], axis=0))
            if len(change):
                done = change[-1] + 1
                yield go([x[:done] for x in wait])
                wait = [x[done:] for x in wait]
        if wait is not None and len(wait[0]):
            yield go(wait)

    def go(cols: list[np.ndarray]) -> pa.RecordBatch:
        block, lead, p, q, second, turned = cols
        order = np.lexsort((turned, second, q, p, lead, block))
        block, lead, p, q, second, turned = (x[order] for x in (block, lead, p, q, second, turned))
        group = np.cumsum(np.concatenate([[0], np.any([x[1:] != x[:-1] for x in (block, lead, p, q)], axis=0)]))
        return meet(group, second, block, p != q, turned)

    keyed = dealt.repartition("block", "lead", "p", "q").sortWithinPartitions("block", "lead", "p", "q")
    return keyed.mapInArrow(run, "a long, b long").distinct()


def classes(fps: DataFrame, budget: int = 3) -> DataFrame:
    """(fp, component_id, copies) for every fingerprint of fps (doc_id, fp): the least id that links reach."""
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "simhash-reps")
    roots = components(links(reps.select("fp"), budget))
    known = roots.join(reps, roots["node"] == reps["fp"]).select("node", "root", "rep")
    least = known.groupBy("root").agg(F.min("rep").alias("component_id")).withColumnRenamed("root", "_r")
    named = known.join(least, F.col("root") == F.col("_r")).select("node", "component_id")
    linked = reps.join(named, F.col("fp") == F.col("node"), "left")
    return linked.select("fp", F.when(F.col("node").isNotNull(), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"), "copies")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, budget: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    fps = stored(fingerprints(docs, words, seed), "simhash-docs")
    # Written first, so that the join below reads both sides plainly and adaptive execution can split a hot fingerprint.
    found = stored(classes(fps, budget), "simhash-named").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(found, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, seed: int = 42, budget: int = 3) -> DataFrame:
    """docs with one row of each class left, the one of least id; rows without an id stay. Columns are those of docs."""
    return least_of_each(docs, near_duplicates(docs, words, seed, budget))


def least_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of docs that one_of_each leaves, by the classes (doc_id, component_id) of its rows.

    Rows without an id stay. Of rows that repeat an id the one of the least text stays (then the least as JSON); it is
    found by a pre-aggregated minimum, so an id that very many rows share is not gathered."""
    found = stored(classes.filter("doc_id IS NOT NULL").select("doc_id", "component_id"), "simhash-classes")
    own = F.max(F.col("doc_id") == F.col("component_id"))
    keep = found.groupBy(F.col("doc_id").alias("_keep")).agg(F.count("*").alias("_rows"), own.alias("_own")).filter("_own").drop("_own")
    named, nameless = docs.filter(F.col("doc_id").isNotNull()), docs.filter(F.col("doc_id").isNull())
    once = named.join(keep.filter("_rows = 1"), F.col("doc_id") == F.col("_keep"), "left_semi")
    if keep.filter("_rows > 1").isEmpty():
        return once.unionByName(nameless)
    again = named.join(keep.filter("_rows > 1"), F.col("doc_id") == F.col("_keep"), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = again.select(F.col("doc_id").alias("_id"), whole.alias("_row"), F.struct("text", F.to_json(whole)).alias("_by")).groupBy("_id").agg(F.min_by("_row", "_by").alias("_row"))
    return once.unionByName(least.select("_row.*")).unionByName(nameless)
