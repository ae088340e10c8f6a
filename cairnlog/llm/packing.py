"""Packing: hierarchical, over several context sizes.

Each document's ids (and an end id) are routed to a tier by length. Long ones give full windows of the longest tier;
what is left of one opens a long window, whose gap is filled from the shorter tiers, largest fitting piece first, the
last one cut to fit. Pieces that no long window takes are packed in their own tier, cut so that every sequence of a
tier is full. Tiers are powers of two, so full sequences hold no padding; only the last sequence of a task is padded.
Full sequences of a tier are grouped into steps of ``step_tokens`` tokens, the same for every tier.

A task packs the rows it reads: no shuffle, no state beyond ``held`` pieces a tier, and a lost task is simply run
again. A sequence id is the task's number in the high bits and a counter in the low ones.

Defined results: a null text counts as empty (its one id is the end id); a null id stays null; repeated rows are
packed as often as they occur; very long texts are packed whole; an empty table gives no rows; other columns than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import only
from .tokens import tokenizer

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_id long"


@dataclass(frozen=True)
class Tiers:
    sizes: tuple[int, ...] = (256, 512, 1024)
    held: int = 64
    step_tokens: int = 16384


class Packer:
    """Packs pieces (document number, start, length) as they come; done sequences go to ``out`` as rows."""

    def __init__(self, tiers: Tiers, task: int):
        self.t, self.top = tiers, tiers.sizes[-1]
        self.base, self.next = task << 36, 0
        self.full = dict.fromkeys(tiers.sizes, 0)
        self.pool = {s: deque() for s in tiers.sizes[:-1]}
        self.open: deque[tuple[list, int]] = deque()
        self.out: list[tuple] = []

    def emit(self, pieces: list, tier: int) -> None:
        sequence, offset = self.base + self.next, 0
        self.next += 1
        per_step = max(1, self.t.step_tokens // tier)
        step = self.base + (self.t.sizes.index(tier) << 32) + self.full[tier] // per_step
        self.full[tier] += 1
        for doc, start, length in pieces:
            self.out.append((doc, start, length, sequence, offset, tier, step))
            offset += length

    def add(self, doc, tokens: int) -> None:
        start = 0
        while tokens - start >= self.top:
            self.emit([(doc, start, self.top)], self.top)
            start += self.top
        if tokens > start:
            self.route((doc, start, tokens - start))

    def route(self, piece: tuple) -> None:
        for size, pool in self.pool.items():
            if piece[2] <= size:
                pool.append(piece)
                if len(pool) > self.t.held:
                    self.pack_tier(size)
                return
        self.open.append(([piece], self.top - piece[2]))
        self.fill()

    def take(self, pool: deque, room: int) -> tuple:
        """The pool's first piece, cut to the room there is; the rest goes back to be routed."""
        doc, start, length = pool.popleft()
        if length > room:
            pool.appendleft((doc, start + room, length - room))
            length = room
        return doc, start, length

    def fill(self) -> None:
        """Close open long windows from the shorter tiers, and by one another where more than held stay open."""
        while self.open:
            pieces, gap = self.open.popleft()
            for size in reversed(self.pool):
                pool = self.pool[size]
                while pool and pool[0][2] <= gap:
                    pieces.append(pool.popleft())
                    gap -= pieces[-1][2]
            for pool in self.pool.values():
                while gap and pool:
                    pieces.append(self.take(pool, gap))
                    gap -= pieces[-1][2]
            if gap and len(self.open) >= self.t.held:
                while gap and self.open:
                    more, _ = self.open.popleft()
                    more = deque(more)
                    while gap and more:
                        pieces.append(self.take(more, gap))
                        gap -= pieces[-1][2]
                    for piece in more:
                        self.pool[self.t.sizes[-2]].append(piece) if piece[2] <= self.t.sizes[-2] else self.open.append(([piece], self.top - piece[2]))
            if gap:
                self.open.appendleft((pieces, gap))
                return
            self.emit(pieces, self.top)

    def pack_tier(self, size: int) -> None:
        """Full sequences of one tier from its own pieces; less than one sequence stays in the pool."""
        pool = self.pool[size]
        while sum(p[2] for p in pool) >= size:
            pieces, room = [], size
            while room:
                pieces.append(self.take(pool, room))
                room -= pieces[-1][2]
            self.emit(pieces, size)

    def close(self) -> None:
        """What is left goes to windows of the longest tier; only the last one is not full."""
        rest = deque(p for pieces, _ in self.open for p in pieces)
        self.open.clear()
        for pool in self.pool.values():
            rest.extend(pool)
            pool.clear()
        while rest:
            pieces, room = [], self.top
            while room and rest:
                pieces.append(self.take(rest, room))
                room -= pieces[-1][2]
            self.emit(pieces, self.top)


def pack(docs: DataFrame, path: str, end_id: int = 0, tiers: Tiers = Tiers()) -> DataFrame:
    """One row per piece of each document: which ids, and where they lie in which sequence of which tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tok = Packer(tiers, TaskContext.get().partitionId()), tokenizer(path)
        end = end_id.to_bytes(4, "little")
        live: dict[int, tuple] = {}
        number = 0

        def rows() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_id")}
            for n, start, length, sequence, offset, tier, step in out:
                doc_id, ids = live[n]
                for k, v in zip(cols, (doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, sequence, offset, tier, step), strict=True):
                    cols[k].append(v)
            kept = {p[0] for pieces, _ in packer.open for p in pieces} | {p[0] for pool in packer.pool.values() for p in pool}
            for n in [n for n in live if n not in kept]:
                del live[n]
            kinds = {"ids": pa.binary(), "tier": pa.int32()}
            return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()})

        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for lo in range(0, len(doc_ids), 256):
                some = [t or "" for t in texts.slice(lo, 256).to_pylist()]
                for doc_id, ids in zip(doc_ids[lo : lo + 256], tok.ids(some), strict=True):
                    live[number] = (doc_id, ids + end)
                    packer.add(number, len(ids) // 4 + 1)
                    number += 1
                yield rows()
        packer.close()
        yield rows()

    return only(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
