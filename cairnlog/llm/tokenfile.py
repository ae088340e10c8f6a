"""Token-ID output: a wavelet matrix per shard.

A shard holds the ids of consecutive documents as bit-planes, most significant bit first; each plane is stably sorted
by the bits before it, and carries counts of ones for every 512 bits. Planes are compressed in chunks, the counts beside
them, so that from the one file a token can be read at any position, counted in any range and found at its k-th
occurrence by reading the header and one chunk of each plane (Shard).

Shards are written as rows of a Parquet table (one binary file a row) in the shared folder: Spark's committer makes a
lost executor harmless, and any store that Spark writes to will do.

Defined results: null texts are empty documents (their end id alone); null ids come first in the order; repeated ids
follow each other in the order of the hashes of their texts; very long texts are whole; an empty table gives no shard and no row.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, shared_dir, slices
from .tokens import tokenizer

MAGIC, BLOCK = b"WVMX2\n", 512
#: Bytes of a plane that are compressed together.
CHUNK = 8192
FILES = "part int, shard int, first_token long, n_tokens long, n_docs long, file binary"


class WaveletMatrix:
    """Succinct sequence of unsigned ids."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self._ranks: dict[int, np.ndarray] = {}

    def counts(self, level: int) -> np.ndarray:
        """Ones in each block of BLOCK bits."""
        per = np.bitwise_count(self.planes[level])
        pad = -len(per) % (BLOCK // 8)
        return np.pad(per, (0, pad)).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint16)

    def ranks(self, level: int) -> np.ndarray:
        """Ones before each block."""
        if level not in self._ranks:
            self._ranks[level] = np.concatenate([[0], np.cumsum(self.counts(level), dtype=np.int64)])
        return self._ranks[level]

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        ids = np.asarray(ids)
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for bit in range(bits - 1, -1, -1):
            one = (now >> bit & 1).astype(bool)
            planes.append(np.packbits(one))
            low = now[~one]
            zeros.append(len(low))
            now = np.concatenate([low, now[one]])
        return cls(len(ids), planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids in order, from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level][:], count=self.n).view(bool)
            up = np.empty(self.n, kind)
            up[~one] = now[: self.zeros[level]]
            up[one] = now[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            now = up
        return now.astype(np.uint32)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        part = self.planes[level][block * BLOCK // 8 : (i + 7) // 8]
        return int(self.ranks(level)[block]) + int(np.unpackbits(part)[: i - block * BLOCK].sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, plane in enumerate(self.planes):
            one = plane[i >> 3] >> (7 - (i & 7)) & 1
            ones = self._ones(level, i)
            value = value << 1 | int(one)
            i = self.zeros[level] + ones if one else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of token in positions lo to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, k from 0; IndexError where there are fewer."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = bool(token >> (len(self.planes) - 1 - level) & 1)
            i = self._nth(level, i - self.zeros[level] if one else i, one)
        return i

    def _nth(self, level: int, k: int, one: bool) -> int:
        """Position of the k-th set (or clear) bit of a plane."""
        ranks = self.ranks(level)
        before = ranks if one else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])


def to_file(matrix: WaveletMatrix, doc_ids: list[int | None], sizes: np.ndarray) -> bytes:
    """Magic, header length, JSON header, then the compressed sections: document ids, sizes, each plane's counts of ones
    (a section a plane), each plane's chunks (a section a chunk)."""
    pack = zstandard.ZstdCompressor(level=1).compress
    nulls = [i for i, d in enumerate(doc_ids) if d is None]
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    levels = range(len(matrix.planes))
    parts = [pack(ids.tobytes()), pack(np.asarray(sizes, "<i8").tobytes()), *(pack(matrix.counts(k).astype("<u2").tobytes()) for k in levels)]
    parts += [pack(p[at : at + CHUNK].tobytes()) for p in matrix.planes for at in range(0, len(p), CHUNK)]
    head = json.dumps({"n": matrix.n, "docs": len(doc_ids), "nulls": nulls, "zeros": matrix.zeros, "sections": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


class Plane:
    """A plane of a file, its chunks read when they are needed."""

    def __init__(self, size: int, chunk: Callable[[int], np.ndarray]):
        self.size, self.chunk = size, chunk

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        if not isinstance(at, slice):
            return self.chunk(at // CHUNK)[at % CHUNK]
        lo, hi, _ = at.indices(self.size)
        parts = [self.chunk(k) for k in range(lo // CHUNK, -(-hi // CHUNK))]
        first = lo // CHUNK * CHUNK
        return np.concatenate([np.zeros(0, np.uint8), *parts])[lo - first : hi - first] if lo < hi else np.zeros(0, np.uint8)


class Shard(WaveletMatrix):
    """A shard's file behind a function that reads (offset, length): access, count and select read what they need."""

    def __init__(self, read: Callable[[int, int], bytes], held: int = 64):
        start = read(0, len(MAGIC) + 4)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        (size,) = struct.unpack("<I", start[len(MAGIC) :])
        self.head = json.loads(read(len(start), size))
        self.at = np.concatenate([[0], np.cumsum(self.head["sections"], dtype=np.int64)]) + len(start) + size
        self.read, n, levels = read, self.head["n"], len(self.head["zeros"])
        width, each = (n + 7) // 8, -(-((n + 7) // 8) // CHUNK)
        self.chunk = lru_cache(held)(lambda k: np.frombuffer(self.section(k), np.uint8))
        super().__init__(n, [Plane(width, lambda k, first=2 + levels + level * each: self.chunk(first + k)) for level in range(levels)], self.head["zeros"])

    def section(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.read(int(self.at[k]), int(self.at[k + 1] - self.at[k])))

    def counts(self, level: int) -> np.ndarray:
        return np.frombuffer(self.section(2 + level), "<u2")

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        doc_ids: list[int | None] = np.frombuffer(self.section(0), "<i8").tolist()
        for i in self.head["nulls"]:
            doc_ids[i] = None
        return doc_ids, np.frombuffer(self.section(1), "<i8")


def from_file(data: bytes) -> tuple[Shard, list[int | None], np.ndarray]:
    shard = Shard(lambda at, n: data[at : at + n])
    return shard, *shard.documents()


def write_shards(docs: DataFrame, path: str, end_id: int, out: str, shard_tokens: int = 1 << 20) -> None:
    """Encode every text and write the shards in ascending doc_id order; a shard closes at shard_tokens ids or more."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = tokenizer(path), TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        tokens, first, shard = 0, 0, 0

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u4"))
            data = to_file(matrix, doc_ids, np.array([len(h) // 4 for h in held], np.int64))
            row = {"part": part, "shard": shard, "first_token": first, "n_tokens": tokens, "n_docs": len(doc_ids), "file": data}
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            texts, ids_of = batch.column("text"), batch.column("doc_id").to_pylist()
            for lo in range(0, len(ids_of), 256):
                some = [t or "" for t in texts.slice(lo, 256).to_pylist()]
                for doc_id, ids in zip(ids_of[lo : lo + 256], tok.ids(some), strict=True):
                    held.append(ids + end)
                    doc_ids.append(doc_id)
                    tokens += len(ids) // 4 + 1
                    if tokens >= shard_tokens:
                        yield close()
                        first, shard = first + tokens, shard + 1
                        held, doc_ids, tokens = [], [], 0
        if doc_ids:
            yield close()

    # The text's hash splits rows that share an id, or have none.
    order = (F.col("doc_id"), F.xxhash64("text"), F.col("text"))
    only(docs, "doc_id", "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(build, FILES).write.parquet(out)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the shards in a folder: its ids (binary, little-endian unsigned 32-bit) and its place."""
    files = spark.read.schema(FILES).parquet(folder)
    # As many rows as the writing stage had tasks: each task's total, to know how many ids lie before it.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    base, before = {}, 0
    for r in sorted(totals, key=lambda r: r.part):
        base[r.part], before = before, before + r.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for part, first, data in zip(*(batch.column(c).to_pylist() for c in ("part", "first_token", "file")), strict=True):
                matrix, doc_ids, sizes = from_file(data)
                ids = matrix.decode().astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                cut = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + (base[part] + first), pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(cut, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return files.select("part", "first_token", "file").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def encode_and_read(docs: DataFrame, path: str, end_id: int, shard_tokens: int = 1 << 20) -> DataFrame:
    """Write the shards to the shared folder and read their documents back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(docs, path, end_id, folder, shard_tokens)
    return read_documents(spark, folder)
