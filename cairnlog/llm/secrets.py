"""Secret scans: fixed patterns, and novelty as measured by a primed compressor.

The compressor is zstandard, primed with a dictionary of code words and of the identifiers that are most common in the
corpus itself (counted over all its texts). A candidate is a run of characters that keys are written with, long enough;
a run is cut at each '=' that does not pad its end, so that a value stands without its name. It must be of letters and
digits mixed, or of letters whose case changes as no written word's does; a value whose own name is sensitive may be of
any. A candidate's marginal size is what it adds, in bytes, to the compressed text around it. One that hardly compresses
(its marginal bits a character reach ``bits``) and that has a word of a sensitive context in its name or shortly before
or after it is reported, without what a pattern has already. Long candidates are measured, and reported, in pieces.

Defined results: a null text counts as empty and has no secret; very long texts are scanned whole; repeated rows each get
theirs; an empty table gives no rows; where spans overlap both are given (redact() replaces them as one); other columns
than doc_id and text are not read by scan() and kept by redact(), whatever their names. Spans are code points of the
text, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices

# The three base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

LEAST = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
SENSITIVE = re.compile(r"password|passwd|pass[ _-]?phrase|passcode|pwd|secret|token|api[_-]?key|apikey|auth|credential|bearer|private|access|signature|session|cookie|(?<![a-z0-9])key(?![a-z0-9])", re.I | re.A)

#: Identifiers and code words that common text around a secret is made of.
IDENTIFIERS = " ".join(
    """abstract access account action address admin api app apply args array async auth await base bearer bool boolean
    break bucket buffer build cache call case catch char class client cloud code column commit config connect const
    constructor content context continue cookie count create credential data database date debug decode default delete
    deploy description dict docker double email enabled encode endpoint enum environment error event except export
    extends false field file filter final finally float for format from function get global group handler hash header
    host http https id if import include index init input insert int interface is item join json key kind lambda len
    length let license list load local log login long main map message method mode model module name namespace new next
    node none null number object option options order output package param parse password path payload port post prefix
    print private process profile property protected public query range raise read redirect region register release
    repository request require response result return role route row run save schema script secret select self server
    service session set shell signature size source spec start state static status stdin stdout string struct super
    switch sync table tag target task test text this throw time timeout timestamp title token true try type uint undefined
    update upload url user username uuid value var vector version view void while with write yaml yield""".split()
)
#: Names in front of an assignment, a call or a key's colon; shorter than any candidate, so that none is learnt whole.
NAME = r"(?<![A-Za-z0-9_])([A-Za-z_]{4,15})(?=[\"']?\x20?[=:(])"


@dataclass(frozen=True)
class Settings:
    bits: float = 4.5
    around: int = 256
    before: int = 48
    after: int = 48
    longest: int = 4096
    identifiers: int = 1500


class Novelty:
    """Marginal compressed size under the identifier dictionary; learnt: the corpus's own, most common first."""

    def __init__(self, s: Settings = Settings(), learnt: tuple[str, ...] = ()):
        self.s = s
        # What stands last in a dictionary is the cheapest to refer to.
        words = zstandard.ZstdCompressionDict(" ".join([*learnt[::-1], IDENTIFIERS]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=3)
        self.size = lambda data, c=zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=False, write_checksum=False): len(c.compress(data))

    def bits(self, text: str, start: int, end: int) -> float:
        """Bits that each character of the span adds to its surroundings."""
        left = text[max(0, start - self.s.around) : start]
        right = text[end : end + self.s.around]
        part = text[start : min(end, start + self.s.longest)]
        return 8 * (self.size((left + part + right).encode()) - self.size((left + right).encode())) / len(part)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost non-overlapping by kind, then those too short go."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def parts(run: str) -> list[tuple[int, int, int]]:
    """(name, start, end) of what stands between the '=' of a run; name: where the part before it starts, or start.

    What pads the run's end stays with the last part."""
    out, name, last = [], -1, len(run.rstrip("="))
    for m in re.finditer("[^=]+", run):
        a, b = m.span()
        out.append((a if name < 0 else name, a, b if b < last else len(run)))
        name = a
    return out


def uncovered(a: int, b: int, covers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of a to b the covers (apart and in order) leave."""
    out = []
    for lo, hi in covers:
        if a < min(lo, b):
            out.append((a, min(lo, b)))
        a = max(a, hi)
    return [*out, (a, b)] if a < b else out


def mixed(run: str) -> bool:
    """Letters and digits, or letters whose case goes up more often than from word to word."""
    if not re.search("[A-Za-z]", run):
        return False
    return bool(re.search("[0-9]", run)) or len(re.findall("[a-z][A-Z]", run)) >= max(3, 0.17 * len(run))


def novel_pieces(text: str, a: int, b: int, novelty: Novelty) -> list[tuple[int, int]]:
    """What of a candidate reaches the bound, in even pieces of the longest size at most; neighbours are put together."""
    n = -(-(b - a) // novelty.s.longest)
    out: list[tuple[int, int]] = []
    for k in range(n):
        lo, hi = a + (b - a) * k // n, a + (b - a) * (k + 1) // n
        if novelty.bits(text, lo, hi) >= novelty.s.bits:
            out[-1:] = [(out[-1][0], hi)] if out and out[-1][1] == lo else [*out[-1:], (lo, hi)]
    return out


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible candidates in a sensitive context, without what base spans cover."""
    found, k = [], 0
    covers: list[tuple[int, int]] = []
    for a, _, b in sorted(base):
        covers[-1:] = [(covers[-1][0], max(b, covers[-1][1]))] if covers and a <= covers[-1][1] else [*covers[-1:], (a, b)]
    for m in RUN.finditer(text):
        for name, a, b in parts(m[0]):
            name, a, b = name + m.start(), a + m.start(), b + m.start()
            if b - a < LEAST:
                continue
            own = SENSITIVE.search(text, name, a)
            if not own and not mixed(text[a:b]):
                continue
            while k < len(covers) and covers[k][1] <= a:
                k += 1
            end = k
            while end < len(covers) and covers[end][0] < b:
                end += 1
            if not uncovered(a, b, covers[k:end]):
                continue
            if own or SENSITIVE.search(text, max(0, a - novelty.s.before), a) or SENSITIVE.search(text, b, b + novelty.s.after):
                found += [(x, 3, y) for lo, hi in novel_pieces(text, a, b, novelty) for x, y in uncovered(lo, hi, covers[k:end])]
    return found


def spans(text: str | None, novelty: Novelty) -> list[tuple[int, int, int]]:
    text = text or ""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty))


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def identifiers(docs: DataFrame, s: Settings = Settings()) -> tuple[str, ...]:
    """The corpus's most common names, by how often they stand in all texts; s.identifiers of them at most."""
    names = only(docs, "text").select(F.explode(F.regexp_extract_all("text", F.lit(NAME), F.lit(1))).alias("name"))
    counts = names.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")
    return tuple(r.name for r in counts.orderBy(F.desc("n"), "name").limit(s.identifiers).collect())


def scan(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, found) for every row: found is the array of (kind, start, end, secret, bits)."""
    schema = "doc_id long, found array<struct<kind: string, start: long, end: long, secret: string, bits: double>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string()), ("bits", pa.float64())]))

    learnt = identifiers(docs, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(s, learnt)
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                out.append([{"kind": KINDS[k], "start": a, "end": b, "secret": text[a:b], "bits": novelty.bits(text, a, b)} for a, k, b in spans(text, novelty)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "found"])

    return only(docs, "doc_id", "text").mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the base spans' SHA-256 and all spans in writing, from scan()'s rows."""
    as_text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"] != "novel")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"), count("novel").alias("n_novel")
    )


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """text with every span (overlapping ones together) replaced by [SECRET]."""
    out, at = [], 0
    for a, _, b in found:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with the secrets in text replaced; n_chars, where there is one, follows. No row goes."""

    learnt = identifiers(docs, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(s, learnt)
        for batch in slices(batches):
            texts = [t if t is None else redacted(t, spans(t, novelty)) for t in batch.column("text").to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kept = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNull() | F.col("text").isNull(), F.col("n_chars")).otherwise(kept))
    return out
