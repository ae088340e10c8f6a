"""Whole-text token ids by the tokenizers library, at the speed of a table lookup.

A byte-pair tokenizer never merges across its own pre-token boundaries, so a text can be cut where such a boundary is
certain and the parts encoded apart. Two kinds of tokenizer file are cut that way:

* byte level, white space leads the word: a cut before each run of spaces and line feeds;
* white space dropped: a cut at spaces and line feeds, which go.

All parts of a block of texts are looked up at once, in numpy, in two tables of fixed size that the worker keeps: a row
is a part's key (its first sixteen bytes; of longer parts the first eight and a hash of the rest), its number of ids and
the ids. A part that is not there is encoded by the library and stored: in its row of the first table if that is free,
so that the common words, which come early, stay; else in its row of the second, in place of what was there. Parts whose end the library's own regular expressions
might class otherwise make their text go to the library whole, as do all texts under any other kind of file.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

UNSURE = re.compile("[\x1c-\x1f\x85᠎​-‍﻿]")
PLAIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:]?)")
SLOTS, WIDE, LONGEST = 1 << 20, 11, 96
KEY, COUNT, IDS = slice(0, 4), 4, slice(5, 5 + WIDE)
#: Keeps the first 0 to 8 bytes of a little-endian word.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def public_path(name: str) -> str:
    """Where this machine keeps a public tokenizer file; every executor asks for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class CachedTokenizer:
    """ids(texts): little-endian unsigned 32-bit ids of each text, as bytes, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.kind = "leading"
        elif pre.get("type") == "Sequence" and [pre["pretokenizers"][0].get(k) for k in ("invert", "behavior")] == [True, "Removed"] and "Lowercase" in json.dumps(norm):
            self.kind = "dropped"
        else:
            self.kind = "whole"
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = _byte_letters()
        rng = np.random.default_rng(1)
        self.power = rng.integers(1, 1 << 62, LONGEST, np.uint64) * np.uint64(2) + np.uint64(1)
        self.table, self.second = (np.zeros((n, 5 + WIDE), np.uint32) for n in (SLOTS, SLOTS // 2))
        self.tails: dict[str, list[int]] = {}

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, parts: list[str]) -> list[list[int] | None]:
        """Ids of each part; None where the part's end is not certain to be a boundary."""
        out: list[list[int] | None] = [None] * len(parts)
        plain, stems, other = [], [], []
        dropped = self.kind == "dropped"
        for k, part in enumerate(parts):
            if m := PLAIN.fullmatch(part):
                space, word, tail = m.groups()
                plain.append((k, tail))
                stem = word.lower() if dropped else space + word
                # Letters of ASCII stand for themselves.
                stems.append(stem if dropped and stem.isascii() else stem.encode().decode("latin1").translate(self.letters))
            elif dropped or not (UNSURE.search(part) or (part[-1].isspace() and part.strip(" \n"))):
                other.append(k)
        for k, ids in zip(other, self._whole([parts[k] for k in other]), strict=True):
            out[k] = ids
        unique = {s: n for n, s in enumerate(dict.fromkeys(stems))}
        names = list(unique)
        held: list[list[int]] = []
        for lo in range(0, len(names), 200):
            e = self.model.encode(" ".join(names[lo : lo + 200]), add_special_tokens=False)
            ids, cuts = e.ids, np.flatnonzero(np.diff(np.array(e.word_ids), prepend=-1, append=-2))
            held += [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for (k, tail), stem in zip(plain, stems, strict=True):
            if tail and tail not in self.tails:
                self.tails[tail] = self._whole([tail])[0]
            out[k] = held[unique[stem]] + self.tails[tail] if tail else held[unique[stem]]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.kind == "whole":
            return [np.array(x, "<u4").tobytes() for x in self._whole(texts)]
        out, lo = [], 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and held < 100_000:
                held += len(texts[hi])
                hi += 1
            out += self._block(texts[lo:hi])
            lo = hi
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        # A line feed stands between texts, so that a cut lies there; in the leading kind it is no part of any text.
        joined = b"\n".join(raw) + b"\n"
        padded = joined + bytes(16)
        buf = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(r) for r in raw], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        blank = (buf == 32) | (buf == 10)
        joint = np.zeros(len(buf), bool)
        joint[first + sizes] = True
        if self.kind == "leading":
            begin = blank & ~np.concatenate([[True], blank[:-1]])
            begin |= joint
            begin[first] = True
            start = np.flatnonzero(begin)
            stop = np.append(start[1:], len(buf))
            keep = ~joint[start]
            start, stop = start[keep], stop[keep]
        else:
            start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
            stop = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
        size = stop - start
        n = len(start)
        if not n:
            return [b""] * len(texts)
        long = size > LONGEST
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        k0 = eight[start] & FIRST[np.minimum(size, 8)]
        k1 = eight[start + 8] & FIRST[np.clip(size - 8, 0, 8)]
        rest = np.flatnonzero(size > 16)
        if len(rest):
            cut = np.minimum(size[rest], LONGEST) - 8
            edge = np.cumsum(cut) - cut
            nth = np.arange(int(cut.sum())) - np.repeat(edge, cut)
            byte = buf[np.repeat(start[rest] + 8, cut) + nth].astype(np.uint64) + np.uint64(1)
            k1[rest] = np.add.reduceat(byte * self.power[nth], edge)
        mixed = (k0 * np.uint64(0x9E3779B97F4A7C15) ^ k1 * np.uint64(0xC2B2AE3D27D4EB4F) ^ k1 >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
        slot, other = (mixed >> np.uint64(40)).astype(np.int64) % SLOTS, (mixed >> np.uint64(20)).astype(np.int64) % (SLOTS // 2)
        found_rows = self.table[slot]

        def missing(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            key = rows[:, KEY].copy().view(np.uint64)
            return (key[:, 0] != k0[at]) | (key[:, 1] != k1[at]) | (rows[:, COUNT] >> 16 != size[at])

        missed = np.flatnonzero(missing(found_rows, slice(None)) | long)
        if len(missed):
            again = self.second[other[missed]]
            absent = missing(again, missed) | long[missed]
            found_rows[missed[~absent]] = again[~absent]
            missed = missed[absent]
        row, count = found_rows[:, IDS], (found_rows[:, COUNT] & 0xFFFF).astype(np.int64)
        apart: dict[int, list[int] | None] = {}
        if len(missed):
            mv = memoryview(buf)
            names = [bytes(mv[start[k] : stop[k]]) for k in missed]
            unique = {b: u for u, b in enumerate(dict.fromkeys(names))}
            found = self._encode([b.decode() for b in unique])
            which = np.array([unique[b] for b in names])
            lens = np.array([-1 if x is None else len(x) for x in found])
            table = np.zeros((len(found), WIDE), np.uint32)
            held = np.where(lens <= WIDE, np.maximum(lens, 0), 0)
            table[np.arange(WIDE) < held[:, None]] = list(chain.from_iterable(x for x in found if x is not None and len(x) <= WIDE))
            row[missed], count[missed] = table[which], lens[which]
            # Beside the count stands the part's length, without which a part and one with zero bytes after it were alike.
            fit = missed[(lens[which] >= 0) & (lens[which] <= WIDE) & ~long[missed]]
            fresh = np.empty((len(fit), 5 + WIDE), np.uint32)
            fresh[:, KEY] = np.stack([k0[fit], k1[fit]], 1).view(np.uint32)
            fresh[:, COUNT], fresh[:, IDS] = size[fit] << 16 | count[fit], row[fit]
            free = self.table[slot[fit], COUNT] == 0
            self.table[slot[fit[free]]] = fresh[free]
            self.second[other[fit[~free]]] = fresh[~free]
            odd = (lens[which] < 0) | (lens[which] > WIDE)
            for k, u in zip(missed[odd].tolist(), which[odd].tolist(), strict=True):
                apart[k] = found[u]
        length = np.maximum(count, 0)
        place = np.cumsum(length) - length
        flat = np.empty(int(length.sum()), "<u4")
        if apart:
            normal = np.ones(len(flat), bool)
            width = length.copy()
            for k, ids in apart.items():
                if ids:
                    flat[place[k] : place[k] + len(ids)] = ids
                    normal[place[k] : place[k] + len(ids)] = False
                width[k] = 0
            flat[normal] = row[np.arange(WIDE) < width[:, None]]
        else:
            flat[:] = row[np.arange(WIDE) < length[:, None]]
        # Where each text's parts begin, and so its ids.
        begins = np.searchsorted(start, first)
        ends = np.append(np.append(place, len(flat))[np.append(begins[1:], n)], 0)[:-1]
        starts = np.append(0, ends[:-1])
        out = [flat[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for i in {int(np.searchsorted(first, start[k], "right")) - 1 for k, ids in apart.items() if ids is None}:
            out[i] = np.array(self._whole([texts[i]])[0], "<u4").tobytes()
        return out


_loaded: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """One per worker process, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = CachedTokenizer(path)
    return _loaded[path]
