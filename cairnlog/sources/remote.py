"""Remote reads in the metric protocol: snappy-compressed protobuf requests in, sample series out.

Fixed by the wire format. Request: 1 query; query: 1 start ms, 2 end ms, 3 matcher, 4 hints; matcher: 1 type (0 =, 1 !=,
2 =~, 3 !~), 2 name, 3 value; hints: 1 step ms. Response: 1 result; result: 1 series; series: 1 label, 2 sample; label:
1 name, 2 value; sample: 1 value (double), 2 timestamp ms. Such messages are built whole by one process; their size is
that of the answer, at most one sample for each series and step."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa

from ..plans.temql import Matcher
from .push import _fields, _signed, _snappy

TYPES = ("=", "!=", "=~", "!~")


@dataclass(frozen=True)
class ReadQuery:
    start: int
    end: int
    matchers: tuple[Matcher, ...]
    step: int


def decode_read(data: bytes) -> list[ReadQuery]:
    out = []
    for number, query in _fields(_snappy(data)):
        if number != 1:
            continue
        start = end = step = 0
        matchers = []
        for n, value in _fields(query):
            if n == 1:
                start = _signed(value)
            elif n == 2:
                end = _signed(value)
            elif n == 3:
                m = dict(_fields(value))
                matchers.append(Matcher(m.get(2, b"").decode(), TYPES[m.get(1, 0)], m.get(3, b"").decode()))
            elif n == 4:
                step = _signed(dict(_fields(value)).get(1, 0))
        out.append(ReadQuery(start, end, tuple(matchers), step))
    return out


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _part(number: int, body: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(body)) + body


def encode_read(queries: Iterable[ReadQuery]) -> bytes:
    """The request that decode_read() reads."""
    out = b""
    for q in queries:
        body = varint(8) + varint(q.start) + varint(16) + varint(q.end)
        for m in q.matchers:
            body += _part(3, varint(8) + varint(TYPES.index(m.op)) + _part(2, m.name.encode()) + _part(3, m.value.encode()))
        out += _part(1, body + _part(4, varint(8) + varint(q.step)))
    return pa.compress(out, codec="snappy", asbytes=True)


def encode_response(results: Iterable[Iterable[tuple[dict[str, str], list[tuple[int, float]]]]]) -> bytes:
    """results: for each query its series, each a label set and its samples (ms, value) in order of time."""
    out = []
    for series in results:
        body = []
        for labels, samples in series:
            one = b"".join(_part(1, _part(1, k.encode()) + _part(2, v.encode())) for k, v in sorted(labels.items()))
            one += b"".join(_part(2, b"\x09" + struct.pack("<d", value) + varint(16) + varint(ms)) for ms, value in samples)
            body.append(_part(1, one))
        out.append(_part(1, b"".join(body)))
    return pa.compress(b"".join(out), codec="snappy", asbytes=True)


def decode_response(data: bytes) -> list[list[tuple[dict[str, str], list[tuple[int, float]]]]]:
    out = []
    for _, result in _fields(_snappy(data)):
        found = []
        for _, series in _fields(result):
            labels, samples = {}, []
            for n, value in _fields(series):
                part = dict(_fields(value))
                if n == 1:
                    labels[part.get(1, b"").decode()] = part.get(2, b"").decode()
                else:
                    samples.append((_signed(part.get(2, 0)), struct.unpack("<d", part.get(1, bytes(8)))[0]))
            found.append((labels, samples))
        out.append(found)
    return out
