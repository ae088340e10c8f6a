"""Label sets: canonical text, order, serialisation and the parsing of label text, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escapes within quotes: named ones, a byte in hexadecimal or octal digits, a code point; the quote itself.
_ESCAPE = r'\\(?:[abfnrtv\\{q}]|x[0-9A-Fa-f]{{2}}|[0-3][0-7]{{2}}|u[0-9A-Fa-f]{{4}}|U00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{{4}})'
# Possessive throughout, so that the JVM matches values of any length without recursion.
_QUOTED = "|".join(q + rf"(?:[^\\\n{q}]++|{_ESCAPE.format(q=q)})*+" + q for q in "\"'") + "|`[^`]*+`"
#: One name="value" item of label text; the value in double or single quotes or in backticks.
ITEM = rf"\s*+([A-Za-z_][A-Za-z0-9_]*+)\s*+=\s*+({_QUOTED})\s*+"
WHOLE = rf"\A\s*+\{{(?:{ITEM}(?:,{ITEM})*+,?\s*+)?\}}\s*+\z"
#: A stretch without an escape, or one escape.
PIECE = r"([^\\]++|\\(?:x..|[0-7]{3}|u.{4}|U.{8}|.))"
# The named escapes.
NAMED = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def quoted(value: Column) -> Column:
    """value in double quotes, with backslash, quote and the characters of named escapes escaped."""
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), *((c, f"\\{k}") for k, c in NAMED.items())):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return F.concat(F.lit('"'), value, F.lit('"'))


def _bytes(piece: Column) -> Column:
    """The UTF-8 bytes, in hexadecimal, that one piece of a quoted value stands for."""
    kind = F.substring(piece, 2, 1)
    digits = F.substr(piece, F.lit(3))
    utf8 = lambda text: F.hex(F.encode(text, "UTF-8"))
    named = F.lit(None).cast("string")
    for k, c in NAMED.items():
        named = F.when(kind == k, F.lit(c.encode().hex())).otherwise(named)
    return (
        F.when(~F.startswith(piece, F.lit("\\")), utf8(piece))
        .when(kind == "x", digits)
        .when(kind.isin("u", "U"), utf8(F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")))
        .when(F.length(piece) == 4, F.lpad(F.conv(F.substr(piece, F.lit(2)), 8, 16), 2, "0"))
        .otherwise(F.coalesce(named, utf8(kind)))
    )


def unquoted(text: Column) -> Column:
    """The value of a quoted text; nothing is escaped between backticks."""
    body = F.substr(text, F.lit(2), F.length(text) - 2)
    pieces = F.regexp_extract_all(body, F.lit(PIECE), F.lit(1))
    decoded = F.unhex(F.array_join(F.transform(pieces, _bytes), "")).cast("string")
    return F.when(F.startswith(text, F.lit("`")) | ~F.contains(body, F.lit("\\")), body).otherwise(decoded)


def sorted_entries(labels: Column) -> Column:
    return F.array_sort(F.map_entries(labels))


def canonical(labels: Column) -> Column:
    """{a="x",b="y"} with names in order: the identity of a series."""
    items = F.transform(sorted_entries(labels), lambda e: F.concat(e["key"], F.lit("="), quoted(e["value"])))
    return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))


def serialised(labels: Column, separator: str = "ÿ") -> Column:
    """Names and values in order, each followed by the separator."""
    return F.array_join(F.flatten(F.transform(sorted_entries(labels), lambda e: F.array(e["key"], e["value"]))), separator)


def parse(text: Column) -> Column:
    """Label text to a map; null where the text is no label set. The last of repeated names holds."""
    def last(found: Column) -> Column:
        names = found["names"]
        entries = F.zip_with(names, found["values"], lambda k, v: F.struct(k.alias("key"), unquoted(v).alias("value")))
        return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(names, i + 2, F.size(names)), lambda n: n == e["key"])))

    # As the only element of an array, so that the items are found once and not again for each use.
    found = F.struct(F.regexp_extract_all(text, F.lit(ITEM), F.lit(1)).alias("names"), F.regexp_extract_all(text, F.lit(ITEM), F.lit(2)).alias("values"))
    return F.when(F.regexp_like(text, F.lit(WHOLE)), F.get(F.transform(F.array(found), last), F.lit(0)))


def tag(name: Column, value: Column) -> Column:
    """A label as name=value."""
    return F.concat(name, F.lit("="), value)


def series_hash(series_key: Column) -> Column:
    return F.xxhash64(series_key)
