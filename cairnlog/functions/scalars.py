"""Scalar functions of the engine as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_label_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


def ts_to_ms(ts: Column) -> Column:
    """Whole milliseconds since the epoch, the rest cut off."""
    return F.unix_millis(ts.cast("timestamp"))


def str2int64(text: Column) -> Column:
    """0 where the text is no whole number."""
    return F.coalesce(F.when(F.regexp_like(text, F.lit(r"^[+-]?[0-9]+$")), text.try_cast("bigint")), F.lit(0).cast("bigint"))


def parse_time(text: Column) -> Column:
    """Milliseconds from seconds with a fraction, or from RFC 3339 text; null for anything else."""
    seconds = F.when(F.regexp_like(text, F.lit(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$")), F.round(text.try_cast("double") * 1000).cast("bigint"))
    dated = F.when(F.regexp_like(text, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T")), F.unix_millis(text.try_cast("timestamp")))
    return F.coalesce(seconds, dated)


def valid_timestamp(ms: Column) -> Column:
    """Years 1 to 9999."""
    return ms.between(F.lit(-62135596800000), F.lit(253402300799999))


def format_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


def highlight(line: Column, terms: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """Every whole-word term in marks. Terms and marks are taken as they are, no character of theirs means more."""
    if not terms:
        return line
    wanted = "|".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    mark = lambda text: re.sub(r"([\\$])", r"\\\1", text)
    return F.regexp_replace(line, rf"(?<![A-Za-z0-9_])({wanted})(?![A-Za-z0-9_])", f"{mark(before)}$1{mark(after)}")


def expr_link(expr: Column, tab: int) -> Column:
    """Link to the graph (tab 0) or table (tab 1) view of an expression."""
    return F.concat(F.lit("/graph?g0.expr="), F.url_encode(expr), F.lit(f"&g0.tab={tab}"))


def overlaps(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Closed intervals share a point."""
    return (a_min <= b_max) & (b_min <= a_max)
