"""Queries to columns: the whole query becomes predicates that Catalyst prunes and pushes down."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokenizers import DEFAULT, has_term
from .temql import Both, Expr, Matcher, TemQLSyntaxError, Term, terms


def check_expression(text: str) -> None:
    """A syntax error where the JVM can't read the expression, before any task runs."""
    sc = SparkContext._active_spark_context
    if sc is not None:
        try:
            sc._jvm.java.util.regex.Pattern.compile(text)
        except IllegalArgumentException as e:
            raise TemQLSyntaxError(f"bad regular expression {text!r}: {str(e).splitlines()[0]}", 0) from None


def matches(m: Matcher, value: Column) -> Column:
    """A missing label counts as the empty string; expressions are anchored at both ends."""
    v = F.coalesce(value, F.lit("")) if m.op != "=" or m.value == "" else value
    if m.op == "=":
        return v == m.value
    if m.op == "!=":
        return v != m.value
    check_expression(m.value)
    full = F.regexp_like(v, F.lit(rf"\A(?:{m.value})\z"))
    if m.op == "=~":
        return full
    if m.op == "!~":
        return ~full
    raise ValueError(f"unknown matcher {m.op!r}")


def labels_match(matchers: tuple[Matcher, ...], columns: list[str], promoted: str = "lbl_") -> Column:
    """All matchers together; a promoted label column is used where there is one, for pushdown."""
    def value(name: str) -> Column:
        return F.col(promoted + name) if promoted + name in columns else F.col("labels")[name]

    return reduce(lambda a, b: a & b, (matches(m, value(m.name)) for m in matchers), F.lit(True))


def fold(expr: Expr, leaf: Callable[[str], Column]) -> Column:
    """The boolean tree over a column for each term."""
    if isinstance(expr, Term):
        return leaf(expr.text)
    left, right = fold(expr.left, leaf), fold(expr.right, leaf)
    return left & right if isinstance(expr, Both) else left | right


def line_matches(expr: Expr | None, line: Column, tokenizer: str = DEFAULT) -> Column:
    return F.lit(True) if expr is None else fold(expr, lambda t: has_term(line, t, tokenizer))


def any_term(expr: Expr, line: Column, tokenizer: str = DEFAULT) -> Column:
    return reduce(lambda a, b: a | b, (has_term(line, t, tokenizer) for t in terms(expr)))


def gated(logs: DataFrame, expr: Expr, tokenizer: str = DEFAULT, scope: tuple[str, ...] = ()) -> DataFrame:
    """Series semantics: the tree decides over series (in each scope group), by the terms any of their lines hold;
    of those series all lines with any of the terms are kept."""
    wanted = terms(expr)
    hits = logs.filter(any_term(expr, F.col("line"), tokenizer))
    keys = ["series_key", *scope]
    flags = hits.groupBy(*keys).agg(*[F.max(has_term(F.col("line"), t, tokenizer)).alias(f"_has{i}") for i, t in enumerate(wanted)])
    passed = flags.filter(fold(expr, lambda t: F.col(f"_has{wanted.index(t)}"))).select(*keys)
    return hits.join(passed, keys, "left_semi")
