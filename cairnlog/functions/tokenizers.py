"""Tokenizer registry: a name stands for a function from a text column to an array of terms.

The default takes runs of ASCII letters, digits and underscores, case kept: exactly what a query can name. It has a
second form, a regular expression for one term, that stays inside generated code."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "word"
_registry: dict[str, Callable[[Column], Column]] = {}


def register_tokenizer(name: str, tokens: Callable[[Column], Column]) -> None:
    _registry[name] = tokens


def tokenize(line: Column, name: str = DEFAULT) -> Column:
    """Terms of a line; blank ones are left out."""
    if name not in _registry:
        raise KeyError(f"no tokenizer named {name!r}")
    terms = _registry[name](line)
    return terms if name == DEFAULT else F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != "")


def has_term(line: Column, term: str, name: str = DEFAULT) -> Column:
    """Whether the line holds the term. contains() comes first: sound, cheap, and pushed to the scan."""
    if name == DEFAULT:
        if not re.fullmatch(r"[A-Za-z0-9_]+", term):
            return F.lit(False)
        return line.contains(term) & F.regexp_like(line, F.lit(rf"(?<![A-Za-z0-9_]){term}(?![A-Za-z0-9_])"))
    return F.array_contains(tokenize(line, name), term)


register_tokenizer(DEFAULT, lambda line: F.regexp_extract_all(line, F.lit(r"([A-Za-z0-9_]+)"), F.lit(1)))
register_tokenizer("whitespace", lambda line: F.split(line, r"\s+"))
