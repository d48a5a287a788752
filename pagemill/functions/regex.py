"""Pieces shared by patterns. Java's ``\\b`` knows accented letters, so boundaries are spelled out in ASCII."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def replace_all(text: Column, steps: list[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) in order."""
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text)


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def ends_any(text: Column, ends: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.endswith(x) for x in ends], F.lit(False))


def literal(text: str) -> str:
    """A text as a pattern of itself."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/#&~" else c for c in text)


def first_case(rules: list[tuple[Column, str]], default: Column | str | None) -> Column:
    """The label of the first rule that holds."""
    out = F.when(*rules[0]) if rules else F.lit(None)
    for condition, label in rules[1:]:
        out = out.when(condition, label)
    return out.otherwise(default)
