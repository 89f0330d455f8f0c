"""Column functions for text: Unicode-aware strip, counting, escaping, numbers as a tolerant reader sees them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at either end (all of it, not spaces alone)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def occurrences(text: Column, token: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("long")


def literal(pattern: str) -> str:
    """A literal inside a Java regular expression."""
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def to_number(c: Column) -> Column:
    """double where the whole string reads as a decimal number (no type suffixes), else null."""
    trimmed = strip(c)
    return F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.expr("double(0)") + trimmed.try_cast("double"))


def tokens_of(query: str) -> list[str]:
    """Search tokens: lower-cased words of two characters or more, repeats kept."""
    return [w for w in query.lower().split() if len(w) >= 2]


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def label_pattern(label: str) -> str:
    """The value after a label, up to the end of its line."""
    return "(?iudU)" + literal(label) + r"\s*[:\-]?\s*(.{1,500}?)(?:\n|$)"

