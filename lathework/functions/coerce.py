"""Coercion rules shared by all record readers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that count as true in verdicts.
TRUE_WORDS = ("true", "1", "yes", "y", "passed", "resolved")

_BLANKS = r"^[\s ]+|[\s ]+$"


def text(c: Column | str) -> Column:
    """Null becomes the empty string; outer white space goes."""
    return F.coalesce(F.regexp_replace(_col(c).cast("string"), _BLANKS, ""), F.lit(""))


def filled(c: Column | str) -> Column:
    """The stripped text, null where nothing is left."""
    return F.nullif(text(c), F.lit(""))


def truth(c: Column | str, words: tuple[str, ...] = TRUE_WORDS) -> Column:
    return F.lower(text(c)).isin(*words)


def whole(c: Column | str) -> Column:
    """A non-negative integer; what doesn't parse, or is negative, is 0."""
    return F.greatest(F.coalesce(_col(c).try_cast("bigint"), F.lit(0)), F.lit(0))


def number(c: Column | str) -> Column:
    """A non-negative double; NaN, what doesn't parse, or is negative, is 0."""
    d = F.coalesce(_col(c).try_cast("double"), F.lit(0.0))
    return F.when(F.isnan(d) | (d < 0), 0.0).otherwise(d)


def micros(c: Column | str) -> Column:
    """Money in millionths, so that sums are exact; null and NaN stay null."""
    d = _col(c).cast("double")
    return F.when(d.isNull() | F.isnan(d), None).otherwise(F.round(d * 1_000_000).cast("bigint"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b > 0, a.cast("double") / b.cast("double"))


def first_filled(*columns: Column | str) -> Column:
    return F.coalesce(*[filled(c) for c in columns])


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
