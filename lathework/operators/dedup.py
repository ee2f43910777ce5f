"""Which of several rows for one key counts; every choice has a total order, so results repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _packed(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> tuple[Column, list[str]]:
    """One struct that leads with the order and holds every other column once."""
    rest = [c for c in df.columns if c not in keys]
    led = [F.col(o) if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)]
    named = {o for o in order if isinstance(o, str)}
    return F.struct(*led, *[F.col(c) for c in rest if c not in named]), rest


def last_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the greatest ``order`` for each key, in one aggregation that starts before the shuffle.

    Null orders come first. All columns of ``df`` travel in the aggregate, so select before.
    """
    packed, rest = _packed(df, keys, order)
    return df.groupBy(*keys).agg(F.max(packed).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    packed, rest = _packed(df, keys, order)
    return df.groupBy(*keys).agg(F.min(packed).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def only_per(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys with exactly one distinct value."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_most")).filter(F.col(value) == F.col("_most")).drop("_most")
