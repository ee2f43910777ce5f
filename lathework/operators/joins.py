"""Joins of attempts with verdicts, predictions with data sets, and outcome lists with each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("solver_id", "instance_id")


def with_verdicts(attempts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Attempts with their verdict; without one they are unresolved with outcome ``unknown``.

    Both sides share the key, so Spark picks the side to send by its measured size and
    splits a hot key when it sorts.
    """
    return attempts.join(verdicts, list(KEYS), "left").withColumns(
        {"resolved": F.coalesce("resolved", F.lit(False)), "harness_outcome": F.coalesce("harness_outcome", F.lit("unknown"))}
    )


def matching_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_semi")


def covered_and_missing(predictions: DataFrame, dataset: DataFrame, key: str = "instance_id") -> DataFrame:
    """Predictions of known instances, and a ``missing_prediction`` row for each instance without one."""
    known = predictions.join(dataset.select(key), key, "left_semi").withColumn("status", F.lit("predicted"))
    missing = dataset.select(key).join(predictions.select(key), key, "left_anti").withColumn("status", F.lit("missing_prediction"))
    return known.unionByName(missing, allowMissingColumns=True)


def backfilled(rows: DataFrame, only: DataFrame, key: str, value: str) -> DataFrame:
    """Fill ``value`` where it is null, from the one candidate of its key."""
    return rows.join(only.withColumnRenamed(value, "_only"), key, "left").withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), "_only")).drop("_only")


def test_transitions(before: DataFrame, after: DataFrame, keys: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """Full outer join of two outcome lists: fail-to-pass, pass-to-pass, and the rest; an absent test counts as failing."""
    b = before.withColumnRenamed(outcome, "before")
    a = after.withColumnRenamed(outcome, "after")
    passed = lambda c: F.coalesce(F.col(c) == "pass", F.lit(False))
    return b.join(a, list(keys), "full_outer").withColumn(
        "transition",
        F.when(passed("after") & ~passed("before"), "fail_to_pass").when(passed("after"), "pass_to_pass").when(passed("before"), "pass_to_fail").otherwise("fail_to_fail"),
    )
