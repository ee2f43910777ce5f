"""Attempts nested under their instances, for reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.functions import text
from lathework.operators import dedup

KEYS = ("solver_id", "instance_id")


def compact(*columns: str) -> Column:
    return F.struct(*columns)


def latest(attempts: DataFrame) -> DataFrame:
    """The attempt of each solver and instance that ended last, by the text of its time and its number."""
    named = attempts.filter("coalesce(solver_id, '') <> '' and coalesce(instance_id, '') <> ''")
    return dedup.last_per(named, list(KEYS), [F.coalesce("ended", F.lit("")), "attempt_index", "attempt_id"])


def first_filled(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first value of a key, in order, that isn't empty."""
    return rows.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(key).agg(F.min_by(value, order).alias(value))


def heads(attempts: DataFrame, statements: DataFrame, judged: DataFrame, instances: int = 60, statement_chars: int = 8_000) -> DataFrame:
    """The best resolved instances with their solvers, told by id; a statement is clipped and says so.

    The few instances are chosen before anything is nested, so lists are only built for them.
    """
    counts = attempts.groupBy("instance_id").agg(F.count("*").alias("solver_count"), F.count_if("resolved").alias("resolved_count"))
    bucket = F.floor(F.col("resolved_count") * 100 / F.col("solver_count"))
    chosen = counts.orderBy(-bucket, F.desc("solver_count"), "instance_id").limit(instances)
    few = F.broadcast(chosen)  # at most ``instances`` rows
    rows = attempts.join(few, "instance_id").join(judged, list(KEYS), "left")
    nested = rows.groupBy("instance_id", "solver_count", "resolved_count").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("solver_id", "resolved", "attempt_id", "overall_label"))), lambda s: F.concat_ws(":", s["solver_id"], s["resolved"].cast("string"), s["attempt_id"], F.coalesce(s["overall_label"], F.lit("-")))), ",").alias("solvers")
    )
    said = statements.join(few.select("instance_id"), "instance_id", "left_semi")
    clip = text.clipped("statement", statement_chars)
    return nested.join(said, "instance_id", "left").select(
        "instance_id", "solver_count", "resolved_count", "solvers", F.coalesce(clip["text"], F.lit("")).alias("statement"), F.coalesce(clip["clipped"], F.lit(False)).alias("statement_clipped")
    )
