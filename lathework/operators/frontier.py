"""Rankings and frontiers over a small table of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _far(column: str):
    return F.coalesce(F.col(column).cast("double"), F.lit(float("inf")))


def ranking_key():
    """Best first: rate, resolved, cost, latency, total cost, name."""
    return F.struct(-F.col("raw_resolution_rate"), -F.col("resolved_instance_count"), _far("cost_per_resolved"), _far("latency_ms_per_resolved"), F.col("total_cost_usd"), F.col("solver_id"))


def ranked(summary: DataFrame) -> DataFrame:
    return summary.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(ranking_key())))


def budget_frontier(summary: DataFrame) -> DataFrame:
    """For each distinct budget, the best group that costs no more."""
    able = summary.filter("cost_per_resolved is not null and resolved_instance_count > 0")
    w = Window.partitionBy().orderBy("cost_per_resolved").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best = able.withColumn("best", F.min(ranking_key()).over(w))
    return best.groupBy(F.col("cost_per_resolved").alias("budget")).agg(F.min(F.col("best.solver_id")).alias("best_solver"), F.array_sort(F.collect_list("solver_id")).alias("bucket")).withColumn("bucket", F.array_join("bucket", ","))


def pareto(summary: DataFrame) -> DataFrame:
    """Groups that no other beats in rate, cost and latency at once.

    The table has one row a solver; its three numbers a row are gathered once and every
    row is held against them, so nothing grows with the attempts.
    """
    points = summary.select("solver_id", F.col("raw_resolution_rate").alias("rate"), _far("cost_per_resolved").alias("cost"), _far("latency_ms_per_resolved").alias("latency"))
    packed = points.agg(F.collect_list(F.struct("rate", "cost", "latency")).alias("all"))  # groups, not rows: bounded by the number of solvers
    beats = lambda o: (
        (o["rate"] >= F.col("rate")) & (o["cost"] <= F.col("cost")) & (o["latency"] <= F.col("latency"))
        & ((o["rate"] > F.col("rate")) | (o["cost"] < F.col("cost")) | (o["latency"] < F.col("latency")))
    )
    return points.join(F.broadcast(packed)).filter(~F.exists("all", beats)).select("solver_id", "rate", F.nullif("cost", F.lit(float("inf"))).alias("cost"), F.nullif("latency", F.lit(float("inf"))).alias("latency"))


def cost_key():
    """Cheapest first: cost, rate, latency, name."""
    return F.struct(_far("cost_per_resolved"), -F.col("raw_resolution_rate"), _far("latency_ms_per_resolved"), F.col("solver_id"))
