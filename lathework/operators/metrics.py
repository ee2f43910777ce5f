"""Grouped metrics of joined attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions.coerce import ratio

MILLION = 1_000_000


def half_up_rank(p: float, n: Column) -> Column:
    """0-based index of the nearest-rank percentile that rounds half up."""
    return F.floor(F.lit(p / 100) * (n - 1) + 0.5)


def ceil_rank(p: float, n: Column) -> Column:
    return F.greatest(F.ceil(n * p / 100) - 1, F.lit(0))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, asked: dict[str, float], rank=half_up_rank) -> DataFrame:
    """Exact nearest-rank percentiles per key.

    Values are counted first and ranked by running totals over the distinct values of a
    key: the window holds distinct values, not rows, and no list of a group is ever built.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    ranked = counted.withColumns({"_total": F.sum("_n").over(w), "_upto": F.sum("_n").over(w.orderBy(value))})
    picks = [F.min(F.when(F.col("_upto") > rank(p, F.col("_total")), F.col(value))).alias(name) for name, p in asked.items()]
    return ranked.groupBy(*keys).agg(*picks)


def per_instance(joined: DataFrame, dims: Sequence[str]) -> DataFrame:
    """First level of the summary: one row a group and instance. Attempts without instance are kept apart by a null."""
    paid = F.when(F.col("cost_micros") > 0, F.col("cost_micros"))
    return joined.groupBy(*dims, "instance_id").agg(
        F.count("*").alias("attempts"), F.max("resolved").alias("resolved"), F.sum(paid).alias("cost"), F.min(paid).alias("least_cost"),
        F.max(F.when(F.col("resolved"), paid)).alias("most_resolved_cost"), F.sum("duration_ms").alias("duration"),
        F.sum(F.when(F.col("resolved"), F.col("duration_ms"))).alias("resolved_duration"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"),
    )


def group_summary(joined: DataFrame, dims: Sequence[str] = ("solver_id",), dear_micros: int = MILLION) -> DataFrame:
    """Counts, rates, money, time and tokens per group, in two aggregation levels (by instance, then by group)."""
    one = per_instance(joined, dims)
    real = F.col("instance_id").isNotNull() & (F.col("instance_id") != "")
    won = real & F.col("resolved")
    n = F.count_if(won)
    level = one.groupBy(*dims).agg(
        F.sum("attempts").alias("attempt_count"), F.count_if(real).alias("unique_instance_count"), n.alias("resolved_instance_count"),
        F.sum(F.when(real, F.col("cost"))).alias("cost"), F.sum(F.when(won, F.col("least_cost"))).alias("resolved_cost"),
        F.sum(F.when(real, F.col("duration"))).alias("duration"), F.sum(F.when(real, F.col("resolved_duration"))).alias("resolved_duration"),
        F.count_if(won & (F.col("most_resolved_cost") >= dear_micros)).alias("dear"),
        F.count_if(won & (F.col("most_resolved_cost") >= dear_micros) & (F.col("least_cost") >= dear_micros)).alias("dear_only"),
        F.min(F.when(won, F.col("least_cost"))).alias("low"), F.max(F.when(won, F.col("least_cost"))).alias("high"),
        F.count(F.when(won, F.col("least_cost"))).alias("priced"),
        *[F.sum(F.when(real, F.col(c))).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")],
    )
    c = F.col
    return level.select(
        *dims, "attempt_count", "unique_instance_count", "resolved_instance_count",
        F.coalesce(ratio(c("resolved_instance_count"), c("unique_instance_count")), F.lit(0.0)).alias("raw_resolution_rate"),
        F.coalesce("duration", F.lit(0)).alias("total_duration_ms"), F.coalesce("resolved_duration", F.lit(0)).alias("resolved_duration_ms"),
        (F.coalesce("cost", F.lit(0)) / MILLION).alias("total_cost_usd"), (F.coalesce("resolved_cost", F.lit(0)) / MILLION).alias("resolved_cost_usd"),
        (ratio(F.coalesce("resolved_cost", F.lit(0)), c("resolved_instance_count")) / MILLION).alias("cost_per_resolved"),
        ratio(F.coalesce("resolved_duration", F.lit(0)), c("resolved_instance_count")).alias("latency_ms_per_resolved"),
        F.coalesce(ratio(c("dear"), c("resolved_instance_count")), F.lit(0.0)).alias("dear_coverage"),
        F.coalesce(ratio(c("dear_only"), c("resolved_instance_count")), F.lit(0.0)).alias("exclusive_dear_rate"),
        # the mean of consecutive gaps of sorted least costs is the range over one less than their number
        F.when(c("priced") >= 2, (c("high") - c("low")) / (c("priced") - 1) / MILLION).alias("marginal_cost"),
        ratio(c("duration"), c("attempt_count")).alias("average_duration_ms"),
        *[F.coalesce(x, F.lit(0)).alias(x) for x in ("input_tokens", "output_tokens", "total_tokens")],
        ratio(F.coalesce("total_tokens", F.lit(0)), c("resolved_instance_count")).alias("tokens_per_resolved"),
    )


def attempt_summary(joined: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Percentiles of duration, tool calls and per-attempt averages of each group; attempts without instance count only as attempts."""
    real = F.coalesce(F.col("instance_id") != "", F.lit(False))
    one = joined.groupBy(*dims, "instance_id").agg(
        F.count("*").alias("attempts"), F.max("resolved").alias("resolved"), F.sum(F.greatest(F.coalesce("tool_calls", F.lit(0)), F.lit(0))).alias("calls"), F.sum("total_tokens").alias("tokens"))
    level = one.groupBy(*dims).agg(
        F.sum("attempts").alias("attempt_count"), F.count_if(real & F.col("resolved")).alias("resolved_instance_count"),
        F.coalesce(F.sum(F.when(real, F.col("calls"))), F.lit(0)).alias("tool_calls"), F.coalesce(F.sum(F.when(real, F.col("tokens"))), F.lit(0)).alias("tokens"))
    spent = joined.filter(real).select(*dims, F.greatest(F.coalesce("duration_ms", F.lit(0)), F.lit(0)).alias("duration_ms"))
    both = level.alias("a").join(percentiles(spent, dims, "duration_ms", {"p50_duration_ms": 50.0, "p95_duration_ms": 95.0}).alias("b"), [F.col(f"a.{d}").eqNullSafe(F.col(f"b.{d}")) for d in dims], "left")
    n, won = F.col("attempt_count"), F.col("resolved_instance_count")
    return both.select(
        *[F.col(f"a.{d}").alias(d) for d in dims], "attempt_count", "resolved_instance_count", "p50_duration_ms", "p95_duration_ms", "tool_calls",
        ratio(F.col("tokens"), n).alias("average_tokens"), ratio(F.col("tool_calls"), n).alias("average_tool_calls"), ratio(F.col("tokens"), won).alias("tokens_per_resolved"), ratio(F.col("tool_calls"), won).alias("tool_calls_per_resolved"))


def group_value(rows: DataFrame, field: str, metadata: str) -> Column:
    """A group's key: the column of that name, else that key of the metadata (a VARIANT), else ``unknown``; a null is the empty text."""
    if field in rows.columns:
        return F.coalesce(F.col(field).cast("string"), F.lit(""))
    inside = F.try_variant_get(metadata, f"$.{field}", "variant")
    return F.when(inside.isNull(), "unknown").otherwise(F.coalesce(F.try_variant_get(inside, "$", "string"), F.lit("")))


def group_json(dims: Sequence[str]) -> Column:
    return F.to_json(F.struct(*dims))


def top_line(joined: DataFrame) -> DataFrame:
    """One row over everything; distinct counts come from the per-instance level."""
    one = per_instance(joined, ["solver_id"]).groupBy("instance_id").agg(
        F.sum("attempts").alias("attempts"), F.max("resolved").alias("resolved"), F.sum("cost").alias("cost"), F.sum("duration").alias("duration"), F.sum("total_tokens").alias("tokens")
    )
    return one.agg(
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempt_count"), F.count("instance_id").alias("unique_instances"),
        F.count_if(F.col("resolved") & F.col("instance_id").isNotNull()).alias("resolved_instances"),
        (F.coalesce(F.sum("cost"), F.lit(0)) / MILLION).alias("total_cost_usd"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        ratio(F.sum("duration"), F.sum("attempts")).alias("average_duration_ms"),
    ).withColumn("unresolved_instances", F.col("unique_instances") - F.col("resolved_instances"))


def shares(df: DataFrame, label: str) -> DataFrame:
    """Counts of a label with their share of all."""
    counted = df.groupBy(label).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def offers(joined: DataFrame) -> DataFrame:
    """The resolved attempts that name a price."""
    return joined.filter("resolved and cost_micros > 0").select("solver_id", "instance_id", "attempt_id", "cost_micros", "duration_ms")


def cheapest_offers(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The least offer per key by cost, duration, solver and attempt."""
    by = F.struct("cost_micros", F.coalesce("duration_ms", F.lit(0)), "solver_id", "attempt_id")
    return found.groupBy(*keys).agg(F.min(by).alias("o")).select(*keys, F.col("o.cost_micros").alias("least_micros"), F.col("o.solver_id").alias("least_solver"))


def avoidable_spend(found: DataFrame) -> DataFrame:
    """Per solver: what its resolved instances cost at its own least price, at the least price of all, and the difference."""
    own = cheapest_offers(found, ["solver_id", "instance_id"]).withColumnRenamed("least_micros", "own").drop("least_solver")
    floor = cheapest_offers(found, ["instance_id"])
    both = own.join(floor, "instance_id").groupBy("solver_id").agg(F.count("*").alias("n_instances"), F.sum("own").alias("own"), F.sum("least_micros").alias("floor"))
    return both.select("solver_id", "n_instances", (F.col("own") / MILLION).alias("spend_usd"), (F.col("floor") / MILLION).alias("floor_usd"), (F.greatest(F.col("own") - F.col("floor"), F.lit(0)) / MILLION).alias("avoidable_usd"))


def instance_savings(found: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` instances with the widest gap between least and greatest price."""
    gaps = found.groupBy("instance_id").agg(F.count("*").alias("n_offers"), F.min("cost_micros").alias("low"), F.max("cost_micros").alias("high"))
    return gaps.withColumn("gap_micros", F.col("high") - F.col("low")).filter("n_offers >= 2 and gap_micros > 0").orderBy(F.desc("gap_micros"), "instance_id").limit(k)
