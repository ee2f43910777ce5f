"""Aggregates over review scores with an array of dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_delta(deltas: dict[str, float]) -> Column:
    """Sum of weight times delta, rounded to 6 places; in ten-thousandths, so the sum is exact."""
    total = sum((F.col(c) * round(w * 10_000) for c, w in deltas.items()), F.lit(0))
    return F.round(total / 10_000, 6)


def delta_label(d: Column) -> Column:
    return F.when(d <= -1.25, "much_worse").when(d <= -0.35, "worse").when(d < 0.35, "similar").when(d < 1.25, "better").otherwise("much_better")


def by_solver(scored: DataFrame) -> DataFrame:
    d = F.col("overall_delta")
    return scored.groupBy("solver_id").agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_delta"), (F.count_if(d >= 0.35) / F.count("*")).alias("better_share"), (F.count_if(d <= -0.35) / F.count("*")).alias("worse_share"),
        F.count_if(F.col("resolved") & (d <= -0.35)).alias("resolved_but_worse"), F.count_if(~F.col("resolved") & (d >= 0.35)).alias("unresolved_but_promising"))


def by_dimension(scored: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """One row a declared dimension, also where no row has it."""
    long = scored.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("delta")) for d in dimensions])).alias("x")).select("x.*")
    declared = scored.sparkSession.createDataFrame([(d,) for d in dimensions], "dimension string")
    return declared.join(long.groupBy("dimension").agg(F.count("delta").alias("n"), F.avg("delta").alias("mean_delta")), "dimension", "left").fillna(0, ["n"])


# What a judge may call a delta.
LABEL_DELTAS = {"much_worse": -2, "worse": -1, "same": 0, "better": 1, "much_better": 2}


def parsed_deltas(df: DataFrame, answer: str, dimensions: Sequence[str]) -> DataFrame:
    """Add ``deltas``, one whole number from -2 to 2 a dimension, out of a judge's JSON answer (bare or fenced); null where the answer, a dimension or a delta is missing.

    A known label overrides the delta. Each step is a column of its own, so nothing is parsed twice.
    """
    bare = F.regexp_replace(answer, r"^\s+|\s+$", "")
    fenced = F.regexp_replace(F.regexp_extract("_bare", r"(?si)```(?:json)?\s*(.*?)```", 1), r"^\s+|\s+$", "")
    read = df.withColumn("_bare", bare).withColumn("_text", F.when(F.col("_bare").startswith("{"), F.col("_bare")).otherwise(fenced)).withColumn("_v", F.try_parse_json("_text"))
    items = read.withColumn("_items", F.try_variant_get("_v", "$.dimensions", "array<struct<name:string,label:string,delta:string>>"))
    told = F.create_map(*[F.lit(x) for kv in LABEL_DELTAS.items() for x in kv])
    each = F.transform("_items", lambda x: F.struct(F.trim(x["name"]).alias("name"), F.coalesce(F.try_element_at(told, F.coalesce(F.lower(F.trim(x["label"])), F.lit(""))), x["delta"].try_cast("int")).alias("delta")))
    by_name = items.withColumn("_each", each)
    pick = lambda name: F.try_element_at(F.filter("_each", lambda x: x["name"] == name), F.lit(-1))["delta"]
    whole = by_name.withColumn("_d", F.array(*map(pick, dimensions)))
    good = F.forall("_d", lambda d: F.coalesce(d.between(-2, 2), F.lit(False)))
    return whole.withColumn("deltas", F.when(good, F.col("_d"))).drop("_bare", "_text", "_v", "_items", "_each", "_d")


def from_cache(requests: DataFrame, cache: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Requests with the cached value of their keys and whether it was there; only scored rows are cached."""
    scored = cache.filter("judge_status = 'scored'").groupBy(*keys).agg(F.max(value).alias(value))
    return requests.join(scored, list(keys), "left").withColumn("cache_hit", F.col(value).isNotNull())
