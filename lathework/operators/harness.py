"""Results of a harness joined with the data set and the predictions they belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.functions import verdicts
from lathework.operators import dedup

KEYS = ("solver_id", "instance_id")


def resolved_slice(dataset: DataFrame, predictions: DataFrame, resolved_keys: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """The predictions of resolved keys, and the data set's row of each of them (one a prediction, so one a solver)."""
    kept = predictions.join(resolved_keys.select(*keys).distinct(), list(keys), "left_semi")
    return kept, kept.select(*keys).join(dataset, "instance_id")


def resolved_slice_by_results(dataset: DataFrame, predictions: DataFrame, results: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """One row a resolved key with both a prediction and a data set row, led by the results: the first of each key counts."""
    first = dedup.first_per(results.filter("resolved"), list(KEYS), order).select(*KEYS)
    return first.join(predictions, list(KEYS), "left_semi").join(dataset.select("instance_id"), "instance_id", "left_semi")


def dataset_results(dataset: DataFrame, results: DataFrame) -> DataFrame:
    """One row a data set row: its status, normalised; without a result it is unresolved, and says so."""
    joined = dataset.join(results, "instance_id", "left")
    status = verdicts.harness_status(F.coalesce("harness_outcome", F.lit("missing")))
    told = joined.withColumn("_s", status).withColumn("_there", F.col("has_result").isNotNull())
    return told.select(
        *dataset.columns, F.col("_s.status").alias("status"), F.coalesce(F.col("resolved"), F.col("_s.resolved") & ~F.col("_s.is_error")).alias("resolved"),
        F.when(F.col("_there"), F.col("failure_reason")).otherwise("no harness result for instance").alias("reason"),
        F.when(F.col("_s.is_error"), F.col("failure_reason")).alias("error"),
    )


def merged_results(predictions: DataFrame, results: DataFrame, dataset: DataFrame) -> DataFrame:
    """A row for every prediction, an error where the harness said nothing, and a skipped row for each instance without a prediction."""
    own = predictions.select(*KEYS).join(results, list(KEYS), "left")
    status = F.when(F.col("has_result").isNull(), "error").otherwise(verdicts.harness_status("harness_outcome")["status"])
    rows = own.select(*KEYS, status.alias("status"), F.when(F.col("has_result").isNull(), "no harness result for prediction").otherwise(F.col("failure_reason")).alias("reason"), F.coalesce("resolved", F.lit(False)).alias("resolved"))
    missing = dataset.select("instance_id").join(predictions.select("instance_id"), "instance_id", "left_anti")
    skipped = missing.select(F.lit("").alias("solver_id"), "instance_id", F.lit("skipped").alias("status"), F.lit("missing_prediction").alias("reason"), F.lit(False).alias("resolved"))
    return rows.unionByName(skipped)


def with_logs(results: DataFrame, logs: DataFrame, summary: str) -> DataFrame:
    """The results with the log's summary as the reason of the errors, where the log says anything."""
    joined = results.join(logs, list(KEYS), "left")
    told = (F.col("status") == "error") & F.col(summary).isNotNull() & (F.col(summary) != "")
    return joined.withColumn("reason", F.when(told, F.col(summary)).otherwise(F.col("reason"))).drop(summary)


def run_counters(results: DataFrame) -> DataFrame:
    """One row: results by status, and the share of resolved ones to three places (half to even)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(
        F.count("*").alias("total"), n("resolved").alias("resolved"), n("not_resolved").alias("not_resolved"), n("error").alias("error"), n("skipped").alias("skipped"),
        F.when(F.count("*") > 0, F.bround(n("resolved") / F.count("*"), 3)).otherwise(0.0).alias("rate"),
    )


def outcome_maps(outcomes: DataFrame, keys: Sequence[str], test: str, outcome: str, run: str, runs: Sequence[str]) -> DataFrame:
    """One row a key with a map of test outcomes for each of ``runs``; of a test told twice the greatest outcome counts."""
    one = outcomes.groupBy(*keys, run, test).agg(F.max(outcome).alias("_o"))
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(run) == r, F.struct(test, "_o"))))).alias(r) for r in runs]  # a key's tests
    return one.groupBy(*keys).agg(*maps)
