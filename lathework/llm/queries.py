"""The queries over the training-data operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm import digests, mixing, nonsource, packing, pairs, secrets, splits, subjects, truncation
from lathework.runtime import settle, stow, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_values(table(spark, sf, "attempts"), table(spark, sf, "solvers"))


@query
def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_shares(table(spark, sf, "attempts"), table(spark, sf, "solvers"))


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.credential_lines(table(spark, sf, "materialized_items"), table(spark, sf, "attempts"))


@query
def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.redacted(secrets.long_form(table(spark, sf, "materialized_items"), table(spark, sf, "attempts")))


# --- percentiles -------------------------------------------------------------------------

METRICS = ["duration_ms", "cost_usd", "total_tokens"]


def _attempt_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """One row an attempt; an attempt that never ended has no duration yet."""
    raw = table(spark, sf, "telemetry").select(
        "attempt_id", "solver_id", "provider", F.to_date("started_at").alias("day"), "ingested_at",
        F.when(F.col("ended_at").isNotNull(), F.col("duration_ms")).cast("double").alias("duration_ms"),
        F.col("cost_usd").cast("double").alias("cost_usd"), F.col("total_tokens").cast("double").alias("total_tokens"),
    )
    return digests.latest(raw, "attempt_id", "ingested_at", ["solver_id", "provider", "day", *METRICS])


@query
def p2_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Per solver, provider and day (scope ``day``), and of the whole period merged from the days (scope ``period``, without day)."""
    data = stow(_attempt_metrics(spark, sf), "metrics")
    keys = ["solver_id", "provider"]
    days = settle(digests.digests(data, [*keys, "day"], METRICS))
    by_day, period = settle(digests.quantiles(days, [*keys, "day"])), settle(digests.quantiles(digests.merge(days, keys), keys))
    day_rows, period_rows = digests.certify(data, [(by_day, [*keys, "day"]), (period, keys)], METRICS)
    one = day_rows.withColumn("scope", F.lit("day")).withColumn("rank_bound", digests.rank_bound(merges=2))
    all_ = period_rows.withColumn("scope", F.lit("period")).withColumn("day", F.lit(None).cast("date")).withColumn("rank_bound", digests.rank_bound(merges=3))
    return one.unionByName(all_)


@query
def p2_digests(spark: SparkSession, sf: str) -> DataFrame:
    return digests.digests(_attempt_metrics(spark, sf), ["solver_id", "provider", "day"], METRICS)


# --- splits ------------------------------------------------------------------------------

TIES = [["instance_id"], ["solver_id", "task_cluster"]]


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    found = splits.groups(table(spark, sf, "router_rows"), "row_id", TIES)
    return found.filter("row_id <> group_id").select("group_id", "row_id")


SQL["p6_found"] = r"""
 with recursive k as (select distinct row_id, nullif(lower(regexp_replace(coalesce(instance_id, ''), '^\s+|\s+$', '', 'g')), '') as i, nullif(lower(regexp_replace(coalesce(solver_id, ''), '^\s+|\s+$', '', 'g')), '') as s,
   nullif(lower(regexp_replace(coalesce(task_cluster, ''), '^\s+|\s+$', '', 'g')), '') as c from router_rows where row_id is not null),
 e as (select a.row_id as x, b.row_id as y from k a join k b on a.i = b.i union select a.row_id, b.row_id from k a join k b on a.s = b.s and a.c = b.c),
 r as (select row_id as x, row_id as y from k union select r.x, e.y from r join e on r.y = e.x)
 select min(y) as group_id, x as row_id from r group by x having min(y) <> x"""


@query
def p6_splits(spark: SparkSession, sf: str) -> DataFrame:
    found = settle(splits.groups(table(spark, sf, "router_rows"), "row_id", TIES))
    return splits.assign_splits(found, table(spark, sf, "split_targets"))


# --- files that are no hand-written source -----------------------------------------------


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return nonsource.file_kinds(table(spark, sf, "file_roles"))


@query
def p7_composition(spark: SparkSession, sf: str) -> DataFrame:
    return nonsource.composition(table(spark, sf, "file_roles"))


# --- containers and mixtures -------------------------------------------------------------


@query
def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.containers_of(table(spark, sf, "documents"), table(spark, sf, "containers"))


@query
def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf), table(spark, sf, "containers"))


@query
def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.drawn(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


@query
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.drawn(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


# --- subject areas -----------------------------------------------------------------------


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.subject_areas(table(spark, sf, "documents"), table(spark, sf, "subject_labels"), table(spark, sf, "subjects"))


@query
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _areas(spark, sf).select("doc_id", "subject")


@query
def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.composition(settle(_areas(spark, sf)), table(spark, sf, "documents"))


# --- broken pairs ------------------------------------------------------------------------


def _defects(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defects(table(spark, sf, "attempts"), table(spark, sf, "solvers"), table(spark, sf, "materialized_items"))


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _defects(spark, sf)


@query
def p5_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Every attempt with its defect, or ``none``."""
    attempts = table(spark, sf, "attempts").select("attempt_id").dropna().distinct()
    return attempts.join(_defects(spark, sf), "attempt_id", "left").select("attempt_id", F.coalesce("defect", F.lit("none")).alias("defect"))
