"""The domain tables in the shape the operators work on.

``attempts``: one row an attempt out of telemetry, the delivery ingested last, money in
millionths. ``verdicts``: one row a solver and instance, the evaluation ingested last.
``runs``: attempts with patch, state and output. Each has the SQL of the same shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.functions import coerce
from lathework.operators import dedup
from lathework.runtime import table


def attempts(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The attempts with ``columns`` beside their id, or with all; fewer columns make the deduplication cheaper."""
    raw = table(spark, sf, "telemetry").filter("attempt_id is not null").select(
        "attempt_id", "instance_id", "solver_id", "provider", "started_at", "ended_at", "ingested_at", "duration_ms",
        coerce.micros("cost_usd").alias("cost_micros"), "input_tokens", "output_tokens", "total_tokens", "errors", "usage_source",
    )
    if columns:
        raw = raw.select("attempt_id", "ingested_at", *columns)
    return dedup.last_per(raw, ["attempt_id"], ["ingested_at"]).withColumn(
        "attempt_index", F.coalesce(F.regexp_extract("attempt_id", r":attempt-(\d+)$", 1).try_cast("bigint"), F.lit(0))
    )


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "instance_results").filter("solver_id is not null and instance_id is not null").select(
        "solver_id", "instance_id", "ingested_at", "job_id", coerce.truth("resolved").alias("resolved"),
        coerce.filled("harness_outcome").alias("harness_outcome"), coerce.filled("failure_reason").alias("failure_reason"),
    )
    return dedup.last_per(raw, ["solver_id", "instance_id"], ["ingested_at", "job_id"]).drop("ingested_at", "job_id")


def runs(spark: SparkSession, sf: str, *columns: str | Column) -> DataFrame:
    """The attempts' records with ``columns`` beside their id; what is made of long texts is made before the shuffle."""
    raw = table(spark, sf, "attempts").filter("attempt_id is not null")
    return dedup.last_per(raw.select("attempt_id", "ingested_at", *columns), ["attempt_id"], ["ingested_at"])


SQL = {
    "v_attempts": r"""
 select * exclude (rn), coalesce(try_cast(nullif(regexp_extract(attempt_id, ':attempt-(\d+)$', 1), '') as bigint), 0) as attempt_index from (
  select attempt_id, instance_id, solver_id, provider, started_at, ended_at, ingested_at, duration_ms,
   case when cost_usd is null or isnan(cost_usd) then null else cast(round(cost_usd * 1000000) as bigint) end as cost_micros,
   input_tokens, output_tokens, total_tokens, errors, usage_source,
   row_number() over (partition by attempt_id order by ingested_at desc, instance_id desc, solver_id desc) as rn
  from telemetry where attempt_id is not null) where rn = 1""",
    "v_verdicts": r"""
 select * exclude (rn, ingested_at, job_id) from (
  select solver_id, instance_id, ingested_at, job_id, lower(trim(coalesce(resolved, ''), E' \t\n\r')) in ('true','1','yes','y','passed','resolved') as resolved,
   nullif(trim(harness_outcome, E' \t\n\r'), '') as harness_outcome, nullif(trim(failure_reason, E' \t\n\r'), '') as failure_reason,
   row_number() over (partition by solver_id, instance_id order by ingested_at desc, job_id desc nulls last) as rn
  from instance_results where solver_id is not null and instance_id is not null) where rn = 1""",
    "v_runs": r"""
 select * exclude (rn) from (select *, row_number() over (partition by attempt_id order by ingested_at desc) as rn from attempts where attempt_id is not null) where rn = 1""",
    "v_joined": r"""
 select a.*, coalesce(v.resolved, false) as resolved, coalesce(v.harness_outcome, 'unknown') as harness_outcome, v.failure_reason
 from v_attempts a left join v_verdicts v using (solver_id, instance_id)""",
}


def sql(body: str, *names: str) -> str:
    """``body`` behind the named views, in order of need."""
    order = [n for n in SQL if n in names or ("v_joined" in names and n in ("v_attempts", "v_verdicts"))]
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in order) + "\n" + body if order else body
