"""The queries of the core engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathework.functions import coerce, patch, reports, roles, text, usage
from lathework.operators import dedup, frontier, joins, metrics, nested, planning, review, router
from lathework.plans import views
from lathework.runtime import settle, table
from lathework.sources import records
from lathework.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame] | None = None, *, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query under its function's name, with the SQL that says the same where SQL can."""

    def add(g: Callable[[SparkSession, str], DataFrame]):
        QUERIES[g.__name__] = g
        if sql:
            SQL[g.__name__] = views.sql(sql, *needs)
        return g

    return add(f) if f else add


#: What the grouped metrics read of an attempt.
COUNTED = ("instance_id", "solver_id", "duration_ms", "cost_micros", "input_tokens", "output_tokens", "total_tokens")


def joined(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return joins.with_verdicts(views.attempts(spark, sf, *columns), views.verdicts(spark, sf))


# --- grouped metrics ---------------------------------------------------------------------

_ONE = """
 one as (select {dims}, instance_id, count(*) as attempts, bool_or(resolved) as resolved,
   sum(case when cost_micros > 0 then cost_micros end) as cost, min(case when cost_micros > 0 then cost_micros end) as least_cost,
   max(case when resolved and cost_micros > 0 then cost_micros end) as most_resolved_cost, sum(duration_ms) as duration,
   sum(case when resolved then duration_ms end) as resolved_duration, sum(input_tokens) as input_tokens, sum(output_tokens) as output_tokens, sum(total_tokens) as total_tokens
  from v_joined group by {dims}, instance_id)"""

_SUMMARY = """
 select {dims}, cast(sum(attempts) as bigint) as attempt_count, count(*) filter (real) as unique_instance_count, count(*) filter (won) as resolved_instance_count,
  case when count(*) filter (real) > 0 then count(*) filter (won) / count(*) filter (real) else 0 end as raw_resolution_rate,
  cast(coalesce(sum(duration) filter (real), 0) as bigint) as total_duration_ms, cast(coalesce(sum(resolved_duration) filter (real), 0) as bigint) as resolved_duration_ms,
  cast(coalesce(sum(cost) filter (real), 0) as bigint) / 1000000 as total_cost_usd, cast(coalesce(sum(least_cost) filter (won), 0) as bigint) / 1000000 as resolved_cost_usd,
  case when count(*) filter (won) > 0 then cast(coalesce(sum(least_cost) filter (won), 0) as bigint) / count(*) filter (won) / 1000000 end as cost_per_resolved,
  case when count(*) filter (won) > 0 then cast(coalesce(sum(resolved_duration) filter (real), 0) as bigint) / count(*) filter (won) end as latency_ms_per_resolved,
  case when count(*) filter (won) > 0 then count(*) filter (won and most_resolved_cost >= 1000000) / count(*) filter (won) else 0 end as dear_coverage,
  case when count(*) filter (won) > 0 then count(*) filter (won and most_resolved_cost >= 1000000 and least_cost >= 1000000) / count(*) filter (won) else 0 end as exclusive_dear_rate,
  case when count(least_cost) filter (won) >= 2 then (max(least_cost) filter (won) - min(least_cost) filter (won)) / (count(least_cost) filter (won) - 1) / 1000000 end as marginal_cost,
  cast(sum(duration) filter (real) as bigint) / cast(sum(attempts) as bigint) as average_duration_ms,
  cast(coalesce(sum(input_tokens) filter (real), 0) as bigint) as input_tokens, cast(coalesce(sum(output_tokens) filter (real), 0) as bigint) as output_tokens,
  cast(coalesce(sum(total_tokens) filter (real), 0) as bigint) as total_tokens,
  case when count(*) filter (won) > 0 then cast(coalesce(sum(total_tokens) filter (real), 0) as bigint) / count(*) filter (won) end as tokens_per_resolved
 from (select *, coalesce(instance_id, '') <> '' as real, coalesce(instance_id, '') <> '' and resolved as won from one) group by {dims}"""


def _summary_sql(dims: str) -> str:
    return views.sql("", "v_joined").rstrip() + "," + _ONE.format(dims=dims) + _SUMMARY.format(dims=dims)


@query
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.group_summary(joined(spark, sf, *COUNTED))


@query
def group_summary_by_provider(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.group_summary(joined(spark, sf, *COUNTED, "provider", "usage_source"), ("provider", "usage_source"))


SQL["group_summary"] = _summary_sql("solver_id")
SQL["group_summary_by_provider"] = _summary_sql("provider, usage_source")


@query(needs=("v_joined",), sql="""
 , per as (select instance_id, count(*) as attempts, bool_or(resolved) as resolved, sum(case when cost_micros > 0 then cost_micros end) as cost, sum(duration_ms) as duration, sum(total_tokens) as tokens
  from v_joined group by instance_id)
 select cast(sum(attempts) as bigint) as attempt_count, count(instance_id) as unique_instances, count(*) filter (resolved and instance_id is not null) as resolved_instances,
  cast(coalesce(sum(cost), 0) as bigint) / 1000000 as total_cost_usd, cast(coalesce(sum(tokens), 0) as bigint) as total_tokens,
  cast(sum(duration) as bigint) / cast(sum(attempts) as bigint) as average_duration_ms,
  count(instance_id) - count(*) filter (resolved and instance_id is not null) as unresolved_instances from per""")
def top_line(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.top_line(joined(spark, sf, *COUNTED))


_PERCENTILES = """
 select solver_id, list_sort(list(duration_ms))[1 + cast(floor(0.5 * (count(duration_ms) - 1) + 0.5) as int)] as p50, list_sort(list(duration_ms))[1 + cast(floor(0.95 * (count(duration_ms) - 1) + 0.5) as int)] as p95
 from v_attempts where duration_ms is not null group by solver_id"""


@query(needs=("v_attempts",), sql=_PERCENTILES)
def duration_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.percentiles(views.attempts(spark, sf, "solver_id", "duration_ms"), ["solver_id"], "duration_ms", {"p50": 50.0, "p95": 95.0})


@query(needs=("v_joined",), sql="""
 , l as (select case when low like 'invalid patch:%' or replace(replace(low, '-', '_'), ' ', '_') = 'invalid_patch' then 'invalid_patch' when contains(low, 'timeout') or replace(replace(low, '-', '_'), ' ', '_') = 'timed_out' then 'timeout'
   when contains(low, 'hit your limit') or contains(low, 'rate limit') then 'rate_limit' when contains(low, 'model not found') then 'model_not_found' else raw end as reason
  from (select raw, lower(raw) as low from (select coalesce(failure_reason, harness_outcome) as raw from v_joined where not resolved)))
 select reason, count(*) as n, count(*) / sum(count(*)) over () as share from l group by reason""")
def failure_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    lost = joined(spark, sf, "instance_id", "solver_id").filter("not resolved").select(text.failure_label(F.coalesce("failure_reason", "harness_outcome")).alias("reason"))
    return metrics.shares(lost, "reason")


@query(needs=("v_joined",), sql="""
 select attempt_id, solver_id, instance_id, cost_micros, duration_ms from v_joined where not resolved
 order by coalesce(cost_micros, 0) desc, coalesce(duration_ms, 0) desc, solver_id, instance_id, attempt_id limit 10""")
def unresolved_top10(spark: SparkSession, sf: str) -> DataFrame:
    rows = joined(spark, sf, "instance_id", "solver_id", "cost_micros", "duration_ms").filter("not resolved").select("attempt_id", "solver_id", "instance_id", "cost_micros", "duration_ms")
    return rows.orderBy(F.desc(F.coalesce("cost_micros", F.lit(0))), F.desc(F.coalesce("duration_ms", F.lit(0))), "solver_id", "instance_id", "attempt_id").limit(10)


@query(needs=("v_joined",), sql="""
 , offers as (select solver_id, instance_id, cost_micros from v_joined where resolved and cost_micros > 0),
 own as (select solver_id, instance_id, min(cost_micros) as own from offers group by all), floor_ as (select instance_id, min(cost_micros) as least from offers group by all)
 select solver_id, count(*) as n_instances, cast(sum(own) as bigint) / 1000000 as spend_usd, cast(sum(least) as bigint) / 1000000 as floor_usd,
  greatest(cast(sum(own) - sum(least) as bigint), 0) / 1000000 as avoidable_usd from own join floor_ using (instance_id) group by solver_id""")
def avoidable_spend(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.avoidable_spend(metrics.offers(joined(spark, sf, "instance_id", "solver_id", "duration_ms", "cost_micros")))


@query(needs=("v_joined",), sql="""
 select instance_id, count(*) as n_offers, min(cost_micros) as low, max(cost_micros) as high, max(cost_micros) - min(cost_micros) as gap_micros from v_joined where resolved and cost_micros > 0
 group by instance_id having count(*) >= 2 and max(cost_micros) > min(cost_micros) order by gap_micros desc, instance_id limit 10""")
def instance_savings_top10(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.instance_savings(metrics.offers(joined(spark, sf, "instance_id", "solver_id", "duration_ms", "cost_micros")))


@query
def solver_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.ranked(group_summary(spark, sf)).select("solver_id", "rank", "raw_resolution_rate")


@query
def budget_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.budget_frontier(group_summary(spark, sf))


@query
def pareto_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.pareto(group_summary(spark, sf))


_S = SQL["group_summary"]
_S = _S[: _S.rindex("\n select solver_id, cast(sum(attempts)")] + ", s as (" + _S[_S.rindex("\n select solver_id, cast(sum(attempts)") :] + ")"
_ORDER = "{p}raw_resolution_rate desc, {p}resolved_instance_count desc, coalesce({p}cost_per_resolved, 'infinity'::double), coalesce({p}latency_ms_per_resolved, 'infinity'::double), {p}total_cost_usd, {p}solver_id"
SQL["solver_ranks"] = _S + f" select solver_id, cast(row_number() over (order by {_ORDER.format(p='')}) as int) as rank, raw_resolution_rate from s"
SQL["budget_frontier"] = _S + f""", a as (select * from s where cost_per_resolved is not null and resolved_instance_count > 0)
 select b.cost_per_resolved as budget, (select a.solver_id from a where a.cost_per_resolved <= b.cost_per_resolved order by {_ORDER.format(p='a.')} limit 1) as best_solver, string_agg(b.solver_id, ',' order by b.solver_id) as bucket
 from a b group by b.cost_per_resolved"""
SQL["pareto_frontier"] = _S + """, p as (select solver_id, raw_resolution_rate as rate, coalesce(cost_per_resolved, 'infinity'::double) as cost, coalesce(latency_ms_per_resolved, 'infinity'::double) as latency from s)
 select solver_id, rate, case when isinf(cost) then null else cost end as cost, case when isinf(latency) then null else latency end as latency from p
 where not exists (select 1 from p o where o.rate >= p.rate and o.cost <= p.cost and o.latency <= p.latency and (o.rate > p.rate or o.cost < p.cost or o.latency < p.latency))"""


@query(needs=("v_joined",), sql="""
 select coalesce(harness_outcome, 'unknown') as outcome, count(*) as n, count(*) filter (resolved) as n_resolved from v_joined group by 1""")
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return joined(spark, sf, "instance_id", "solver_id").groupBy(F.col("harness_outcome").alias("outcome")).agg(F.count("*").alias("n"), F.count_if(F.col("resolved")).alias("n_resolved"))


# --- joins, dedup, set operations --------------------------------------------------------


@query(needs=("v_attempts", "v_verdicts"), sql="""
 select count(*) as n from (select distinct solver_id, instance_id from v_attempts) a semi join v_verdicts using (solver_id, instance_id)""")
def matching_keys(spark: SparkSession, sf: str) -> DataFrame:
    return joins.matching_keys(views.attempts(spark, sf, "instance_id", "solver_id"), views.verdicts(spark, sf)).agg(F.count("*").alias("n"))


@query(needs=("v_attempts",), sql="""
 select * exclude (rn) from (select solver_id, instance_id, attempt_id, ended_at, attempt_index, row_number() over (partition by solver_id, instance_id order by coalesce(ended_at, timestamp '1970-01-01') desc, attempt_index desc, attempt_id desc) as rn from v_attempts
  where solver_id is not null and instance_id is not null) where rn = 1""")
def latest_attempt(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.attempts(spark, sf, "solver_id", "instance_id", "ended_at").filter("solver_id is not null and instance_id is not null").select("solver_id", "instance_id", "attempt_id", "ended_at", "attempt_index")
    return dedup.last_per(rows, ["solver_id", "instance_id"], [F.coalesce("ended_at", F.lit("1970-01-01").cast("timestamp_ntz")), "attempt_index", "attempt_id"])


@query(needs=("v_runs",), sql="""
 select instance_id, solver_id as model_name_or_path, model_patch from v_runs where length(coalesce(model_patch, '')) > 0 and coalesce(solver_id, '') <> '' and coalesce(instance_id, '') <> ''""")
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return records.predictions(views.runs(spark, sf, "instance_id", "solver_id", "model_patch"))


@query(needs=("v_runs",), sql="""
 , p as (select instance_id, solver_id as model_name_or_path from v_runs where length(coalesce(model_patch, '')) > 0 and coalesce(solver_id, '') <> '' and coalesce(instance_id, '') <> ''),
 d as (select distinct instance_id from materialized_items where instance_id is not null)
 select instance_id, model_name_or_path, 'predicted' as status from p semi join d using (instance_id) union all
 select instance_id, null, 'missing_prediction' from d anti join p using (instance_id)""")
def prediction_coverage(spark: SparkSession, sf: str) -> DataFrame:
    made = records.predictions(views.runs(spark, sf, "instance_id", "solver_id", F.left("model_patch", F.lit(1)).alias("model_patch"))).drop("model_patch")  # whether there is one
    return joins.covered_and_missing(made, table(spark, sf, "materialized_items").select("instance_id").dropna().distinct())


@query(needs=("v_attempts",), sql="""
 , sole as (select instance_id, min(solver_id) as one from v_attempts group by instance_id having count(distinct solver_id) = 1)
 select r.instance_id, r.job_id, coalesce(nullif(r.solver_id, ''), sole.one) as solver_id from (select distinct instance_id, job_id, solver_id from instance_results) r left join sole using (instance_id)""")
def solver_backfill(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "instance_results").select("instance_id", "job_id", "solver_id").distinct()
    sole = dedup.only_per(views.attempts(spark, sf, "instance_id", "solver_id"), "instance_id", "solver_id")
    return joins.backfilled(rows, sole, "instance_id", "solver_id")


@query(needs=("v_runs",), sql="""
 , l as (select job_id, instance_id, solver_id, attempt_state, attempt_index, row_number() over (partition by job_id order by attempt_index desc, attempt_id desc) as rn from v_runs where job_id is not null)
 select job_id, instance_id, solver_id, attempt_state, attempt_index from l where rn = 1""")
def latest_per_job(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.runs(spark, sf, "job_id", "attempt_index", "instance_id", "solver_id", "attempt_state").filter("job_id is not null").drop("ingested_at")
    return dedup.last_per(rows, ["job_id"], ["attempt_index", "attempt_id"]).select("job_id", "instance_id", "solver_id", "attempt_state", "attempt_index")


@query(needs=("v_runs", "v_verdicts"), sql="""
 , f as (select job_id, instance_id, solver_id, attempt_state from (select *, row_number() over (partition by job_id order by attempt_index desc, attempt_id desc) as rn from v_runs where job_id is not null) where rn = 1)
 select instance_id, solver_id from f where attempt_state in ('failed', 'timed_out') union select instance_id, solver_id from f semi join (select * from v_verdicts where not resolved) u using (instance_id, solver_id)""")
def retry_keys(spark: SparkSession, sf: str) -> DataFrame:
    return planning.retry_keys(latest_per_job(spark, sf), ["failed", "timed_out"], views.verdicts(spark, sf).filter("not resolved"), ["instance_id", "solver_id"])


@query(needs=("v_attempts",), sql="""
 , r as (select attempt_id, instance_id, solver_id, duration_ms, attempt_index from v_attempts where instance_id is not null and solver_id is not null),
 b as (select * exclude (rn) from (select *, row_number() over (partition by instance_id, solver_id order by attempt_index, attempt_id desc) as rn from r where attempt_index >= 2) where rn = 1)
 select instance_id, solver_id, duration_ms, 1 as run from b union all
 select instance_id, solver_id, duration_ms, 0 from (select * exclude (rn) from (select *, row_number() over (partition by instance_id, solver_id order by attempt_index, attempt_id desc) as rn from r where attempt_index < 2) where rn = 1) anti join b using (instance_id, solver_id)""")
def retry_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The first attempts as the base run, the least later attempt of a key as its retry; the retry replaces."""
    rows = views.attempts(spark, sf, "instance_id", "solver_id", "duration_ms").filter("instance_id is not null and solver_id is not null").select("attempt_id", "instance_id", "solver_id", "duration_ms", "attempt_index")
    keys = ["instance_id", "solver_id"]
    order = [-F.col("attempt_index"), "attempt_id"]
    runs = [dedup.last_per(rows.filter(c), keys, order).select(*keys, "duration_ms", F.lit(n).alias("run")) for n, c in enumerate(("attempt_index < 2", "attempt_index >= 2"))]
    return planning.merged_runs(runs, keys)


@query(sql="""
 select 'run:' || i.instance_id || ':' || s.solver_id || ':' || seed as job_id, i.instance_id, s.solver_id, s.provider, cast(seed as int) as seed
 from (select distinct instance_id from materialized_items where instance_id is not null and instance_id <> '') i, (select distinct solver_id, provider from solvers) s, (select unnest([7, 8]) as seed)""")
def job_plan(spark: SparkSession, sf: str) -> DataFrame:
    return planning.job_plan(table(spark, sf, "materialized_items"), table(spark, sf, "solvers"), planning.expand_seeds(7, 2)).select("job_id", "instance_id", "solver_id", "provider", F.col("seed").cast("int").alias("seed"))


@query(sql="""
 select instance_id, repo, version, cast((row_number() over (partition by repo, version order by instance_id) - 1) // 32 as int) as batch_no
 from (select distinct instance_id, repo, coalesce(version, '') as version from materialized_items where instance_id is not null)""")
def batch_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "materialized_items").filter("instance_id is not null").select("instance_id", "repo", F.coalesce("version", F.lit("")).alias("version")).distinct()
    return planning.batches(rows, ["repo", "version"], ["instance_id"], 32)


_LOG = "(select event_id, ts, 'job-' || user_id as job_id, event_type as status, value from events)"


@query(sql=f"""
 select job_id, status, event_id from (select *, row_number() over (partition by job_id order by ts desc, event_id desc) as rn from {_LOG}) where rn = 1""")
def job_final_status(spark: SparkSession, sf: str) -> DataFrame:
    return planning.final_states(jobs.log(table(spark, sf, "events"))).select("job_id", "status", "event_id")


@query(sql=f"""
 select before, status as after, count(*) as n from (select status, lag(status) over (partition by job_id order by ts, event_id) as before from {_LOG}) where before is not null group by all""")
def job_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return planning.transitions(jobs.log(table(spark, sf, "events")))


# --- routing -----------------------------------------------------------------------------


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    return router.solver_rollup(joined(spark, sf, "instance_id", "solver_id", "started_at", "ended_at", "duration_ms", "cost_micros"))


_ROLL = """, o as (select *, row_number() over (partition by solver_id, instance_id order by attempt_index desc, coalesce(ended_at, started_at) desc nulls last, attempt_id desc) as last_,
  row_number() over (partition by solver_id, instance_id order by attempt_index, coalesce(ended_at, started_at) nulls first, attempt_id) as first_ from v_joined where solver_id is not null and instance_id is not null),
 roll as (select solver_id, instance_id, count(*) as n_attempts, cast(coalesce(sum(cost_micros), 0) as bigint) as cost_micros, cast(coalesce(sum(duration_ms), 0) as bigint) as duration_ms,
  max(case when first_ = 1 then attempt_id end) as first_attempt, max(case when last_ = 1 then attempt_id end) as last_attempt, bool_or(last_ = 1 and resolved) as resolved, max(case when last_ = 1 then harness_outcome end) as harness_outcome
  from o group by solver_id, instance_id)"""
_RANK = """, ranking as (select solver_id, count(*) as n_instances, cast(sum(cost_micros) as bigint) / count(*) as mean_cost, cast(sum(duration_ms) as bigint) / count(*) as mean_duration,
  cast(row_number() over (order by cast(sum(cost_micros) as bigint) / count(*), cast(sum(duration_ms) as bigint) / count(*), solver_id) as int) as rank from roll group by solver_id)"""
_ROUTE = """, ids as (select arg_min(solver_id, rank) as cheap_id, arg_max(solver_id, rank) as dear_id from ranking),
 c as (select roll.*, row_number() over (partition by instance_id order by solver_id <> cheap_id, solver_id) as cheap_, row_number() over (partition by instance_id order by solver_id = dear_id desc, solver_id desc) as dear_,
  row_number() over (partition by instance_id order by not resolved, cost_micros, duration_ms, solver_id) as oracle_ from roll, ids),
 r as (select instance_id, (select count(*) from roll x where x.instance_id = a.instance_id) as n_solvers, a.solver_id as cheap_solver, b.solver_id as dear_solver, case when o.resolved then o.solver_id end as oracle_solver, case when o.resolved then o.cost_micros end as oracle_cost,
  a.resolved as cr, b.resolved as dr, a.cost_micros as cc, b.cost_micros as dc, a.duration_ms as cd, b.duration_ms as dd,
  not a.resolved and regexp_matches(a.harness_outcome, '(?i)invalid.?patch|timed.?out|timeout|no.progress|budget.exceeded') as sig
  from (select * from c where cheap_ = 1) a join (select * from c where dear_ = 1) b using (instance_id) join (select * from c where oracle_ = 1) o using (instance_id)),
 routed as (select instance_id, n_solvers, cheap_solver, dear_solver, oracle_solver, oracle_cost, cr as cheap_resolved, cc as cheap_cost, cd as cheap_latency, false as cheap_escalated, dr as dear_resolved, dc as dear_cost, dd as dear_latency, false as dear_escalated,
  cr or dr as failure_resolved, cc + case when not cr then dc else 0 end as failure_cost, cd + case when not cr then dd else 0 end as failure_latency, not cr as failure_escalated,
  cr or (sig and dr) as signal_resolved, cc + case when sig then dc else 0 end as signal_cost, cd + case when sig then dd else 0 end as signal_latency, sig as signal_escalated,
  case when cr then 'cheap_is_enough' when dr then 'needs_expensive' else 'likely_unsolved' end as label from r)"""


@query(needs=("v_joined",), sql=_ROLL + " select * from roll")
def solver_instance_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _rollup(spark, sf)


@query(needs=("v_joined",), sql=_ROLL + _RANK + " select * from ranking")
def solver_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return router.solver_ranking(_rollup(spark, sf))


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    roll = settle(_rollup(spark, sf))
    return router.routing_rows(roll, router.solver_ranking(roll))


@query(needs=("v_joined",), sql=_ROLL + _RANK + _ROUTE + " select * from routed")
def routing_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf)


@query(needs=("v_joined",), sql=_ROLL + _RANK + _ROUTE + """, long as (""" + " union all ".join(
    f"select oracle_cost, '{p}' as policy, {p}_resolved as resolved, {p}_cost as cost, {p}_latency as latency, {p}_escalated as escalated from routed" for p in router.POLICIES
) + """) select policy, count(*) as n, count(*) filter (resolved) as n_resolved, count(*) filter (escalated) as n_escalated, cast(sum(cost) as bigint) / count(*) as mean_cost, cast(sum(latency) as bigint) / count(*) as mean_latency,
  cast(sum(case when oracle_cost is not null then greatest(cost - oracle_cost, 0) end) as bigint) / nullif(count(oracle_cost), 0) as mean_regret,
  list_sort(list(latency))[1 + cast(greatest(ceil(count(latency) * 95.0 / 100) - 1, 0) as int)] as p95_latency from long group by policy""")
def policy_summary(spark: SparkSession, sf: str) -> DataFrame:
    return router.policy_summary(_routed(spark, sf))


_SPLIT = """ select instance_id, label, case when at_ <= greatest(round_even(n * 0.6, 0), 1) then 'train' when at_ <= greatest(round_even(n * 0.6, 0), 1) + round_even(n * 0.2, 0) then 'validation' else 'test' end as split
 from (select instance_id, label, count(*) over (partition by label) as n, row_number() over (partition by label order by sha256(instance_id), instance_id) as at_ from routed)"""


@query(needs=("v_joined",), sql=_ROLL + _RANK + _ROUTE + _SPLIT)
def router_split(spark: SparkSession, sf: str) -> DataFrame:
    return router.stratified_split(_routed(spark, sf).select("instance_id", "label"), "instance_id", "label")


@query(needs=("v_joined",), sql=_ROLL + _RANK + _ROUTE + """, k as (select label, count(*) as n from routed group by label)
 select cast(sum(n) as bigint) as n, 1 - cast(sum(n * n) as bigint) / cast(sum(n) * sum(n) as bigint) as gini, arg_min(label, (-n, label)) as majority from k""")
def gini_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return router.gini(_routed(spark, sf), "label")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of a task beside its routing label."""
    columns = ("problem_statement", "version", "repo", "base_commit")
    items = dedup.last_per(table(spark, sf, "materialized_items").filter("instance_id is not null").select("instance_id", "ingested_at", *columns), ["instance_id"], ["ingested_at"])
    repo, n_words = coerce.text("repo"), F.size(text.words("problem_statement"))
    numbers = (
        F.char_length(coerce.text("problem_statement")), text.filled_lines("problem_statement"), n_words,
        F.when(repo == "", 0).otherwise(F.size(F.split(repo, "/"))), F.char_length(repo), (coerce.text("base_commit") != "").cast("int"),
    )
    told = {"version_bucket": text.version_bucket("version"), "problem_statement_length_bucket": text.length_bucket(n_words), "problem_statement_signal": text.signal("problem_statement")}
    return items.select(
        "instance_id", *[c.alias(n) for n, c in zip(NUMBERS, numbers, strict=True)],
        *[(told[name] == bucket).cast("int").alias(f"{name}={bucket}") for name, buckets in BUCKETS.items() for bucket in buckets],
    ).join(_routed(spark, sf).select("instance_id", "label"), "instance_id")


NUMBERS = ("problem_statement_char_count", "problem_statement_line_count", "problem_statement_word_count", "repo_segment_count", "repo_slug_length", "base_commit_present")
BUCKETS = {
    "version_bucket": ("unknown", "python-tagged", "semantic", "compound", "opaque"),
    "problem_statement_length_bucket": ("short", "medium", "long", "very_long"),
    "problem_statement_signal": ("stacktrace", "error", "test", "path", "neutral"),
}
FEATURES = (*NUMBERS, *(f"{name}={bucket}" for name, buckets in BUCKETS.items() for bucket in buckets))


@query
def best_split(spark: SparkSession, sf: str) -> DataFrame:
    found = router.best_split(settle(_vectors(spark, sf)), FEATURES, "label")
    return spark.createDataFrame([found] if found else [], "feature string, threshold double, impurity double, uneven double")


@query
def tree_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The tree of the depth that validates best, told on all rows inside CASE expressions."""
    rows = settle(router.stratified_split(_vectors(spark, sf), "instance_id", "label"))
    tree, _ = router.fit_selected(rows, FEATURES, "label")
    return rows.select("instance_id", "split", "label", router.predicted(tree).alias("predicted"))


# --- texts, patches, JSON, reports -------------------------------------------------------

_BLANKS = "E' \\t\\n\\r\\x0b\\x0c'"
_FEATURES_SQL = r"""
 select instance_id, cluster_label, count(*) as n from (select instance_id, 'len=' || case when w <= 12 then 'short' when w <= 30 then 'medium' when w <= 60 then 'long' else 'very_long' end
  || '|signal=' || case when regexp_matches(s, '(?i)\b(traceback|stack ?trace|stacktrace|exception|panic|segfault)\b') then 'stacktrace' when regexp_matches(s, '(?i)\b(error|failed|failing|failure|bug|broken|crash|incorrect|invalid|regression)\b') then 'error'
    when regexp_matches(s, '(?i)\b(test|tests|pytest|unittest|assert|fixture|repro|regression)\b') then 'test' when regexp_matches(s, '(\b[\w./-]+\.[A-Za-z0-9]{1,6}\b|/[\w./-]+)') then 'path' else 'neutral' end
  || '|version=' || case when v = '' then 'unknown' when regexp_matches(v, '(?i)\bpy\d{2,3}\b') or contains(lower(v), 'python') then 'python-tagged' when regexp_matches(v, '\d+\.\d+(\.\d+)?') then 'semantic' when regexp_matches(v, '[-_+/]') then 'compound' else 'opaque' end as cluster_label
  from (select instance_id, s, v, len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) as w from (select distinct instance_id, trim(coalesce(problem_statement, ''), E' \t\n\r') as s, trim(coalesce(version, ''), E' \t\n\r') as v from materialized_items)))
 group by instance_id, cluster_label"""


@query(sql=_FEATURES_SQL)
def task_clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "materialized_items").select("instance_id", "problem_statement", "version").distinct()
    return rows.select("instance_id", text.cluster_label("problem_statement", "version").alias("cluster_label")).groupBy("instance_id", "cluster_label").agg(F.count("*").alias("n"))


@query(sql=r"""
 select doc_id, array_to_string(l, ',') as refs from (select doc_id, list_sort(list_distinct(regexp_extract_all(text, '(?:#|GH-)(\d+)', 1))) as l from documents where text is not null) where len(l) > 0""")
def issue_refs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("text is not null")
    return docs.select("doc_id", F.array_join(text.review_refs("text"), ",").alias("refs")).filter("refs <> ''")


_PULLS = r"""list_concat(list_concat(regexp_extract_all(text, '(?i)https?://github\.com/[^/\s]+/[^/\s]+/pull/(\d+)', 1), regexp_extract_all(text, '(?i)\bmerge\s+pull\s+request\s+#?(\d+)\b', 1)), regexp_extract_all(text, '(?i)\b(?:pr|pull request)\s*#?\s*(\d+)\b', 1))"""


@query(sql=rf"""
 with p as (select doc_id, text, list_filter({_PULLS}, lambda x, i: list_position({_PULLS}, x) = i) as pulls from documents where text is not null),
 i as (select doc_id, pulls, list_concat(regexp_extract_all(text, '(?i)https?://github\.com/[^/\s]+/[^/\s]+/issues/(\d+)', 1), list_filter(regexp_extract_all(' ' || text, '(?i)[^A-Za-z0-9](?:#|gh-)(\d+)\b', 1), lambda x: not list_contains(pulls, x))) as l from p)
 select doc_id, array_to_string(list_filter(l, lambda x, n: list_position(l, x) = n), ',') as issues, array_to_string(pulls, ',') as pulls from i where len(l) > 0 or len(pulls) > 0""")
def commit_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Issue and pull numbers told apart."""
    docs = table(spark, sf, "documents").filter("text is not null")
    return docs.select("doc_id", F.array_join(text.issue_refs("text"), ",").alias("issues"), F.array_join(text.pull_refs("text"), ",").alias("pulls")).filter("issues <> '' or pulls <> ''")


@query
def file_role_counts(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "file_roles").select("file_id", "repo", text.file_role("path").alias("role")).distinct()
    return files.groupBy("repo").pivot("role", ["prod", "test", "test_support", "docs", "config_build", "generated_vendor", "unknown"]).count().fillna(0)


def _list(values: Sequence[str]) -> str:
    return str(list(values))


_RULES = roles.merged()
SQL["file_role_counts"] = rf"""
 with f as (select distinct file_id, repo, list_filter(string_split(lower(replace(trim(path, E' \t\n\r'), '\', '/')), '/'), lambda p: p <> '' and p <> '.') as parts from file_roles),
 g as (select *, coalesce(parts[-1], '') as name, parts[:-2] as folders, regexp_extract(coalesce(parts[-1], ''), '.\.([^.]+)$', 1) as ending from f),
 h as (select repo, case when len(parts) = 0 then 'unknown' when list_has_any(parts, {_list(_RULES.vendor)}) or list_has_any(parts, {_list(roles.BUILD_DIRS)}) then 'generated_vendor'
   when len(parts) > 1 and list_has_any(parts[1:1], {_list(roles.CONFIG_ROOTS)}) or list_contains({_list(_RULES.config)}, name) then 'config_build' when list_contains({_list(_RULES.support)}, name) then 'test_support'
   when list_contains(parts[1:1], 'docs') and len(parts) > 1 or list_contains(folders, 'docs') and not list_contains({_list(roles.NO_DOCS)}, name) then 'docs' when list_contains({_list(roles.DOC_FILES)}, name) then 'docs'
   when list_has_any(folders, {_list(_RULES.test_dirs)}) then case when list_has_any(folders, {_list(roles.FIXTURE_DIRS)}) then 'test_support' when regexp_matches(name, '{roles.test_name(_RULES)}') or list_contains({_list(_RULES.endings)}, ending) then 'test' else 'test_support' end
   when regexp_matches(name, '{roles.test_name(_RULES)}') then 'test' when list_contains({_list(_RULES.endings)}, ending) or list_contains(folders, 'src') then 'prod' else 'unknown' end as role from g)
 select repo, """ + ", ".join(f"count(*) filter (role = '{r}') as {r}" for r in ("prod", "test", "test_support", "docs", "config_build", "generated_vendor", "unknown")) + " from h group by repo"


@query(sql=r"""
 select instance_id, len(list_filter(regexp_split_to_array(patch, '\n'), lambda x: x like 'diff --git %')) as files, len(list_filter(regexp_split_to_array(patch, '\n'), lambda x: x like '+%' and not x like '+++ %')) as added,
  len(list_filter(regexp_split_to_array(patch, '\n'), lambda x: x like '-%' and not x like '--- %')) as removed, len(list_filter(regexp_split_to_array(patch, '\n'), lambda x: x like '@@ -%')) as hunks
 from (select distinct instance_id, patch from materialized_items where patch is not null)""")
def patch_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "materialized_items").filter("patch is not null").select("instance_id", "patch").distinct()
    return rows.select("instance_id", patch.stats("patch").alias("s")).select("instance_id", *[F.col(f"s.{c}").cast("bigint").alias(c) for c in ("files", "added", "removed", "hunks")])


@query(sql=r"""
 select instance_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as paths from (select instance_id, list_concat(regexp_extract_all(patch, '(?m)^diff --git "?a/.+?"? "?b/(.+?)"?$', 1), regexp_extract_all(patch, '(?m)^\+\+\+ b/(.+)$', 1)) as l
  from (select distinct instance_id, patch from materialized_items where patch is not null))""")
def patch_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "materialized_items").filter("patch is not null").select("instance_id", "patch").distinct()
    return rows.select("instance_id", F.array_join(patch.paths("patch"), ",").alias("paths"))


@query
def patch_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Production and test side of patch and test patch together, and the patch without the test patch's files."""
    rows = table(spark, sf, "materialized_items").select("instance_id", "patch", "test_patch").distinct()
    whole = F.concat(F.coalesce("patch", F.lit("")), F.coalesce("test_patch", F.lit("")))
    cut = rows.select("instance_id", patch.split_sides(whole).alias("s"), patch.without("patch", patch.paths("test_patch")).alias("w"))
    return cut.select("instance_id", F.col("s.prod").alias("prod"), F.col("s.test").alias("test"), F.col("s.crossed").alias("crossed"), F.col("w.kept").alias("kept"), F.array_join("w.removed_paths", ",").alias("removed_paths"))


@query(needs=("v_runs",), sql="""
 select attempt_id, greatest(coalesce(try_cast(u ->> 'input_tokens' as bigint), try_cast(u ->> 'prompt_tokens' as bigint), 0), 0) as input, greatest(coalesce(try_cast(u ->> 'output_tokens' as bigint), try_cast(u ->> 'completion_tokens' as bigint), 0), 0) as output,
  greatest(coalesce(try_cast(u ->> 'total_tokens' as bigint), greatest(coalesce(try_cast(u ->> 'input_tokens' as bigint), try_cast(u ->> 'prompt_tokens' as bigint), 0), 0) + greatest(coalesce(try_cast(u ->> 'output_tokens' as bigint), try_cast(u ->> 'completion_tokens' as bigint), 0), 0)), 0) as total,
  greatest(coalesce(try_cast(u ->> 'cached_input_tokens' as bigint), 0), 0) as cached
 from (select attempt_id, case when json_type(j) = 'VARCHAR' then try_cast(j ->> '$' as json) else j end as u from (select attempt_id, try_cast(usage as json) as j from v_runs)) where json_type(u) = 'OBJECT'""")
def usage_tokens(spark: SparkSession, sf: str) -> DataFrame:
    v = views.runs(spark, sf, "usage").select("attempt_id", usage.parsed("usage").alias("v")).filter("schema_of_variant(v) like 'OBJECT%'")
    return v.select("attempt_id", usage.tokens(F.col("v")).alias("t")).select("attempt_id", "t.*")


@query(needs=("v_runs",), sql=r"""
 , l as (select attempt_id, raw_output, list_filter(list_transform(string_split(raw_output, chr(10)), lambda x: try_cast(x as json)), lambda x: x is not null) as e, list_filter(string_split(raw_output, chr(10)), lambda x: trim(x) <> '') as filled from v_runs where raw_output like '{%')
 select attempt_id, cast(coalesce(list_sum(list_transform(e, lambda x: case when (x ->> 'type') in ('tool_call', 'function_call', 'tool_use') or ((x ->> 'type') = 'item.started' and json_extract_string(x, '$.item.type') in ('command_execution', 'function_call', 'tool_call'))
   or ((x ->> 'type') = 'response.output_item.added' and json_extract_string(x, '$.item.type') in ('function_call', 'tool_call')) then 1
   else len(list_filter(coalesce(json_extract_string(x, '$.message.content[*].type'), []), lambda t: t in ('tool_use', 'server_tool_use', 'tool_call', 'function_call'))) end)), 0) as int) as tool_calls,
  json_extract_string(list_filter(e, lambda x: (x ->> 'type') = 'message')[-1], '$.text') as answer,
  len(filled) > 0 and len(list_filter(filled, lambda x: coalesce(lower(try_cast(x as json) ->> 'type') = 'error', false))) = len(filled) as error_only from l""")
def output_events(spark: SparkSession, sf: str) -> DataFrame:
    """Tool calls and the last message of each JSON-lines output."""
    told = (usage.tool_calls("raw_output").alias("tool_calls"), usage.last_message("raw_output").alias("answer"), usage.error_only("raw_output").alias("error_only"))
    return views.runs(spark, sf, F.col("raw_output").startswith("{").alias("lines"), *told).filter("lines").drop("ingested_at", "lines")


_FIELDS = ("model_patch", "raw_output", "stderr_output", "usage", "metadata")


@query(needs=("v_runs",), sql=" , w as (" + " union ".join(
    f"select attempt_id, solver_id, '{name}' as warning from v_runs where " + " or ".join(f"regexp_matches(trim(coalesce({f}, ''), E' \t\n\r'), '{pattern}')" for f in _FIELDS)
    for name, pattern in (("absolute_path", r"(?:^|[^A-Za-z0-9_.-])(?:/[A-Za-z0-9_.-]+){2,}"), ("source_snippet", r"\b(?:def|class|function|import|package|public|private|const|let|var)\s+"))
) + ") select solver_id, warning, count(*) as n from w group by all")
def privacy_scan(spark: SparkSession, sf: str) -> DataFrame:
    """What a shared bundle of attempts would give away, per solver."""
    found = F.array_distinct(F.flatten(F.array(*map(text.privacy_warnings, _FIELDS))))
    return views.runs(spark, sf, "solver_id", found.alias("found")).select("solver_id", F.explode("found").alias("warning")).groupBy("solver_id", "warning").agg(F.count("*").alias("n"))


@query(sql="""
 select instance_id, sha256(concat_ws('|', case when repo is null then '-' else length(repo) || ':' || repo end, case when base_commit is null then '-' else length(base_commit) || ':' || base_commit end, case when version is null then '-' else length(version) || ':' || version end)) as hash
 from (select distinct instance_id, repo, base_commit, version from materialized_items)""")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "materialized_items").select("instance_id", "repo", "base_commit", "version").distinct()
    return rows.select("instance_id", text.content_hash("repo", "base_commit", "version").alias("hash"))


SHARDS = 64


@query(needs=("v_verdicts",), sql="""
 select solver_id, 'pkg/mod.py::Suite::' || instance_id as test_id, case when resolved then 'pass' when contains(lower(coalesce(harness_outcome, '')), 'error') then 'error' else 'fail' end as outcome from v_verdicts""")
def junit_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Every verdict written as a JUnit report and parsed back."""
    verdicts = views.verdicts(spark, sf)
    bad = F.when(F.col("resolved"), "").when(F.lower("harness_outcome").contains("error"), "<error/>").otherwise("<failure/>")
    case = F.concat(F.lit('<testcase classname="pkg.mod.Suite" name="'), F.col("instance_id"), F.lit('">'), bad, F.lit("</testcase>"))
    # one report a solver and shard, so that no report grows with the solver's share of the rows
    report = verdicts.groupBy("solver_id", F.pmod(F.xxhash64("instance_id"), F.lit(SHARDS)).alias("shard")).agg(F.concat(F.lit("<testsuite>"), F.array_join(F.array_sort(F.collect_list(case)), ""), F.lit("</testsuite>")).alias("report"))
    return reports.parsed(report, "solver_id", "report", "junit")


@query(needs=("v_runs",), sql="""
 , o as (select solver_id, instance_id, min(case when attempt_index = 1 then attempt_state end) as before, max(case when attempt_index >= 2 then attempt_state end) as after, bool_or(attempt_index = 1) as b, bool_or(attempt_index >= 2) as a
  from v_runs where solver_id is not null and instance_id is not null group by all)
 select solver_id, instance_id, case when not b then null when before = 'succeeded' then 'pass' else 'fail' end as before, case when not a then null when after = 'succeeded' then 'pass' else 'fail' end as after,
  case when a and after = 'succeeded' and not coalesce(b and before = 'succeeded', false) then 'fail_to_pass' when a and after = 'succeeded' then 'pass_to_pass' when b and before = 'succeeded' then 'pass_to_fail' else 'fail_to_fail' end as transition from o where a or b""")
def test_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """First attempts against later ones as two outcome lists over (solver, instance)."""
    runs = views.runs(spark, sf, "solver_id", "instance_id", "attempt_index", "attempt_state").filter("solver_id is not null and instance_id is not null")
    told = lambda c: F.when(c == "succeeded", "pass").otherwise("fail").alias("outcome")
    keys = ["solver_id", "instance_id"]
    before = runs.filter("attempt_index = 1").groupBy(*keys).agg(told(F.min("attempt_state")))
    after = runs.filter("attempt_index >= 2").groupBy(*keys).agg(told(F.max("attempt_state")))
    return joins.test_transitions(before, after, keys)


# --- review scores -----------------------------------------------------------------------

DIMENSIONS = {"d_task_fit": 0.30, "d_correctness": 0.25, "d_maintainability": 0.20, "d_tests": 0.15, "d_focus": 0.10}
_SCORED = """(select *, (d_task_fit * 3000 + d_correctness * 2500 + d_maintainability * 2000 + d_tests * 1500 + d_focus * 1000) / 10000 as overall_delta from (
 select 'solver-' || (l_suppkey % 5) as solver_id, l_linestatus = 'O' as resolved, cast(l_partkey % 5 as int) - 2 as d_task_fit, cast(l_suppkey % 5 as int) - 2 as d_correctness, cast(l_linenumber % 5 as int) - 2 as d_maintainability,
  cast((l_orderkey + l_partkey) % 5 as int) - 2 as d_tests, cast(l_orderkey % 5 as int) - 2 as d_focus, l_orderkey, l_linenumber from lineitem))"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    five = lambda c: (c % 5).cast("int") - 2
    rows = line.select(
        F.concat(F.lit("solver-"), (F.col("l_suppkey") % 5).cast("string")).alias("solver_id"), (F.col("l_linestatus") == "O").alias("resolved"), five(F.col("l_partkey")).alias("d_task_fit"), five(F.col("l_suppkey")).alias("d_correctness"),
        five(F.col("l_linenumber")).alias("d_maintainability"), five(F.col("l_orderkey") + F.col("l_partkey")).alias("d_tests"), five(F.col("l_orderkey")).alias("d_focus"), "l_orderkey", "l_linenumber")
    return rows.withColumn("overall_delta", review.weighted_delta(DIMENSIONS))


@query(sql=f"""
 select solver_id, count(*) as n, round(avg(overall_delta), 6) as mean_delta, count(*) filter (overall_delta >= 0.35) / count(*) as better_share, count(*) filter (overall_delta <= -0.35) / count(*) as worse_share,
  count(*) filter (resolved and overall_delta <= -0.35) as resolved_but_worse, count(*) filter (not resolved and overall_delta >= 0.35) as unresolved_but_promising from {_SCORED} group by solver_id""")
def review_by_solver(spark: SparkSession, sf: str) -> DataFrame:
    return review.by_solver(_scored(spark, sf)).withColumn("mean_delta", F.round("mean_delta", 6))


@query(sql=" union all ".join(f"select '{d}' as dimension, count({d}) as n, avg({d}) as mean_delta from {_SCORED}" for d in DIMENSIONS))
def review_by_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return review.by_dimension(_scored(spark, sf), list(DIMENSIONS))


@query(sql=f"select solver_id, l_orderkey, l_linenumber, round(overall_delta, 6) as overall_delta from {_SCORED} order by overall_delta desc, l_orderkey, l_linenumber, solver_id limit 10")
def review_best10(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("solver_id", "l_orderkey", "l_linenumber", "overall_delta").orderBy(F.desc("overall_delta"), "l_orderkey", "l_linenumber", "solver_id").limit(10)


@query(sql=f"select case when d <= -1.25 then 'much_worse' when d <= -0.35 then 'worse' when d < 0.35 then 'similar' when d < 1.25 then 'better' else 'much_better' end as label, count(*) as n from (select round(overall_delta, 6) as d from {_SCORED}) group by label")
def review_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).groupBy(review.delta_label(F.col("overall_delta")).alias("label")).agg(F.count("*").alias("n"))


# --- streams and their batch twins -------------------------------------------------------


@query(sql=f"select date_trunc('hour', ts) as starts_at, status, count(*) as n, cast(sum(cast(round(value * 1000000) as bigint)) as bigint) as value_micros from {_LOG} group by all")
def burn_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.burn(jobs.log(table(spark, sf, "events"))).withColumn("starts_at", F.col("starts_at").cast("timestamp_ntz"))


@query(sql=f"""
 select starts_at, status, count(*) as n, cast(sum(cast(round(value * 1000000) as bigint)) as bigint) as value_micros from (
  select date_trunc('hour', ts) as starts_at, status, value from {_LOG} union all select date_trunc('hour', ts) - interval 1 hour, status, value from {_LOG}) group by all""")
def burn_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.burn(jobs.log(table(spark, sf, "events")), "2 hours", "1 hour").withColumn("starts_at", F.col("starts_at").cast("timestamp_ntz"))


@query(sql=f"""
 select job_id, min(ts) as starts_at, max(ts) + interval 30 minute as ends_at, count(*) as n from (select *, sum(fresh) over (partition by job_id order by ts, event_id) as session from (
  select *, case when ts < lag(ts) over (partition by job_id order by ts, event_id) + interval 30 minute then 0 else 1 end as fresh from {_LOG})) group by job_id, session""")
def job_sessions(spark: SparkSession, sf: str) -> DataFrame:
    found = jobs.sessions(jobs.log(table(spark, sf, "events")))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("starts_at", "ends_at")})


@query(sql=SQL["burn_tumbling"])
def burn_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows out of a file stream driven to its end."""
    out = jobs.replay(spark, sf, "events.parquet", jobs.burn, ["starts_at", "status"])
    return out.withColumn("starts_at", F.col("starts_at").cast("timestamp_ntz"))


@query(sql=f"select job_id, round(sum(value), 6) as spent from {_LOG} group by job_id having sum(value) > 1000")
def budget_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs whose running value passes a limit, with the total kept as state."""
    return jobs.replay(spark, sf, "events.parquet", lambda df: jobs.over_budget(df, 1_000.0), ["job_id"]).withColumn("spent", F.round("spent", 6))


# --- nested records as flat tables -------------------------------------------------------


def _nested(spark: SparkSession, sf: str, kinds: tuple[str, ...] | None = None, once: bool = False) -> DataFrame:
    runs = nested.occurrences(table(spark, sf, "attempts"), "attempt_id", ["usage", "metadata"], kinds=kinds, once=once)
    return runs.unionByName(nested.occurrences(table(spark, sf, "task_features"), "instance_id", ["features"], kinds=kinds, once=once))


_PATHS = r"""
 with recursive src as (select attempt_id as owner_id, 'usage' as field_name, usage as t from attempts union select attempt_id, 'metadata', metadata from attempts union select instance_id, 'features', features from task_features),
 roots as (select owner_id, field_name, try_cast(t as json) as j from src where t is not null),
 n as (
  select owner_id, field_name, '' as path, case when json_type(j) = 'VARCHAR' then try_cast(j ->> '$' as json) else j end as j, false as in_array from roots where j is not null
  union all
  select owner_id, field_name, path || kid.at as path, kid.j as j, kid.el as in_array from (select owner_id, field_name, path, unnest(case when json_type(j) = 'OBJECT' then
    list_transform(json_keys(j), lambda k: {'at': case when path = '' then k else '.' || k end, 'el': false, 'j': case when list_contains(LISTED, k) then (case when json_type(j -> k) = 'VARCHAR' then (case when json_type(try_cast(j ->> k as json)) = 'OBJECT' then json_array(try_cast(j ->> k as json)) else coalesce(try_cast(j ->> k as json), j -> k) end) when json_type(j -> k) = 'OBJECT' then json_array(j -> k) else j -> k end) else j -> k end})
   when json_type(j) = 'ARRAY' then list_transform(range(cast(json_array_length(j) as bigint)), lambda i: {'at': '[' || i || ']', 'el': true, 'j': json_extract(j, cast(i as bigint))}) else [] end) as kid from n where json_type(j) in ('OBJECT', 'ARRAY')))
 select distinct owner_id, field_name, path as node_path from n where in_array and json_type(j) = 'OBJECT'"""
SQL["p3_found"] = _PATHS.replace("LISTED", str(list(nested.LIST_KEYS)))


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.array_objects(_nested(spark, sf))


@query
def p3_bridge(spark: SparkSession, sf: str) -> DataFrame:
    return nested.bridge(_nested(spark, sf))


@query
def p3_objects(spark: SparkSession, sf: str) -> DataFrame:
    return nested.objects(_nested(spark, sf, once=True))


KINDS = {
    "models": {"name": "string"},
    "tiers": {"upto": "bigint", "usd": "double"},
    "turns": {"no": "bigint", "role": "string"},
    "calls": {"tool": "string", "ms": "bigint"},
    "edits": {"path": "string", "added": "bigint", "removed": "bigint"},
    "retries": {"at": "string", "why": "string"},
    "signals": {"kind": "string", "weight": "double"},
    "spans": {"start": "bigint", "end": "bigint"},
    "cached": {"read": "bigint", "write": "bigint"},
    "args": {"cwd": "string"},
    "payload": {"host": "string", "run_id": "string"},
}

#: The roots, one table a field.
ROOTS = {
    "usage": {"input_tokens": "bigint", "output_tokens": "bigint", "prompt_tokens": "bigint", "completion_tokens": "bigint"},
    "metadata": {"schema_version": "string", "host": "string", "run_id": "string"},
    "features": {
        "repo": "string", "repo_segment_count": "bigint", "repo_slug_length": "bigint", "version": "string", "version_bucket": "string", "base_commit_present": "boolean",
        "problem_statement_char_count": "bigint", "problem_statement_word_count": "bigint", "problem_statement_length_bucket": "string", "problem_statement_signal": "string",
        "problem_statement_has_error_terms": "boolean", "problem_statement_has_stacktrace": "boolean",
    },
}


def _kind(kind: str, columns: dict[str, str], field: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: nested.of_kind(_nested(spark, sf, (kind,)), kind, columns, field)


QUERIES |= {f"p3_{kind}": _kind(kind, columns) for kind, columns in KINDS.items()}
QUERIES |= {f"p3_{field}": _kind("", columns, field) for field, columns in ROOTS.items()}


@query
def p3_flags(spark: SparkSession, sf: str) -> DataFrame:
    """The command-line flags of ``args``, the one array of scalars."""
    return nested.values_of(_nested(spark, sf, ("args",)), "args", "flags")
