"""Queries over runs, verdicts and reviews: full summaries, harness results, retries, browsing and judging, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.functions import coerce, text, usage, verdicts
from lathework.operators import browser, dedup, frontier, harness, joins, metrics, planning, review, router
from lathework.plans import views
from lathework.plans.catalogue import _LOG, _RANK, _ROLL, _ROUTE, _S, _SCORED, DIMENSIONS, FEATURES, SQL, _routed, _scored, _vectors, group_summary, job_plan, joined, query, retry_keys
from lathework.runtime import settle, table
from lathework.sources import records
from lathework.streaming import jobs


def _trim(c: str) -> str:
    return f"trim(coalesce({c}, ''), E' \\t\\n\\r')"


def _label(c: str) -> str:
    raw, low = _trim(c), f"lower({_trim(c)})"
    flat = f"replace(replace({low}, '-', '_'), ' ', '_')"
    return (
        f"(case when {low} like 'invalid patch:%' or {flat} = 'invalid_patch' then 'invalid_patch' when contains({low}, 'timeout') or {flat} = 'timed_out' then 'timeout'"
        f" when contains({low}, 'hit your limit') or contains({low}, 'rate limit') then 'rate_limit' when contains({low}, 'model not found') then 'model_not_found' else {raw} end)"
    )


# --- what records state ------------------------------------------------------------------

_OBJECTS = """, raw_ as (select *, try_cast(usage as json) as ju, try_cast(metadata as json) as jm from v_runs),
 o_ as (select * exclude (ju, jm), case when json_type(ju) = 'VARCHAR' then try_cast(ju ->> '$' as json) else ju end as u, case when json_type(jm) = 'VARCHAR' then try_cast(jm ->> '$' as json) else jm end as m from raw_),
 told as (select *, case when json_type(u) = 'OBJECT' and len(json_keys(u)) > 0 then u when json_type(m -> 'usage') = 'OBJECT' and len(json_keys(m -> 'usage')) > 0 then m -> 'usage' end as stated from o_)"""
_EVENT = """(case when (x ->> 'type') in ('tool_call', 'function_call', 'tool_use') or ((x ->> 'type') = 'item.started' and json_extract_string(x, '$.item.type') in ('command_execution', 'function_call', 'tool_call'))
   or ((x ->> 'type') = 'response.output_item.added' and json_extract_string(x, '$.item.type') in ('function_call', 'tool_call')) then 1
   else len(list_filter(coalesce(json_extract_string(x, '$.message.content[*].type'), []), lambda t: t in ('tool_use', 'server_tool_use', 'tool_call', 'function_call'))) end)"""
_CALLS = f"""coalesce(case when coalesce(try_cast(stated ->> 'tool_calls' as bigint), try_cast(m ->> 'tool_calls' as bigint)) is not null then greatest(coalesce(try_cast(stated ->> 'tool_calls' as bigint), try_cast(m ->> 'tool_calls' as bigint)), 0) end,
  cast(list_sum(list_transform(list_filter(list_transform(string_split(raw_output, chr(10)), lambda x: try_cast(x as json)), lambda x: x is not null), lambda x: {_EVENT})) as bigint), 0)"""


def _pick(keys: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"try_cast(stated ->> '{k}' as bigint)" for k in keys) + ")"


_IN, _OUT = f"greatest(coalesce({_pick(usage.INPUT)}, 0), 0)", f"greatest(coalesce({_pick(usage.OUTPUT)}, 0), 0)"


@query(needs=("v_runs",), sql=_OBJECTS + f"""
 select attempt_id, {_IN} as input, {_OUT} as output, case when {_pick(usage.TOTAL)} is not null then greatest({_pick(usage.TOTAL)}, 0) else {_IN} + {_OUT} end as total, greatest(coalesce({_pick(usage.CACHED)}, 0), 0) as cached from told""")
def usage_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every attempt's record, wherever the record states them."""
    found = usage.record_tokens(usage.parsed("usage"), usage.parsed("metadata"))
    return views.runs(spark, sf, found.alias("t")).select("attempt_id", "t.*")


@query(needs=("v_runs",), sql=_OBJECTS + f" select attempt_id, {_CALLS} as tool_calls from told")
def tool_call_count(spark: SparkSession, sf: str) -> DataFrame:
    return views.runs(spark, sf, usage.record_calls(usage.parsed("usage"), usage.parsed("metadata"), F.col("raw_output")).alias("tool_calls")).select("attempt_id", "tool_calls")


@query(needs=("v_attempts",), sql="""
 select solver_id, count(*) as n, cast(sum(cast(round((case attempt_index % 3 when 1 then c * 0.25 + c * 0.75 else c end) * 1000000) as bigint)) as bigint) as cost_micros
 from (select solver_id, attempt_index, cost_micros / 1000000 as c from v_attempts where cost_micros > 0) group by solver_id""")
def row_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Money written as a total, as parts or in the metadata, and read back."""
    paid = views.attempts(spark, sf, "solver_id", "cost_micros").filter("cost_micros > 0")
    c, kind = F.col("cost_micros") / 1_000_000, F.col("attempt_index") % 3
    own = F.when(kind == 0, F.to_json(F.struct(c.alias("total_cost")))).when(kind == 1, F.to_json(F.struct((c * 0.25).alias("input_cost"), (c * 0.75).alias("output_cost"))))
    inside = F.when(kind == 2, F.to_json(F.struct(F.struct(c.alias("usd")).alias("cost"))))
    read = paid.select("solver_id", usage.record_cost(F.try_parse_json(own), F.try_parse_json(inside)).alias("cost"))
    return read.groupBy("solver_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("cost") * 1_000_000).cast("bigint")).alias("cost_micros"))


# --- grouped metrics in full -------------------------------------------------------------

_COUNTED = ("instance_id", "solver_id", "duration_ms", "cost_micros", "input_tokens", "output_tokens", "total_tokens")


@query(needs=("v_joined", "v_runs"), sql=_OBJECTS + f""",
 calls as (select attempt_id, {_CALLS} as tool_calls from told),
 c as (select solver_id, count(*) as attempt_count, cast(coalesce(sum(tool_calls) filter (real), 0) as bigint) as tool_calls, cast(coalesce(sum(total_tokens) filter (real), 0) as bigint) as tokens,
   list_sort(list(greatest(coalesce(duration_ms, 0), 0)) filter (real)) as d, count(distinct instance_id) filter (real and resolved) as won from (select *, coalesce(instance_id, '') <> '' as real from v_joined left join calls using (attempt_id)) group by solver_id)
 select solver_id, attempt_count, won as resolved_instance_count, d[1 + cast(floor(0.5 * (len(d) - 1) + 0.5) as int)] as p50_duration_ms, d[1 + cast(floor(0.95 * (len(d) - 1) + 0.5) as int)] as p95_duration_ms, tool_calls,
  tokens / attempt_count as average_tokens, tool_calls / attempt_count as average_tool_calls, case when won > 0 then tokens / won end as tokens_per_resolved, case when won > 0 then tool_calls / won end as tool_calls_per_resolved from c""")
def group_summary_full(spark: SparkSession, sf: str) -> DataFrame:
    """The per-attempt averages, percentiles and tool calls of each group."""
    rows = joined(spark, sf, *_COUNTED).join(tool_call_count(spark, sf), "attempt_id", "left")
    return metrics.attempt_summary(rows, ["solver_id"])


@query(needs=("v_joined", "v_runs"), sql=_OBJECTS + """,
 g as (select coalesce(t.attempt_state, '') as attempt_state, case when (m -> 'schema_version') is null then 'unknown' else coalesce(m ->> 'schema_version', '') end as schema_version, 'unknown' as zone, j.instance_id, j.resolved
  from v_joined j join told t using (attempt_id))
 select attempt_state, schema_version, zone, json_object('attempt_state', attempt_state, 'schema_version', schema_version, 'zone', zone)::varchar as group_json, count(*) as attempt_count,
  count(distinct instance_id) filter (instance_id <> '') as unique_instance_count, count(distinct instance_id) filter (instance_id <> '' and resolved) as resolved_instance_count from g group by 1, 2, 3""")
def group_summary_by_state(spark: SparkSession, sf: str) -> DataFrame:
    """Groups by a column, by a key of the metadata, and by one that no record has."""
    states = views.runs(spark, sf, "attempt_state", "metadata").withColumn("meta", usage.parsed("metadata")).drop("ingested_at", "metadata")
    rows = joined(spark, sf, *_COUNTED).join(states, "attempt_id")
    dims = ["attempt_state", "schema_version", "zone"]
    keyed = rows.select(*_COUNTED, "resolved", *[metrics.group_value(rows, d, "meta").alias(d) for d in dims])
    found = metrics.group_summary(keyed, dims)
    return found.select(*dims, metrics.group_json(dims).alias("group_json"), "attempt_count", "unique_instance_count", "resolved_instance_count")


@query(needs=("v_joined", "v_runs"), sql=_OBJECTS + f""",
 calls as (select attempt_id, {_CALLS} as tool_calls from told)
 select count(*) as joined_rows, count(cost_micros) / count(*) as cost_coverage_rate, count(*) filter (total_tokens > 0) / count(*) as token_coverage_rate, count(*) filter (tool_calls > 0) / count(*) as tool_call_coverage_rate,
  cast(coalesce(sum(greatest(cost_micros, 0)), 0) as bigint) / 1000000 as total_attempt_cost_usd, cast(coalesce(sum(tool_calls), 0) as bigint) as total_tool_calls from v_joined left join calls using (attempt_id)""")
def top_line_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the joined rows name a cost, tokens and tool calls."""
    rows = joined(spark, sf, *_COUNTED).join(tool_call_count(spark, sf), "attempt_id", "left")
    share = lambda c: coerce.ratio(F.count_if(c), F.count("*"))
    return rows.agg(
        F.count("*").alias("joined_rows"), share(F.col("cost_micros").isNotNull()).alias("cost_coverage_rate"), share(F.col("total_tokens") > 0).alias("token_coverage_rate"),
        share(F.col("tool_calls") > 0).alias("tool_call_coverage_rate"), (F.coalesce(F.sum(F.greatest("cost_micros", F.lit(0))), F.lit(0)) / 1_000_000).alias("total_attempt_cost_usd"),
        F.coalesce(F.sum("tool_calls"), F.lit(0)).alias("total_tool_calls"))


@query
def cheapest_solver(spark: SparkSession, sf: str) -> DataFrame:
    return group_summary(spark, sf).agg(F.min_by("solver_id", frontier.cost_key()).alias("solver_id"))


SQL["cheapest_solver"] = _S + " select solver_id from s order by coalesce(cost_per_resolved, 'infinity'::double), raw_resolution_rate desc, coalesce(latency_ms_per_resolved, 'infinity'::double), solver_id limit 1"


# --- failures and harness results --------------------------------------------------------


@query(needs=("v_runs", "v_verdicts"), sql=f"""
 select coalesce(nullif(failure_reason, ''), nullif({_label('exit_reason')}, ''), case when lower({_trim('attempt_state')}) in ('failed', 'invalid_patch', 'timed_out') then {_label(f"lower({_trim('attempt_state')})")} end, '') as reason, count(*) as n
 from v_runs left join v_verdicts using (solver_id, instance_id) where not coalesce(resolved, false) group by 1""")
def failure_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why unresolved attempts failed, from the verdict, the exit reason, the events or the state."""
    error = usage.event_error(usage.parsed("metadata"))
    silent = (usage.record_tokens(usage.parsed("usage"), usage.parsed("metadata"))["total"] == 0) & usage.error_only("raw_output")
    # only a few attempts have an event error; the costly test for the others stays unread
    rows = views.runs(spark, sf, "solver_id", "instance_id", "exit_reason", "attempt_state", error.alias("event"), F.when(error.isNotNull(), silent).otherwise(False).alias("mute"))
    lost = joins.with_verdicts(rows.drop("ingested_at"), views.verdicts(spark, sf)).filter("not resolved")
    why = verdicts.failure_reason(F.col("failure_reason"), F.lit(None).cast("string"), F.col("exit_reason"), F.col("event"), F.col("attempt_state"), F.col("mute"))
    return lost.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


_ITEMS = """, items as (select * exclude (rn) from (select *, row_number() over (partition by instance_id order by ingested_at desc) as rn from materialized_items where instance_id is not null) where rn = 1)"""
_STATUS = "case when {s} in ('resolved', 'passed', 'pass') then 'resolved' when {s} in ('not_resolved', 'unresolved', 'failed') then 'not_resolved' when {s} in ('skipped', 'missing_prediction') then 'skipped' when {s} in ('error', 'errored', 'crash', 'failed_with_exception') then 'error' else 'not_resolved' end"
_LAST = _ITEMS + """, last as (select * exclude (rn) from (select instance_id, solver_id, harness_outcome, failure_reason, resolved, row_number() over (partition by instance_id order by ingested_at desc, job_id desc nulls last, solver_id desc) as rn from instance_results where instance_id is not null) where rn = 1),
 results as (select i.instance_id, i.repo, lower(trim(coalesce(case when l.instance_id is null then 'missing' else nullif(trim(l.harness_outcome, E' \\t\\n\\r'), '') end, 'missing'))) as h, l.instance_id is not null as there, nullif(trim(l.failure_reason, E' \\t\\n\\r'), '') as failure_reason,
   case when trim(coalesce(l.resolved, ''), E' \\t\\n\\r') = '' then null else lower(trim(l.resolved, E' \\t\\n\\r')) in ('true','1','yes','y','passed','resolved') end as known from items i left join last l using (instance_id))"""


def _items(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    raw = table(spark, sf, "materialized_items").filter("instance_id is not null").select("instance_id", "ingested_at", *columns)
    return dedup.last_per(raw, ["instance_id"], ["ingested_at"]).drop("ingested_at")


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """One result an instance, the evaluation ingested last; a blank verdict is unknown."""
    raw = table(spark, sf, "instance_results").filter("instance_id is not null").select(
        "instance_id", "ingested_at", "job_id", "solver_id", coerce.filled("harness_outcome").alias("harness_outcome"), coerce.filled("failure_reason").alias("failure_reason"),
        F.when(coerce.filled("resolved").isNotNull(), coerce.truth("resolved")).alias("resolved"))
    return dedup.last_per(raw, ["instance_id"], ["ingested_at", "job_id", "solver_id"]).select("instance_id", "harness_outcome", "failure_reason", "resolved", F.lit(True).alias("has_result"))


def _dataset_results(spark: SparkSession, sf: str) -> DataFrame:
    return harness.dataset_results(_items(spark, sf, "repo"), _results(spark, sf))


@query(sql="with zero as (select 1)" + _LAST + f"""
 select instance_id, repo, {_STATUS.format(s='h')} as status, coalesce(known, {_STATUS.format(s='h')} = 'resolved') as resolved, case when there then failure_reason else 'no harness result for instance' end as reason,
  case when {_STATUS.format(s='h')} = 'error' then failure_reason end as error from results""")
def harness_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every item with the normalised status of its last result, missing ones included."""
    return _dataset_results(spark, sf)


@query(sql="with zero as (select 1)" + _LAST + f""", t as (select {_STATUS.format(s='h')} as status, coalesce(case when there then failure_reason else 'no harness result for instance' end, '') as reason from results)
 select case when reason in ({', '.join(repr(c) for c in verdicts.FAILURE_CODES)}) then reason when status = 'error' and reason = 'run_a_failed' then 'base_repo_unrunnable' when status = 'error' and reason in ('run_b_rerun_failed', 'run_c_rerun_failed') then 'flaky_outcomes'
   when status = 'not_resolved' and reason = 'declared_ftp_not_resolved' then reason else 'unknown_validator_failure' end as code, status, count(*) as n from t where status <> 'resolved' group by all""")
def failure_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    rows = _dataset_results(spark, sf).filter("status <> 'resolved'")
    return rows.groupBy(verdicts.failure_code(F.col("status"), F.col("reason"), F.lit(None).cast("string")).alias("code"), "status").agg(F.count("*").alias("n"))


_MADE = """, made as (select distinct solver_id, instance_id, attempt_id from v_runs where length(coalesce(model_patch, '')) > 0 and coalesce(solver_id, '') <> '' and coalesce(instance_id, '') <> '')"""


def _made(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of the attempts with a patch, and whether there is one told before any text is shuffled."""
    has = (F.length(F.coalesce("model_patch", F.lit(""))) > 0).alias("has_patch")
    return views.runs(spark, sf, "solver_id", "instance_id", has).filter("has_patch and coalesce(solver_id, '') <> '' and coalesce(instance_id, '') <> ''").select("solver_id", "instance_id", "attempt_id")


@query(needs=("v_runs", "v_verdicts"), sql=_MADE + _ITEMS + " select solver_id, instance_id, repo, version from made semi join (select * from v_verdicts where resolved) using (solver_id, instance_id) join items using (instance_id)")
def resolved_slice(spark: SparkSession, sf: str) -> DataFrame:
    """The data set's row of every prediction of a resolved key."""
    return harness.resolved_slice(_items(spark, sf, "repo", "version"), _made(spark, sf), views.verdicts(spark, sf).filter("resolved"))[1].select("solver_id", "instance_id", "repo", "version")


@query(needs=("v_runs", "v_verdicts"), sql=_MADE + _ITEMS + """ select distinct solver_id, instance_id from instance_results semi join made using (solver_id, instance_id) semi join items using (instance_id)
 where lower(trim(coalesce(resolved, ''), E' \\t\\n\\r')) in ('true','1','yes','y','passed','resolved')""")
def resolved_slice_by_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "instance_results").select("solver_id", "instance_id", "ingested_at", coerce.truth("resolved").alias("resolved")).filter("solver_id is not null and instance_id is not null")
    return harness.resolved_slice_by_results(_items(spark, sf), _made(spark, sf), rows, ["ingested_at"])


_MERGED = _MADE + _ITEMS + f""", keys as (select distinct solver_id, instance_id from made),
 merged as (select k.solver_id, k.instance_id, case when v.solver_id is null then 'error' else {_STATUS.format(s="lower(coalesce(v.harness_outcome, ''))")} end as status,
   case when v.solver_id is null then 'no harness result for prediction' else v.failure_reason end as reason, coalesce(v.resolved, false) as resolved from keys k left join v_verdicts v using (solver_id, instance_id)
  union all select '', instance_id, 'skipped', 'missing_prediction', false from items anti join keys using (instance_id))"""


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    results = views.verdicts(spark, sf).withColumn("has_result", F.lit(True))
    return harness.merged_results(_made(spark, sf).select("solver_id", "instance_id").distinct(), results, _items(spark, sf))


@query(needs=("v_runs", "v_verdicts"), sql=_MERGED + " select * from merged")
def merged_results(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf)


@query(needs=("v_runs", "v_verdicts"), sql=_MERGED + """ select count(*) as total, count(*) filter (status = 'resolved') as resolved, count(*) filter (status = 'not_resolved') as not_resolved, count(*) filter (status = 'error') as error,
  count(*) filter (status = 'skipped') as skipped, round_even(count(*) filter (status = 'resolved') / count(*), 3) as rate from merged""")
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    return harness.run_counters(_merged(spark, sf))


@query(needs=("v_runs",), sql="""
 , t as (select instance_id, solver_id, max(case when attempt_state = 'succeeded' then 'pass' else 'fail' end) filter (attempt_index = 1) as b, max(case when attempt_state = 'succeeded' then 'pass' else 'fail' end) filter (attempt_index = 2) as b2,
   max(case when attempt_state = 'succeeded' then 'pass' else 'fail' end) filter (attempt_index = 3) as c, max(case when attempt_state = 'succeeded' then 'pass' else 'fail' end) filter (attempt_index = 4) as c2
  from v_runs where instance_id is not null and solver_id is not null and attempt_index between 1 and 4 group by instance_id, solver_id)
 select instance_id, bool_or(b is distinct from b2 or c is distinct from c2) as flaky, bool_or(coalesce(b = 'pass', false) and coalesce(c, '') <> 'pass') as regressed, bool_or(coalesce(b = 'fail', false) and coalesce(c, '') <> 'pass') as still_failing from t group by instance_id""")
def flaky(spark: SparkSession, sf: str) -> DataFrame:
    """The attempts one to four of an instance as two runs with their reruns, a test a solver: what is flaky, regressed, or fails still."""
    rows = views.runs(spark, sf, "instance_id", "solver_id", "attempt_index", "attempt_state").filter("instance_id is not null and solver_id is not null and attempt_index between 1 and 4")
    runs = ("b", "b_again", "c", "c_again")
    told = rows.select("instance_id", "solver_id", F.element_at(F.array(*map(F.lit, runs)), F.col("attempt_index")).alias("run"), F.when(F.col("attempt_state") == "succeeded", "pass").otherwise("fail").alias("outcome"))
    maps = harness.outcome_maps(told, ["instance_id"], "solver_id", "outcome", "run", runs)
    passed = lambda o: F.map_keys(F.map_filter("b", lambda k, v: v == o))
    return maps.select(
        "instance_id", verdicts.flaky(*map(F.col, runs)).alias("flaky"), F.coalesce(verdicts.regressed(F.col("b"), F.col("c"), passed("pass")), F.lit(False)).alias("regressed"),
        F.coalesce(verdicts.still_failing(F.col("c"), passed("fail")), F.lit(False)).alias("still_failing"))


@query(sql=None)
def retry_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs of the plan whose instance and solver failed."""
    return job_plan(spark, sf).join(retry_keys(spark, sf), ["instance_id", "solver_id"], "left_semi").select("job_id", "instance_id", "solver_id", "provider", "seed")


SQL["retry_plan"] = "with plan as (" + SQL["job_plan"] + "), keys as (" + SQL["retry_keys"] + ") select job_id, instance_id, solver_id, provider, seed from plan semi join keys using (instance_id, solver_id)"


@query(sql="""
 with r as (select instance_id, solver_id, ingested_at, case when abs(row_id) % 3 = 0 then 'base' when abs(row_id) % 3 = 1 then 'base-retry' else 'base-retry-b' end as run, row_id from (select *, length(job_id) as row_id from instance_results where instance_id is not null and solver_id is not null and job_id is not null))
 select 'base' as family, instance_id, solver_id, run from (select *, row_number() over (partition by instance_id, solver_id order by run <> 'base' desc, run desc) as rn from r) where rn = 1""")
def retry_family(spark: SparkSession, sf: str) -> DataFrame:
    """Results spread over a base run and two retries, merged: the last run of a key counts, all runs have results."""
    kind = F.length("job_id") % 3
    rows = table(spark, sf, "instance_results").filter("instance_id is not null and solver_id is not null and job_id is not null").select(
        "instance_id", "solver_id", F.when(kind == 0, "base").when(kind == 1, "base-retry").otherwise("base-retry-b").alias("run"))
    whole = planning.complete_families(rows, rows.select("run").distinct(), "run").drop("family")
    return planning.merged_families(whole, "run", ["instance_id", "solver_id"]).select("family", "instance_id", "solver_id", "run")


# --- browsing and judging ----------------------------------------------------------------


@query(needs=("v_runs", "v_verdicts"), sql="""
 , l as (select * exclude (rn) from (select solver_id, instance_id, attempt_id, row_number() over (partition by solver_id, instance_id order by coalesce(attempt_ended_at, '') desc, attempt_index desc nulls last, attempt_id desc) as rn from v_runs where coalesce(solver_id, '') <> '' and coalesce(instance_id, '') <> '') where rn = 1),
 a as (select l.*, coalesce(v.resolved, false) as resolved from l left join v_verdicts v using (solver_id, instance_id)),
 c as (select instance_id, count(*) as solver_count, count(*) filter (resolved) as resolved_count from a group by instance_id order by -floor(count(*) filter (resolved) * 100 / count(*)), count(*) desc, instance_id limit 60),
 st as (select instance_id, arg_min(problem_statement, (ingested_at, problem_statement)) as statement from materialized_items where coalesce(problem_statement, '') <> '' group by instance_id)
 select instance_id, solver_count, resolved_count, string_agg(concat_ws(':', solver_id, case when resolved then 'true' else 'false' end, attempt_id, case when resolved then 'better' else '-' end), ',' order by solver_id) as solvers,
  coalesce(any_value(left(statement, 8000)), '') as statement, coalesce(any_value(length(statement) > 8000), false) as statement_clipped from c join a using (instance_id) left join st using (instance_id) group by instance_id, solver_count, resolved_count""")
def attempt_browser_head(spark: SparkSession, sf: str) -> DataFrame:
    """The 60 best resolved instances with their solvers' last attempts, judged where resolved."""
    rows = views.runs(spark, sf, "solver_id", "instance_id", "attempt_index", F.col("attempt_ended_at").alias("ended")).drop("ingested_at")
    last = joins.with_verdicts(browser.latest(rows).select("solver_id", "instance_id", "attempt_id"), views.verdicts(spark, sf))
    judged = views.verdicts(spark, sf).filter("resolved").select("solver_id", "instance_id", F.lit("better").alias("overall_label"))
    items = table(spark, sf, "materialized_items").select("instance_id", F.struct("ingested_at", "problem_statement").alias("at"), F.col("problem_statement").alias("statement"))
    return browser.heads(last.select("solver_id", "instance_id", "attempt_id", "resolved"), browser.first_filled(items, "instance_id", "statement", "at"), judged)


def _ten(spark: SparkSession, sf: str, rows: DataFrame, worst: bool) -> DataFrame:
    d = F.col("overall_delta")
    return rows.select("solver_id", "l_orderkey", "l_linenumber", "overall_delta").orderBy(d if worst else -d, "l_orderkey", "l_linenumber", "solver_id").limit(10)


_TEN = "select solver_id, l_orderkey, l_linenumber, round(overall_delta, 6) as overall_delta from {s} {w} order by overall_delta {d}, l_orderkey, l_linenumber, solver_id limit 10"


@query(sql=_TEN.format(s=_SCORED, w="", d="asc"))
def review_worst10(spark: SparkSession, sf: str) -> DataFrame:
    return _ten(spark, sf, _scored(spark, sf), True)


@query(sql=_TEN.format(s=_SCORED, w="where resolved and overall_delta <= -0.35", d="asc"))
def review_resolved_but_worse10(spark: SparkSession, sf: str) -> DataFrame:
    return _ten(spark, sf, _scored(spark, sf).filter("resolved and overall_delta <= -0.35"), True)


@query(sql=_TEN.format(s=_SCORED, w="where not resolved and overall_delta >= 0.35", d="desc"))
def review_promising10(spark: SparkSession, sf: str) -> DataFrame:
    return _ten(spark, sf, _scored(spark, sf).filter("not resolved and overall_delta >= 0.35"), False)


@query(sql=f"""
 select case when l_linenumber % 7 = 0 then 'error' when d <= -1.25 then 'much_worse' when d <= -0.35 then 'worse' when d < 0.35 then 'similar' when d < 1.25 then 'better' else 'much_better' end as label, count(*) as n from (select *, round(overall_delta, 6) as d from {_SCORED}) group by label""")
def judged_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The scores written as a judge's JSON answers, bare or fenced, every seventh with a dimension left out, and parsed back."""
    rows = _scored(spark, sf)
    names = list(DIMENSIONS)
    item = lambda n: F.concat(F.lit(f'{{"name": "{n}", "delta": '), F.col(n).cast("string"), F.lit("}"))
    whole = F.concat(F.lit('{"summary": "s", "dimensions": ['), F.concat_ws(", ", *[item(n) if i else F.when(F.col("l_linenumber") % 7 != 0, item(n)) for i, n in enumerate(names)]), F.lit("]}"))
    answer = F.when(F.col("l_orderkey") % 2 == 0, whole).otherwise(F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```")))
    parsed = review.parsed_deltas(rows.select(answer.alias("answer")), "answer", names).select(F.col("deltas").alias("d"))
    total = F.round(sum((F.col("d")[i] * round(w * 10_000) for i, w in enumerate(DIMENSIONS.values())), F.lit(0)) / 10_000, 6)
    return parsed.groupBy(F.when(F.col("d").isNull(), "error").otherwise(review.delta_label(total)).alias("label")).agg(F.count("*").alias("n"))


@query(sql=f"""
 select solver_id, count(*) filter (l_orderkey % 2 = 0 and l_linenumber % 3 <> 0) as hits, count(*) filter (not (l_orderkey % 2 = 0 and l_linenumber % 3 <> 0)) as misses from {_SCORED} group by solver_id""")
def judge_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Scores asked again against a cache that has the even orders, a third of them unscored."""
    rows = _scored(spark, sf).select("solver_id", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("attempt_id"), F.sha2(F.col("l_orderkey").cast("string"), 256).alias("cache_key"), "overall_delta", "l_orderkey", "l_linenumber")
    cache = rows.filter("l_orderkey % 2 = 0").select("attempt_id", "cache_key", F.when(F.col("l_linenumber") % 3 != 0, "scored").otherwise("error").alias("judge_status"), "overall_delta")
    found = review.from_cache(rows.select("solver_id", "attempt_id", "cache_key"), cache, ["attempt_id", "cache_key"], "overall_delta")
    return found.groupBy("solver_id").agg(F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses"))


# --- routing -----------------------------------------------------------------------------


@query
def learned_policy(spark: SparkSession, sf: str) -> DataFrame:
    """The learned routing beside the label's four policies, on the test rows (else the validation rows, else all)."""
    vectors = settle(router.stratified_split(_vectors(spark, sf), "instance_id", "label"))
    tree, _ = router.fit_selected(vectors, FEATURES, "label")
    held = router.evaluation_rows(vectors, "split").select("instance_id", "label", router.predicted(tree).alias("predicted"))
    return router.policy_summary(router.with_learned(_routed(spark, sf).drop("label").join(held, "instance_id")), (*router.POLICIES, "learned"))


@query(needs=("v_joined",), sql=_ROLL + _RANK + _ROUTE + """, k as (select instance_id, max(cluster_label) as cluster from task_features group by instance_id)
 select label, count(*) as n, string_agg(distinct cluster, ',' order by cluster) as clusters from routed left join k using (instance_id) group by label""")
def baseline_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The clusters that each routing label is seen in; there are at most a hundred clusters."""
    clusters = table(spark, sf, "task_features").groupBy("instance_id").agg(F.max("cluster_label").alias("cluster"))
    rows = _routed(spark, sf).select("instance_id", "label").join(clusters, "instance_id", "left")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.nullif(F.array_join(F.array_sort(F.collect_set("cluster")), ","), F.lit("")).alias("clusters"))


# --- logs as streams ---------------------------------------------------------------------


@query(sql=SQL["job_final_status"])
def job_final_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The last state of every job out of a file stream, deliveries of one event counted once."""
    return jobs.replay(spark, sf, "events.parquet", jobs.final_states, ["job_id"]).select("job_id", "status", "event_id")


@query(sql=f"select status, count(*) as n from {_LOG} group by status")
def status_counts_stream(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.replay(spark, sf, "events.parquet", lambda df: df.groupBy("status").agg(F.count("*").alias("n")), ["status"])


@query(sql=f"select event_id, job_id, count(*) over (partition by job_id order by epoch_us(ts) range between 60000000 preceding and current row) as n_window from {_LOG}")
def events_per_minute(spark: SparkSession, sf: str) -> DataFrame:
    return planning.events_in_window(jobs.log(table(spark, sf, "events")), "job_id", "ts", 60).select("event_id", "job_id", "n_window")


@query(needs=("v_runs",), sql="""
 select instance_id, solver_id, attempt_id from (select *, sha256('7|' || attempt_id) as at_ from v_runs) order by at_, attempt_id limit 20""")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty attempts of a seeded order."""
    return planning.seeded_order(views.runs(spark, sf, "instance_id", "solver_id"), "attempt_id", 7).select("instance_id", "solver_id", "attempt_id").limit(20)


@query(needs=("v_runs",), sql="""
 select solver_id, count(*) filter (escalates) as n_escalating, count(*) as n from (select solver_id, not coalesce(v.resolved, false) and (lower(coalesce(attempt_state, '')) in ('invalid_patch', 'timed_out', 'budget_exceeded')
   or regexp_matches(lower(concat_ws(' ', coalesce(attempt_state, ''), coalesce(v.failure_reason, ''), coalesce(exit_reason, ''), coalesce(v.harness_outcome, 'unknown'))), 'invalid_patch|invalid patch|timed_out|timed out|timeout|no_progress|no progress|no-progress|budget_exceeded|budget exceeded')) as escalates
  from v_runs left join (""" + views.SQL["v_verdicts"] + """) v using (solver_id, instance_id)) group by solver_id""")
def escalations(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts whose state or words call for another solver."""
    rows = joins.with_verdicts(views.runs(spark, sf, "solver_id", "instance_id", "attempt_state", "exit_reason").drop("ingested_at"), views.verdicts(spark, sf))
    up = verdicts.escalates(F.col("resolved"), F.col("attempt_state"), F.col("failure_reason"), F.col("exit_reason"), F.col("harness_outcome"))
    return rows.groupBy("solver_id").agg(F.count_if(up).alias("n_escalating"), F.count("*").alias("n"))
