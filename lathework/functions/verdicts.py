"""States, outcomes and reasons of jobs, attempts and harness runs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lathework.functions.coerce import _col, text
from lathework.functions.text import failure_label

# Spellings of a harness status, the codes of validator failures, and the states and terms that call for another solver.
RESOLVED_STATUS = ("resolved", "passed", "pass")
UNRESOLVED_STATUS = ("not_resolved", "unresolved", "failed")
SKIPPED_STATUS = ("skipped", "missing_prediction")
ERROR_STATUS = ("error", "errored", "crash", "failed_with_exception")
FAILURE_CODES = (
    "base_repo_unrunnable", "env_install_failed", "test_targeting_failed", "test_patch_apply_failed", "patch_apply_failed",
    "no_fail_to_pass", "pass_to_pass_regression", "flaky_outcomes", "missing_junit", "unknown_validator_failure",
)
RETRYABLE = ("failed", "timed_out", "invalid_patch", "budget_exceeded")
ESCALATING = ("invalid_patch", "timed_out", "budget_exceeded")
ESCALATION_TERMS = (
    "invalid_patch", "invalid patch", "timed_out", "timed out", "timeout", "no_progress", "no progress", "no-progress", "budget_exceeded", "budget exceeded",
)
TIMEOUT_MARKERS = ("test timed out after", "deadline exceeded", "timed out after", "connection timed out", "read timed out")


def harness_status(c: Column | str) -> Column:
    """struct<status, resolved, is_error> of a harness's word for it."""
    s = F.lower(text(c))
    status = (
        F.when(s.isin(*RESOLVED_STATUS), "resolved").when(s.isin(*UNRESOLVED_STATUS), "not_resolved")
        .when(s.isin(*SKIPPED_STATUS), "skipped").when(s.isin(*ERROR_STATUS), "error").otherwise("not_resolved")
    )
    return F.struct(status.alias("status"), (status == "resolved").alias("resolved"), (status == "error").alias("is_error"))


def failure_code(status: Column, reason: Column, code: Column) -> Column:
    """A validator failure under one of ``FAILURE_CODES`` (or the one reason that stands for itself)."""
    r = F.coalesce(reason, F.lit(""))
    return (
        F.when(code.isin(*FAILURE_CODES), code).when(r.isin(*FAILURE_CODES), r)
        .when((status == "error") & (r == "run_a_failed"), "base_repo_unrunnable")
        .when((status == "error") & r.isin("run_b_rerun_failed", "run_c_rerun_failed"), "flaky_outcomes")
        .when(status == "flaky", "flaky_outcomes")
        .when((status == "not_resolved") & (r == "declared_ftp_not_resolved"), r)
        .otherwise("unknown_validator_failure")
    )


def outcome_label(*columns: Column | str) -> Column:
    """The first outcome that says anything, else ``unknown``."""
    return F.coalesce(*[F.nullif(F.coalesce(_col(c).cast("string"), F.lit("")), F.lit("")) for c in columns], F.lit("unknown"))


def unsuccessful(resolved: Column, status: Column, *reasons: Column) -> Column:
    """Not resolved where that is known; else by the status; else where any reason is given."""
    s = F.lower(text(status))
    any_reason = F.lit(False)
    for r in reasons:
        any_reason |= F.coalesce(r != "", F.lit(False))
    return F.when(resolved.isNotNull(), ~resolved).when(s.isin(*RESOLVED_STATUS), False).when(s != "", True).otherwise(any_reason)


def failure_reason(failure: Column, reason: Column, exit_reason: Column, event: Column, state: Column, mute: Column) -> Column:
    """Why an attempt failed, from the first source that tells.

    ``event`` is what an event's error says and ``mute`` whether the attempt did nothing but
    err: a model that wasn't found then explains it, and any event explains an invalid patch.
    """
    told, left = F.nullif(failure_label(event), F.lit("")), F.nullif(failure_label(exit_reason), F.lit(""))
    first = F.when(((told == "model_not_found") & mute) | (left == "invalid_patch"), told)
    last = F.lower(text(state))
    plain = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(first, plain(failure), plain(reason), left, told, F.when(last.isin("failed", "invalid_patch", "timed_out"), failure_label(last)), F.lit(""))


def escalates(resolved: Column, state: Column, *says: Column) -> Column:
    """An unresolved attempt whose state, or what is said of it, shows that another solver should try."""
    heard = F.lower(F.concat_ws(" ", F.coalesce(state, F.lit("")), *[F.coalesce(c, F.lit("")) for c in says]))
    terms = "|".join(ESCALATION_TERMS)
    return ~resolved & (F.lower(F.coalesce(state, F.lit(""))).isin(*ESCALATING) | heard.rlike(terms))


def accepted(state: Column | str) -> Column:
    return F.regexp_replace(F.lower(text(state)), r"^contractstate\.", "") == "accepted"


def infra_timeout(c: Column | str) -> Column:
    return F.lower(F.coalesce(_col(c), F.lit(""))).rlike("|".join(TIMEOUT_MARKERS))


def same_outcomes(a: Column, b: Column) -> Column:
    """Whether two maps of outcomes are equal; maps themselves don't compare."""
    flat = lambda m: F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))
    return flat(a) == flat(b)


def flaky(b: Column, b_again: Column, c: Column, c_again: Column) -> Column:
    """A rerun came out differently."""
    return ~same_outcomes(b, b_again) | ~same_outcomes(c, c_again)


def regressed(b: Column, c: Column, declared: Column) -> Column:
    """A test declared to keep passing passed before and doesn't after."""
    get = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(""))
    return F.exists(declared, lambda t: (get(b, t) == "pass") & (get(c, t) != "pass"))


def still_failing(c: Column, declared: Column) -> Column:
    """A test declared to pass after doesn't."""
    return F.exists(declared, lambda t: F.coalesce(F.try_element_at(c, t), F.lit("")) != "pass")


