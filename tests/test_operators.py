import datetime

import pytest
from pyspark.sql import functions as F

from lathework.functions import coerce, patch, reports, text, usage
from lathework.operators import dedup, frontier, joins, metrics, planning, router

ATTEMPT = "solver_id string, instance_id string, attempt_id string, duration_ms long, cost_micros long, input_tokens long, output_tokens long, total_tokens long, resolved boolean"


def summary(spark, rows, **kw):
    full = [(*r, None, None, None, res) for *r, res in rows]
    return metrics.group_summary(spark.createDataFrame(full, ATTEMPT), **kw).collect()[0]


def test_nothing_resolved(spark):
    rows = [("s", "i1", "a", 17, 1_500_000, False), ("s", "i1", "b", 23, 2_000_000, False), ("s", "i2", "c", 40, 4_000_000, False)]
    r = summary(spark, rows)
    assert (r["attempt_count"], r["unique_instance_count"], r["total_cost_usd"], r["cost_per_resolved"]) == (3, 2, 7.5, None)
    df = spark.createDataFrame([(x[0], x[3]) for x in rows], "solver_id string, duration_ms long")
    assert tuple(metrics.percentiles(df, ["solver_id"], "duration_ms", {"p50": 50.0, "p95": 95.0}).collect()[0]) == ("s", 23, 40)


def test_dear_coverage_and_marginal_cost(spark):
    rows = [("s", "cheap", "a", 1, 500_000, True), ("s", "cheap", "b", 1, 1_000_000, True), ("s", "border", "c", 1, 11_000_000, True), ("s", "dear", "d", 1, 12_000_000, True), ("s", "lost", "e", 1, 15_000_000, False)]
    r = summary(spark, rows, dear_micros=10_000_000)
    assert r["dear_coverage"] == pytest.approx(2 / 3) and r["exclusive_dear_rate"] == pytest.approx(2 / 3) and r["cost_per_resolved"] == pytest.approx(23.5 / 3)
    assert summary(spark, [("s", "x", "a", 1, 2_000_000, True), ("s", "y", "b", 1, 12_000_000, True)])["marginal_cost"] == 10.0


def test_two_percentile_rules(spark):
    df = spark.createDataFrame([("s", 100), ("s", 250)], "k string, v long")
    assert metrics.percentiles(df, ["k"], "v", {"p": 50.0}).collect()[0]["p"] == 250
    assert metrics.percentiles(df, ["k"], "v", {"p": 50.0}, metrics.ceil_rank).collect()[0]["p"] == 100


def test_frontiers(spark):
    rows = [("a", 0.5, 5, 2.0, 10.0, 10.0), ("b", 0.9, 9, 9.0, 20.0, 81.0), ("c", 0.4, 4, 3.0, 30.0, 12.0), ("d", 0.5, 5, 2.0, 10.0, 10.0), ("e", 0.0, 0, None, None, 3.0)]
    df = spark.createDataFrame(rows, "solver_id string, raw_resolution_rate double, resolved_instance_count long, cost_per_resolved double, latency_ms_per_resolved double, total_cost_usd double")
    assert sorted(r["solver_id"] for r in frontier.pareto(df).collect()) == ["a", "b", "d"]
    steps = {r["budget"]: (r["best_solver"], r["bucket"]) for r in frontier.budget_frontier(df).collect()}
    assert steps == {2.0: ("a", "a,d"), 3.0: ("a", "c"), 9.0: ("b", "b")}
    assert [r["solver_id"] for r in frontier.ranked(df).orderBy("rank").collect()] == ["b", "a", "d", "c", "e"]


def test_routing(spark):
    t = datetime.datetime(2026, 1, 1)
    rows = [("cheap", "i1", "a1", 1, t, t, 1_000_000, 5, True, "ok"), ("dear", "i1", "a2", 1, t, t, 4_000_000, 9, True, "ok"), ("cheap", "i2", "a3", 1, t, t, 1_000_000, 5, False, "timed_out"), ("dear", "i2", "a4", 1, t, t, 4_000_000, 9, True, "ok")]
    df = spark.createDataFrame(rows, "solver_id string, instance_id string, attempt_id string, attempt_index long, ended_at timestamp, started_at timestamp, cost_micros long, duration_ms long, resolved boolean, harness_outcome string")
    roll = router.solver_rollup(df)
    got = {r["instance_id"]: r for r in router.routing_rows(roll, router.solver_ranking(roll)).collect()}
    assert (got["i1"]["label"], got["i2"]["label"]) == ("cheap_is_enough", "needs_expensive")
    assert (got["i1"]["signal_escalated"], got["i2"]["signal_escalated"]) == (False, True)
    assert got["i2"]["failure_cost"] == 5_000_000 and got["i2"]["oracle_solver"] == "dear"


def test_tree(spark):
    rows = [(float(x), float(y), "a" if x < 5 else ("b" if y < 3 else "c")) for x in range(10) for y in range(6)]
    df = spark.createDataFrame(rows, "x double, y double, label string")
    tree = router.fit_tree(df, ["x", "y"], "label", depth=2)
    assert df.filter(router.predicted(tree) != F.col("label")).count() == 0
    assert router.best_split(df.filter("x < 0"), ["x"], "label") is None


def test_depth_is_selected_on_validation_and_refitted(spark):
    grid = [(float(x), float(y)) for x in range(10) for y in range(6)]
    truth = lambda x, y: "a" if x < 5 else ("b" if y < 2 else "c")
    schema = "x double, y double, label string, split string"
    both = spark.createDataFrame([(x, y, truth(x, y), s) for x, y in grid for s in ("train", "validation", "test")], schema)
    tree, depth = router.fit_selected(both, ["x", "y"], "label")
    assert depth == 2 and both.filter(router.predicted(tree) != F.col("label")).count() == 0
    shallow = spark.createDataFrame([(x, y, truth(x, y) if s == "train" else ("a" if x < 5 else "c"), s) for x, y in grid for s in ("train", "validation")], schema)
    assert router.fit_selected(shallow, ["x", "y"], "label")[1] == 1
    moved = spark.createDataFrame([(0.0, 0.0, "a", "train"), (4.0, 0.0, "b", "train"), (1.0, 0.0, "a", "validation"), (3.0, 0.0, "b", "validation"), (1.5, 0.0, "a", "validation")], schema)
    assert router.fit_selected(moved, ["x"], "label")[0]["threshold"] == 2.25
    assert router.fit_selected(moved.filter("split = 'train'"), ["x"], "label")[0]["threshold"] == 2.0


def test_all_features_of_a_task_are_offered(spark):
    from lathework.plans import catalogue

    assert len(set(catalogue.FEATURES)) == 20
    rows = catalogue._vectors(spark, "/root/testdata/sf0.001").collect()
    assert rows
    for r in rows:
        assert all(r[f] is not None for f in catalogue.FEATURES)
        for name, buckets in catalogue.BUCKETS.items():
            assert sum(r[f"{name}={b}"] for b in buckets) == 1


def test_dedup_and_merge(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "b"), ("k", 2, "c"), ("m", None, "z")], "k string, at int, v string")
    assert {r["k"]: r["v"] for r in dedup.last_per(df, ["k"], ["at"]).collect()} == {"k": "b", "m": "z"}
    assert {r["k"]: r["v"] for r in dedup.first_per(df, ["k"], ["at"]).collect()} == {"k": "a", "m": "z"}
    merged = planning.merged_runs([df.filter("at = 1"), df.filter("at = 2")], ["k"])
    assert [r["v"] for r in merged.collect()] == ["c"]
    ids = planning.filtered_ids(df, "k", "at", exclude=df.filter("k = 'm'"))
    assert [r["v"] for r in ids.collect()] == ["a"]


def test_transitions_and_backfill(spark):
    b = spark.createDataFrame([("t1", "fail"), ("t2", "pass"), ("t3", "pass")], "t string, outcome string")
    a = spark.createDataFrame([("t1", "pass"), ("t2", "pass"), ("t4", "pass")], "t string, outcome string")
    assert {r["t"]: r["transition"] for r in joins.test_transitions(b, a, ["t"]).collect()} == {"t1": "fail_to_pass", "t2": "pass_to_pass", "t3": "pass_to_fail", "t4": "fail_to_pass"}


def one(spark, column, **values):
    return spark.range(1).select(column.alias("r")).collect()[0]["r"]


def test_texts(spark):
    lit = F.lit
    assert one(spark, text.signal(lit("Traceback in the test"))) == "stacktrace" and one(spark, text.signal(lit("see src/a.py"))) == "path"
    assert [one(spark, text.version_bucket(lit(v))) for v in ("", "py311", "1.2.3", "repo-main", "x")] == ["unknown", "python-tagged", "semantic", "compound", "opaque"]
    assert one(spark, text.issue_refs(lit("Merge pull request #12 fixes #3, GH-4 and #12"))) == ["3", "4"] and one(spark, text.pull_refs(lit("PR #7, pull request 8, merge pull request #9"))) == ["9", "7", "8"]
    roles = {"src/a.py": "prod", "tests/test_a.py": "test", "tests/fixtures/x.json": "test_support", "vendor/x.go": "generated_vendor", "docs/a.md": "docs", ".github/w.yml": "config_build", "README.md": "docs", "latest.java": "test", "": "unknown", "a.bin": "unknown"}
    assert {p: one(spark, text.file_role(lit(p))) for p in roles} == roles
    assert one(spark, text.failure_label(lit("Invalid-Patch"))) == "invalid_patch" and one(spark, text.repo_of_url(lit("git@host:o/r.git"))) == "o/r"
    assert one(spark, text.compact_number(lit(1234567))) == "1.2M" and one(spark, coerce.number(lit("nan"))) == 0.0 and one(spark, coerce.whole(lit("-3"))) == 0


DIFF = "diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n@@ -1 +1 @@\n-a\n+b\ndiff --git a/tests/test_a.py b/tests/test_a.py\n--- a/tests/test_a.py\n+++ b/tests/test_a.py\n@@ -1 +1,2 @@\n-a\n+b\n+c\n"


def test_patches(spark):
    d = F.lit(DIFF)
    sides = one(spark, patch.split_sides(d))
    assert sides["prod"] + sides["test"] == DIFF and "tests/" not in sides["prod"] and not sides["crossed"]
    assert one(spark, patch.paths(d)) == ["src/a.py", "tests/test_a.py"]
    s = one(spark, patch.stats(d))
    assert (s["files"], s["added"], s["removed"], s["hunks"]) == (2, 3, 2, 2)
    w = one(spark, patch.without(d, F.array(F.lit("src/a.py"))))
    assert w["kept"] == sides["test"] and w["removed_paths"] == ["src/a.py"]
    assert one(spark, patch.fenced_patch(F.lit("Here:\n```diff\n" + DIFF + "```\nbye"))) == DIFF
    assert one(spark, patch.unsafe_paths(F.lit("diff --git a/../x b/../x\n"))) == ["../x"] and one(spark, patch.paths(F.lit(None))) == []


def test_usage(spark):
    v = usage.parsed(F.lit('"{\\"prompt_tokens\\": 5, \\"output_tokens\\": 2}"'))
    t = one(spark, usage.tokens(v))
    assert (t["input"], t["output"], t["total"], t["cached"]) == (5, 2, 7, 0)
    raw = F.lit('{"type":"tool_call"}\nbroken{\n{"type":"item","item":{"type":"command"}}\n{"type":"message","text":"hi"}')
    assert one(spark, usage.tool_calls(raw)) == 1 and one(spark, usage.last_message(raw)) == "hi" and not one(spark, usage.error_only(raw))
    assert one(spark, usage.error_only(F.lit('{"type":"error"}\n'))) and one(spark, usage.tool_calls(F.lit(None))) == 0


def test_reports(spark):
    xml = '<testsuite><testcase classname="pkg.mod.Suite" name="a"/><testcase classname="pkg.mod" name="b"><failure/></testcase><testcase name="c"><skipped type="pytest.xfail"/></testcase></testsuite>'
    assert reports.PARSERS["junit"](xml) == {"pkg/mod.py::Suite::a": "pass", "pkg/mod.py::b": "fail", "c": "skip"} and reports.PARSERS["junit"]("<broken") == {}
    assert reports.cargo("     Running unittests src/lib.rs (target/debug/deps/core-0123456789abcdef)\ntest m::t ... ok\ntest m::u ... FAILED") == {"core::m::t": "pass", "core::m::u": "fail"}
    df = spark.createDataFrame([("r", '{"Action":"run","Package":"p","Test":"T"}\n{"Action":"fail","Package":"p","Test":"T"}\n{"Action":"pass","Package":"p","Test":"T"}\nnoise'), ("n", None)], "id string, out string")
    assert [tuple(r) for r in reports.go_test(df, "id", "out").collect()] == [("r", "p::T", "pass")]
    assert [tuple(r) for r in reports.parsed(spark.createDataFrame([("r", xml), ("n", None)], "id string, out string"), "id", "out", "junit").filter("outcome = 'fail'").collect()] == [("r", "pkg/mod.py::b", "fail")]
    with pytest.raises(ValueError):
        reports.register("junit")(reports.cargo)


def test_job_plan(spark):
    ids = spark.createDataFrame([("i1",), ("i2",), ("i1",), ("",), (None,)], "instance_id string")
    solvers = spark.createDataFrame([("s1", "p"), ("s2", "p")], "solver_id string, provider string")
    plan = planning.job_plan(ids, solvers, planning.expand_seeds(5, 3))
    assert plan.count() == 12 and plan.select("job_id").distinct().count() == 12
