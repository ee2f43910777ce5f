import json

from pyspark.sql import functions as F

from lathework.functions import lines, patch, reports, roles, text, usage, verdicts
from lathework.operators import browser, enrich, harness, metrics, planning, review


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def parsed(value):
    return F.try_parse_json(F.lit(None if value is None else json.dumps(value)))


def test_usage_chain(spark):
    read = lambda u, m=None: tuple(one(spark, usage.record_tokens(parsed(u), parsed(m))))
    assert read({"prompt_tokens": 3, "completion_tokens": 4}) == (3, 4, 7, 0)
    assert read({"input_tokens": 3, "total_tokens": 0, "prompt_tokens_details": {"cached_tokens": 2}}) == (3, 0, 0, 2)
    assert read({}, {"usage": {"input_tokens": 5, "output_tokens": 1, "cached_input_tokens": 4}}) == (5, 1, 6, 4)
    assert read(None, {"telemetry": [{"x": 1}, {"part": {"usage": {"input_tokens": 9}}}]}) == (9, 0, 9, 0)
    events = [{"part": {"tokens": {"input": 2, "output": 3, "cache": {"read": 5}}}}, {"part": {"tokens": {"input": 1, "total": 0}}}]
    assert read(None, {"telemetry": events}) == (8, 3, 11, 5)
    assert read(None, None) == (0, 0, 0, 0) and read({"input_tokens": -4, "output_tokens": "x"}) == (0, 0, 0, 0)


def test_tool_calls(spark):
    raw = "\n".join(json.dumps(x) for x in (
        {"type": "tool_call"}, {"type": "item.started", "item": {"type": "command_execution"}}, {"type": "item.completed", "item": {"type": "command_execution"}},
        {"type": "response.output_item.added", "item": {"type": "function_call"}}, {"message": {"content": [{"type": "tool_use"}, {"type": "text"}, {"type": "server_tool_use"}]}},
    )) + "\nnot json"
    count = lambda u, m=None, r=None: one(spark, usage.record_calls(parsed(u), parsed(m), F.lit(r)))
    assert count(None, None, raw) == 5 and count(None) == 0 and count({"tool_calls": 0}, None, raw) == 0
    assert count({"x": 1, "num_tool_calls": 7}) == 7 and count({"tool_calls": [1, 2]}) == 2
    assert count(None, {"tool_call_count": 3}, raw) == 3 and count(None, {"telemetry": [{"type": "tool_use"}]}, raw) == 1


def test_costs(spark):
    cost = lambda c, m=None: one(spark, usage.record_cost(parsed(c), parsed(m)))
    assert cost({"total_cost": 0, "usd": 1.5, "input_cost": 9}) == 1.5 and cost({"input_cost": 0.25, "tool_cost": 0.5, "x": 3}) == 0.75
    assert cost({}, {"cost": {"value": 2}}) == 2 and cost(None) is None and cost({"total_cost": -1}) is None
    assert cost(None, {"telemetry": [{"cost": {"usd": 1}}, {"cost": 0.5}, {"part": {"cost": 0.25}}, {"cost": "x"}]}) == 1.75


def test_failure_chain(spark):
    def why(failure=None, reason=None, left=None, event=None, state=None, mute=False):
        return one(spark, verdicts.failure_reason(*[F.lit(x).cast("string") for x in (failure, reason, left, event, state)], F.lit(mute)))

    assert why("f", "r", "timeout after 3 s") == "f" and why(None, "r") == "r" and why(left="Timeout after 3 s") == "timeout"
    assert why("f", left="invalid patch: x", event="rate limit hit") == "rate_limit" and why("f", event="Model not found", mute=True) == "model_not_found" and why("f", event="model not found") == "f"
    assert why(event="boom") == "boom" and why(state=" Timed_Out ") == "timeout" and why(state="succeeded") == "" and why() == ""
    error = {"telemetry": [{"error": {"name": ""}}, {"error": {"data": {"message": "first"}, "name": "n"}}, {"error": {"name": "second"}}]}
    assert one(spark, usage.event_error(parsed(error))) == "first"


def test_statuses(spark):
    status = lambda s: tuple(one(spark, verdicts.harness_status(F.lit(s))))
    assert status(" Passed ") == ("resolved", True, False) and status("crash") == ("error", False, True) and status("missing") == ("not_resolved", False, False) and status("missing_prediction") == ("skipped", False, False)
    code = lambda s, r=None, c=None: one(spark, verdicts.failure_code(F.lit(s), F.lit(r).cast("string"), F.lit(c).cast("string")))
    assert code("error", "run_a_failed") == "base_repo_unrunnable" and code("error", "run_b_rerun_failed") == "flaky_outcomes" and code("flaky") == "flaky_outcomes"
    assert code("x", "missing_junit") == "missing_junit" and code("x", "y", "no_fail_to_pass") == "no_fail_to_pass" and code("not_resolved", "declared_ftp_not_resolved") == "declared_ftp_not_resolved" and code("error") == "unknown_validator_failure"
    lost = lambda r, s, *why: one(spark, verdicts.unsuccessful(F.lit(r).cast("boolean"), F.lit(s).cast("string"), *[F.lit(w).cast("string") for w in why]))
    assert lost(False, "passed") and not lost(True, "failed") and not lost(None, "Pass") and lost(None, "odd") and lost(None, None, None, "e") and not lost(None, "", None)
    up = lambda done, state, *says: one(spark, verdicts.escalates(F.lit(done), F.lit(state).cast("string"), *[F.lit(x).cast("string") for x in says]))
    assert up(False, "timed_out") and up(False, None, "No progress made") and not up(True, "timed_out") and not up(False, "failed", "tests failed")
    assert one(spark, verdicts.accepted(F.lit("ContractState.accepted"))) and not one(spark, verdicts.accepted(F.lit("rejected")))


def test_outcome_maps(spark):
    rows = [("i", "b", "t1", "pass"), ("i", "b_again", "t1", "pass"), ("i", "c", "t1", "fail"), ("i", "c_again", "t1", "fail"), ("j", "b", "t", "pass")]
    maps = harness.outcome_maps(spark.createDataFrame(rows, "id string, run string, test string, outcome string"), ["id"], "test", "outcome", "run", ("b", "b_again", "c", "c_again"))
    found = {r["id"]: (r["f"], r["r"]) for r in maps.select("id", verdicts.flaky(*map(F.col, ("b", "b_again", "c", "c_again"))).alias("f"), verdicts.regressed(F.col("b"), F.col("c"), F.array(F.lit("t1"))).alias("r")).collect()}
    assert found == {"i": (False, True), "j": (True, False)}


def test_line_texts(spark):
    log = "2026-01-01 10:00:00,1 - INFO - start\n>>>>> Patch Apply Failed:\n2026-01-01 10:00:01,1 - INFO - hunk 1\nhunk 2\n\nafter\n"
    assert one(spark, lines.failure_summary(F.lit(log))) == ">>>>> Patch Apply Failed:\nhunk 1\nhunk 2"
    assert one(spark, lines.failure_summary(F.lit("a\n2026-01-01 - INFO - the end \n\n"))) == "the end" and one(spark, lines.failure_summary(F.lit(None).cast("string"))) is None
    assert one(spark, lines.block_text(F.lit("\n\n a  b \r\n\r\n\r\n\n c\t d\n\n"))) == "a b\n\nc d"
    assert one(spark, lines.dependencies(F.lit("# x\na==1 # pin\n\n b>2\n#"))) == ["a==1", "b>2"]
    assert one(spark, lines.python_versions(F.lit("py311, >=3.9,<3.13; 3.10.2 ~=3.8 python"))) == ["3.10", "3.11", "3.8", "3.9"]
    assert one(spark, lines.least_version(F.array(*map(F.lit, ("3.10", "x", "3.9"))))) == "3.9"
    assert tuple(one(spark, lines.go_module(F.lit("module a/b/v3 // x\n\ngo 1.21.3\nrequire (\n\tx v1\n\ty v2 // indirect\n)\nrequire z v1\n")))) == ("a/b/v3", "1.21", 3, "v3")
    props = F.create_map(F.lit("v"), F.lit("1.2"))
    assert one(spark, lines.interpolated(F.lit("a-${v}-${ v }-${w}-${"), props)) == "a-1.2-1.2-${w}-${"
    nodes = one(spark, lines.test_nodes(F.lit("=== x::y ===\na/b.py::t1\n a/b.py::C::t2 \nERROR: a::b\na/b.py::t1\nc.py::t\n")))
    assert nodes == ["a/b.py::t1", "a/b.py::C::t2", "c.py::t"] and one(spark, lines.node_files(F.array(*map(F.lit, nodes)))) == ["a/b.py", "c.py"]
    told = lambda *x: tuple(one(spark, lines.statement(*map(F.lit, x))))
    assert told("T", "b  c", "P", "", "", "s", "") == ("T\n\nb c", "linked_issue") and told("", "", "P", "q", "a", "s", "") == ("P\n\nq", "pull_request")
    assert told("", "", "", "", "advice", "fix it", "") == ("advice", "llm_advisory") and told("", "", "", "", "advice", "a b c d e f g", "h") == ("a b c d e f g\n\nh", "commit")


def test_names_numbers_and_hashes(spark):
    assert one(spark, text.model_name(F.lit("Acme/Models/Big_One"), ["big-one"], {"x": "y"})) == "big-one" and one(spark, text.model_name(F.lit(" A_b "), ["z"], {"a-b": "c"})) == "c"
    assert one(spark, text.safe_name(F.lit("9-Lives!/x"))) == "_9_lives_x" and one(spark, text.safe_name(F.lit("--"))) == "unnamed"
    shown = [one(spark, f(F.lit(v))) for f, v in ((text.compact_number, 1234.0), (text.compact_number, 7.0), (text.compact_number, 7.25), (text.percent, 0.5), (text.currency, 0.004), (text.currency, 1234.5), (text.currency, -1.0), (text.duration, 61_000), (text.duration, 1_500), (text.duration, 9))]
    assert shown == ["1.2K", "7", "7.3", "50.0%", "$0.0040", "$1,234.50", "$0.00", "1.0m", "1.5s", "9ms"] and one(spark, text.percent(F.lit(None).cast("double"))) == "-"
    import hashlib

    want = {"a": "é\U0001f600\"x\n", "b": None}
    got = one(spark, text.canonical_hash({k: text.json_text(F.lit(v).cast("string")) for k, v in want.items()}))
    assert got == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, text.review_refs(F.lit("fixes #12, GH-3 and #12 but gh-4"))) == ["12", "3"]


def test_roles_by_language(spark):
    role = lambda p, of=None: one(spark, text.file_role(F.lit(p), of))
    assert [role(p) for p in ("src/a.py", "pkg/latest.java", "a/b_test.go", "tests/data/x.json", "tests/fixtures/a.py", "tests/a.py", "conftest.py", "docs/x.md", "README.md", ".github/w.yml", "target/x.rs", "Cargo.toml", "benches/b.rs", "x.bin", "")] == [
        "prod", "test", "test", "test_support", "test_support", "test", "test_support", "docs", "docs", "config_build", "generated_vendor", "config_build", "test", "unknown", "unknown"]
    assert role("benches/b.rs", ["python"]) == "prod" and role("a/x.spec.ts", ["python"]) == "prod" and role("a/x.spec.ts", ["javascript"]) == "test" and role("a/x.spec.ts", ["cobol"]) == "test"
    scores = F.array(*[F.struct(F.lit(c).alias("confidence"), F.lit(n).alias("name")) for c, n in ((0.5, "rust"), (0.5, "go"), (0.0, "c"))])
    assert one(spark, roles.detected(scores)) == "go" and one(spark, roles.detected(F.filter(scores, lambda s: s["confidence"] > 9))) == "unknown"


def test_patch_functions(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-(a)\n+( a )\n"
    assert one(spark, patch.formatting_only(F.lit(diff))) and not one(spark, patch.formatting_only(F.lit(diff + "+return 1\n"))) and not one(spark, patch.formatting_only(F.lit("")))
    assert one(spark, patch.fenced_patch(F.lit("so:\n" + diff + "```\nbye"))) == diff and one(spark, patch.fenced_patch(F.lit("nothing"))) is None
    plan = {"files": {"a.py": "1"}, "edits": [{"path": "b.py", "content": "2"}, {"content": "x"}]}
    assert [tuple(e) for e in one(spark, patch.edits(parsed(plan)))] == [("a.py", "1"), ("b.py", "2")]
    tests = "diff --git a/tests/test_a.py b/tests/test_a.py\ndiff --git a/tests/conftest.py b/tests/conftest.py\n"
    assert one(spark, patch.targeted_tests(F.lit(tests))) == ["tests/test_a.py"] and one(spark, patch.targeted_tests(F.lit(tests.split("\n", 1)[1]))) == ["tests"] and one(spark, patch.targeted_tests(F.lit(diff))) == []
    assert one(spark, patch.immutable_paths(F.array(F.lit(" k "), F.lit("")), F.lit(diff))) == ["k"]


def test_report_styles(spark):
    xml = '<testsuites><testsuite><testcase classname="a.b.C.D" name="t"/><testcase name="u" file="C:\\w\\tests\\x.py"><skipped/><failure/></testcase><testcase classname="a.b.C.D" name="t"><error/></testcase><testcase name=" "/></testsuite></testsuites>'
    assert reports.PARSERS["junit"](xml) == {"a/b.py::C.D::t": "error", "tests/x.py::u": "skip"}
    assert reports.PARSERS["junit-js"](xml) == {"a.b.C.D::t": "error", "tests/x.py::u": "skip"} and reports.PARSERS["junit-java"](xml) == {"a.b.C.D::t": "error", "u": "skip"}
    assert reports.PARSERS["go"]('{"Action":"run","Test":"T","Package":"p"}\n{"Action":"fail","Test":"T","Package":"p"}\nx\n{"Action":"pass","Test":"T","Package":"p"}\n{"Action":"pass","Package":"p"}') == {"p::T": "pass"}
    assert one(spark, reports.payload(parsed({"log": "l", "output": "o"}))) == "o" and one(spark, reports.payload(parsed("bare"))) == "bare"
    outcomes = spark.createDataFrame([("r", "t", "fail", 1), ("r", "t", "pass", 2)], "id string, test_id string, outcome string, at int")
    assert reports.merged(outcomes, "id", "at").first()["outcome"] == "pass"


def test_judge_answers(spark):
    names = ["x", "y"]
    read = lambda a: review.parsed_deltas(spark.createDataFrame([(a,)], "answer string"), "answer", names).first()["deltas"]
    good = json.dumps({"dimensions": [{"name": "y", "delta": 1}, {"name": "x", "delta": 0, "label": " Better "}]})
    assert read(good) == [1, 1] and read("Sure:\n```json\n" + good + "\n```") == [1, 1]
    assert read("no") is None and read(json.dumps({"dimensions": [{"name": "x", "delta": 1}]})) is None and read(json.dumps({"dimensions": [{"name": n, "delta": 3} for n in names]})) is None


def test_families_order_and_windows(spark):
    rows = spark.createDataFrame([("r", "k", 1), ("r-retry-2", "k", 3), ("r-retry", "k", 2), ("r-retry", "m", 9), ("q", "k", 5)], "run string, id string, v int")
    assert {(r["family"], r["id"]): r["v"] for r in planning.merged_families(rows, "run", ["id"]).collect()} == {("r", "k"): 3, ("r", "m"): 9, ("q", "k"): 5}
    runs = spark.createDataFrame([("r",), ("r-retry",), ("q",), ("q-retry",)], "run string")
    assert {r["family"] for r in planning.complete_families(rows, runs, "run").collect()} == {"r"}
    a, b = ([r[0] for r in planning.seeded_order(rows.select("v").withColumn("v", F.col("v").cast("string")), "v", s).collect()] for s in (1, 2))
    assert sorted(a) == sorted(b) and a != b
    log = spark.createDataFrame([("j", "2026-01-01 00:00:00"), ("j", "2026-01-01 00:01:00"), ("j", "2026-01-01 00:02:01"), ("i", "2026-01-01 00:00:30")], "job string, ts string")
    assert sorted(r["n_window"] for r in planning.events_in_window(log, "job", "ts", 60).collect()) == [1, 1, 1, 2]


def test_contexts(spark):
    commits = spark.createDataFrame([("c", " O/R ", ["7", "8", "9"])], "id string, repo string, refs array<string>")
    cache = spark.createDataFrame([("o/r", "issue", "7", "missing", None, None), ("o/r", "issue", "8", "ok", "", "b"), ("o/r", "issue", "9", "ok", "T", None), ("o/r", "pull", "7", "ok", "P", "")], "repo string, kind string, number string, status string, title string, body string")
    got = enrich.first_titled(enrich.looked_up(commits, cache, "id", "repo", "refs", "issue"), "id").first()
    assert tuple(got) == ("c", "7,8,9", "9", "T", "")
    rows = spark.createDataFrame([("c", 0, "7", "", None, None), ("c", 1, "7", "T", "B", None), ("c", 2, None, None, None, "u"), ("c", 3, "", " ", None, None)], "id string, pos int, ref string, title string, body string, url string")
    assert sorted(tuple(r) for r in enrich.merged_contexts(rows, "id").select("first_pos", "ref", "title", "body", "url").collect()) == [(0, "7", "T", "B", None), (2, None, None, None, "u")]


def test_group_values_and_browser(spark):
    rows = spark.createDataFrame([("s", '{"zone": "eu", "none": null}'), (None, None)], "solver_id string, meta string").withColumn("meta", F.try_parse_json("meta"))
    got = [tuple(r) for r in rows.select(*[metrics.group_value(rows, f, "meta").alias(f) for f in ("solver_id", "zone", "none", "other")]).collect()]
    assert got == [("s", "eu", "", "unknown"), ("", "unknown", "unknown", "unknown")]
    attempts = spark.createDataFrame([("s", "i", "2026", 1, "a"), ("s", "i", "2026", 2, "b"), ("s", "i", "2025", 9, "c"), ("", "i", "2027", 1, "d")], "solver_id string, instance_id string, ended string, attempt_index int, attempt_id string")
    assert [r["attempt_id"] for r in browser.latest(attempts).collect()] == ["b"]


def test_results_with_logs(spark):
    results = spark.createDataFrame([("s", "i", "error", "harness error"), ("s", "j", "resolved", None), ("s", "k", "error", "r")], "solver_id string, instance_id string, status string, reason string")
    logs = spark.createDataFrame([("s", "i", "why"), ("s", "j", "ignored")], "solver_id string, instance_id string, summary string")
    assert {r["instance_id"]: r["reason"] for r in harness.with_logs(results, logs, "summary").collect()} == {"i": "why", "j": None, "k": "r"}
