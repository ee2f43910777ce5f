from lathework.llm import truncation as t

SCHEMA = "attempt_id string, solver_id string, model_patch string, raw_output string, stderr_output string, output_format string, h int"
DIFF = "diff --git a/x.py b/x.py\nindex 1..2 100644\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n a\n-b\n+c\n d\n"


def test_diffs():
    assert not t.diff_open(DIFF)
    assert not t.diff_open(DIFF[:-1])  # only the last newline is missing
    assert t.diff_open(DIFF[:-3])  # the last line is missing
    assert all(t.examine("model_patch", DIFF[:n])[0] == "cut" for n in range(30, len(DIFF) - 4))
    assert t.examine("model_patch", "No patch this time")[0] == "whole"
    assert t.examine("model_patch", DIFF + "\\ No newline at end of file\n")[0] == "whole"


def test_json_lines():
    whole = '{"type": "message", "text": "a \\"b\\" [c"}'
    assert t.examine("raw_output", whole, "jsonl")[0] == "whole"
    assert all(t.json_tail_open(whole[:n]) for n in range(1, len(whole)))
    assert t.json_tail_open('{"a": "\\u00')


def test_notes_and_multibyte():
    for end in ("…[truncated]", "... (12 more characters)", "\n<output clipped at limit>", "�"):
        assert t.examine("stderr_output", "some text" + end)[0] == "cut"
    assert t.examine("stderr_output", "column x was [truncated] to 3 characters by `f`, as configured.")[0] == "whole"


def test_baseline_decides(spark):
    whole = "All good here. It reads the settlement offer. Nothing else. See the settlement offer."
    rows = [(f"a{i}", "s", None, whole + " Done.", "line one.\nKilled", "plain", i) for i in range(20)]
    rows += [("cut", "s", DIFF[:-4], "All good here. It reads the settl", "line one.\nline t", "plain", 1), ("bare", "s", None, "All good here. It reads the settlement offer", None, "plain", 1)]
    rows += [(None, None, None, None, None, None, None), ("blank", "s", " ", "", "\n", "plain", 2)] + rows[:1]
    attempts = spark.createDataFrame(rows, SCHEMA)
    solvers = spark.createDataFrame([("s", "plain", 1)], "solver_id string, output_format string, reason int")
    found = {(r[0], r[1]) for r in t.cut_values(attempts, solvers).collect()}
    assert found == {("cut", f) for f in t.FIELDS}
    shares = {r["field_name"]: r for r in t.cut_shares(attempts, solvers).filter("solver_id = 's'").collect()}
    assert shares["raw_output"]["n_cut"] == 1 and shares["raw_output"]["n_values"] == 23


def test_cut_values_give_no_baseline(spark):
    lines = "hook `a` finished without output.\nhook `b` finished without output.\n"
    rows = [(f"w{i}", "s", None, None, lines, "plain", i) for i in range(30)]
    rows += [(f"n{i}", "s", None, None, lines + "hook `c` finished w\n<output clipped at limit>", "plain", i) for i in range(5)]
    rows += [("torn", "s", None, None, lines + "hook `d` finished w", "plain", 1)]
    rows += [("stray", "s", None, None, "hook `e` finished\n" + lines, "plain", 1), ("within", "s", None, None, lines + "hook `f` finished", "plain", 1), ("bare", "s", None, None, lines + "hook `g` finished without output", "plain", 1)]
    found = t.cut_values(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("s", "plain")], "solver_id string, output_format string"))
    assert {r[0] for r in found.collect()} == {f"n{i}" for i in range(5)} | {"torn", "within"}


def test_a_source_with_enough_places_decides_for_itself(spark):
    rows = [(f"a{i}", "ends", None, "It keeps the map here. It works.\n", None, "plain", i) for i in range(30)]
    rows += [(f"b{i}", "goes", None, "It keeps the map here as before. It works.\n", None, "plain", i) for i in range(30)]
    rows += [(f"x-{s}", s, None, "It works. It keeps the map here", None, "plain", 1) for s in ("ends", "goes")]
    found = t.cut_values(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("ends", "plain"), ("goes", "plain")], "solver_id string, output_format string"))
    assert {r[0] for r in found.collect()} == {"x-goes"}


def test_a_small_solver_has_its_own_usual_last_lines(spark):
    rows = [(f"b{i}", "big", None, None, "All done.", "plain", i) for i in range(3000)]
    rows += [(f"s{i}", "small", None, None, "line one.\nbye" if i < 8 else "All done.", "plain", i) for i in range(40)]
    rows += [("torn", "small", None, None, "line one.\nby", "plain", 1)]
    alike = "x" * 250
    rows += [(f"l{i}", "long", None, None, "line one.\n" + alike + " end of it", "plain", i) for i in range(20)] + [("longer", "long", None, None, "line one.\n" + alike + " end o", "plain", 1)]
    styles = spark.createDataFrame([(s, "plain") for s in ("big", "small", "long")], "solver_id string, output_format string")
    assert {r[0] for r in t.cut_values(spark.createDataFrame(rows, SCHEMA), styles).collect()} == {"torn", "longer"}


def test_empty(spark):
    assert t.cut_values(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "solver_id string, output_format string")).count() == 0
