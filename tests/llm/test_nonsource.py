import math
import random

from lathework.llm import nonsource as n

SCHEMA = "file_id long, repo string, path string, role string, content string, h int"
BODY = "\n".join(f"def handler_{w}(request):\n    return render_{w}(request.{w}, limit={i})" for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta".split()))


def test_rules():
    assert n.by_rules("src/a.py", "o/r", BODY) is None
    assert n.by_rules(r".\vendor\pkg\a.py", "o/r", BODY) == "vendored"
    assert n.by_rules("src/vendor_portal.py", "o/r", BODY) is None
    assert n.by_rules("src/a.py", "o/r", "# Code generated by x 1.2. DO NOT EDIT.\n" + BODY) == "generated"
    assert n.by_rules("src/generator.py", "o/r", BODY + '\nout.write("# Code generated by x. DO NOT EDIT.\\n")') is None
    assert n.by_rules("src/a.py", "o/r", "# Copyright (c) the r authors, all rights kept.\n" + BODY) is None
    assert n.by_rules("src/a.js", "o/r", "!function(){" + "var a=f(b,1);c&&(d.x=2);" * 60 + "}();") == "minified"
    assert n.by_rules("src/a.py", "o/r", BODY + '\nP = r"' + "|".join(f"wordword{i}" for i in range(90)) + '"') is None
    assert n.by_rules("src/a.py", "o/r", "A = [\n" + "    1, 2, 3, 0x0f, 5,\n" * 40 + "]\n") == "data_blob"
    assert n.by_rules("src/a.go", "o/r", "\n".join(f"x.Field{i} = d.Read({i}, {8 * i})" for i in range(40))) == "generated"
    assert n.by_rules(None, None, None) is None and n.by_rules("", "", " \n") is None


def test_copies_without_notice(spark):
    edited = BODY.replace("limit=3", "limit=30")
    rows = [(1, "o/a", "third_party/lib/x.py", None, BODY, 1), (2, "o/b", "src/x.py", "prod", edited, 1), (3, "o/b", "src/y.py", None, "\n".join(f"own_line_number_{i} = compute({i})*other_{i}" if i % 2 else f"call_the_{i}_thing()" for i in range(12)), 1), (4, None, None, None, None, None), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows + rows[:2], SCHEMA)
    assert {r[0]: r[1] for r in n.file_kinds(df).filter("file_id is not null").collect()} == {1: "vendored", 2: "vendored"}
    assert n.file_kinds(df.limit(0)).count() == 0
    assert {r["kind"] for r in n.composition(df).collect()} == {"vendored", "hand_written"}


def test_frequent_lines_still_lead_to_the_copy(spark):
    many = [(i, f"o/{i}", "vendor/lib/x.py", None, BODY + f"\nedited_line_{i} = own_value({i})", 1) for i in range(n.RARE + 20)]
    df = spark.createDataFrame([*many, (999, "o/z", "src/x.py", None, BODY, 1)], SCHEMA)
    assert n.file_kinds(df).filter("file_id = 999").count() == 1


def test_copies_across_repositories_without_any_mark(spark):
    own = "\n".join(f"def own_{i}(x):\n    return x + {i}" for i in range(40, 60))
    rows = [(i, f"o/{i}", "src/x.py", None, BODY + f"\nedited_line_{i} = own_value({i})", 1) for i in range(3)]
    rows += [(10, "o/0", "src/own.py", None, own, 1), (11, "o/0", "src/own2.py", None, own, 1), (12, "o/1", "src/own.py", None, own + "\nx = 1", 1)]
    rows += [(20 + i, f"p/{i}", "src/__init__.py", None, "from .core import *", 1) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r[0]: r[1] for r in n.file_kinds(df).collect()} == {0: "vendored", 1: "vendored", 2: "vendored"}
    assert {(r["kind"], r["by"]): r["n_files"] for r in n.evidence(df).collect()} == {("vendored", "index"): 3}


def test_long_lines_end():
    assert n.by_rules("a.py", "o/r", "x = [" + "1111111111 " * 20_000 + "!") in (None, "data_blob")
    assert n.by_rules("a.py", "o/r", "{" + "a1b2" * 50_000) in (None, "data_blob")


def test_every_holder_of_frequent_lines_is_compared(spark):
    lines = BODY.split("\n")
    halves = ["\n".join([*(lines[:9] if i % 2 else lines[7:]), f"edited_line_{i} = own_value({i})"]) for i in range(2 * n.RARE + 20)]
    rows = [(i, f"o/{i}", "vendor/lib/x.py", None, half, 1) for i, half in enumerate(halves)]
    whole = [(900, "o/w", "vendor/lib/x.py", None, BODY, 1)]
    copies = [(999, "o/z", "src/x.py", None, BODY + "\nour_own_edit = compute(it)", 1), (998, "o/y", "src/y.py", None, "\n".join(lines[2:14]), 1)]
    found = lambda *rows: {r[0] for r in n.file_kinds(spark.createDataFrame([x for part in rows for x in part], SCHEMA)).collect()}
    assert {998, 999} <= found(rows, whole, copies)
    assert not {998, 999} & found(rows, copies)


def test_every_repository_of_a_holder_counts(spark):
    part = "\n".join(BODY.split("\n")[:14])
    rows = [(i, f"o/{r}", "src/x.py", None, BODY, 1) for i, r in enumerate("abc")]
    rows += [(10 + i, f"o/{r}", "src/y.py", None, part + f"\nown_{r} = {i}", 1) for i, r in enumerate("abc")]
    for i in range(3):
        df = spark.createDataFrame([*rows[:3], rows[3 + i]], SCHEMA)
        assert {r[0] for r in n.file_kinds(df).collect()} == {0, 1, 2, 10 + i}


def test_a_first_holder_does_not_settle_the_repositories(spark):
    many = [(100 + i, "o/a", f"src/x{i}.py", None, BODY + f"\nedited_line_{i} = own_value({i})", 1) for i in range(n.RARE + 30)]
    pair = [(1, "o/b", "src/y.py", None, BODY, 1), (2, "o/c", "src/z.py", None, BODY + "\nother_line = 5", 1)]
    assert not n.file_kinds(spark.createDataFrame([*many, pair[0]], SCHEMA)).count()
    assert {r[0] for r in n.file_kinds(spark.createDataFrame(many + pair, SCHEMA)).collect()} == {1, 2, *range(100, 130 + n.RARE)}


def test_twins_of_marked_files_are_asked_too(spark):
    kinds = lambda *rows: {r[0]: r[1] for r in n.file_kinds(spark.createDataFrame(list(rows), SCHEMA)).collect()}
    known, built = (1, "o/a", "third_party/lib/x.py", None, BODY, 1), (1, "o/a", "dist/x.py", None, BODY, 1)
    twins = [(i, f"o/{i}", "src/x.py", None, BODY, 1) for i in range(2, 5)]
    short = [(10 + i, "o/a", path, None, "from .core import *", 1) for i, path in enumerate(["third_party/lib/__init__.py", *(f"src/p{i}/__init__.py" for i in range(60))])]
    df = spark.createDataFrame([known, *twins[:1], *short], SCHEMA)
    assert {r[0]: r[1] for r in n.file_kinds(df).collect()} == {1: "vendored", 2: "vendored", 10: "vendored"}
    assert {r["by"]: r["n_files"] for r in n.evidence(df).collect()} == {"rule": 2, "index": 1}
    assert kinds(built, *twins) == {1: "generated", 2: "vendored", 3: "vendored", 4: "vendored"}
    assert kinds(built, *twins[:1]) == {1: "generated"}


def test_index_finds_what_all_pairs_show(spark, monkeypatch):
    monkeypatch.setattr(n, "RARE", 3)
    monkeypatch.setattr(n, "SALT", 2)
    draw = random.Random(7)
    rows = []
    for library in range(6):
        lines = [f"library_{library}.call_{chr(97 + i)}(value)" for i in range(26)]
        home = draw.sample("abcdef", draw.choice([2, 2, 3, 4]))
        for _ in range(draw.randint(6, 18)):
            a = draw.randint(0, 3)
            cut = lines[a : a + draw.randint(14, 22)]
            for _ in range(draw.randint(0, 2)):
                cut[draw.randrange(len(cut))] = f"own_line_{draw.randrange(10**6)} = 1"
            for _ in range(draw.choice([1, 1, 2])):
                rows.append((len(rows), f"o/{draw.choice(home)}", draw.choice(["src", "src", "src", "src", "dist", "vendor/lib" if library < 2 else "src"]) + f"/{len(rows)}.py", None, "\n".join(cut), 1))
    held = [(i, r, n.by_rules(p, r, c), set(n.line_pairs(c))) for i, r, p, _, c, _ in rows]
    want = {}
    for i, r, kind, own in held:
        over = [(j, s, k) for j, s, k, other in held if j != i and len(own & other) >= math.ceil(n.CONTAINED * len(own))]
        copied = any(k == "vendored" for _, _, k in over) or kind is None and len({s for _, s, _ in over} - {r}) >= 2
        want |= {i: "vendored" if copied else kind} if copied or kind else {}
    assert {r[0]: r[1] for r in n.file_kinds(spark.createDataFrame(rows, SCHEMA)).collect()} == want
    assert 10 < sum(k == "vendored" for k in want.values()) < len(rows) - 10
