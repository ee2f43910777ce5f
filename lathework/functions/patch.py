"""Unified diffs as columns: files, paths, sides and counts, with array functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lathework.functions.coerce import _col
from lathework.functions.text import file_role

_OLD = r'(?m)^diff --git "?a/(.+?)"? "?b/.+?"?$'
_NEW = r'(?m)^diff --git "?a/.+?"? "?b/(.+?)"?$'


def chunks(diff: Column | str) -> Column:
    """The diff cut before each file header; text before the first header is left out."""
    return F.filter(F.split(F.coalesce(_col(diff), F.lit("")), r"(?m)^(?=diff --git )"), lambda x: x.startswith("diff --git "))


def files(diff: Column | str) -> Column:
    """array<struct<path, old_path, role, text>>, one element a file."""
    return F.transform(chunks(diff), lambda x: F.struct(
        F.regexp_extract(x, _NEW, 1).alias("path"), F.regexp_extract(x, _OLD, 1).alias("old_path"), file_role(F.regexp_extract(x, _NEW, 1)).alias("role"), x.alias("text")))


def _side(role: Column) -> Column:
    return F.when(role.isin("test", "test_support"), "test").when(role.isin("docs", "generated_vendor"), "left_out").otherwise("prod")


def split_sides(diff: Column | str) -> Column:
    """struct<prod, test, crossed>: test support goes with the tests only where there is a test; a rename across sides is flagged."""
    f = files(diff)
    any_test = F.exists(f, lambda x: x["role"] == "test")
    prod = F.filter(f, lambda x: (_side(x["role"]) == "prod"))
    test = F.filter(f, lambda x: any_test & (_side(x["role"]) == "test"))
    crossed = F.exists(f, lambda x: (x["path"] != x["old_path"]) & (_side(file_role(x["old_path"])) != _side(x["role"])))
    join = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), "")
    return F.struct(join(prod).alias("prod"), join(test).alias("test"), crossed.alias("crossed"))


def paths(diff: Column | str) -> Column:
    """Distinct paths in order of appearance, rejects left out."""
    d = F.coalesce(_col(diff), F.lit(""))
    found = F.concat(F.regexp_extract_all(d, F.lit(_NEW), 1), F.regexp_extract_all(d, F.lit(r"(?m)^\+\+\+ b/(.+)$"), 1))
    return F.filter(F.array_distinct(found), lambda p: ~p.endswith(".rej"))


def roles(diff: Column | str) -> Column:
    """map<role, sorted paths> of a diff's files."""
    f = files(diff)
    of = F.array_sort(F.array_distinct(F.transform(f, lambda x: x["role"])))
    return F.map_from_arrays(of, F.transform(of, lambda r: F.array_sort(F.array_distinct(F.transform(F.filter(f, lambda x: x["role"] == r), lambda x: x["path"])))))


def without(diff: Column | str, withheld: Column) -> Column:
    """struct<kept, removed_paths>: the diff without the files of ``withheld``."""
    f = files(diff)
    kept = F.filter(f, lambda x: ~F.array_contains(withheld, x["path"]))
    gone = F.filter(f, lambda x: F.array_contains(withheld, x["path"]))
    return F.struct(F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("kept"), F.transform(gone, lambda x: x["path"]).alias("removed_paths"))


def stats(diff: Column | str) -> Column:
    """struct<files, added, removed, hunks>."""
    d = F.coalesce(_col(diff), F.lit(""))
    count = lambda p: F.regexp_count(d, F.lit(p))
    return F.struct(
        F.size(chunks(diff)).alias("files"), (count(r"(?m)^\+") - count(r"(?m)^\+\+\+ ")).alias("added"),
        (count(r"(?m)^-") - count(r"(?m)^--- ")).alias("removed"), count(r"(?m)^@@ -").alias("hunks"))


def unsafe_paths(diff: Column | str) -> Column:
    """Paths that are absolute or climb out of the tree."""
    return F.filter(paths(diff), lambda p: p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)"))


def fenced_patch(answer: Column | str) -> Column:
    """A diff out of free text: a fenced block, else the text from its first file header to a fence's end."""
    t = F.coalesce(_col(answer), F.lit(""))
    fence = F.regexp_extract(t, r"(?si)```(?:diff|patch)\r?\n(.*?)```", 1)
    fenced = F.when(fence.contains("diff --git"), F.regexp_replace(fence, r"^\s+|\s+$", ""))
    bare = F.regexp_replace(F.regexp_extract(t, r"(?s)(?:^|\n)(diff --git.*)$", 1), r"(?s)\n[ \t]*```[ \t]*(?:\n.*)?$", "")
    whole = F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_replace(bare, r"^\n+|\n+$", ""), F.lit("")))
    return F.concat(whole, F.lit("\n"))


def patch_of_output(raw: Column | str, answers: Column) -> Column:
    """A diff out of an output: of its text, else of the first of its JSON ``answers`` that holds one."""
    inner = F.filter(F.transform(answers, fenced_patch), lambda x: x.isNotNull())
    return F.coalesce(F.when(~F.ltrim(F.coalesce(_col(raw), F.lit(""))).startswith("{"), fenced_patch(raw)), F.try_element_at(inner, F.lit(1)), F.lit(""))


def edits(v: Column) -> Column:
    """array<struct<path, content>> of an edit plan in VARIANT: its ``files`` as list or map, and its ``edits``."""
    rows = lambda path: F.coalesce(F.try_variant_get(v, path, "array<struct<path:string,content:string>>"), F.array().cast("array<struct<path:string,content:string>>"))
    by_path = F.transform(F.map_entries(F.coalesce(F.try_variant_get(v, "$.files", "map<string,string>"), F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("content")))
    return F.transform(F.filter(F.concat(rows("$.files"), by_path, rows("$.edits")), lambda e: e["path"].isNotNull()), lambda e: F.struct(e["path"].alias("path"), F.coalesce(e["content"], F.lit("")).alias("content")))


def formatting_only(diff: Column | str) -> Column:
    """A diff of 80 changed lines at most, none of which holds a keyword or a run of three word characters."""
    changed = F.transform(F.filter(F.split(F.coalesce(_col(diff), F.lit("")), "\n"), lambda x: x.rlike(r"^[+-].") & ~x.startswith("+++") & ~x.startswith("---")), lambda x: F.trim(F.substring(x, F.lit(2), F.length(x))))
    says = lambda x: x.rlike(r"\b(?:def|class|return|assert|if|for|while|with|except|raise|import|from) ") | x.rlike("[A-Za-z0-9_]{3,}")
    return (F.size(changed) > 0) & (F.size(changed) <= 80) & F.forall(changed, lambda x: ~says(x))


def targeted_tests(diff: Column | str) -> Column:
    """The test files that a diff changes; the whole folder where it changes only what tests lean on."""
    p = paths(diff)
    base = lambda x: F.substring_index(F.lower(x), "/", -1)
    supports = lambda x: F.lower(x).rlike(r"^tests/") & F.lower(x).rlike(r"conftest\.py$|pytest\.ini$|tox\.ini$|fixtures|testdata$")
    tests = lambda x: F.lower(x).endswith(".py") & (F.lower(x).rlike("^(?:tests?|spec|testsuites)/") | base(x).rlike(r"^test_|_test\.py$|_test_|spec"))
    found = F.filter(p, lambda x: tests(x) & ~supports(x))
    return F.when(F.size(found) > 0, found).when(F.exists(p, supports), F.array(F.lit("tests"))).otherwise(F.array().cast("array<string>"))


def immutable_paths(declared: Column, test_patch: Column | str) -> Column:
    """The declared paths, else those of the test patch."""
    said = F.filter(F.transform(declared, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(declared.isNotNull(), said).otherwise(paths(test_patch))
