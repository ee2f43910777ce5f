"""Texts read line by line inside the JVM: logs, manifests, version notes and statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lathework.functions.coerce import _col, text

# Lines of a harness log that tell why a run failed, strongest first.
FAILURE_MARKERS = (">>>>> Patch Apply Failed:", "Test timed out after ", "failed to start podman system service", "Failed to apply patch to container:")


def split(c: Column | str) -> Column:
    return F.split(F.coalesce(_col(c), F.lit("")), r"\r\n|\n|\r")


def _bare(line: Column) -> Column:
    """A log line without its time stamp."""
    return F.regexp_replace(F.trim(line), r"^202.*? - INFO - ", "")


def failure_summary(log: Column | str) -> Column:
    """The first marked line with up to six lines after it, as far as the next blank one; else the last filled line."""
    lines = split(log)

    def found(marker: str) -> Column:
        at = F.array_position(F.transform(lines, lambda x: x.contains(marker)), F.lit(True)).cast("int")
        after = F.slice(lines, at + 1, F.lit(6))
        filled = F.transform(after, _bare)
        stop = F.array_position(F.transform(filled, lambda x: x == ""), F.lit(True)).cast("int")
        kept = F.when(stop > 0, F.slice(filled, F.lit(1), stop - 1)).otherwise(filled)
        return F.when(at > 0, F.array_join(F.concat(F.array(F.trim(F.element_at(lines, at))), kept), "\n"))

    last = F.try_element_at(F.filter(F.transform(lines, _bare), lambda x: x != ""), F.lit(-1))
    return F.coalesce(*[found(m) for m in FAILURE_MARKERS], last)


def block_text(c: Column | str) -> Column:
    """Lines with single spaces, and single blank lines between them."""
    lines = F.transform(split(c), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", " "))
    joined = F.array_join(lines, "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def line_text(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"\s+", " ")


def weak(subject: Column, body: Column) -> Column:
    """A commit of at most six words tells little."""
    return F.size(F.filter(F.split(F.concat_ws(" ", line_text(subject), line_text(body)), " "), lambda w: w != "")) <= 6


def statement(issue_title: Column, issue_body: Column, pull_title: Column, pull_body: Column, advice: Column, subject: Column, body: Column) -> Column:
    """struct<text, source>: a problem statement out of the linked issue, else the pull request, else advice where the commit tells little, else the commit."""
    joined = lambda *parts: F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])
    some = lambda *parts: F.length(F.concat_ws("", *parts)) > 0
    issue, pull = (line_text(issue_title), block_text(issue_body)), (line_text(pull_title), block_text(pull_body))
    told = block_text(advice)
    pick = lambda t, s: F.struct(t.alias("text"), F.lit(s).alias("source"))
    return (
        F.when(some(*issue), pick(joined(*issue), "linked_issue")).when(some(*pull), pick(joined(*pull), "pull_request"))
        .when((told != "") & weak(subject, body), pick(told, "llm_advisory")).otherwise(pick(joined(line_text(subject), line_text(body)), "commit"))
    )


def dependencies(c: Column | str) -> Column:
    """The filled lines of a requirements file without comments, in order."""
    return F.filter(F.transform(split(c), lambda x: F.regexp_replace(F.regexp_replace(x, r"#.*$", ""), r"^\s+|\s+$", "")), lambda x: x != "")


def python_versions(c: Column | str) -> Column:
    """major.minor of the version notes in a text, sorted as texts; upper bounds say nothing."""
    notes = F.filter(F.split(F.replace(F.coalesce(_col(c), F.lit("")), F.lit(";"), F.lit(" ")), r"[\s,]+"), lambda x: x != "")
    tag = lambda x: F.regexp_extract(F.lower(x), r"^py\d(\d\d)$", 1)
    plain = lambda x: F.regexp_extract(x, r"^(?:>=|>|==|=|~=)?\s*(3\.\d+)", 1)
    found = F.transform(notes, lambda x: F.when(tag(x) != "", F.concat(F.lit("3."), tag(x))).otherwise(F.when(~x.rlike("^<"), plain(x)).otherwise("")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def least_version(versions: Column) -> Column:
    """The least version by its numbers; what has none comes last."""
    numbers = lambda v: F.transform(F.split(v, r"\."), lambda x: x.try_cast("int"))
    keyed = F.transform(versions, lambda v: F.struct(F.when(F.forall(numbers(v), lambda x: x.isNotNull()), numbers(v)).otherwise(F.array(F.lit(999))).alias("k"), v.alias("v")))
    return F.array_min(keyed)["v"]


def go_module(c: Column | str) -> Column:
    """struct<module, go, requires, major> of a module file; requirements are counted inside blocks and alone."""
    lines = F.filter(F.transform(split(c), lambda x: F.trim(F.regexp_replace(x, "//.*$", ""))), lambda x: x != "")
    one = lambda p: F.coalesce(F.try_element_at(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, p, 1)), lambda x: x != ""), F.lit(-1)), F.lit(""))
    module = one(r"^module\s+(\S+)")
    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"))

    def step(state: Column, x: Column) -> Column:
        opens, closes = x.startswith("require ("), state["inside"] & (x == ")")
        counts = ~opens & ~closes & ~x.startswith("module ") & ~x.startswith("go ") & (state["inside"] | x.startswith("require "))
        return F.struct(F.when(opens, True).when(closes, False).otherwise(state["inside"]).alias("inside"), (state["n"] + counts.cast("int")).alias("n"))

    major = F.regexp_extract(module, r"/v(\d+)$", 1)
    return F.struct(
        module.alias("module"), one(r"^go\s+.*?(\d+\.\d+)").alias("go"), F.aggregate(lines, zero, step)["n"].alias("requires"),
        F.when(major != "", F.concat(F.lit("v"), major)).otherwise("unknown").alias("major"),
    )


def interpolated(c: Column | str, properties: Column) -> Column:
    """``${name}`` replaced by its value in a map; unknown names stay."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), r"\$\{")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.when(
        p.rlike(r"(?s)^[^}]+\}"), F.concat(F.coalesce(F.try_element_at(properties, F.trim(F.regexp_extract(p, r"(?s)^([^}]+)\}", 1))), F.concat(F.lit("${"), F.regexp_extract(p, r"(?s)^([^}]+\})", 1))), F.regexp_replace(p, r"(?s)^[^}]+\}", ""))
    ).otherwise(F.concat(F.lit("${"), p)))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def test_nodes(c: Column | str) -> Column:
    """Node ids of a collection's output, in order, each once."""
    found = F.transform(split(c), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(found, lambda x: x.contains("::") & ~x.startswith("=") & ~x.startswith("ERROR:") & ~x.startswith("no tests collected")))


def node_files(nodes: Column) -> Column:
    """The files of node ids, in order, each once."""
    return F.array_distinct(F.filter(F.transform(nodes, lambda x: F.substring_index(F.trim(x), "::", 1)), lambda x: x != ""))


def tidy_ids(ids: Column) -> Column:
    """Test ids without outer blanks, in order, each once."""
    return F.array_distinct(F.filter(F.transform(ids, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""))
