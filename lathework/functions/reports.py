"""Test reports as rows: JUnit XML, ``go test -json`` and cargo's text output."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSERS: dict[str, Callable[[str], dict[str, str]]] = {}


def register(name: str):
    def add(f: Callable[[str], dict[str, str]]):
        if name in PARSERS:
            raise ValueError(f"a parser named {name} is there already")
        PARSERS[name] = f
        return f

    return add


def _file(path: str) -> str:
    path = path.replace("\\", "/")
    at = path.rfind("/tests/")
    return path[at + 1 :] if at >= 0 else path


def test_id(group: str, name: str, file: str = "", style: str = "pytest") -> str:
    """The id of a case in the style of the tool that wrote the report."""
    group, file = group.replace("\\", "/"), _file(file)
    if style != "pytest":
        return f"{group}::{name}" if group else f"{file}::{name}" if file and style == "js" else name
    if not group:
        return f"{file}::{name}" if file else name
    parts = group.split(".")
    upper = next((i for i, p in enumerate(parts) if p[:1].isupper()), len(parts))
    module = "/".join(parts[:upper]) + ".py" if upper else ""
    return "::".join(x for x in (module, ".".join(parts[upper:]), name) if x)


def _cases(report: str, style: str) -> dict[str, str]:
    try:
        root = ET.fromstring(report.strip())
    except ET.ParseError:
        return {}
    out: dict[str, str] = {}
    for suite in root.iter("testsuite"):
        for case in suite.findall("testcase"):
            if not (name := (case.get("name") or "").strip()):
                continue
            held = {child.tag for child in case}
            outcome = "skip" if held & {"skipped", "xpass", "xfail"} else "error" if "error" in held else "fail" if "failure" in held else "pass"
            out[test_id((case.get("classname") or "").strip(), name, (case.get("file") or "").strip(), style)] = outcome
    return out


for _style, _name in (("pytest", "junit"), ("js", "junit-js"), ("java", "junit-java")):
    #: test id -> outcome; skip before error before failure before pass, the last of an id counts; a broken report gives none.
    register(_name)(lambda report, style=_style: _cases(report, style))


@register("go")
def go(report: str) -> dict[str, str]:
    """Lines of ``go test -json``; the last pass, fail or skip of a test counts."""
    out = {}
    for line in report.splitlines():
        try:
            event = json.loads(line)
        except ValueError:
            continue
        if isinstance(event, dict) and event.get("Test") and event.get("Action") in ("pass", "fail", "skip"):
            out["::".join(x for x in (event.get("Package"), event["Test"]) if x)] = event["Action"]
    return out


# Keys under which a payload may hold its report.
PAYLOAD_KEYS = ("junit_xml", "output", "log", "stdout")


def payload(v: Column) -> Column:
    """The report in a payload: the text itself, else under the first of ``PAYLOAD_KEYS``."""
    bare = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.coalesce(bare, *[F.try_variant_get(v, f"$.{k}", "string") for k in PAYLOAD_KEYS])


def merged(outcomes: DataFrame, id_column: str, order: str) -> DataFrame:
    """One outcome a test over several reports: that of the last report in ``order``."""
    return outcomes.groupBy(id_column, "test_id").agg(F.max_by("outcome", order).alias("outcome"))


@register("cargo")
def cargo(report: str) -> dict[str, str]:
    """Lines of the runner; the crate named last carries forward."""
    crate, out = "", {}
    for line in report.splitlines():
        if m := re.search(r"Running .*?(?:deps/)?([\w-]+?)(?:-[0-9a-f]{8,})?\)?$", line):
            crate = m[1]
        elif m := re.match(r"test (\S+)(?: - .*)? \.\.\. (ok|FAILED|ignored)", line):
            out[f"{crate}::{m[1]}" if crate else m[1]] = {"ok": "pass", "FAILED": "fail", "ignored": "skip"}[m[2]]
    return out


def parsed(df: DataFrame, id_column: str, report: str, style: str) -> DataFrame:
    """(id, test_id, outcome) of each report in ``style``, a name in ``PARSERS``."""
    parser = PARSERS[style]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, t, o) for i, text in zip(pdf["id"], pdf["report"]) if text for t, o in parser(text).items()]
            yield pd.DataFrame(rows, columns=[id_column, "test_id", "outcome"])

    return df.select(F.col(id_column).cast("string").alias("id"), F.col(report).alias("report")).mapInPandas(parse, f"`{id_column}` string, test_id string, outcome string")


def go_test(df: DataFrame, id_column: str | list[str], report: str) -> DataFrame:
    """``go test -json``: the last pass, fail or skip of each test, without Python."""
    line = F.posexplode(F.split(report, "\n"))
    ids = [id_column] if isinstance(id_column, str) else id_column
    events = df.select(*ids, line).select(*ids, "pos", F.try_parse_json("col").alias("v"))
    seen = events.select(
        *ids, "pos", *[F.try_variant_get("v", f"$.{k}", "string").alias(k) for k in ("Action", "Package", "Test")]
    ).filter("Test is not null and Action in ('pass', 'fail', 'skip')")
    return seen.groupBy(*ids, F.concat_ws("::", "Package", "Test").alias("test_id")).agg(F.max_by("Action", "pos").alias("outcome"))
