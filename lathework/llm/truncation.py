"""Texts whose end was lost on the way into the record (problem 1).

Each value runs through the structural automaton of its own format: JSON lines (open
strings, escapes and bracket stack), unified diffs (line counts promised by the hunk
headers), prose and logs (fences, back-ticks, unfinished tracebacks). A note left by the
cut and a broken multibyte tail decide at once. A value that is structurally whole but
ends without a terminator is compared with the baseline of its kind: how often the words it
stops at end a sentence inside values that aren't cut and how often the text goes on after
them (of its own solver and field where those tell enough, else of all solvers), and the last
lines that recur across values.

Defined results: a null or blank value is whole; a ``model_patch`` that was never a diff
is whole; repeated attempts give one row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.runtime import settle

FIELDS = ("model_patch", "raw_output", "stderr_output")
#: Last lines that recur in at least this share of the values of a kind end a value by themselves.
LAST_LINE_SHARE, LAST_LINE_COUNT = 0.003, 3
#: So do those that recur in this share of the values of a kind that one solver has; more, as few values may be torn alike by chance.
OWN_LINE_SHARE, OWN_LINE_COUNT = 0.02, 6
GRAM = 4
#: A phrase ends a value when it ends at least so many sentences, and this share of the places it stands at.
PHRASE_COUNT, PHRASE_SHARE = 2, 0.5
#: From so many places on, a solver's own field decides on a phrase, else the field of all solvers.
SOURCE_COUNT = 20
#: Bits of the map of asked phrases that the counting pass gets; its size doesn't grow with the input.
BITS = 1 << 23
FLUSH = 100_000

_NOTE = re.compile(
    r"(?:(?:…|\.\.\.)\s*\[?(?:output |text )?truncated\]?|(?:…|\.\.\.)\s*\(\d+ more (?:characters|chars|bytes|lines)\)"
    r"|<(?:output|text) (?:clipped|truncated|cut)[^<>\n]{0,40}>|\[(?:output |text )?truncated(?: \d+ \w+)?\])\s*$",
    re.I,
)
_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
_ENDS = re.compile(r"[.!?。:;](?:[\"'”»)\]]*)$")
_SENTENCE_END = re.compile(r"[.!?][\"'”»)]*(?=\s)|(?=\n)")
_WORD = re.compile(r"\S+")
_TICKED = re.compile(r"`[^`\n]*`")
_PATH = re.compile(r"(?<![\w/])(?:[\w.-]+/)+[\w-]+\.[A-Za-z]{1,5}\b")
_DIGITS = re.compile(r"\d+")
_RAISED = re.compile(r"\b[A-Z]\w*(?:Error|Exception)\b")
_FRAME = re.compile(r'\n\s+File "[^\n]*\n\s+[^\n]*$')
_DOUBT = re.compile(r"(?:[\d/_]\S*|\S*[\d/_])\.$")


def masked(text: str) -> str:
    return _DIGITS.sub("0", _RAISED.sub("<raised>", _PATH.sub("<path>", _TICKED.sub("`x`", text))))


def json_tail_open(line: str) -> bool:
    """Pushdown automaton over one JSON text: True when it ends inside a string, an escape or a bracket."""
    stack: list[str] = []
    inside = False
    i, n = 0, len(line)
    while i < n:
        c = line[i]
        if inside:
            if c == "\\":
                if i + 1 >= n or (line[i + 1] == "u" and not re.match(r"[0-9a-fA-F]{4}", line[i + 2 : i + 6])):
                    return True
                i += 2
                continue
            if c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append(c)
        elif c in "}]":
            if not stack:
                return False
            stack.pop()
        i += 1
    return inside or bool(stack)


def diff_open(text: str) -> bool:
    """True when a unified diff stops before the lines its hunk headers promise, or inside a header."""
    old = new = 0
    where = "text"
    ended = text.endswith("\n")
    lines = text.split("\n")
    if ended:
        lines.pop()
    for line in lines:
        if old > 0 or new > 0:
            sign = line[:1]
            if sign in (" ", ""):
                old, new = old - 1, new - 1
            elif sign == "+":
                new -= 1
            elif sign == "-":
                old -= 1
            elif sign == "\\":
                pass
            else:
                return False  # not what the header promised: damaged, yet not at its end
            where = "body"
            continue
        if m := _HUNK.match(line):
            old, new = int(m[1] or 1), int(m[2] or 1)
            where = "hunk"
        elif line.startswith(("diff --git ", "index ", "--- ", "+++ ", "similarity ", "rename ", "new file", "deleted file", "old mode", "new mode", "Binary ", "GIT binary")):
            where = "done" if line.startswith(("rename to", "Binary ", "new mode", "deleted file")) else "header"
        elif where in ("header", "body", "hunk", "done") and line and line[0] not in "\\ +-" or (where == "header" and line.strip()):
            where = "torn"
        elif line.startswith("\\"):
            where = "body"
    if old > 0 or new > 0 or where in ("hunk", "header", "torn"):
        return True
    last = lines[-1] if lines else ""
    return not ended and where == "body" and _open_code(last)


def _open_code(line: str) -> bool:
    return line.count('"') % 2 == 1 or line.count("`") % 2 == 1 or line.count("(") > line.count(")") or line.count("[") > line.count("]")


def is_diff(text: str) -> bool:
    return "diff --git " in text or ("\n+++ " in text and "--- " in text) or bool(re.search(r"(?m)^@@ -\d+", text))


def examine(field: str, text: str | None, style: str | None = None) -> tuple[str, str, str, str]:
    """(verdict, reason, tail phrase, hash of the last line): verdict is ``cut``, ``whole`` or ``ask`` the baseline."""
    whole, cut = ("whole", "", "", ""), lambda why: ("cut", why, "", "")
    if not text or not text.strip():
        return whole
    if _NOTE.search("\n".join(text.rstrip().rsplit("\n", 2)[-2:])):
        return cut("note")
    if text[-1] == "�" or "\ud800" <= text[-1] <= "\udfff":
        return cut("multibyte")
    if field == "model_patch":
        if not is_diff(text):
            return cut("header") if re.match(r"(?:d|di|dif|diff( -{0,2}g?i?t?)?)\s*$", text) else whole
        return cut("hunk") if diff_open(text) else whole
    if field == "raw_output" and (style == "jsonl" or (style is None and text.lstrip()[:1] == "{")):
        last = text.rstrip().rsplit("\n", 1)[-1]
        try:
            json.loads(last)
            return whole
        except ValueError:
            return cut("json") if json_tail_open(last) or not last.startswith("{") else whole
    if text.endswith("\n"):
        return cut("fence") if text.count("```") % 2 else whole
    last = text.rsplit("\n", 1)[-1]
    if text.count("```") % 2:
        return cut("fence")
    if field == "stderr_output" and (re.match(r'\s+File "', last) or last.startswith("Traceback") or _FRAME.search("\n".join(["", *text.rsplit("\n", 2)[-2:]]))):
        return cut("traceback")
    line = last.strip()
    if line == "```":
        return whole
    if last.count("`") % 2:
        return cut("backtick")
    if _ENDS.search(line) and not _DOUBT.search(masked(line)):
        return whole
    if re.search(r"(?:^|[\s,])(?:[\w.-]+/)+[\w-]+\.[a-z]{1,4}$", line) and re.match(r"(?:[-*] |[A-Z][\w ]{2,20}: )", line):
        return whole  # a list of paths
    return ("ask", "terminator", phrase(line), hashlib.blake2b(masked(line).encode("utf-8", "replace"), digest_size=16).hexdigest())


def phrase(sentence: str) -> str:
    pieces = [p for p in _SENTENCE_END.split(masked(sentence)) if p.strip()]
    return " ".join(_WORD.findall(pieces[-1])[-GRAM:]).rstrip(".!?") if pieces else ""


def passages(text: str) -> Iterator[tuple[str, bool]]:
    """(phrase, it ends a sentence or line) at every word of ``text``, its own end left out."""
    text = masked(text)
    start = 0
    stops = [m.end() for m in _SENTENCE_END.finditer(text)]
    for end in [*stops, None]:
        words = _WORD.findall(text[start:end])
        start = end
        for i in range(1, len(words)):
            yield " ".join(words[max(i - GRAM, 0) : i]), False
        if words and end is not None:
            yield " ".join(words[-GRAM:]).rstrip(".!?"), True


def has_terminators(field: str, style: str | None) -> bool:
    return field == "stderr_output" or (field == "raw_output" and style != "jsonl")


_COLUMNS = ["kind", "attempt_id", "solver_id", "field_name", "verdict", "reason", "tail", "last_line", "n"]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ends: Counter = Counter()
    for pdf in batches:
        rows = []
        styles = pdf["output_format"].tolist()
        for field in [f for f in FIELDS if f in pdf]:
            for attempt, solver, style, text in zip(pdf["attempt_id"], pdf["solver_id"], styles, pdf[field]):
                if text is None:
                    continue
                verdict, reason, tail, last = examine(field, text, style)
                rows.append(("value", attempt, solver, field, verdict, reason, tail, last, 1))
                if has_terminators(field, style):
                    ends[(solver, field, "")] += 1
                    if verdict == "ask":
                        ends[(solver, field, last)] += 1
        yield pd.DataFrame(rows, columns=_COLUMNS)
        if len(ends) > FLUSH:
            yield _ends_frame(ends)
            ends.clear()
    yield _ends_frame(ends)


def _ends_frame(ends: Counter) -> pd.DataFrame:
    return pd.DataFrame([("end", None, s, f, None, None, None, p, n) for (s, f, p), n in ends.items()], columns=_COLUMNS)


def phrase_counts(texts: DataFrame, asked: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """solver_id, field_name, tail, n_end, n_on: the asked phrases in values that aren't cut.

    The pass knows the asked phrases by a bit map, so a few others are counted as well.
    """
    bits = bytearray(BITS // 8)
    for at in asked.select((F.crc32("tail") % BITS).alias("at")).distinct().toPandas()["at"]:
        bits[at >> 3] |= 1 << (at & 7)
    bits = bytes(bits)
    read = [f for f in fields if f != "model_patch"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, list[int]] = {}

        def counted() -> pd.DataFrame:
            rows = [(*key, *n) for key, n in seen.items()]
            seen.clear()
            return pd.DataFrame(rows, columns=["solver_id", "field_name", "tail", "n_end", "n_on"])

        for pdf in batches:
            for field in read:
                for solver, style, text in zip(pdf["solver_id"], pdf["output_format"], pdf[field]):
                    if text is None or not has_terminators(field, style) or examine(field, text, style)[0] == "cut":
                        continue
                    for tail, ends in passages(text):
                        at = zlib.crc32(tail.encode("utf-8", "replace")) % BITS
                        if bits[at >> 3] >> (at & 7) & 1:
                            seen.setdefault((solver, field, tail), [0, 0])[0 if ends else 1] += 1
            if len(seen) > FLUSH:
                yield counted()
        yield counted()

    found = texts.select("solver_id", "output_format", *read).mapInPandas(
        scan, "solver_id string, field_name string, tail string, n_end long, n_on long"
    )
    return settle(found.groupBy("solver_id", "field_name", "tail").agg(F.sum("n_end").alias("n_end"), F.sum("n_on").alias("n_on")))


def ending_phrases(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """The (solver_id, field_name, tail) of ``asked`` that end a value by what their own source, or all values of the field, show."""
    pooled = counts.groupBy("field_name", "tail").agg(F.sum("n_end").alias("all_end"), F.sum("n_on").alias("all_on"))
    own = counts.select(F.col("solver_id").alias("s"), F.col("field_name").alias("f"), F.col("tail").alias("t"), "n_end", "n_on")
    told = asked.join(pooled, ["field_name", "tail"]).join(own, F.col("solver_id").eqNullSafe(F.col("s")) & (F.col("field_name") == F.col("f")) & (F.col("tail") == F.col("t")), "left")
    enough = F.coalesce(F.col("n_end") + F.col("n_on") >= SOURCE_COUNT, F.lit(False))
    n_end, n_on = F.when(enough, F.col("n_end")).otherwise(F.col("all_end")), F.when(enough, F.col("n_on")).otherwise(F.col("all_on"))
    return told.filter((n_end >= PHRASE_COUNT) & (n_end >= PHRASE_SHARE * (n_end + n_on))).select("solver_id", "field_name", "tail")


def examined(attempts: DataFrame, solvers: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per non-null value of ``fields``: attempt_id, solver_id, field_name, is_cut, reason."""
    style = solvers.groupBy("solver_id").agg(F.min("output_format").alias("output_format"))
    texts = attempts.select("attempt_id", "solver_id", *fields).join(style, "solver_id", "left").select("attempt_id", "solver_id", "output_format", *fields)
    seen = settle(
        texts.mapInPandas(
            _scan,
            "kind string, attempt_id string, solver_id string, field_name string, verdict string, reason string, tail string, last_line string, n long",
        )
    )
    values = seen.filter("kind = 'value'")
    open_ = values.filter("verdict = 'ask'")
    asked = open_.select("solver_id", "field_name", "tail").distinct()
    phrases = ending_phrases(asked, phrase_counts(texts, asked, fields)).select(F.col("solver_id").alias("s"), F.col("field_name").alias("f"), F.col("tail").alias("t"), F.lit(True).alias("phrase_ends"))
    own = seen.filter("kind = 'end'").groupBy("solver_id", "field_name", "last_line").agg(F.sum("n").alias("n"))
    ends = own.groupBy("field_name", "last_line").agg(F.sum("n").alias("n"))
    total = ends.filter("last_line = ''").select("field_name", F.col("n").alias("of"))
    own_total = own.filter("last_line = ''").select(F.col("solver_id").alias("s"), F.col("field_name").alias("f"), F.col("n").alias("of"))
    usual = (
        ends.filter("last_line <> ''").join(F.broadcast(total), "field_name")  # one row per field
        .filter((F.col("n") >= LAST_LINE_COUNT) & (F.col("n") >= LAST_LINE_SHARE * F.col("of")))
        .select("field_name", "last_line", F.lit(True).alias("usual"))
    )
    own_usual = (
        own.filter("last_line <> ''").join(own_total, F.col("solver_id").eqNullSafe(F.col("s")) & (F.col("field_name") == F.col("f")))
        .filter((F.col("n") >= OWN_LINE_COUNT) & (F.col("n") >= OWN_LINE_SHARE * F.col("of")))
        .select("s", "f", F.col("last_line").alias("l"), F.lit(True).alias("own_usual"))
    )
    answered = (
        open_.join(phrases, F.col("solver_id").eqNullSafe(F.col("s")) & (F.col("field_name") == F.col("f")) & (F.col("tail") == F.col("t")), "left").drop("s", "f", "t")
        .join(usual, ["field_name", "last_line"], "left")
        .join(own_usual, F.col("solver_id").eqNullSafe(F.col("s")) & (F.col("field_name") == F.col("f")) & (F.col("last_line") == F.col("l")), "left")
        .select("attempt_id", "solver_id", "field_name", (F.col("phrase_ends").isNull() & F.col("usual").isNull() & F.col("own_usual").isNull()).alias("is_cut"), "reason")
    )
    sure = values.filter("verdict <> 'ask'").select("attempt_id", "solver_id", "field_name", (F.col("verdict") == "cut").alias("is_cut"), "reason")
    return sure.unionByName(answered)


def cut_values(attempts: DataFrame, solvers: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    return examined(attempts, solvers, fields).filter("is_cut").select("attempt_id", "field_name").distinct()


def cut_shares(attempts: DataFrame, solvers: DataFrame) -> DataFrame:
    """Per solver and field: values, damaged values and their share."""
    return (
        examined(attempts, solvers).groupBy("attempt_id", "solver_id", "field_name").agg(F.max("is_cut").alias("is_cut"))
        .groupBy("solver_id", "field_name")
        .agg(F.count("*").alias("n_values"), F.count_if("is_cut").alias("n_cut"))
        .withColumn("cut_share", F.col("n_cut") / F.col("n_values"))
    )
