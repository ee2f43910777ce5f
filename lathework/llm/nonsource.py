"""Generated, minified, vendored and data files among source files (problem 7).

First the index: every file, of every repository, is a set of hashes of its pairs of
neighbouring filled lines, and files with the same set count as one. An inverted index tells
how rare each hash is and whether it stands in several repositories or in a known third-party
file (one with a third party's notice or in a third-party tree). A file of which at least
``CONTAINED`` stands in one known third-party file is vendored, and so is a file without any
other mark of which that much stands in files of two other repositories or more. Candidates
come from the file's rarest hashes, the shares are exact, and the hashes met must be so rare
together that chance doesn't explain them. A hash of more than ``RARE`` files leads to two of
its holders at first; for a file which the pairs so found leave open, be it for want of one
more repository, every holder follows that could settle it.

Then the rules, for the remaining files: third-party notices and trees, a tool's notice in
the leading comments, the share of white space and of short identifiers, lines that are data,
runs of lines that differ only in numbers.

Defined results: a null or blank content is hand-written unless its folder says otherwise;
roles are not trusted; a file has one kind, ``vendored`` before ``minified`` before
``data_blob`` before ``generated``; repeated rows count once; of repeated ids with
different contents the first kind in that order holds; a null repository is one of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathework.runtime import bounded, settle, stow

RARE = 50
#: A hash in more files than this is spread over several join keys.
SALT = 1_000
CONTAINED = 0.8
#: So many natural units of rarity beyond those that tell one file from all others: chance explains a share with probability e^-MARGIN.
MARGIN = 7.0
#: The files that a small collection is seen among.
BACKGROUND = 10_000
#: Pairs of files are broadcast up to this number.
SMALL = 100_000

ORDER = ("vendored", "minified", "data_blob", "generated")

THIRD_PARTY_TREE = re.compile(r"(?:^|/)(?:vendor(?:ed)?|node_modules|bower_components|third[_-]?party|3rdparty|extern(?:als?)?|deps|_vendor|site-packages|Godeps/_workspace)/[^/]+/", re.I)
BUILD_TREE = re.compile(r"^(?:dist|build/lib|target/generated[\w-]*|\.next|coverage)/")
COMMENT = re.compile(r"^\s*(?:#|//|/\*+!?|\*|<!--|--|;|\"\"\")\s?(.*)$")
NOTICE = re.compile(
    r"@generated\b|<auto-?generated>|\bcode generated by\b|\b(?:this file (?:is|was) )?auto(?:matically)?[- ]?generated\b|\bgenerated (?:by|from|with|using|code|file)\b.*|"
    r"\bautomatically (?:produced|created|written)\b|\bmanual (?:changes|edits) will be\b|^output of [`\"']|\brerun\b.*\binstead of (?:changing|editing)\b|"
    r"\bbundled on publish\b|\bdo not (?:edit|modify)\b|\bcopied by the build\b|^\s*built from\b|\bproduced by\b.*\b(?:tool|compiler|build)\b|\bedits? will be (?:lost|overwritten)\b",
    re.I,
)
SOURCE_MARK = re.compile(r"^(?:source|from|origin): [\w./-]+\.(?:idl|proto|tmpl|thrift|g4|y|l|xsd|wsdl|json|yaml|yml|sql|avsc|fbs|graphql)(?::\d+)?$", re.I)
THIRD_PARTY_NOTICE = re.compile(
    r"\bvendored from\b|\bthis file is part of (?P<a>[\w.-]+) \(release|\(c\) the (?P<b>[\w.-]+) contributors\b|\bupstream:|\bused under its own licen[cs]e\b|\bcopied from (?:the )?(?P<c>[\w.-]+) (?:project|v?\d)|^!? ?[\w.-]+ v\d+\.\d+[\w.]* \|",
    re.I,
)
# Possessive, so that no line, however long, is tried in more than one way.
NUMBERISH = re.compile(r"^[\s\[({]*+(?:[-+]?(?:0x[0-9a-fA-F]++|\d[\d_.]*+(?:e[-+]?\d++)?)[\s,;\])}]*+)++$")
STRINGISH = re.compile(r"""^\s*+["'`][A-Za-z0-9+/=_\\x-]{24,}+["'`]\s*+[,+\\)]*+\s*+$""")
RECORDISH = re.compile(
    r"""^\s*+[{(\[]\s*+(?:(?:(?:"[^"]*+"|'[^']*+'|\w++)\s*+[:=]\s*+)?(?:[-+]?\d[\w.]*+|"[^"]*+"|'[^']*+'|true|false|null|None)\s*+,?\s*+){2,}+[})\]]\s*+,?\s*+$"""
)
NUMBERS = re.compile(r"0x[0-9a-fA-F]+|\d+")
WORDS = re.compile(r"[A-Za-z_$][\w$]*")


def normal_path(path: str | None) -> str:
    path = (path or "").strip().replace("\\", "/")
    while path.startswith("./"):
        path = path[2:]
    return re.sub(r"/{2,}", "/", path)


def leading_comments(lines: list[str]) -> list[str]:
    """The text of the comment lines before the first line of code."""
    out: list[str] = []
    for line in lines:
        if not line.strip() or line.startswith("#!"):
            continue
        m = COMMENT.match(line)
        if not m or line[:1] in " \t":
            break
        out.append(m[1].strip())
    return out


def own_notice(comment: str, repo: str | None) -> bool:
    """A notice that names the repository itself is the authors' own."""
    name = (repo or "").rsplit("/", 1)[-1].lower()
    return bool(name) and name in comment.lower()


def shape(text: str) -> str | None:
    """minified or data_blob by what the lines are made of."""
    lines = [x for x in text.split("\n") if x.strip()]
    body = [x for x in lines if not COMMENT.match(x)] or lines
    size = sum(map(len, body))
    if not size:
        return None
    data = sum(len(x) for x in body if (NUMBERISH.match(x) or STRINGISH.match(x) or RECORDISH.match(x)))
    if data >= 0.75 * size and size >= 200:
        return "data_blob"
    longest = max(map(len, body))
    if longest >= 200 and size / len(body) >= 120:
        whole = "\n".join(body)
        gaps = sum(whole.count(c) for c in " \t\n") / len(whole)
        digits = sum(c.isdigit() or c in ",.xX" for c in whole) / len(whole)
        words = WORDS.findall(whole)
        if digits > 0.75 or (words and max(map(len, words)) > 0.5 * len(whole)):
            return "data_blob"
        line = max(body, key=len)
        marks = sum(line.count(c) for c in ";{}(),=") / len(line)
        if gaps < 0.1 and marks >= 0.08:
            return "minified"
    return None


def stamped(lines: list[str]) -> bool:
    """Most code lines differ from their neighbour only in numbers, as a tool writes them."""
    code = [NUMBERS.sub("0", x.strip()) for x in lines if len(x.strip()) > 3]
    if len(code) < 8:
        return False
    numbered = sum(1 for a, b in zip(code, code[1:]) if a == b and "0" in a)
    return numbered >= 0.5 * (len(code) - 1)


def third_party(path: str | None, repo: str | None, head: list[str]) -> bool:
    """In a third-party tree, or under a third party's notice."""
    return bool(THIRD_PARTY_TREE.search(normal_path(path))) or any(THIRD_PARTY_NOTICE.search(c) and not own_notice(c, repo) for c in head)


def by_rules(path: str | None, repo: str | None, content: str | None) -> str | None:
    p = normal_path(path)
    text = content or ""
    lines = text.split("\n")
    head = leading_comments(lines)
    if third_party(path, repo, head):
        return "vendored"
    if kind := shape(text):
        return kind
    if any(NOTICE.search(c) for c in head) or BUILD_TREE.match(p):
        return "generated"
    comments = [m[1].strip() for x in lines if (m := COMMENT.match(x))]
    if sum(1 for c in comments if SOURCE_MARK.match(c)) >= 1 and head and SOURCE_MARK.match(head[0]):
        return "generated"
    return "generated" if stamped(lines) else None


def line_pairs(text: str | None) -> list[int]:
    """Distinct 63-bit hashes of neighbouring filled lines; the start and the end of a file are neighbours too."""
    lines = ["", *(s for x in (text or "").split("\n") if (s := x.strip())), ""]
    if len(lines) == 2:
        return []
    return [xxhash.xxh64_intdigest(x) >> 1 for x in {f"{a}\n{b}".encode("utf-8", "replace") for a, b in zip(lines, lines[1:])}]


def set_hash(hashes: list[int]) -> int:
    """One 63-bit hash of a whole set of hashes."""
    return xxhash.xxh64_intdigest(repr(sorted(hashes))) >> 1


def scanned(files: DataFrame) -> DataFrame:
    """file_id, repo_id, rule_kind, f (the hash of the set), hashes: what the rules say of each file, and its line pairs."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = [by_rules(p, r, c) for p, r, c in zip(pdf["path"], pdf["repo"], pdf["content"])]
            hashes = [line_pairs(c) for c in pdf["content"]]
            yield pd.DataFrame({"file_id": pdf["file_id"], "repo_id": pdf["repo_id"], "rule_kind": kinds, "f": [set_hash(x) for x in hashes], "hashes": hashes})

    return files.select("file_id", F.hash("repo").alias("repo_id"), "repo", "path", "content").mapInPandas(
        scan, "file_id long, repo_id int, rule_kind string, f long, hashes array<long>"
    )


def _holding(lines: DataFrame, holders: DataFrame, pending: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(f, v, low, high, many): the verified pairs of the files of ``lines`` and the sets of ``holders`` that hold enough of them.

    ``lines`` has f, h, n_lines and n, the number of holders of h; any set of more than the
    missing share of a file's hashes holds a shared one, so the rarest such set is looked up.
    ``pending`` tells from the first pairs which files are still open (f, near, far); all their
    pairs follow, but those of sets that stand in the repositories near and far alone.
    """
    needed = F.ceil(CONTAINED * F.col("n_lines"))
    rarest = lines.withColumn("needed", needed).withColumn("at", F.row_number().over(Window.partitionBy("f").orderBy("n", "h"))).filter(F.col("at") <= F.col("n_lines") - needed + 1).filter("n > 0")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs.filter("f <> v").distinct())
        asked = bounded(settle(pairs.join(lines.select("f", "h", "n_lines"), "f")), SMALL)
        shared = holders.select("v", "h", "low", "high", "many").join(asked, ["v", "h"]).groupBy("f", "v", "n_lines", "low", "high", "many").agg(F.count("*").alias("shared"))
        return settle(shared.filter(F.col("shared") >= needed).select("f", "v", "low", "high", "many"))

    rare = rarest.filter(F.col("n") <= RARE).select("f", "h", "needed")
    frequent = settle(rarest.filter(F.col("n") > RARE).select("f", "h", "needed", "n"))
    ends = holders.join(bounded(frequent.select("h").distinct(), SMALL), "h").groupBy("h").agg(F.min(F.struct("low", "v"))["v"].alias("least"), F.max(F.struct("high", "v"))["v"].alias("most"))
    ends = frequent.join(ends, "h").select("f", F.explode(F.array("least", "most")).alias("v"))
    first = verified(holders.select("h", "v", "v_lines").join(bounded(settle(rare), SMALL), "h").filter("v_lines >= needed").select("f", "v").unionByName(ends))
    left = settle(frequent.join(pending(first), "f"))
    if left.isEmpty():
        return first
    keys = F.floor(F.col("n") / SALT)
    spread = holders.join(left.select("h", "n").distinct(), "h").select("h", "v", "v_lines", "low", "high", "many", F.pmod("v", keys + 1).alias("salt"))
    further = F.coalesce(F.col("many") | ~F.col("low").isin(F.col("near"), F.col("far")) | ~F.col("high").isin(F.col("near"), F.col("far")), F.lit(True))
    every = left.select("f", "h", "needed", "near", "far", F.explode(F.sequence(F.lit(0).cast("long"), keys)).alias("salt")).join(spread, ["h", "salt"])
    return first.unionByName(verified(every.filter("v_lines >= needed").filter(further).select("f", "v"))).distinct()


def by_index(seen: DataFrame) -> DataFrame:
    """(f, bare) of the sets that the index shows to be a third party's; where ``bare`` holds, only their files without any other mark."""
    filled = seen.filter(F.size("hashes") > 0)
    known = F.coalesce(F.col("rule_kind") == "vendored", F.lit(False))
    facts = filled.drop("hashes").repartition("f").groupBy("f").agg(
        F.min("file_id").alias("file_id"), F.min("repo_id").alias("low"), F.max("repo_id").alias("high"), (F.countDistinct("repo_id") > 2).alias("many"),
        F.max(known).alias("known"), (F.max(known) & ~F.min(known)).alias("twin"), F.max(F.col("rule_kind").isNull()).alias("bare"), F.countDistinct("file_id").alias("n_files"),
    )
    n_files = max(filled.select("file_id").distinct().count(), BACKGROUND)
    floor = math.log(n_files) + MARGIN
    sets = stow(filled.select("f", "file_id", "hashes").join(facts, ["f", "file_id"]).dropDuplicates(["f", "file_id"]), "sets")
    postings = sets.select(F.col("f").alias("v"), "known", "bare", "low", "high", "many", "n_files", F.size("hashes").alias("v_lines"), F.explode("hashes").alias("h"))
    stats = postings.groupBy("h").agg(
        F.count("*").alias("n"), F.count_if("known").alias("n_known"), F.sum("n_files").alias("n_files"), F.min("low").alias("low"), F.max("high").alias("high")
    ).filter("n > 1 and n_known > 0 or low <> high")
    met = stow(
        postings.filter("not known").select(F.col("v").alias("f"), "bare", F.col("v_lines").alias("n_lines"), "h")
        .join(stats.withColumn("crossing", F.col("low") != F.col("high")).drop("low", "high"), "h"), "met"
    )
    rarity = F.log(F.lit(float(n_files)) / F.col("n_files"))
    hopeful = settle(
        met.groupBy("f", "n_lines", "bare").agg(
            F.count_if(F.col("n_known") > 0).alias("met_known"), F.sum(F.when(F.col("n_known") > 0, rarity)).alias("known_rarity"),
            F.count_if("crossing").alias("met_any"), F.sum(F.when(F.col("crossing"), rarity)).alias("any_rarity"),
        )
        .withColumn("needed", F.ceil(CONTAINED * F.col("n_lines")))
        .withColumn("ask_known", (F.col("met_known") >= F.col("needed")) & (F.col("known_rarity") >= floor))
        .withColumn("ask_any", (F.col("met_any") >= F.col("needed")) & (F.col("any_rarity") >= floor) & F.col("bare"))
        .filter("ask_known or ask_any")
    )

    def lines(ask: str, n: str, holds: str) -> DataFrame:
        """The hashes of the hopeful files, those without a holder included (rarest of all, under numbers of their own)."""
        of = hopeful.filter(ask).select("f", "n_lines")
        found = met.filter(holds).select("f", "h", F.col(n).alias("n")).join(bounded(of, SMALL), "f")
        count = found.groupBy("f", "n_lines").agg(F.count("*").alias("n_met"))
        absent = count.filter("n_met < n_lines").select("f", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_lines") - F.col("n_met"))).alias("h"), F.lit(0).cast("long").alias("n"), "n_lines")
        return settle(found.unionByName(absent.withColumn("h", -F.col("h"))))

    theirs = postings.select("v", "v_lines", "h", "low", "high", "many", "known")
    asked = hopeful.filter("ask_known").select("f", F.lit(None).cast("int").alias("near"), F.lit(None).cast("int").alias("far"))
    in_known = _holding(lines("ask_known", "n_known", "n_known > 0"), theirs.filter("known"), lambda held: asked.join(held, "f", "left_anti"))
    twins = settle(sets.filter("twin").select("f", F.explode("hashes").alias("h")))  # they stand whole in a known file
    n_twins = postings.select("h", "n_files").join(bounded(twins.select("h").distinct(), SMALL), "h").groupBy("h").agg(F.sum("n_files").alias("n_files"))
    in_known = in_known.select("f").unionByName(twins.join(n_twins, "h").groupBy("f").agg(F.sum(rarity).alias("rarity")).filter(F.col("rarity") >= floor).select("f"))
    open_ = bounded(settle(hopeful.filter("ask_any").select("f")), SMALL)
    own = settle(filled.select("f", "repo_id", F.lit(False).alias("many")).join(open_, "f").distinct())

    def reached(held: DataFrame) -> DataFrame:
        """(f, near, far, elsewhere): the repositories of a file and its holders; a set of more than two settles it alone, low and high are all of any other."""
        repos = own.unionByName(held.select("f", F.explode(F.array("low", "high")).alias("repo_id"), "many"))
        enough = F.max("many") | (F.countDistinct("repo_id") >= 3)  # its own and two more
        return repos.groupBy("f").agg(F.min("repo_id").alias("near"), F.max("repo_id").alias("far"), enough.alias("elsewhere"))

    held = _holding(lines("ask_any", "n", "crossing"), theirs, lambda held: reached(held).filter("not elsewhere").drop("elsewhere"))
    elsewhere = reached(held).filter("elsewhere").select("f", F.lit(True).alias("bare"))
    return in_known.withColumn("bare", F.lit(False)).unionByName(elsewhere).groupBy("f").agg(F.min("bare").alias("bare"))


def file_kinds(files: DataFrame) -> DataFrame:
    """(file_id, kind) of every file that isn't hand-written."""
    return _told(files).groupBy("file_id").agg(F.min_by("kind", "rank").alias("kind"))


def _told(files: DataFrame) -> DataFrame:
    seen = stow(scanned(files), "files")
    copied = F.coalesce(F.when(F.col("bare"), F.col("rule_kind").isNull()).otherwise(~F.col("rule_kind").eqNullSafe("vendored")) & F.col("bare").isNotNull(), F.lit(False))
    told = seen.drop("hashes").join(by_index(seen), "f", "left").withColumn("copied", copied).withColumn("kind", F.when(F.col("copied"), "vendored").otherwise(F.col("rule_kind"))).filter("kind is not null")
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    return told.select("file_id", "kind", F.when(F.col("copied"), "index").otherwise("rule").alias("by"), rank.alias("rank"))


def evidence(files: DataFrame) -> DataFrame:
    """(kind, by, n_files): how many files of each kind the index and the rules told."""
    return _told(files).select("file_id", "kind", "by").distinct().groupBy("kind", "by").agg(F.count("*").alias("n_files"))


def composition(files: DataFrame) -> DataFrame:
    """Per repository and kind: files and bytes, hand-written ones included."""
    kinds = file_kinds(files)
    facts = files.groupBy("file_id").agg(F.min("repo").alias("repo"), F.max(F.octet_length("content")).alias("bytes"))
    return (
        facts.join(kinds, "file_id", "left").groupBy("repo", F.coalesce("kind", F.lit("hand_written")).alias("kind"))
        .agg(F.count("*").alias("n_files"), F.sum("bytes").alias("n_bytes"))
    )
