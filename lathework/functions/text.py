"""Scalar functions on statements, commit texts, versions and paths, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lathework.functions import roles
from lathework.functions.coerce import _col, text

# The words that make a statement's signal, strongest first.
SIGNALS = (
    ("stacktrace", r"(?i)\b(traceback|stack ?trace|stacktrace|exception|panic|segfault)\b"),
    ("error", r"(?i)\b(error|failed|failing|failure|bug|broken|crash|incorrect|invalid|regression)\b"),
    ("test", r"(?i)\b(test|tests|pytest|unittest|assert|fixture|repro|regression)\b"),
    ("path", r"(\b[\w./-]+\.[A-Za-z0-9]{1,6}\b|/[\w./-]+)"),
)


def signal(statement: Column | str) -> Column:
    s = text(statement)
    out = F.lit("neutral")
    for name, pattern in reversed(SIGNALS):
        out = F.when(s.rlike(pattern), name).otherwise(out)
    return out


def words(c: Column | str) -> Column:
    return F.filter(F.split(text(c), r"\s+"), lambda w: w != "")


def filled_lines(c: Column | str) -> Column:
    return F.size(F.filter(F.split(text(c), r"\r\n|\n|\r"), lambda x: F.trim(x) != ""))


def length_bucket(n: Column) -> Column:
    return F.when(n <= 12, "short").when(n <= 30, "medium").when(n <= 60, "long").otherwise("very_long")


def version_bucket(version: Column | str) -> Column:
    v = text(version)
    return (
        F.when(v == "", "unknown").when(v.rlike(r"(?i)\bpy\d{2,3}\b") | F.lower(v).contains("python"), "python-tagged")
        .when(v.rlike(r"\d+\.\d+(\.\d+)?"), "semantic").when(v.rlike(r"[-_+/]"), "compound").otherwise("opaque")
    )


def cluster_label(statement: Column | str, version: Column | str) -> Column:
    n = F.size(words(statement))
    return F.concat(F.lit("len="), length_bucket(n), F.lit("|signal="), signal(statement), F.lit("|version="), version_bucket(version))


def model_name(c: Column | str, known: Sequence[str] = (), aliases: dict[str, str] | None = None) -> Column:
    """A model's name in lower case with dashes; of the whole, its last part, and what follows ``models/`` or ``accounts/``, the first that is ``known``, through ``aliases``."""
    whole = F.replace(F.lower(text(c)), F.lit("_"), F.lit("-"))
    pairs = [F.lit(x) for kv in (aliases or {}).items() for x in kv]
    alias = (lambda x: F.coalesce(F.try_element_at(F.create_map(*pairs), x), x)) if pairs else (lambda x: x)
    tail_ = lambda mark: F.when(whole.contains(mark), F.substring_index(whole, mark, -1))
    candidates = [whole, tail_("/"), tail_("models/"), tail_("accounts/")]
    found = [F.when(alias(x).isin(*known), alias(x)) for x in candidates] if known else []
    return F.coalesce(*found, alias(whole))


def review_refs(c: Column | str) -> Column:
    """Distinct numbers behind ``#`` or ``GH-``, sorted as texts."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"(?:#|GH-)(\d+)"), 1)))


# The address and keyword patterns of references below.
def pull_refs(c: Column | str) -> Column:
    """Distinct numbers of pull requests, in the order of: addresses, merge notes, keywords."""
    s = text(c)
    return F.array_distinct(F.concat(
        F.regexp_extract_all(s, F.lit(r"(?i)https?://github\.com/[^/\s]+/[^/\s]+/pull/(\d+)"), 1),
        F.regexp_extract_all(s, F.lit(r"(?i)\bmerge\s+pull\s+request\s+#?(\d+)\b"), 1),
        F.regexp_extract_all(s, F.lit(r"(?i)\b(?:pr|pull request)\s*#?\s*(\d+)\b"), 1),
    ))


def issue_refs(c: Column | str) -> Column:
    """Distinct numbers of issues; a number that is a pull request's is none, unless an issue address names it."""
    s = text(c)
    named = F.regexp_extract_all(s, F.lit(r"(?i)https?://github\.com/[^/\s]+/[^/\s]+/issues/(\d+)"), 1)
    loose = F.regexp_extract_all(s, F.lit(r"(?i)(?<![A-Za-z0-9])(?:#|gh-)(\d+)\b"), 1)
    return F.array_distinct(F.concat(named, F.array_except(loose, pull_refs(c))))


def failure_label(c: Column | str) -> Column:
    """Common spellings of a failure under one label; others as they are. The spellings are fixed values."""
    raw = text(c)
    low = F.lower(raw)
    flat = F.regexp_replace(low, r"[-\s]", "_")
    return (
        F.when(low.startswith("invalid patch:") | (flat == "invalid_patch"), "invalid_patch").when(low.contains("timeout") | (flat == "timed_out"), "timeout")
        .when(low.contains("hit your limit") | low.contains("rate limit"), "rate_limit").when(low.contains("model not found"), "model_not_found").otherwise(raw)
    )


def path_parts(path: Column | str) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text(path), r"\\", "/")), "/"), lambda p: (p != "") & (p != "."))


def file_role(path: Column | str, languages: Sequence[str] | None = None) -> Column:
    """The role of a file by its path alone, first rule that holds."""
    return roles.file_role(path_parts(path), languages)


def united(a: Column, b: Column) -> Column:
    """Two maps of lists under one: the values of a key sorted, each once."""
    some = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    return F.map_zip_with(a, b, lambda k, x, y: F.array_sort(F.array_union(some(x), some(y))))


def slug(c: Column | str) -> Column:
    return F.replace(text(c), F.lit("/"), F.lit("__"))


def instance_id(repo: Column | str, commit: Column | str) -> Column:
    """The repository's slug and the first twelve characters of the commit."""
    return F.concat(slug(repo), F.lit("-rg-"), F.substring(text(commit), 1, 12))


def safe_name(c: Column | str) -> Column:
    """A name that can be a module's: word characters only, no digit first."""
    name = F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")
    return F.when(name == "", "unnamed").when(name.rlike("^[0-9]"), F.concat(F.lit("_"), name)).otherwise(name)


def artifact_name(c: Column | str, key: Column) -> Column:
    """A file name out of an id and the first twelve characters of a key."""
    stem = F.regexp_replace(F.regexp_replace(text(c), r"[^\p{L}\p{N}_:-]", "-"), "^-+|-+$", "")
    return F.concat(F.when(stem == "", "judge").otherwise(stem), F.lit("-"), F.substring(key, 1, 12))


def repo_of_url(c: Column | str) -> Column:
    """owner/name out of an https or ssh remote."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text(c), r"(?:https?://[^/]+/|git@[^:]+:|ssh://[^/]+/)([^/\s]+/[^/\s]+?)/?$", 1), r"\.git$", ""), F.lit(""))


def tail(c: Column | str, n: int = 2000) -> Column:
    return F.right(_col(c), F.lit(n))


def clipped(c: Column | str, n: int) -> Column:
    """A struct of the first ``n`` characters and whether more were there."""
    return F.struct(F.substring(_col(c), 1, n).alias("text"), (F.char_length(_col(c)) > n).alias("clipped"))


def _told(c: Column | str, shown: Column) -> Column:
    return F.when(_col(c).isNull(), "-").otherwise(shown)


def compact_number(c: Column | str) -> Column:
    d = _col(c).cast("double")
    small = F.when(d == F.floor(d), F.format_string("%.0f", d)).otherwise(F.format_string("%.1f", d))
    return _told(c, F.when(F.abs(d) >= 1e9, F.format_string("%.1fB", d / 1e9)).when(F.abs(d) >= 1e6, F.format_string("%.1fM", d / 1e6)).when(F.abs(d) >= 1e3, F.format_string("%.1fK", d / 1e3)).otherwise(small))


def percent(c: Column | str) -> Column:
    return _told(c, F.format_string("%.1f%%", _col(c).cast("double") * 100))


def currency(c: Column | str) -> Column:
    d = _col(c).cast("double")
    return _told(c, F.when(d <= 0, "$0.00").when(d < 0.01, F.format_string("$%.4f", d)).otherwise(F.format_string("$%,.2f", d)))


def duration(ms: Column | str) -> Column:
    n = _col(ms).cast("bigint")
    return _told(ms, F.when(n >= 60_000, F.format_string("%.1fm", n / 60_000)).when(n >= 1_000, F.format_string("%.1fs", n / 1_000)).otherwise(F.concat(n.cast("string"), F.lit("ms"))))


def json_text(c: Column | str) -> Column:
    """A text as JSON writes it in ASCII."""
    quoted = F.to_json(F.array(_col(c)))
    plain = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return F.when(_col(c).isNull(), "null").otherwise(F.array_join(F.transform(F.split(plain, ""), lambda x: F.when(F.ascii(x) < 128, x).otherwise(_unicode(x))), ""))


def _unicode(x: Column) -> Column:
    """A character outside ASCII as one or two escapes."""
    units = F.lower(F.hex(F.encode(x, "UTF-16BE")))
    return F.when(F.length(units) == 8, F.concat(F.lit("\\u"), F.substring(units, 1, 4), F.lit("\\u"), F.substring(units, 5, 4))).otherwise(F.concat(F.lit("\\u"), units))


def canonical_hash(fields: dict[str, Column], length: int = 64) -> Column:
    """The hash of a JSON object with sorted keys and no blanks; the columns are JSON texts."""
    parts = [x for k in sorted(fields) for x in (F.lit(("" if k == min(fields) else ",") + f'"{k}":'), fields[k])]
    return F.substring(F.sha2(F.concat(F.lit("{"), *parts, F.lit("}")), 256), 1, length)


def content_hash(*columns: Column | str) -> Column:
    """A stable hash of columns: each value with its length, nulls told from empty texts."""
    parts = [F.when(_col(c).isNull(), "-").otherwise(F.concat(F.char_length(_col(c).cast("string")).cast("string"), F.lit(":"), _col(c).cast("string"))) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


# What a shared bundle should not hold.
PRIVATE = (
    ("absolute_path", r"(?<![A-Za-z0-9_.-])(?:/[A-Za-z0-9_.-]+){2,}"),
    ("source_snippet", r"\b(?:def|class|function|import|package|public|private|const|let|var)\s+"),
)


def privacy_warnings(c: Column | str) -> Column:
    s = text(c)
    return F.filter(F.array(*[F.when(s.rlike(p), name) for name, p in PRIVATE]), lambda x: x.isNotNull())
