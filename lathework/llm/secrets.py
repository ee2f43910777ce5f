"""Credentials inside source text, patches and tool output (problem 4).

A text is cut into lines; JSON lines are viewed through a length-preserving unescape, so
that every offset found in the view is an offset of the original. Each line is parsed as
the assignments of the usual configuration formats (env, ini, YAML, JSON, XML elements and
attributes, keyword arguments, connection strings, netrc, npmrc). An assignment has a key
path: its own dotted key behind the keys, sections and elements that enclose it on the line or
on the lines before (by brackets, indentation, ``[section]`` and open tags), and the span of
its value in characters and in UTF-8 bytes. A value is a credential when its path names
something sensitive (in its last key, or in the one that holds a bare ``value``, ``default`` or
the like, or in the ``name`` beside it) and its shape is a literal, when its own shape is that of an
issued token, or when it sits where only a credential can sit (user info of an address,
authorization header, login switches, a PEM private block). Redaction splices a mask over the
found byte spans and leaves every other byte alone.

Defined results: null and blank texts have no findings; a credential over several lines is
reported at its first line and masked in all of them; repeated rows give one finding.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "[REDACTED]"


class Finding(NamedTuple):
    line_no: int
    start: int
    end: int
    kind: str
    key: str  # the key path


# Public shapes of issued tokens.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:"
    r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w-]{20,}|xox[abeoprs]-[\w-]{10,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?:ant-|proj-)?[\w-]{20,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|pypi-[\w-]{30,}"
    r"|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{40,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}"
    r")(?![A-Za-z0-9_])"
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
USERINFO = re.compile(r"\b[a-zA-Z][\w+.-]{1,20}://[^\s/:@'\"<>]*:([^\s/'\"<>]{3,}?)@(?=[\w.\[-])")
HEADER = re.compile(
    r"(?i)(?:authorization[\"']?\]?\s*[:=,]\s*[\"'`]*\s*|[\"'`(\s])(?:bearer|basic|token)\s+([A-Za-z0-9+/_=.~-]{12,})"
    r"|(?:x-[\w-]*(?:token|key|secret|auth)|api-?key|private-token)[\"']?\s*[:=]\s*[\"'`]?([A-Za-z0-9+/_=.~-]{12,})"
)
SWITCH = re.compile(
    r"(?:\bcurl\b[^\n]*?\s-u\s*|--user[= ]|-U\s)[\"']?[\w.@-]+:([^\s\"'@]{4,})"
    r"|\bmysql\w*\b[^\n]*?\s-p([^\s\"']{4,})|\blogin\b[^\n]*?\s(?:-p|--password)[= ]\s*[\"']?([^\s\"']{4,})"
    r"|--(?:password|passwd|token|secret|api-key)[= ][\"']?([^\s\"']{6,})|\bsshpass\s+-p\s*([^\s\"']{4,})|\bPGPASSWORD=([^\s\"']{4,})"
)
NETRC = re.compile(r"\b(?:machine|login)\s+\S+.*?\bpassword\s+(\S{4,})")
#: Words without one of which no key is sensitive.
KEY_WORDS = ("pass", "pwd", "pw", "secret", "token", "key", "credential", "auth", "bearer", "salt", "geheim", "kennwort", "contrase", "clave")
SENSITIVE = re.compile(
    r"(?i)(?:pass(?:w(?:or[dt])?|wd|phrase|code)?$|passw(?:or[dt]|d)|passphrase|pwd|(?:^|[_.-])pass(?:$|[_.-])|secret|token$|token[_-]?(?:value|key)|api[_-]?key|access[_-]?key|private[_-]?key|"
    r"signing[_-]?key|encryption[_-]?key|master[_-]?key|auth[_-]?(?:key|token)|credential|geheim|kennwort|contrase|clave$|mot[_-]?de[_-]?passe|salt$|^(?:pw|auth|bearer)$|_pw$)"
)
#: Keys that only hold what the key around or the name beside them is about.
HOLDER = re.compile(r"(?i)^(?:value|val|default|data|text|content|plain|raw|string|literal)$")
NEUTRAL_KEY = re.compile(r"(?i)public|tokeni[sz]er|_url$|_uri$|_path$|_file$|_name$|_id$|_type$|_count$|_len|hint|policy|ttl|expir|label|field$|regex|pattern")
ASSIGN = re.compile(
    r"""(?i)(?P<key>[a-z_][\w.-]*)(?<![.-])[\s"'\]]*(?::=|=>|[:=])\s*[({\[]*\s*(?:"(?P<double>[^"\n]*)"?|'(?P<single>[^'\n]*)'?|`(?P<tick>[^`\n]*)`?|(?P<bare>[^\s"'`,;(){}<>\[\]]+))"""
)
KEYED = re.compile("(?i)" + "|".join(KEY_WORDS))
XML = re.compile(r"""(?:key|name)\s*=\s*["'](?P<key>[\w.-]+)\s?["']\s+value\s*=\s*["'](?P<value>[^"']*)["']""")
XMLTAG = re.compile(r"<(?P<key>[A-Za-z][\w.-]*)>(?P<value>[^<>]+)</(?P=key)>")
SAID = re.compile(
    r"(?i)(?:\b(?:pw|pass(?:word|wd|phrase)?|secret|passwort|kennwort|api[ _-]?key|contraseña|mot de passe)\b[^\n=:]{0,40}?\b(?:is|was|ist|lautet|es|est|=|:)\s+[\"'`]?|\buser\s+\S+\s*/\s*[\"'`]?)([^\s\"'`,;]{6,})"
)
CONTINUED = re.compile(r"""^[+\- ]?\s*["']([^"']*)["'](\)?)""")
REFERENCE = re.compile(
    r"(?i)^(?:\$|%\w+%$|\{\{|<%|@\{|#\{|vault[:.]|env[:.]|secretref|ref\+|ssm:|arn:|kms:|file:|op://|sops:|\$\{)|\b(?:os\.environ|getenv|process\.env|getpass|vault\.|secrets?\.(?:get|read)|config\.|settings\.|environ)\b|^(?:kv|secret)/"
)
PLACEHOLDER = re.compile(
    r"(?i)^(?:<.*>?|\[.*\]|\{.*\}|\*+|x{3,}|\.{3,}|-+|_+|\?+|#+|0+|(?:1234)\d*|null|none|nil|true|false|undefined|empty|todo|tbd|fixme|redacted|masked|hidden|secret|password|passwort|token|string|str|bytes)$"
    r"|your|change[-_ ]?me|example|placeholder|dummy|replace|insert|redact|sample[-_]|fake|_here$|\*{3,}|x{5,}|xxxx|\.\.\.|…"
)
DIGEST = re.compile(r"(?i)^(?:sha\d+[-:]|md5[-:]|sha256:|blake)")
#: Lower-case words, one of which every pattern above needs, so that the search for them, far
#: cheaper than parsing, loses nothing; a test draws strings from each pattern to prove it.
ANCHORS = (
    *KEY_WORDS, "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "k_test_", "sk-", "eyj", "aiza", "npm_", "pypi-",
    "sg.", "hf_", "dop_v1_", "://", r":\/\/", "basic", "user", "-u", "curl", "mysql", "login", "contraseña", "mot de passe",
)
OPENS = re.compile(r"""^\s*(?:-\s+)?(?:<(?P<tag>[A-Za-z][\w.-]*)(?:\s[^<>]*)?>|["']?(?P<key>[A-Za-z_][\w.$-]*)["']?\s*(?::=|=>|[:=])\s*[{\[(|>]?[-+]?)\s*$""")
SECTION = re.compile(r"^\s*\[{1,2}([\w. \"'-]+)\]{1,2}\s*$")
NAMED = re.compile(r"""^\s*(?:-\s+)?[{]?\s*["']?(?:name|key|id|variable)["']?\s*[:=]\s*["']?(?P<name>[A-Za-z_][\w.-]*)["']?\s*,?\s*$""", re.I)
INLINE = re.compile(r"""["']?(?P<key>[A-Za-z_][\w.$-]*)["']?\s*(?::=|=>|[:=])\s*(?P<open>[{\[(])|(?P<bare>[{\[(])|(?P<close>[}\])])""")
HUNK = re.compile(r"^(?:@@ |diff --git |--- |\+\+\+ )")
BLOB = re.compile(r"[A-Za-z0-9+/_=.~-]{12,}")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def literal(value: str, quoted: bool) -> bool:
    """Does the value of a sensitive key look like a literal credential?"""
    v = value.strip()
    if len(v) < 6 or PLACEHOLDER.search(v) or REFERENCE.search(v) or DIGEST.match(v):
        return False
    has_digit, has_letter = any(c.isdigit() for c in v), any(c.isalpha() for c in v)
    if not has_letter or " " in v:
        return False
    if not has_digit:  # letters only: an identifier or a word, unless long and mixed like a random string
        return len(v) >= 12 and _shuffled(v)
    if re.fullmatch(r"[a-z_][\w]*(?:\.[a-z_]\w*)+", v) and not quoted:
        return False
    return len(set(v)) >= 5


def _shuffled(v: str) -> bool:
    """Case or class changes as often as in random text, far oftener than in joined words."""
    kinds = ["U" if c.isupper() else "l" if c.islower() else "." for c in v]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) >= len(v) / 3 and entropy(v) >= 3


def random_like(value: str) -> bool:
    v = value.strip()
    return len(v) >= 8 and any(c.isalpha() for c in v) and (any(c.isdigit() for c in v) or _shuffled(v)) and entropy(v) >= 2.8 and not PLACEHOLDER.search(v) and not REFERENCE.search(v) and not DIGEST.match(v)


def view(line: str) -> str:
    """The line with JSON escapes opened, each two characters wide as before."""
    if not line.lstrip()[:1] == "{" or "\\" not in line:
        return line
    return re.sub(r"\\([\"\\/nrtbf])", lambda m: " " + {"n": "\n", "r": " ", "t": "\t", "b": " ", "f": " "}.get(m[1], m[1]), line)


def sensitive(key: str) -> bool:
    return bool(SENSITIVE.search(key)) and not NEUTRAL_KEY.search(key)


class Lines:
    """The lines of a text with what encloses each of them; ``signed`` lines begin with a diff's sign."""

    def __init__(self, lines: list[str], signed: bool = False):
        self.lines, self.signed = lines, signed

    def body(self, at: int) -> str:
        line = self.lines[at]
        return line[1:] if self.signed and line[:1] in ("+", "-", " ") and not HUNK.match(line) else line

    def enclosing(self, at: int) -> list[str]:
        """The keys, elements and the section around line ``at``, from the outside in."""
        keys: list[str] = []
        indent = _indent(self.body(at))
        for back in range(at - 1, -1, -1):
            if self.signed and HUNK.match(self.lines[back]):
                break
            line = self.body(back)
            if not line.strip():
                continue
            if m := SECTION.match(line):
                keys.append(m[1].strip())
                break
            if _indent(line) < indent:
                indent = _indent(line)
                if m := OPENS.match(line):
                    keys.append(m["key"] or m["tag"])
        return keys[::-1]

    def beside(self, at: int) -> str:
        """The name that stands beside the value on line ``at``, in the same item."""
        line = self.body(at)
        indent = _indent(line)
        for back in range(at - 1, -1, -1):
            line = self.body(back)
            if m := NAMED.match(line):
                return m["name"]
            if not line.strip() or _indent(line) < indent - 2 or line.lstrip().startswith(("- ", "{", "}")):
                break
        return ""


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def inline_keys(s: str, end: int) -> list[str]:
    """The keys whose brackets are open at ``end`` of a line."""
    stack: list[str] = []
    for m in INLINE.finditer(s, 0, end):
        if m["close"]:
            if stack:
                stack.pop()
        else:
            stack.append(m["key"] or "")
    return [k for k in stack if k]


def assignments(s: str, around: Lines, at: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, key path) of the literal values of sensitive keys on line ``at``, whose text or view is ``s``."""

    def path(start: int, *own: str) -> str:
        return ".".join([*around.enclosing(at), *inline_keys(s, start), *own])

    for pattern in (XML, XMLTAG):
        for m in pattern.finditer(s):
            if sensitive(m["key"]) and literal(m["value"], True):
                yield m.start("value"), m.end("value"), path(m.start(), m["key"])
    at_ = 0
    while m := ASSIGN.search(s, at_):
        at_ = m.end("key") + 1
        *outer, key = m["key"].split(".")
        part = m.lastgroup
        held = bool(HOLDER.match(key))
        if not (held or sensitive(key)) or not literal(m[part], part != "bare"):
            continue
        if part == "bare" and s[m.end() : m.end() + 1] in ("(", "["):
            continue  # a call or an index, not a literal
        if held and not sensitive(key):
            holder = (outer or inline_keys(s, m.start()) or around.enclosing(at) or [""])[-1]
            name = around.beside(at) or (n[1] if (n := BESIDE.search(s[: m.start()])) else "")
            if not (sensitive(holder) or sensitive(name)):
                continue
        yield m.start(part), m.end(part), path(m.start(), *outer, key)


BESIDE = re.compile(r"""(?i)["']?\b(?:name|key|id|variable)["']?\s*[:=]\s*["']([A-Za-z_][\w.-]*)["']\s*,\s*["']?$""")


def _in_line(s: str, around: Lines, at: int) -> Iterator[tuple[int, int, str, str]]:
    for m in ISSUED.finditer(s):
        if not PLACEHOLDER.search(m[0]) and len(set(m[0])) > 8:
            yield m.start(), m.end(), "issued", ""
    for m in USERINFO.finditer(s):
        v = m[1]
        if not PLACEHOLDER.search(v) and not REFERENCE.search(v) and not re.fullmatch(r"(?i)(?:pass(?:word)?|pwd|user|secret|token)", v):
            yield m.start(1), m.end(1), "userinfo", "url"
    for m in HEADER.finditer(s):
        g = 1 if m[1] else 2
        if random_like(m[g]):
            yield m.start(g), m.end(g), "header", "authorization"
    for m in SWITCH.finditer(s):
        g = m.lastindex
        if not PLACEHOLDER.search(m[g]) and not REFERENCE.search(m[g]):
            yield m.start(g), m.end(g), "switch", "argument"
    for m in NETRC.finditer(s):
        if not PLACEHOLDER.search(m[1]) and not REFERENCE.search(m[1]):
            yield m.start(1), m.end(1), "netrc", "password"
    for start, end, path in assignments(s, around, at):
        yield start, end, "assignment", path
    for m in SAID.finditer(s):
        if random_like(m[1]) and not s[m.end() : m.end() + 1] == "(":
            yield m.start(1), m.end(1), "said", ""


def _marked_lines(text: str) -> set[int]:
    """1-based numbers of the lines worth parsing."""
    lower = text.lower()
    if len(lower) != len(text):  # a character whose lower case is longer
        lower = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    begins: set[int] = set()
    for anchor in ANCHORS:
        at = lower.find(anchor)
        while at >= 0:
            begins.add(lower.rfind("\n", 0, at) + 1)
            stop = lower.find("\n", at)
            at = lower.find(anchor, stop) if stop >= 0 else -1
    marked: set[int] = set()
    seen, line_no = 0, 1
    for begin in sorted(begins):
        line_no += text.count("\n", seen, begin)
        seen = begin
        marked.add(line_no)
    return marked


def _with_blocks(marked: set[int], around: Lines) -> set[int]:
    """The marked lines and those in the block or the item that a sensitive key or name among them opens."""
    more = set(marked)
    for line_no in marked:
        line = around.body(line_no - 1)
        m = OPENS.match(line) or NAMED.match(line)
        if m and sensitive(m.groupdict().get("name") or m.groupdict().get("key") or m.groupdict().get("tag") or ""):
            least = _indent(line) + (m.re is OPENS)
            for ahead in range(line_no, len(around.lines)):
                body = around.body(ahead)
                if body.strip() and _indent(body) < least or HUNK.match(around.lines[ahead]):
                    break
                more.add(ahead + 1)
    return more


def findings(text: str | None) -> list[Finding]:
    """Every credential of a text: the part at its first line first, its further parts with line_no 0."""
    if not text:
        return []
    marked = _marked_lines(text)
    if not marked:
        return []
    lines = text.split("\n")
    around = Lines(lines, signed="\n@@ -" in text or text.startswith("@@ -"))
    marked = _with_blocks(marked, around)
    out: list[Finding] = []
    offset = 0
    pem_from = -1  # inside a private block
    chain = False  # inside a string literal continued over lines
    for line_no, line in enumerate(lines, 1):
        if pem_from >= 0:
            if end := PEM_END.search(line):
                if end.start() > 1:
                    out.append(Finding(0, offset + (1 if line[:1] in "+- " else 0), offset + end.start(), "private key", ""))
                pem_from = -1
            elif BLOB.search(line) or not line.strip("+- \t"):
                lead = len(line) - len(line.lstrip("+- \t"))
                if len(line) > lead:
                    out.append(Finding(0, offset + lead, offset + len(line), "private key", ""))
            else:
                pem_from = -1
            if pem_from >= 0 or end:
                offset += len(line) + 1
                continue
        if chain:
            m = CONTINUED.match(line)
            if m:
                out.append(Finding(0, offset + m.start(1), offset + m.end(1), "assignment", ""))
                chain = not m[2]
                offset += len(line) + 1
                continue
            chain = False
        if line_no in marked:
            opened = view(line)
            base = 0
            first = True
            spans: list[tuple[int, int, str, str]] = []
            inner_pem = False
            inner_chain = False
            subs = opened.split("\n")
            inside = Lines(subs, signed=any(x.startswith("@@ -") for x in subs)) if len(subs) > 1 else around
            for number, sub in enumerate(subs):
                if inner_pem:
                    if end := PEM_END.search(sub):
                        if end.start() > 0:
                            spans.append((base, base + end.start(), "private key", ""))
                        inner_pem = False
                    elif sub.strip():
                        spans.append((base, base + len(sub.rstrip()), "private key", ""))
                elif inner_chain and (m := CONTINUED.match(sub)):
                    spans.append((base + m.start(1), base + m.end(1), "assignment", ""))
                    inner_chain = not m[2]
                else:
                    if p := PEM.search(sub):
                        spans.append((base + p.end(), base + p.end(), "private key", ""))
                        inner_pem = True
                        rest = sub[p.end() :]
                        if end := PEM_END.search(rest):
                            spans[-1] = (base + p.end(), base + p.end() + end.start(), "private key", "")
                            inner_pem = False
                        elif rest.strip(" \\\"'"):
                            spans[-1] = (base + p.end(), base + len(sub.rstrip(" \\\"'}")), "private key", "")
                    found = sorted(set(_in_line(sub, inside, number if len(subs) > 1 else line_no - 1)))
                    spans += [(base + a, base + b, k, key) for a, b, k, key in found]
                    inner_chain = bool(found) and bool(re.search(r"[=:]\s*\(\s*[\"'][^\"']*[\"']\s*$", sub))
                base += len(sub) + 1
            if inner_pem and "\n" not in opened:
                pem_from = line_no
            if inner_chain and "\n" not in opened:
                chain = True
            last = -1
            for a, b, kind, key in sorted(spans):
                while b > a and opened[b - 1] == " ":  # half of an opened escape
                    b -= 1
                while a < b and opened[a] == " ":
                    a += 1
                if a < last:
                    continue
                out.append(Finding(line_no if first or a >= 0 else 0, offset + a, offset + b, kind, key))
                last = max(b, a + 1)
                first = False
        offset += len(line) + 1
    return out


def byte_spans(text: str, found: list[Finding]) -> list[tuple[int, int]]:
    """The spans of findings in the UTF-8 bytes of ``text``."""
    at = [x for f in found for x in (f.start, f.end)]
    told, last, total = {}, 0, 0
    for x in sorted(set(at)):
        total += len(text[last:x].encode("utf-8", "surrogatepass"))
        told[x], last = total, x
    return [(told[f.start], told[f.end]) for f in found]


def redact(text: str | None) -> str | None:
    """``text`` with a mask spliced into its bytes over every finding."""
    if text is None:
        return None
    found = findings(text)
    if not found:
        return text
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for start, end in sorted(byte_spans(text, found)):
        if end <= start or start < at:
            continue
        out += [data[at:start], MASK.encode()]
        at = end
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def long_form(items: DataFrame, attempts: DataFrame) -> DataFrame:
    """(owner_id, field_name, body): the searched texts, one a row."""
    def one(df: DataFrame, owner: str, field: str) -> DataFrame:
        return df.select(F.col(owner).alias("owner_id"), F.lit(field).alias("field_name"), F.col(field).alias("body")).filter("body is not null")

    return one(items, "instance_id", "patch").unionAll(one(items, "instance_id", "test_patch")).unionAll(one(attempts, "attempt_id", "raw_output"))


def located(texts: DataFrame) -> DataFrame:
    """owner_id, field_name, line_no, byte_start, byte_end, kind, key_path of every credential in ``texts``."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for owner, field, text in zip(pdf["owner_id"], pdf["field_name"], pdf["body"]):
                found = [f for f in findings(text) if f.line_no]
                rows += [(owner, field, f.line_no, *span, f.kind, f.key) for f, span in zip(found, byte_spans(text, found) if found else [])]
            yield pd.DataFrame(rows, columns=["owner_id", "field_name", "line_no", "byte_start", "byte_end", "kind", "key_path"])

    return texts.select("owner_id", "field_name", "body").mapInPandas(
        scan, "owner_id string, field_name string, line_no int, byte_start long, byte_end long, kind string, key_path string"
    )


def credential_lines(items: DataFrame, attempts: DataFrame) -> DataFrame:
    return located(long_form(items, attempts)).select("owner_id", "field_name", "line_no").distinct()


def redacted(texts: DataFrame) -> DataFrame:
    """The texts with every credential masked, and the number of masks; a text delivered twice counts once."""

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            body = [redact(t) for t in pdf["body"]]
            n = [b.count(MASK) - t.count(MASK) for b, t in zip(body, pdf["body"])]
            yield pd.DataFrame({"owner_id": pdf["owner_id"], "field_name": pdf["field_name"], "body": body, "n_masked": n})

    # deliveries of one text are one: by a hash of it, so that no text is compared whole
    once = texts.select("owner_id", "field_name", "body").withColumn("h", F.xxhash64("body")).dropDuplicates(["owner_id", "field_name", "h"])
    return once.select("owner_id", "field_name", "body").mapInPandas(mask, "owner_id string, field_name string, body string, n_masked int")
