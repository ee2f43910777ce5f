"""Nested records as related flat tables, with shared subtrees stored once (problem 3).

Every object is canonicalised bottom-up and named by the hash of its canonical form (a
Merkle identity: the form holds the hashes of the objects inside it). ``occurrences`` is
the bridge: one row for each place an object stands, with its path, its parent's path and
identity, and its ordinal in the array. ``objects`` stores every distinct object once.
``of_kind`` joins the two into one flat table per kind of nested object, the roots of a field
being a kind of their own; ``values_of`` is the table of the scalars in an array of a kind.

Defined results: a null field or one that isn't valid JSON gives no rows; a field that is
a JSON string stands for the JSON in it, as does a string under a list-valued key; a bare
object under such a key is its element 0; null elements keep their position and give no
row; of duplicate keys in one object the last counts; rows of owners delivered twice
collapse; nesting may have any depth.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_KEYS = ("models", "tiers", "turns", "calls", "edits", "retries", "signals", "spans")

REMEMBERED = 1_000_000

_COLUMNS = ["owner_id", "field_name", "node_path", "parent_path", "kind", "ordinal", "in_array", "object_id", "parent_object_id", "attributes"]
_SCHEMA = (
    "owner_id string, field_name string, node_path string, parent_path string, kind string, ordinal int, in_array boolean,"
    " object_id string, parent_object_id string, attributes string"
)


def _reject(constant: str) -> None:
    raise ValueError(constant)


_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_SPACE = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None}


def _parse(text: str) -> Any:
    try:
        return json.loads(text, parse_constant=_reject)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> Any:
    """JSON of any depth, with the open containers on a stack of our own."""
    stack: list[tuple[Any, str | None]] = []  # a container, and the key that waits for its value
    at = _SPACE.match(text, 0).end()
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            box: Any = {} if c == "{" else []
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                key, at = _key(text, at) if c == "{" else (None, at)
                stack.append((box, key))
                continue
            value, at = box, at + 1
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
        elif m := _NUMBER.match(text, at):
            value, at = (float(m[0]) if m[1] or m[2] else int(m[0])), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError(f"no JSON at {at}")
            value, at = _WORDS[word], at + len(word)
        while True:  # a value is whole: put it into its container
            at = _SPACE.match(text, at).end()
            if not stack:
                if at != len(text):
                    raise ValueError(f"more than one JSON value at {at}")
                return value
            box, key = stack.pop()
            if key is None:
                box.append(value)
            else:
                box[key] = value
            c = text[at : at + 1]
            at = _SPACE.match(text, at + 1).end()
            if c == ",":
                key, at = (None, at) if key is None else _key(text, at)
                stack.append((box, key))
                break
            if c != ("]" if key is None else "}"):
                raise ValueError(f"no end of a container at {at}")
            value = box


def _key(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = json.decoder.scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no value at {at}")
    return key, _SPACE.match(text, at + 1).end()


def _opened(value: Any) -> Any:
    """The JSON that a string stands for, however often it is quoted; the string itself where it holds none."""
    while isinstance(value, str):
        try:
            value = _parse(value)
        except ValueError:
            return value
    return value


def object_rows(text: str | None, list_keys: frozenset[str] | set[str] = frozenset(LIST_KEYS)) -> list[tuple]:
    """(node_path, parent_path, kind, ordinal, in_array, object_id, parent_object_id, attributes) of each object in ``text``.

    Containers wait on a stack until their parts are canonical; the form of an object inside
    another is its identity.
    """
    if not text:
        return []
    try:
        root = _opened(_parse(text))
    except ValueError:
        return []
    rows: list[list] = []
    parents: list[int] = []
    open_: list[tuple] = []  # row (-1 for a list), path, kind, key, items to come, canonical parts
    todo: tuple | None = (root, "", "", None, False, -1)  # value, path, kind, ordinal, in an array, row of the object around
    form = ""
    while todo or open_:
        if todo:
            value, path, kind, ordinal, in_array, owner = todo
            todo = None
            if isinstance(value, dict):
                rows.append([path, rows[owner][0] if owner >= 0 else None, kind, ordinal, in_array, None, None, None])
                parents.append(owner)
                open_.append((len(rows) - 1, path, kind, len(rows) - 1, iter(value.items()), []))
                form = None
            elif isinstance(value, list):
                open_.append((-1, path, kind, owner, iter(enumerate(value)), []))
                form = None
            else:
                form = json.dumps(value)
        row, path, kind, owner, items, parts = open_[-1] if open_ else (None,) * 6
        if row is None:
            break
        if form is not None:
            parts[-1] = (parts[-1], form)
            form = None
        step = next(items, None)
        if step is None:
            open_.pop()
            if row >= 0:
                canonical = "{" + ",".join(f"{json.dumps(k)}:{v}" for k, v in sorted(parts)) + "}"
                identity = hashlib.blake2b(canonical.encode(), digest_size=16).hexdigest()
                rows[row][5], rows[row][7] = identity, canonical
                form = f'{{"@":"{identity}"}}'
            else:
                form = "[" + ",".join(v for _, v in parts) + "]"
            if not open_:
                break
            continue
        key, child = step
        parts.append(key)
        if row >= 0:
            if key in list_keys:
                child = _opened(child)
                child = [child] if isinstance(child, dict) else child
            todo = (child, f"{path}.{key}" if path else key, key, None, False, row)
        else:
            todo = (child, f"{path}[{key}]", kind, key, True, owner)
    for r, owner in zip(rows, parents):
        r[6] = rows[owner][5] if owner >= 0 else None
    return [tuple(r) for r in rows]


def occurrences(df: DataFrame, owner: str, fields: Sequence[str], list_keys: Sequence[str] = LIST_KEYS, kinds: Sequence[str] | None = None, once: bool = False) -> DataFrame:
    """The bridge rows of the JSON columns ``fields``, with the canonical form of each object beside its identity.

    ``kinds`` leaves other kinds out; with ``once`` a task gives the form of an object only where
    it meets it first, among the ``REMEMBERED`` objects before.
    """
    keys = frozenset(list_keys)
    wanted = None if kinds is None else frozenset(kinds)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[str] = set()
        for pdf in batches:
            rows = [
                (who, field, *row)
                for field in fields
                for who, text in zip(pdf["owner"], pdf[field])
                for row in object_rows(text, keys)
                if wanted is None or row[2] in wanted
            ]
            if once:
                for i, row in enumerate(rows):
                    if row[7] in met:
                        rows[i] = (*row[:9], None)
                    met.add(row[7])
                if len(met) > REMEMBERED:
                    met.clear()
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return df.select(F.col(owner).alias("owner"), *fields).mapInPandas(scan, _SCHEMA)


def bridge(found: DataFrame) -> DataFrame:
    """Parent-child rows without the contents; owners delivered twice collapse."""
    return found.drop("attributes").distinct()


def objects(found: DataFrame) -> DataFrame:
    """Every distinct object once, with how often it stands; ``found`` may give a form once a task only."""
    places = found.groupBy("object_id", "owner_id", "field_name", "node_path").agg(F.max("attributes").alias("attributes"))
    return places.groupBy("object_id").agg(F.max("attributes").alias("attributes"), F.count("*").alias("n_places"))


def _kind_rows(found: DataFrame, kind: str, field: str | None) -> DataFrame:
    rows = found.filter(F.col("kind") == kind)
    return rows.filter(F.col("field_name") == field) if field else rows


def of_kind(found: DataFrame, kind: str, columns: dict[str, str], field: str | None = None) -> DataFrame:
    """The flat table of one kind: identity, parent, position and the scalar ``columns`` (name to type).

    The roots of a field are the objects of kind "" in ``field``; they have no parent.
    """

    def value(name: str, of: str) -> Column:
        return F.get_json_object("attributes", f"$['{name}']").try_cast(of).alias(name)

    return (
        _kind_rows(found, kind, field)
        .select("owner_id", "field_name", "node_path", "parent_path", "ordinal", "object_id", "parent_object_id", *[value(n, t) for n, t in columns.items()])
        .distinct()
    )


def values_of(found: DataFrame, kind: str, name: str) -> DataFrame:
    """One row for each scalar in the array ``name`` of the objects of a kind, naming that object."""
    values = F.from_json(F.get_json_object("attributes", f"$['{name}']"), "array<string>")
    return (
        found.filter(F.col("kind") == kind)
        .select("owner_id", "field_name", F.col("node_path").alias("parent_path"), F.col("object_id").alias("parent_object_id"), F.posexplode(values).alias("ordinal", name))
        .distinct()
    )


def array_objects(found: DataFrame) -> DataFrame:
    """The places of the objects that are elements of an array."""
    return found.filter("in_array").select("owner_id", "field_name", "node_path").distinct()
