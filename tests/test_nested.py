import json
import random

from lathework.operators import nested
from lathework.plans import catalogue

KEYS = set(nested.LIST_KEYS)


def opened(v):
    while isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            return v
    return v


def brute(text):
    """Paths of the objects in arrays, by plain recursion."""
    try:
        root = opened(json.loads(text))
    except (TypeError, ValueError):
        return set()
    out = set()

    def walk(v, path):
        if isinstance(v, list):
            for i, x in enumerate(v):
                if isinstance(x, dict):
                    out.add(f"{path}[{i}]")
                walk(x, f"{path}[{i}]")
        elif isinstance(v, dict):
            for k, x in v.items():
                if k in KEYS:
                    x = opened(x)
                    x = [x] if isinstance(x, dict) else x
                walk(x, f"{path}.{k}" if path else k)

    walk(root, "")
    return out


def made(rng, depth=0):
    out = {}
    for k in rng.sample([*nested.LIST_KEYS, "payload", "args", "flags"], rng.randint(0, 4)):
        kids = [None if rng.random() < 0.15 else made(rng, depth + 1) for _ in range(rng.randint(0, 3))] if depth < 4 else []
        if k == "flags":
            out[k] = ["-q", "-x"]
        elif k in ("payload", "args"):
            out[k] = made(rng, depth + 1) if depth < 4 else 1
        else:
            roll = rng.random()
            out[k] = json.dumps(kids) if roll < 0.2 else kids[0] if kids and roll < 0.4 else None if roll < 0.5 else kids
    return out


def texts(n=200, seed=3):
    rng = random.Random(seed)
    out = [json.dumps(made(rng)) for _ in range(n)]
    return out + [json.dumps(out[0]), json.dumps(json.dumps(out[1])), out[2][:-3], "", " ", None, "null", "3", '{"a": NaN}', '[{"a": 1}, [{"b": 2}], null]', '{"a": {"a": 1}, "a": []}', "[" * 5000 + "]" * 5000]


def test_paths_match_brute_force():
    for t in texts():
        if t and t.startswith("[[["):
            assert nested.object_rows(t) == []
        elif t != '{"a": NaN}':
            assert {r[0] for r in nested.object_rows(t) if r[4]} == brute(t), t
        else:
            assert nested.object_rows(t) == []


def test_identities_and_parents(spark):
    rows = [(f"o{i}", t, "x") for i, t in enumerate(texts())] + [("o0", texts()[0], "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "owner_id string, usage string, node_path string")
    found = nested.occurrences(df, "owner_id", ["usage"])
    bridge = nested.bridge(found).collect()
    at = {(r["owner_id"], r["node_path"]): r for r in bridge}
    assert len(at) == len(bridge)
    for r in bridge:
        if r["parent_path"] is not None:
            assert at[r["owner_id"], r["parent_path"]]["object_id"] == r["parent_object_id"]
    stored = {r["object_id"]: r for r in nested.objects(found).collect()}
    assert set(stored) == {r["object_id"] for r in bridge} and sum(r["n_places"] for r in stored.values()) == len(bridge)
    calls = nested.of_kind(found, "calls", {"tool": "string", "ms": "bigint"}).collect()
    assert {(r["owner_id"], r["node_path"]) for r in calls} == {k for k, r in at.items() if r["kind"] == "calls"}
    assert nested.array_objects(nested.occurrences(df.limit(0), "owner_id", ["usage"])).count() == 0


def test_same_object_same_identity():
    a = nested.object_rows('{"x": {"b": 1, "a": [2, {"c": 3}]}}')
    b = nested.object_rows('{"y": 1, "x": {"a": [2, {"c": 3}], "b": 1}}')
    assert a[1][5] == b[1][5] and a[0][5] != b[0][5]


def test_every_object_and_scalar_of_the_tables_has_its_flat_row(spark):
    sf = "/root/testdata/sf0.001"
    found = catalogue._nested(spark, sf).distinct().collect()
    tables = {k or f for f, k in {(r["field_name"], r["kind"]) for r in found}}
    flat, scalars = set(), {}
    for name in tables:
        for r in catalogue.QUERIES[f"p3_{name}"](spark, sf).collect():
            flat.add((r["owner_id"], r["field_name"], r["node_path"], r["parent_path"], r["object_id"], r["parent_object_id"]))
            scalars[r["object_id"], name] = r.asDict()
    assert flat == {(r["owner_id"], r["field_name"], r["node_path"], r["parent_path"], r["object_id"], r["parent_object_id"]) for r in found}
    flags = {}
    for r in catalogue.QUERIES["p3_flags"](spark, sf).collect():
        flags.setdefault(r["parent_object_id"], {})[r["ordinal"]] = r["flags"]
    for r in found:
        for key, value in json.loads(r["attributes"]).items():
            if isinstance(value, list) and value and all(isinstance(x, str) for x in value):
                assert flags[r["object_id"]] == dict(enumerate(value))
            elif value is not None and not isinstance(value, (dict, list)):
                assert scalars[r["object_id"], r["kind"] or r["field_name"]][key] == value, (r["kind"], key)


def test_any_depth():
    deep = '{"a":' * 3000 + '{"turns":[{"x":1}]}' + "}" * 3000
    rows = nested.object_rows(deep)
    assert len(rows) == 3002 and rows[-1][4] and rows[-1][0].endswith("a.turns[0]")
    assert nested.object_rows("[" * 3000 + '{"x":1}' + "]" * 3000)[0][:2] == ("[0]" * 3000, None)
    assert nested.object_rows("[" * 5000) == [] and nested.object_rows('{"a":' * 5000 + "}" * 5000) == []
    quoted = '{"x": 1}'
    for _ in range(6):
        quoted = json.dumps(quoted)
    assert len(nested.object_rows(quoted)) == 1


def test_deep_parser_agrees_with_the_usual_one():
    def told(parse, text):
        try:
            return parse(text)
        except ValueError:
            return ValueError

    rng = random.Random(9)
    for text in [x for x in texts(60, 4) if x] + ['[1, -2.5e3, "a\\"b\\u00e9", true, false, null, {}, []]', " {} ", '"x"', "12", "", "nul", "1 2", "[1,]", '{"a" 1}']:
        for part in (text, text[: rng.randrange(len(text) + 1)]):
            assert told(nested._parse_deep, part) == told(lambda x: json.loads(x, parse_constant=nested._reject), part), part


def test_objects_once_a_task_are_the_same(spark):
    df = spark.createDataFrame([(f"o{i}", t) for i, t in enumerate(texts(50))], "o string, f string").repartition(3)
    every, once = (sorted(map(tuple, nested.objects(nested.occurrences(df, "o", ["f"], once=x)).collect())) for x in (False, True))
    assert every == once and all(r[1] for r in once)
