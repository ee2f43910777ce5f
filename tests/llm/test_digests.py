import datetime
import math
import random

from lathework.llm import digests as d

SCHEMA = "k string, day date, x double, y double, n int"


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice("aab"), datetime.date(2026, 1, rng.randint(1, 9)), rng.lognormvariate(0, 2), None if rng.random() < 0.1 else float(rng.randint(0, 5)), i) for i in range(n)]


def test_rank_error_is_bounded_and_certified(spark):
    data = rows(20_000)
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    days = d.digests(df, ["k", "day"], ["x", "y"])
    merged = d.merge(days, ["k"])
    found = d.certify(df, [(d.quantiles(days, ["k", "day"]), ["k", "day"]), (d.quantiles(merged, ["k"]), ["k"])], ["x", "y"])[1].withColumn("bound", d.rank_bound(merges=3)).collect()
    assert len(found) == 2 * 2 * len(d.QUANTILES)
    for r in found:
        values = [v for k, _, x, y, _ in data if k == r["k"] and (v := x if r["metric"] == "x" else y) is not None]
        below, upto = sum(v < r["estimate"] for v in values), sum(v <= r["estimate"] for v in values)
        assert (r["below"], r["upto"], r["n"]) == (below, upto, len(values))
        assert r["rank_error"] <= r["bound"]
    assert max(len(r["means"]) for r in merged.collect()) <= d.DELTA + 1


def test_many_digests_of_one_key_are_clustered_as_they_come(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(6000)]
    parts = spark.createDataFrame([("a", "x", 1.0, v, v, [v], [1.0]) for v in values] + [(None, "x", 1.0, 1.0, 1.0, [1.0], [1.0])], f"k string, {d.DIGEST_TYPE}")
    found = {r["k"]: r for r in d.merge(parts, ["k"]).collect()}
    assert found["a"]["n"] == 6000 and sum(found["a"]["weights"]) == 6000 and found["a"]["low"] == min(values) and found[None]["n"] == 1
    assert len(found["a"]["means"]) <= d.DELTA + 1 and found["a"]["means"] == sorted(found["a"]["means"])


def test_odd_values(spark):
    inf, nan = math.inf, math.nan
    df = spark.createDataFrame([("a", None, inf, nan, 1), ("a", None, -inf, None, 1), ("a", None, 1.0, None, 1), (None, None, 2.0, 5.0, 1), ("b", None, nan, None, 1)], SCHEMA)
    found = {(r["k"], r["metric"]): r for r in d.digests(df, ["k"], ["x", "y"]).collect()}
    assert set(found) == {("a", "x"), (None, "x"), (None, "y")}
    assert (found["a", "x"]["low"], found["a", "x"]["high"], found["a", "x"]["n"]) == (-inf, inf, 3)
    got = d.certify(df, [(d.quantiles(d.digests(df, ["k"], ["x", "y"]), ["k"]), ["k"])], ["x", "y"])[0].collect()
    assert len(got) == 3 * len(d.QUANTILES)


def test_latest_and_empty(spark):
    schema = "id string, at int, x double"
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 2, 2.0), (None, 1, 9.0), (None, 1, 9.0)], schema)
    assert sorted(r["x"] for r in d.latest(df, "id", "at", ["x"]).collect()) == [2.0, 9.0, 9.0]
    assert d.digests(spark.createDataFrame([], SCHEMA), ["k"], ["x"]).count() == 0
