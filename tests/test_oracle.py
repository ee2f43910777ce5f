"""Every core query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from lathework.plans import everything as catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def told(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, (str, bool)) or hasattr(v, "year"):
            return str(v)
        return f"{float(v):.9g}"

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(told, r)) for r in df.values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_queries_without_sql_give_rows(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_split_and_tree_hold_what_they_promise(spark):
    split = catalogue.QUERIES["best_split"](spark, SF).toPandas().iloc[0]
    told = catalogue.QUERIES["tree_predictions"](spark, SF).toPandas()
    labels = set(told["label"])
    assert 0 <= split["impurity"] <= 1 and set(told["predicted"]) <= labels and set(told["split"]) == {"train", "validation", "test"}
    fitted = told[told["split"] != "test"]
    assert (fitted["predicted"] == fitted["label"]).mean() >= fitted["label"].value_counts(normalize=True).iloc[0] - 1e-9


def test_learned_policy_lies_between(spark):
    rows = {r["policy"]: r for r in catalogue.QUERIES["learned_policy"](spark, SF).collect()}
    assert set(rows) == {"cheap", "dear", "failure", "signal", "learned"} and len({r["n"] for r in rows.values()}) == 1
    assert rows["learned"]["n_resolved"] <= rows["failure"]["n_resolved"] and rows["learned"]["mean_cost"] <= rows["cheap"]["mean_cost"] + rows["dear"]["mean_cost"]


def test_patch_sides_and_roles_agree(spark, duck):
    sides = {r["instance_id"]: r for r in catalogue.QUERIES["patch_sides"](spark, SF).collect()}
    role = {r["instance_id"]: dict(x.split(":", 1) for x in r["roles"].split(";") if x) for r in catalogue.QUERIES["patch_roles"](spark, SF).collect()}
    texts = duck.execute("select distinct instance_id, coalesce(patch, '') || coalesce(test_patch, '') as t, coalesce(patch, '') as p from materialized_items where instance_id is not null").fetchall()
    for who, text, patch in texts:
        chunks = ["diff --git " + x for x in ("\n" + text).split("\ndiff --git ")[1:]]
        path = lambda c: c.split("\n", 1)[0].rsplit(" b/", 1)[-1].strip('"')
        by_role = {p: k for k, v in role[who].items() for p in v.split("|")}
        assert {path(c) for c in chunks} == set(by_role)
        has_test = "test" in by_role.values()
        for side, roles in (("prod", ("prod", "config_build", "unknown")), ("test", ("test", "test_support") if has_test else ())):
            want = [path(c) for c in chunks if by_role[path(c)] in roles]
            assert [path("diff --git " + x) for x in ("\n" + sides[who][side]).split("\ndiff --git ")[1:]] == want
        kept = {path("diff --git " + x) for x in ("\n" + sides[who]["kept"]).split("\ndiff --git ")[1:]}
        assert kept.isdisjoint(x for x in sides[who]["removed_paths"].split(",") if x)
        assert kept | {x for x in sides[who]["removed_paths"].split(",") if x} == {path("diff --git " + x) for x in ("\n" + patch).split("\ndiff --git ")[1:]}


def test_flat_tables_name_parents_that_exist(spark):
    objects = {r["object_id"]: r["n_places"] for r in catalogue.QUERIES["p3_objects"](spark, SF).collect()}
    bridge = catalogue.QUERIES["p3_bridge"](spark, SF).toPandas()
    places = bridge["object_id"].value_counts().to_dict()
    assert places == objects
    known = set(zip(bridge["owner_id"], bridge["field_name"], bridge["node_path"], bridge["object_id"]))
    inner = bridge[bridge["parent_path"].notna()]
    assert set(zip(inner["owner_id"], inner["field_name"], inner["parent_path"], inner["parent_object_id"])) <= known
    for kind in ("turns", "calls", "models", "tiers"):
        flat = catalogue.QUERIES[f"p3_{kind}"](spark, SF).toPandas()
        assert len(flat) == (bridge["kind"] == kind).sum()


def test_no_run_shuffles_a_text(spark):
    for name in ("prediction_coverage", "latest_per_job", "retry_keys", "usage_tokens", "test_transitions", "privacy_scan", "merged_results"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        for line in plan.split("\n"):
            if "Exchange" in line or "Aggregate(" in line:
                assert "raw_output#" not in line and "stderr_output#" not in line, (name, line[:200])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
