import json

import pytest
from pyspark.sql import functions as F

from lathework.sources import records
from lathework.streaming import jobs


def test_sniffing_reader(spark, tmp_path):
    lines = tmp_path / "rows.parquet"  # JSON lines under the other ending
    lines.write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2}\n')
    assert records.read_records(spark, str(lines), "id string, n int").count() == 2
    folder = str(tmp_path / "true.parquet")
    spark.range(3).write.parquet(folder)
    assert records.read_records(spark, folder, "id long").count() == 3
    broken = tmp_path / "broken.jsonl"
    broken.write_text('{"id": "a", "n": 1}\n{"id": \n')
    assert records.read_records(spark, str(broken), "id string, n int", strict=False).count() == 1
    with pytest.raises(Exception):
        records.read_records(spark, str(broken), "id string, n int").collect()


def test_listings(spark, tmp_path):
    rows = [{"id": "a", "state": "x"}, {"id": "b", "state": "y"}, {"id": "a", "state": "z"}, {"id": "", "state": "q"}]
    for name, body in (("array", json.dumps(rows)), ("lines", "\n".join(map(json.dumps, rows))), ("object", json.dumps({"candidates": rows}))):
        path = tmp_path / name
        path.write_text(body)
        got = lambda last: {r["id"]: r["state"] for r in records.read_listing(spark, str(path), "id", "id string, state string", wrapper="candidates", last=last).collect()}
        assert got(True) == {"a": "z", "b": "y"} and got(False) == {"a": "x", "b": "y"}


def test_required_ids_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a",), (" ",)], "instance_id string")
    with pytest.raises(Exception, match="blank instance_id"):
        records.require_filled(df, "instance_id").collect()
    records.write_jsonl(df, str(tmp_path / "out"))
    records.write_jsonl(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    records.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["instance_id"]
    assert all(len(r["sha256"]) == 64 for r in records.bundle_manifest(spark, str(tmp_path / "csv")).collect())
    runs = spark.createDataFrame([("s", "i", "p"), ("s", "", "p"), ("s", "i", None)], "solver_id string, instance_id string, model_patch string")
    assert records.predictions(runs).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).select(
        F.col("id").alias("event_id"), (F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("id") * 7 % 600)).alias("ts"), (F.col("id") % 9).alias("user_id"),
        F.concat(F.lit("e"), (F.col("id") % 3).cast("string")).alias("event_type"), (F.col("id") % 13).cast("double").alias("value"), F.lit("{}").alias("props"))
    rows.write.parquet(str(tmp_path / "events"))
    told = lambda df: sorted(map(str, df.collect()))
    batch = told(jobs.burn(jobs.log(rows)))
    assert told(jobs.replay(spark, str(tmp_path / "events"), "*.parquet", jobs.burn, ["starts_at", "status"])) == batch
    spent = {r["job_id"]: r["spent"] for r in jobs.replay(spark, str(tmp_path / "events"), "*.parquet", lambda d: jobs.over_budget(d, 100.0), ["job_id"]).collect()}
    want = {r["job_id"]: r["s"] for r in jobs.log(rows).groupBy("job_id").agg(F.sum("value").alias("s")).filter("s > 100").collect()}
    assert set(spent) == set(want)


def test_mixed_folders_and_locations(spark, tmp_path):
    folder = tmp_path / "run"
    spark.createDataFrame([("a", 1)], "id string, n int").write.parquet(str(folder / "part"))
    (folder / "more.parquet").write_text('{"id": "b", "n": 2}\n')
    assert sorted(map(tuple, records.read_records(spark, str(folder), "id string, n int").collect())) == [("a", 1), ("b", 2)]
    assert not records.is_parquet(spark, str(folder)) and records.is_parquet(spark, str(folder / "part"))
    (folder / "attempts.jsonl").write_text("")
    assert records.located(spark, str(folder), records.ATTEMPTS).endswith("/attempts.jsonl")
    (folder / "run").mkdir()
    (folder / "run" / "attempts.jsonl").write_text("")
    with pytest.raises(ValueError):
        records.located(spark, str(folder), records.ATTEMPTS)
    with pytest.raises(FileNotFoundError):
        records.located(spark, str(tmp_path), records.RESULTS)


def test_matrix_bundle_and_version(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"run_id": "r", "solvers": [{"id": "s1", "provider": "p"}, {"id": "s2"}]}))
    solvers, config = records.read_matrix(spark, str(tmp_path / "m.json"))
    assert config == {"run_id": "r"} and {r["solver_id"] for r in solvers.collect()} == {"s1", "s2"}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "attempts.jsonl").write_text("{}")
    (tmp_path / "b" / "summary.json").write_text("{}")
    manifest = records.bundle_manifest(spark, str(tmp_path / "b"))
    assert {r["path"].rsplit("/", 1)[-1]: r["privacy_class"] for r in manifest.collect()} == {"attempts.jsonl": "source_adjacent", "summary.json": "metadata"}
    assert records.bundle_id(manifest) == records.bundle_id(manifest.repartition(2)) and records.bundle_id(manifest).startswith("art_")
    rows = spark.createDataFrame([("a", 1), ("b", None)], "x string, y int")
    version = lambda df: records.dataset_version(df, ["x", "y"]).first()[0]
    assert version(rows) == version(rows.orderBy("y").repartition(3)) != version(rows.limit(1))


def test_last_states_count_an_event_once(spark, tmp_path):
    rows = [(1, "2026-01-01 00:00:00", 7, "queued"), (2, "2026-01-01 00:01:00", 7, "running"), (2, "2026-01-01 00:01:00", 7, "running"), (3, "2026-01-01 00:00:30", 8, "queued")]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "1.0 value", "'{}' props").write.parquet(str(tmp_path / "e"))
    found = jobs.replay(spark, str(tmp_path / "e"), "*.parquet", jobs.final_states, ["job_id"])
    assert {(r["job_id"], r["status"]) for r in found.collect()} == {("job-7", "running"), ("job-8", "queued")}
