import random

from lathework.llm import splits as s

SCHEMA = "row_id long, instance_id string, solver_id string, task_cluster string, u int, v int"
TIES = [["instance_id"], ["solver_id", "task_cluster"]]


def brute(rows):
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for pick in (lambda r: (r[1],), lambda r: (r[2], r[3])):
        seen = {}
        for r in rows:
            if r[0] is None:
                continue
            key = tuple(k.strip().lower() if k else "" for k in pick(r))
            if all(key):
                a, b = find(r[0]), find(seen.setdefault(key, r[0]))
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_match_union_find(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, "", " ", f"I{rng.randint(0, 400)}", f" i{rng.randint(0, 400)} "]), rng.choice([None, f"s{rng.randint(0, 60)}"]), rng.choice([None, "", f"c{rng.randint(0, 9)}"]), 1, 2) for i in range(600)]
    rows += [(i, f"chain{i // 2}", f"t{(i + 1) // 2}", "x", 0, 0) for i in range(1000, 1200)] + [(None, "I1", "s1", "c1", 0, 0)] + rows[:20]
    found = {r["row_id"]: r["group_id"] for r in s.groups(spark.createDataFrame(rows, SCHEMA), "row_id", TIES).collect()}
    assert found == brute(rows)


def test_subsets():
    assert sum(k * n for k, n in s.nearest_subset({7: 3, 5: 2, 1: 1}, 12).items()) == 12
    rng = random.Random(1)
    for _ in range(30):
        sizes = {rng.randint(1, 20): rng.randint(1, 4) for _ in range(5)}
        target = rng.randint(0, 60)
        sums = {0}
        for size, n in sizes.items():
            sums = {a + size * k for a in sums for k in range(n + 1)}
        got = s.nearest_subset(sizes, target)
        assert all(got[k] <= sizes[k] for k in got)
        assert abs(sum(k * n for k, n in got.items()) - target) == min(abs(x - target) for x in sums)


def test_subsets_on_a_grid():
    rng = random.Random(2)
    for cells in (64, 1000):
        sizes = {rng.randint(1, 5000): rng.randint(1, 9) for _ in range(60)} | {1: 40, 2: 30, 17: 20, 90: 10}
        total = sum(k * n for k, n in sizes.items())
        got = s.nearest_subset(sizes, total // 3, cells)
        assert all(0 < got[k] <= sizes[k] for k in got)
        assert abs(sum(k * n for k, n in got.items()) - total // 3) <= 1


def test_a_hot_value_is_met_in_buckets(spark):
    rows = [(i, "hot", None, None, 0, 0) for i in range(3000)]
    edges = s.star_edges(spark.createDataFrame(rows, SCHEMA), "row_id", TIES).collect()
    ends = {}
    for r in edges:
        ends[r["v"]] = ends.get(r["v"], 0) + 1
    assert len(edges) == 2999 and max(ends.values()) < 200
    assert {r["group_id"] for r in s.groups(spark.createDataFrame(rows, SCHEMA), "row_id", TIES).collect()} == {0}


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(3)
    rows = [(i, f"i{rng.randint(0, 150)}", None, None, 0, 0) for i in range(1000)]
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, None)], "split_name string, share double")
    grouped = s.groups(spark.createDataFrame(rows, SCHEMA), "row_id", TIES)
    out = s.assign_splits(grouped, targets).collect()
    assert len(out) == 1000 and len({(r["group_id"], r["split_name"]) for r in out}) == len({r["group_id"] for r in out})
    counts = {k: sum(r["split_name"] == k for r in out) for k in ("train", "validation", "test")}
    assert counts == {"train": 800, "validation": 100, "test": 100}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    targets = spark.createDataFrame([("train", 1.0)], "split_name string, share double")
    assert s.assign_splits(s.groups(empty, "row_id", TIES), targets).count() == 0
