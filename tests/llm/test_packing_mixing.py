import os
import random

import pytest

from lathework.llm import mixing, packing, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no public vocabulary here")
DOCS = "doc_id long, text string, source string, n_tokens int, copies int"


def test_differencing_balances():
    rng = random.Random(2)
    sizes = [rng.randint(1, 90) for _ in range(200)]
    windows = packing.differencing(sizes, 10)
    assert sorted(i for w in windows for i in w) == list(range(200))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) - min(sums) <= 2


def test_pack_is_whole_and_tight():
    rng = random.Random(3)
    for capacity in (256, 1024):
        sizes = [min(capacity, int(rng.lognormvariate(4, 1)) + 1) for _ in range(700)]
        windows = packing.pack(sizes, capacity)
        assert sorted(i for w in windows for i in w) == list(range(700))
        assert all(sum(sizes[i] for i in w) <= capacity for w in windows)
        assert len(windows) <= 1.04 * sum(sizes) / capacity + 1
    assert packing.pack([], 10) == [] and sorted(packing.pack([10, 10, 10], 10)) == [[0], [1], [2]]


def test_the_count_rises_until_nothing_is_exceeded():
    assert sorted(map(sorted, packing.pack([6, 6, 6, 6], 11))) == [[0], [1], [2], [3]]
    assert len(packing.pack([5, 5, 5, 5, 1], 11)) == 2
    even = packing.pack([7] * 90, 50)
    assert len(even) == 13 and max(map(len, even)) == 7


@needs_vocabulary
def test_containers(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(rng.choice((3, 30, 900)))), "x", 1, 1) for i in range(300)]
    rows += [(900, None, None, None, None), (901, "", None, None, None), (None, "text", None, None, None), rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    kinds = spark.createDataFrame([("narrow", 64), ("wide", 512), (None, 3), ("none", None), ("zero", 0)], "container_name string, capacity_tokens long")
    placed = packing.containers_of(docs, kinds).collect()
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokens.sizes(docs.filter("text is not null and doc_id is not null"), "doc_id", "text").collect()}
    for name, capacity in (("narrow", 64), ("wide", 512)):
        mine = [r for r in placed if r["container_name"] == name]
        per_doc, per_box = {}, {}
        for r in mine:
            per_doc[r["doc_id"]] = per_doc.get(r["doc_id"], 0) + r["n_tokens"]
            per_box[r["container_id"]] = per_box.get(r["container_id"], 0) + r["n_tokens"]
            assert sizes[r["doc_id"]] > capacity or r["n_tokens"] == sizes[r["doc_id"]]
        assert per_doc == {d: n for d, n in sizes.items() if n} and max(per_box.values()) <= capacity
    assert {r["container_name"] for r in packing.fill_report(packing.containers_of(docs, kinds), kinds).collect()} == {"narrow", "wide"}
    assert packing.containers_of(docs.limit(0), kinds).count() == 0


@needs_vocabulary
def test_shares(spark):
    rng = random.Random(5)
    rows = [(i, "word " * rng.randint(1, 120), rng.choice(["Big", "big ", "big", "mid"] if i % 9 else ["small"]), 1, 1) for i in range(3000)] + [(9001, None, "big", 1, 1), (9002, "x", None, 1, 1), (None, "x", "big", 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.2, 1), ("small", 0.3, 3), ("absent", 0.1, 2), (None, 0.1, 1), ("never", 0.2, None)], "source string, target_share double, max_repeats int")
    out, report = mixing.drawn(docs, targets)
    got = {r["source"]: r for r in report.collect()}
    for s, share in (("big", 0.5), ("mid", 0.2), ("small", 0.3)):
        assert abs(got[s]["actual_share"] - share) < 0.004
        assert got[s]["most_repeats"] <= (3 if s == "small" else 1)
    assert got["absent"]["drawn_tokens"] == 0 and got["never"]["drawn_tokens"] == 0
    assert out.filter("copies < 0 or rate < 0").count() == 0
    empty = mixing.drawn(docs.limit(0), targets)
    assert empty[0].count() == 0 and empty[1].count() == 5


@needs_vocabulary
def test_special_token_strings_are_text(spark):
    docs = spark.createDataFrame([(1, "<|endoftext|>", "s", 0, 0), (2, "a" * 20_000, "s", 0, 0)], DOCS)
    assert all(r["n_tokens"] > 1 for r in tokens.sizes(docs, "doc_id", "text").collect())
