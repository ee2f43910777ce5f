"""Splits in which related records stay together (problem 6).

Rows that share a tie value are in one group, and so on through other rows. The ties are
starred first (each row against the smallest row of its tie value, never all pairs), the
edges then contract: in every round each root hooks onto the smallest root it touches, the
hooks are shortcut by pointer jumping until all are stars, the parents and the edges are
relabelled, and edges inside one root vanish. The parent table is written once a round.

Group sizes go into a histogram of size and multiplicity, whose length is at most the
square root of twice the rows. A subset-sum bitset over those multiplicities picks, split
by split from the smallest share up, how many groups of each size come nearest the target
(exactly up to ``CELLS`` rows a split; beyond that on a grid of ``CELLS`` cells, and the gap, at
most one cell for each group taken, is closed with the groups left over); groups are then
numbered inside their size in blocks, so no size is ever ranked in one task.

Defined results: ids are compared without outer blanks and case; null and blank ties share
nothing; repeated rows count once; a null row id gives no row; an empty table gives none;
groups of one size are told apart by a hash of their id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.runtime import bounded, settle

#: Places that the rows of one tie value are met in.
BUCKETS = 64
#: Hooks are broadcast up to this number; beyond it AQE splits the rows of a hot root.
SMALL = 100_000
#: Groups ranked in one task, about.
BLOCK = 50_000
#: Cells of a subset-sum bitset.
CELLS = 1 << 22


def tidy(column: str) -> Column:
    """The compared form of an id: null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(F.col(column).cast("string"), r"^[\s ]+|[\s ]+$", "")), F.lit(""))


def star_edges(rows: DataFrame, id_column: str, ties: Sequence[Sequence[str]]) -> DataFrame:
    """(u, v), u > v: each row with the smallest row of its bucket of each tie value, and those with the smallest of all."""
    edges = None
    for number, columns in enumerate(ties):
        keys = [tidy(c) for c in columns]
        tied = rows.select(F.col(id_column).cast("long").alias("u"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
        names = [f"k{i}" for i in range(len(keys))]
        tied = tied.filter(F.col("u").isNotNull()).dropna(subset=names)
        # in two steps, so that the rows of a hot value are met in BUCKETS places
        tied = tied.withColumn("bucket", F.pmod(F.xxhash64("u"), F.lit(BUCKETS)))
        near = tied.groupBy(*names, "bucket").agg(F.min("u").alias("v"))
        least = near.groupBy(*names).agg(F.min("v").alias("w"))
        found = tied.join(near, [*names, "bucket"]).select("u", "v").unionByName(near.join(least, names).select(F.col("v").alias("u"), F.col("w").alias("v")))
        found = found.filter("u <> v")
        edges = found if edges is None else edges.unionByName(found)
    return edges.distinct()


def _jumped(hooks: DataFrame) -> DataFrame:
    """Every hook moved on to where its end hooks, and whether it moved."""
    up = hooks.select(F.col("u").alias("to"), F.col("to").alias("next"))
    return hooks.join(up, "to", "left").select("u", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges``; the root is the smallest node of its component."""
    edges = settle(edges)
    parents = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("root", F.col("node"))
    for _ in range(max_rounds):
        if edges.isEmpty():
            return parents
        hooks = settle(edges.groupBy("u").agg(F.min("v").alias("to")))
        while True:  # shortcut, two jumps at a time: every hook ends at a root
            jumped = settle(_jumped(_jumped(hooks).drop("moved")))
            hooks = jumped.select("u", "to")
            if jumped.filter("moved").isEmpty():
                break
        hooks = bounded(hooks, SMALL)
        move = hooks.select(F.col("u").alias("root"), "to")
        parents = settle(parents.join(move, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        left = hooks.select("u", F.col("to").alias("ru"))
        right = hooks.select(F.col("u").alias("v"), F.col("to").alias("rv"))
        ends = edges.join(left, "u", "left").join(right, "v", "left").select(F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b"))
        edges = settle(ends.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    raise RuntimeError("the component search did not settle")


def groups(rows: DataFrame, id_column: str, ties: Sequence[Sequence[str]]) -> DataFrame:
    """(row_id, group_id) of every distinct row; a row tied to none is its own group."""
    roots = components(star_edges(rows, id_column, ties)).select(F.col("node").alias("row_id"), F.col("root").alias("group_id"))
    ids = rows.select(F.col(id_column).cast("long").alias("row_id")).dropna().distinct()
    return ids.join(roots, "row_id", "left").select("row_id", F.coalesce("group_id", "row_id").alias("group_id"))


def nearest_subset(sizes: dict[int, int], target: int, cells: int = CELLS) -> dict[int, int]:
    """How many groups of each size to take so that the total comes nearest ``target`` (the smaller total on a tie)."""
    if target <= 0 or not sizes:
        return {}
    total = sum(s * n for s, n in sizes.items())
    limit = min(total, target + max(sizes))
    cell = -(-(limit + 1) // cells)
    chosen = _subset({s: n for s, n in sizes.items() if s >= cell}, target, limit, cell)
    if cell == 1:
        return chosen
    gap = target - sum(s * n for s, n in chosen.items())
    for size in sorted(chosen, reverse=True):  # whole cells were counted, so the total may lie above
        back = min(chosen[size], -(-max(-gap, 0) // size))
        if back and abs(gap + back * size) <= abs(gap):
            chosen[size] -= back
            gap += back * size
    for size in sorted(sizes, reverse=True):
        more = min(sizes[size] - chosen.get(size, 0), max(gap, 0) // size)
        if more:
            chosen[size] = chosen.get(size, 0) + more
            gap -= more * size
    return {s: n for s, n in chosen.items() if n}


def _subset(sizes: dict[int, int], target: int, limit: int, cell: int) -> dict[int, int]:
    top, goal = limit // cell, target / cell
    reached_by = np.full(top + 1, -1, dtype=np.int32)
    items: list[tuple[int, int]] = []  # (size, how many)
    bits, mask = 1, (1 << (top + 1)) - 1
    for size in sorted(sizes, reverse=True):
        count, step = sizes[size], 1
        while count > 0:
            take = min(step, count)
            count, step = count - take, step * 2
            fresh = (bits << (size * take // cell)) & mask & ~bits
            if fresh:
                raw = np.frombuffer(fresh.to_bytes(top // 8 + 1, "little"), dtype=np.uint8)
                reached_by[np.flatnonzero(np.unpackbits(raw, bitorder="little", count=top + 1))] = len(items)
                bits |= fresh
            items.append((size, take))
    sums = np.r_[0, np.flatnonzero(reached_by >= 0)]
    best = int(sums[np.lexsort((sums, np.abs(sums - goal)))[0]])
    chosen: dict[int, int] = {}
    while best:
        size, take = items[reached_by[best]]
        chosen[size] = chosen.get(size, 0) + take
        best -= size * take // cell
    return chosen


def plan_splits(sizes: dict[int, int], shares: Sequence[tuple[str, float]]) -> dict[tuple[int, str], int]:
    """(size, split) -> groups: the smallest share is filled first, the largest takes what is left."""
    total = sum(s * n for s, n in sizes.items())
    whole = sum(share for _, share in shares) or 1.0
    rest = dict(sizes)
    plan: dict[tuple[int, str], int] = {}
    ordered = sorted(shares, key=lambda x: (x[1], x[0]))
    for name, share in ordered[:-1]:
        for size, n in nearest_subset({s: n for s, n in rest.items() if n}, round(total * share / whole)).items():
            plan[(size, name)] = n
            rest[size] -= n
    for size, n in rest.items():
        if n:
            plan[(size, ordered[-1][0])] = n
    return plan


def assign_splits(grouped: DataFrame, targets: DataFrame) -> DataFrame:
    """(row_id, group_id, split_name) for the rows of ``groups`` and the shares of ``targets``."""
    spark = grouped.sparkSession
    shares = [(r[0], float(r[1])) for r in targets.select("split_name", "share").dropna().distinct().collect()]  # a handful of names
    sized = settle(grouped.groupBy("group_id").agg(F.count("*").alias("size")))
    histogram = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most sqrt(2 * rows) sizes
    if not histogram or not shares:
        return grouped.limit(0).withColumn("split_name", F.lit(None).cast("string"))
    plan = plan_splits(histogram, shares)
    order = sorted(name for name, _ in shares)
    ranges, start = [], {}
    for size, name in sorted(plan, key=lambda k: (k[0], order.index(k[1]))):
        low = start.get(size, 0)
        start[size] = low + plan[(size, name)]
        ranges.append((size, low, start[size], name))
    bounds = spark.createDataFrame(ranges, "size long, low long, high long, split_name string")
    # rank inside a size: position in a block of the hash, plus the groups of the blocks before it
    blocks = max(1, -(-sum(histogram.values()) // BLOCK))
    hashed = sized.withColumn("h", F.xxhash64("group_id")).withColumn("block", F.pmod("h", F.lit(blocks)))
    counts = hashed.groupBy("size", "block").agg(F.count("*").alias("n"))
    before = counts.select("size", "block", (F.sum("n").over(Window.partitionBy("size").orderBy("block")) - F.col("n")).alias("before"))
    ranked = hashed.withColumn("at", F.row_number().over(Window.partitionBy("size", "block").orderBy("h", "group_id")) - 1)
    placed = (
        ranked.join(before, ["size", "block"]).withColumn("rank", F.col("at") + F.col("before"))
        .join(bounded(bounds, SMALL), "size").filter("rank >= low and rank < high").select("group_id", "split_name")
    )
    return grouped.join(placed, "group_id").select("row_id", "group_id", "split_name")
