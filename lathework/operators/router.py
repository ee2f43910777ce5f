"""Offline routing between solvers: roll-ups, policies, a stratified split and a small decision tree."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.operators.metrics import ceil_rank


def solver_rollup(joined: DataFrame) -> DataFrame:
    """One row a (solver, instance): sums, the first attempt, and whether the last one resolved it."""
    by = F.struct("attempt_index", F.coalesce("ended_at", F.col("started_at")), "attempt_id")
    return joined.filter("solver_id is not null and instance_id is not null").groupBy("solver_id", "instance_id").agg(
        F.count("*").alias("n_attempts"), F.coalesce(F.sum("cost_micros"), F.lit(0)).alias("cost_micros"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"),
        F.min_by("attempt_id", by).alias("first_attempt"), F.max_by("attempt_id", by).alias("last_attempt"), F.max_by("resolved", by).alias("resolved"),
        F.max_by("harness_outcome", by).alias("harness_outcome"),
    )


def solver_ranking(rollup: DataFrame) -> DataFrame:
    """Mean cost and duration a solver; the head is the cheap one, the tail the expensive one."""
    means = rollup.groupBy("solver_id").agg(F.count("*").alias("n_instances"), (F.sum("cost_micros") / F.count("*")).alias("mean_cost"), (F.sum("duration_ms") / F.count("*")).alias("mean_duration"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("mean_cost", "mean_duration", "solver_id")))


def routing_rows(rollup: DataFrame, ranking: DataFrame) -> DataFrame:
    """One row an instance: the cheap and the expensive choice, the oracle, four policies and the label.

    Where the solver of a role did not try the instance, the first (cheap) or the last
    (expensive) solver that did stands in.
    """
    roles = ranking.agg(F.min_by("solver_id", "rank").alias("cheap_id"), F.max_by("solver_id", "rank").alias("dear_id"))
    row = F.struct("solver_id", "cost_micros", "duration_ms", "resolved", "harness_outcome")
    per = rollup.join(F.broadcast(roles)).groupBy("instance_id").agg(  # one row
        F.count("*").alias("n_solvers"),
        F.min_by(row, F.struct(F.col("solver_id") != F.col("cheap_id"), "solver_id")).alias("cheap"),
        F.max_by(row, F.struct(F.col("solver_id") == F.col("dear_id"), "solver_id")).alias("dear"),
        F.min(F.when(F.col("resolved"), F.struct("cost_micros", "duration_ms", "solver_id"))).alias("oracle"),
    )
    cheap, dear = F.col("cheap"), F.col("dear")
    signal = ~cheap["resolved"] & cheap["harness_outcome"].rlike("(?i)invalid.?patch|timed.?out|timeout|no.progress|budget.exceeded")
    def policy(name: str, escalated: Column, start: Column) -> list[Column]:
        return [
            (start["resolved"] | (escalated & dear["resolved"])).alias(f"{name}_resolved"),
            (start["cost_micros"] + F.when(escalated, dear["cost_micros"]).otherwise(0)).alias(f"{name}_cost"),
            (start["duration_ms"] + F.when(escalated, dear["duration_ms"]).otherwise(0)).alias(f"{name}_latency"), escalated.alias(f"{name}_escalated"),
        ]
    no = F.lit(False)
    return per.select(
        "instance_id", "n_solvers", cheap["solver_id"].alias("cheap_solver"), dear["solver_id"].alias("dear_solver"), F.col("oracle.solver_id").alias("oracle_solver"), F.col("oracle.cost_micros").alias("oracle_cost"),
        *policy("cheap", no, cheap), *policy("dear", no, dear), *policy("failure", ~cheap["resolved"], cheap), *policy("signal", signal, cheap),
        F.when(cheap["resolved"], "cheap_is_enough").when(dear["resolved"], "needs_expensive").otherwise("likely_unsolved").alias("label"),
    )


POLICIES = ("cheap", "dear", "failure", "signal")


def with_learned(rows: DataFrame) -> DataFrame:
    """The learned policy's columns: the dear solver where its label is predicted, else the cheap one."""
    dear = F.col("predicted") == "needs_expensive"
    pick = lambda c: F.when(dear, F.col(f"dear_{c}")).otherwise(F.col(f"cheap_{c}")).alias(f"learned_{c}")
    return rows.select("*", pick("resolved"), pick("cost"), pick("latency"), dear.alias("learned_escalated"))


def evaluation_rows(rows: DataFrame, split: str) -> DataFrame:
    """The test rows, else the validation rows, else the training rows."""
    for name in ("test", "validation"):
        held = rows.filter(F.col(split) == name)
        if not held.isEmpty():
            return held
    return rows


def policy_summary(rows: DataFrame, policies: Sequence[str] = ("cheap", "dear", "failure", "signal")) -> DataFrame:
    """The policies side by side: rates, means, 95th percentile of latency and regret against the oracle."""
    long = rows.select("oracle_cost", F.explode(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.col(f"{p}_resolved").alias("resolved"), F.col(f"{p}_cost").alias("cost"), F.col(f"{p}_latency").alias("latency"), F.col(f"{p}_escalated").alias("escalated")) for p in policies
    ])).alias("x")).select("oracle_cost", "x.*")
    base = long.groupBy("policy").agg(
        F.count("*").alias("n"), F.count_if("resolved").alias("n_resolved"), F.count_if("escalated").alias("n_escalated"), (F.sum("cost") / F.count("*")).alias("mean_cost"), (F.sum("latency") / F.count("*")).alias("mean_latency"),
        (F.sum(F.when(F.col("oracle_cost").isNotNull(), F.greatest(F.col("cost") - F.col("oracle_cost"), F.lit(0)))) / F.nullif(F.count("oracle_cost"), F.lit(0))).alias("mean_regret"),
    )
    from lathework.operators.metrics import percentiles

    return base.join(percentiles(long, ["policy"], "latency", {"p95_latency": 95.0}, ceil_rank), "policy", "left")


def stratified_split(rows: DataFrame, key: str, label: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Per label, in the order of a hash of the key: train, validation, test by rounded counts (half to even)."""
    order = F.sha2(F.col(key), 256)
    w = Window.partitionBy(label)
    n, at = F.count("*").over(w), F.row_number().over(w.orderBy(order, key))
    first = F.greatest(F.bround(n * train), F.lit(1))
    second = first + F.bround(n * validation)
    return rows.withColumn("split", F.when(at <= first, "train").when(at <= second, "validation").otherwise("test"))


def gini(rows: DataFrame, label: str) -> DataFrame:
    counted = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counted.agg(F.sum("n").alias("n"), (1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("gini"), F.min_by(label, F.struct(-F.col("n"), label)).alias("majority"))


def best_split(rows: DataFrame, features: Sequence[str], label: str) -> dict[str, Any] | None:
    """The (feature, threshold) of least weighted Gini impurity over all features at once.

    Values and labels are counted, cumulated by a window over distinct values, and every
    midpoint is scored; one row comes back. Ties: the more even split, then the feature's
    name, then the threshold.
    """
    long = rows.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select(F.col(label).alias("label"), "x.*").dropna()
    counted = long.groupBy("feature", "value", "label").agg(F.count("*").alias("n"))
    labels = [r[0] for r in counted.select("label").distinct().orderBy("label").collect()]  # classes
    wide = counted.groupBy("feature", "value").pivot("label", labels).sum("n").fillna(0)
    up = Window.partitionBy("feature").orderBy("value")
    whole = Window.partitionBy("feature")
    left = [F.sum(F.col(f"`{c}`")).over(up) for c in labels]
    total = [F.sum(F.col(f"`{c}`")).over(whole) for c in labels]
    scored = wide.select("feature", "value", F.lead("value").over(up).alias("next"), F.array(*left).alias("l"), F.array(*total).alias("t")).filter("next is not null")
    add = lambda a: F.aggregate(a, F.lit(0).cast("double"), lambda s, x: s + x)
    impurity = lambda a: 1 - F.aggregate(a, F.lit(0).cast("double"), lambda s, x: s + x * x) / (add(a) * add(a))
    r = F.zip_with("t", "l", lambda t, x: t - x)
    n_left, n_right = add(F.col("l")), add(r)
    score = F.round((n_left * impurity(F.col("l")) + n_right * impurity(r)) / (n_left + n_right), 12)
    found = scored.select("feature", ((F.col("value") + F.col("next")) / 2).alias("threshold"), score.alias("impurity"), F.abs(n_left - n_right).alias("uneven")).orderBy("impurity", "uneven", "feature", "threshold").limit(1).collect()
    return found[0].asDict() if found else None


def fit_tree(rows: DataFrame, features: Sequence[str], label: str, depth: int = 3) -> dict[str, Any]:
    """A decision tree by repeated ``best_split``: at most 2^depth passes, one row back from each."""
    top = rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).collect()  # classes
    leaf = {"label": top[0][label] if top else None}
    if depth == 0 or len(top) < 2 or not (cut := best_split(rows, features, label)):
        return leaf
    total = sum(r["n"] for r in top)
    if cut["impurity"] >= 1 - sum((r["n"] / total) ** 2 for r in top) - 1e-12:
        return leaf
    value = F.col(cut["feature"]).cast("double")
    return {**leaf, **cut, "left": fit_tree(rows.filter(value <= cut["threshold"]), features, label, depth - 1), "right": fit_tree(rows.filter(value > cut["threshold"]), features, label, depth - 1)}


def pruned(tree: dict[str, Any], depth: int) -> dict[str, Any]:
    """A fitted tree as it would be with ``depth`` as its greatest depth."""
    if "feature" not in tree or depth == 0:
        return {"label": tree["label"]}
    return {**tree, "left": pruned(tree["left"], depth - 1), "right": pruned(tree["right"], depth - 1)}


def fit_selected(rows: DataFrame, features: Sequence[str], label: str, split: str = "split", max_depth: int = 3) -> tuple[dict[str, Any], int]:
    """The tree and its depth: of 1 to ``max_depth``, the one most accurate on the validation rows (ties: the shallower), refitted on train and validation.

    Without validation rows the training rows decide and nothing is added. The greedy tree
    of a lesser depth is the deepest one pruned, so one fit serves all depths.
    """
    train = rows.filter(F.col(split) == "train")
    validation = rows.filter(F.col(split) == "validation")
    held = not validation.isEmpty()
    deepest = fit_tree(train, features, label, max_depth)
    depths = range(1, max_depth + 1)
    hits = (validation if held else train).agg(*[F.count_if(predicted(pruned(deepest, d)) == F.col(label)).alias(f"d{d}") for d in depths]).first()  # one row
    depth = max(depths, key=lambda d: (hits[f"d{d}"], -d))
    return (fit_tree(train.unionByName(validation), features, label, depth) if held else pruned(deepest, depth)), depth


def predicted(tree: dict[str, Any]) -> Column:
    """A fitted tree as nested CASE expressions, inside generated code."""
    if "feature" not in tree:
        return F.lit(tree["label"])
    return F.when(F.col(tree["feature"]).cast("double") <= tree["threshold"], predicted(tree["left"])).otherwise(predicted(tree["right"]))
