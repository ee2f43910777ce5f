"""Job plans, retries, batches and the state log of jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.operators import dedup


def expand_seeds(base: int, repeats: int, explicit: Sequence[int] | None = None) -> list[int]:
    return list(explicit) if explicit else [base + i for i in range(repeats)]


def job_plan(instances: DataFrame, solvers: DataFrame, seeds: Sequence[int], run: str = "run") -> DataFrame:
    """Every instance with every solver and seed; solvers and seeds are arrays on each row, not a join."""
    listed = solvers.agg(F.array_sort(F.collect_set(F.struct("solver_id", "provider"))).alias("s"))  # a fixed table of solvers
    ids = instances.select("instance_id").filter("instance_id is not null and instance_id <> ''").distinct()
    wide = ids.join(F.broadcast(listed)).select("instance_id", F.explode("s").alias("s"), F.lit(list(seeds)).alias("seeds")).select("instance_id", "s.*", F.explode("seeds").alias("seed"))
    return wide.withColumn("job_id", F.concat_ws(":", F.lit(run), "instance_id", "solver_id", F.col("seed").cast("string")))


def filtered_ids(ids: DataFrame, key: str, order: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Include and exclude lists, then the first of each id in input order."""
    if include is not None:
        ids = ids.join(include.select(key), key, "left_semi")
    if exclude is not None:
        ids = ids.join(exclude.select(key), key, "left_anti")
    return dedup.first_per(ids, [key], [order])


def final_states(log: DataFrame, key: str = "job_id", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    return dedup.last_per(log, [key], order)


def transitions(log: DataFrame, key: str = "job_id", order: Sequence[str] = ("ts", "event_id"), state: str = "status") -> DataFrame:
    """How often each state follows each other within a job."""
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("before", F.lag(state).over(w)).filter("before is not null").groupBy("before", F.col(state).alias("after")).agg(F.count("*").alias("n"))


def retry_keys(finals: DataFrame, failed_states: Sequence[str], unresolved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that ended in a failed state, and keys whose verdict is unresolved."""
    failed = finals.filter(F.col("attempt_state").isin(*failed_states)).select(*keys)
    tried = finals.select(*keys).join(unresolved.select(*keys), list(keys), "left_semi")
    return failed.unionByName(tried).distinct()


def batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Fixed-size chunks inside each batch key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("batch_no", F.floor(at / size).cast("int"))


def merged_runs(runs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union in run order; a later run's row replaces an earlier one's."""
    union = None
    for number, run in enumerate(runs):
        one = run.withColumn("_run", F.lit(number))
        union = one if union is None else union.unionByName(one, allowMissingColumns=True)
    return dedup.last_per(union, keys, ["_run"]).drop("_run")


def seeded_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A fixed shuffle: rows in the order of a hash of seed and key."""
    return df.withColumn("_at", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key)), 256)).orderBy("_at", key).drop("_at")


def family(name: Column | str) -> Column:
    """The base run's name of a retry's name."""
    base = F.regexp_extract(name, r"^(.+?)-retry(?:-.+)?$", 1)
    return F.when(base == "", F.col(name) if isinstance(name, str) else name).otherwise(base)


def merged_families(rows: DataFrame, run: str, keys: Sequence[str]) -> DataFrame:
    """Rows of retry families merged: the base run first, then by name, and a later row of a key replaces an earlier one."""
    base = family(run)
    named = rows.withColumn("family", base).withColumn("_later", (F.col(run) != base).cast("int"))
    return dedup.last_per(named, ["family", *keys], ["_later", run]).drop("_later")


def complete_families(results: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """The results of the families all of whose runs have results."""
    have = results.select(run).distinct().withColumn("_has", F.lit(True))
    whole = runs.select(run).distinct().join(have, run, "left").groupBy(family(run).alias("family")).agg(F.count_if(F.col("_has").isNull()).alias("_missing")).filter("_missing = 0")
    return results.withColumn("family", family(run)).join(whole.select("family"), "family", "left_semi")


def events_in_window(log: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """How many events of a key lie in the seconds up to each event, itself included."""
    w = Window.partitionBy(key).orderBy(F.col(ts).cast("timestamp").cast("double")).rangeBetween(-seconds, Window.currentRow)
    return log.withColumn("n_window", F.count("*").over(w))
