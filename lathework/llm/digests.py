"""Percentiles of very large columns through mergeable centroid digests (problem 2).

A digest is a list of (mean, weight) centroids in value order. Sorted values are clustered
by the scale ``k(q) = delta / (2 pi) * asin(2 q - 1)``: values whose mid-rank falls into the
same unit of k become one centroid, so clusters are narrow at both tails. Digests of other
partitions, days or solvers merge by putting their centroids together and clustering again.

``digests`` makes one digest per key of what each task holds and merges them by key, so a
hot key is condensed before the shuffle, and the merging task clusters as it reads.
``certify`` counts, in a second pass over the data, how many values lie below and at each
estimate: the certified rank error is the distance of
the asked quantile from the ranks that the estimate really holds.

Defined results: null and NaN values are left out; infinities take part as extremes; a key
whose values are all missing gives no digest; ties collapse into their centroids; repeated
attempts count once, with the delivery ingested last; a null key is a key of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.runtime import bounded, settle

DELTA = 200.0
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
FLUSH_ROWS = 400_000
#: Digests of one key that a merging task holds before it clusters them.
HELD = 1_024
#: Keys whose cut points (a few hundred bytes each) are broadcast; those of more keys are joined.
FEW_KEYS = 50_000

DIGEST_TYPE = "metric string, n double, low double, high double, means array<double>, weights array<double>"


def cluster(group: np.ndarray, value: np.ndarray, weight: np.ndarray, delta: float = DELTA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster the values of many groups at once: (group, mean, weight), sorted by group and mean."""
    if not len(value):
        return group, value, weight
    order = np.lexsort((value, group))
    group, value, weight = group[order], value[order], weight[order]
    first = np.r_[True, group[1:] != group[:-1]]
    starts = np.flatnonzero(first)
    of = np.cumsum(first) - 1
    running = np.cumsum(weight)
    base = (running[starts] - weight[starts])[of]
    total = np.add.reduceat(weight, starts)[of]
    mid = np.clip((running - base - weight / 2) / total, 0.0, 1.0)
    unit = np.floor(delta / (2 * np.pi) * np.arcsin(2 * mid - 1))
    heads = np.flatnonzero(first | np.r_[True, unit[1:] != unit[:-1]])
    w = np.add.reduceat(weight, heads)
    with np.errstate(invalid="ignore"):
        mean = np.add.reduceat(value * weight, heads) / w
    edge = ~np.isfinite(mean)
    mean[edge] = value[heads][edge]
    return group[heads], np.maximum.accumulate(mean) if len(starts) == 1 else mean, w


def estimate(means: np.ndarray, weights: np.ndarray, low: float, high: float, quantiles: Sequence[float]) -> np.ndarray:
    """Quantiles by interpolation between centroid mid-ranks, held inside [low, high]."""
    n = weights.sum()
    mids = np.cumsum(weights) - weights / 2
    xs, ys = np.r_[0.0, mids, n], np.r_[low, means, high]
    with np.errstate(invalid="ignore"):
        found = np.interp(np.asarray(quantiles) * n, xs, ys)
    # where a neighbour is infinite, take the nearest centroid instead of interpolating
    bad = ~np.isfinite(found)
    if bad.any():
        at = np.searchsorted(np.cumsum(weights), np.asarray(quantiles)[bad] * n).clip(0, len(means) - 1)
        found[bad] = means[at]
    return found


def latest(rows: DataFrame, id_column: str, ingested: str, columns: Sequence[str]) -> DataFrame:
    """One row an id, the delivery ingested last; a hash breaks remaining ties. Rows without id all count."""
    packed = F.struct(*columns)
    named = rows.filter(F.col(id_column).isNotNull())
    kept = named.groupBy(id_column).agg(F.max_by(packed, F.struct(F.col(ingested), F.xxhash64(*columns))).alias("r")).select("r.*")
    return kept.unionByName(rows.filter(F.col(id_column).isNull()).select(*columns))


def _rows(keys: pd.DataFrame, metric: str, code: np.ndarray, mean: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray) -> pd.DataFrame:
    heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    ends = np.r_[heads[1:], len(code)]
    out = keys.iloc[code[heads]].reset_index(drop=True)
    out["metric"] = metric
    out["n"] = np.add.reduceat(weight, heads)
    out["low"], out["high"] = low[code[heads]], high[code[heads]]
    out["means"] = [mean[a:b] for a, b in zip(heads, ends)]
    out["weights"] = [weight[a:b] for a, b in zip(heads, ends)]
    return out


def _condense(pdf: pd.DataFrame, keys: list[str], metrics: list[str], delta: float) -> Iterator[pd.DataFrame]:
    code, uniques = pd.factorize(pd.MultiIndex.from_frame(pdf[keys].astype(object).where(pdf[keys].notna(), None)), use_na_sentinel=False)
    names = pd.DataFrame(uniques.tolist(), columns=keys)
    for metric in metrics:
        value = pdf[metric].to_numpy(dtype=float, na_value=np.nan)
        real = ~np.isnan(value)
        if not real.any():
            continue
        c, v = code[real], value[real]
        low, high = np.full(len(names), np.inf), np.full(len(names), -np.inf)
        np.minimum.at(low, c, v)
        np.maximum.at(high, c, v)
        yield _rows(names, metric, *cluster(c, v, np.ones(len(v)), delta), low, high)


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def digests(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], delta: float = DELTA) -> DataFrame:
    """One digest per key and metric: keys, metric, n, low, high, means, weights."""
    keys, metrics = list(keys), list(metrics)

    def condense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= FLUSH_ROWS:
                yield from _condense(pd.concat(held, ignore_index=True), keys, metrics, delta)
                held, rows = [], 0
        if rows:
            yield from _condense(pd.concat(held, ignore_index=True), keys, metrics, delta)

    slim = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    parts = slim.mapInPandas(condense, f"{_key_schema(df, keys)}, {DIGEST_TYPE}")
    return merge(parts, keys, delta)


def merge(parts: DataFrame, keys: Sequence[str], delta: float = DELTA) -> DataFrame:
    """Merge digests that agree in ``keys`` (and metric); other columns are dropped.

    The digests of a key follow each other in one task, which clusters them again as they
    come, so it never holds more than one batch and ``HELD`` digests, however many there are.
    """
    keys = list(keys)
    named = [*keys, "metric"]

    def condensed(pdf: pd.DataFrame, code: np.ndarray) -> pd.DataFrame:
        """One row a code; ``code`` counts up from 0."""
        sizes = pdf["means"].map(len).to_numpy()
        c, m, w = cluster(np.repeat(code, sizes), np.concatenate(pdf["means"].tolist()), np.concatenate(pdf["weights"].tolist()), delta)
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        out = pdf[named].iloc[starts].reset_index(drop=True)
        out["n"] = np.add.reduceat(pdf["n"].to_numpy(dtype=float), starts)
        out["low"], out["high"] = np.minimum.reduceat(pdf["low"].to_numpy(), starts), np.maximum.reduceat(pdf["high"].to_numpy(), starts)
        heads = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        ends = np.r_[heads[1:], len(c)]
        out["means"], out["weights"] = [m[a:b] for a, b in zip(heads, ends)], [w[a:b] for a, b in zip(heads, ends)]
        return out

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: pd.DataFrame | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if open_ is None else pd.concat([open_, pdf], ignore_index=True)
            new = np.zeros(len(pdf), dtype=bool)
            for k in named:
                v, null = pdf[k].to_numpy(dtype=object), pdf[k].isna().to_numpy()
                new[1:] |= (null[1:] != null[:-1]) | (~null[1:] & ~null[:-1] & (v[1:] != v[:-1]))
            code = np.cumsum(new)
            last = code == code[-1]
            if (~last).any():
                yield condensed(pdf[~last], code[~last])
            open_ = pdf[last].reset_index(drop=True)
            if len(open_) > HELD:
                open_ = condensed(open_, np.zeros(len(open_), dtype=int))
        if open_ is not None:
            yield condensed(open_, np.zeros(len(open_), dtype=int))

    together = parts.select(*named, "n", "low", "high", "means", "weights").repartition(*named).sortWithinPartitions(*named)
    return together.mapInPandas(again, f"{_key_schema(parts, keys)}, {DIGEST_TYPE}")


def quantiles(found: DataFrame, keys: Sequence[str], asked: Sequence[float] = QUANTILES) -> DataFrame:
    """keys, metric, n, quantile, estimate."""
    keys, asked = list(keys), list(asked)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [
                estimate(np.asarray(m), np.asarray(w), lo, hi, asked) for m, w, lo, hi in zip(pdf["means"], pdf["weights"], pdf["low"], pdf["high"])
            ]
            out = pdf[[*keys, "metric"]].loc[pdf.index.repeat(len(asked))].reset_index(drop=True)
            out["n"] = np.repeat(pdf["n"].to_numpy(), len(asked)).astype("int64")
            out["quantile"] = np.tile(asked, len(pdf))
            out["estimate"] = np.concatenate(values) if values else np.array([])
            yield out

    return found.mapInPandas(read, f"{_key_schema(found, keys)}, metric string, n long, quantile double, estimate double")


def certify(df: DataFrame, levels: Sequence[tuple[DataFrame, Sequence[str]]], metrics: Sequence[str]) -> list[DataFrame]:
    """Add the certified rank error to the estimates of each level: one counting pass of all values against all of them.

    A level is its estimates and their keys; the first has the finest keys, of which those of
    the others are parts. Every key's estimates travel as one array of cut points a metric and
    level; each value adds one to the slot between the cuts it falls into, so the pass
    aggregates before it shuffles. The cuts are broadcast where they are few.
    """
    metrics, finest = list(metrics), list(levels[0][1])

    def same(left: str, right: str, keys: Sequence[str]) -> list[Column]:
        return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]

    cuts = None
    for i, (estimates, keys) in enumerate(levels):
        own = estimates.groupBy(*keys).agg(*[F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("metric") == m, F.col("estimate"))))).alias(f"cuts_{i}_{m}") for m in metrics])  # a few quantiles a key
        if cuts is None:
            cuts = own
        else:
            cuts = cuts.alias("a").join(own.alias("b"), same("a", "b", keys), "left").select("a.*", *[f"b.cuts_{i}_{m}" for m in metrics])
    cuts = bounded(settle(cuts), FEW_KEYS)
    rows = df.select(*finest, *[F.col(m).cast("double").alias(m) for m in metrics]).alias("d").join(cuts.alias("c"), same("d", "c", finest))

    def slot(i: int, m: str) -> Column:
        passed = F.aggregate(f"cuts_{i}_{m}", F.lit(0), lambda a, c: a + F.when(F.col(m) > c, 2).when(F.col(m) == c, 1).otherwise(0))
        return F.struct(F.lit(i).alias("level"), F.lit(m).alias("metric"), F.when(F.col(m).isNotNull() & ~F.isnan(m), passed).alias("slot"))

    each = F.explode(F.array(*[slot(i, m) for i in range(len(levels)) for m in metrics])).alias("s")
    counted = settle(
        rows.select(*[F.col(f"d.{k}").alias(k) for k in finest], each).select(*finest, "s.*").filter("slot is not null")
        .groupBy(*finest, "level", "metric", "slot").agg(F.count("*").alias("rows"))
    )
    at = F.array_position("cuts", F.col("estimate")).cast("int")
    below = F.aggregate("slots", F.lit(0).cast("long"), lambda a, s: a + F.when(s["slot"] < 2 * at - 1, s["rows"]).otherwise(0))
    upto = F.aggregate("slots", F.lit(0).cast("long"), lambda a, s: a + F.when(s["slot"] < 2 * at, s["rows"]).otherwise(0))
    out = []
    for i, (estimates, keys) in enumerate(levels):
        named = [*keys, "metric"]
        slots = counted.filter(F.col("level") == i).groupBy(*named, "slot").agg(F.sum("rows").alias("rows")).groupBy(*named).agg(F.collect_list(F.struct("slot", "rows")).alias("slots"))  # two more than twice the quantiles
        told = estimates.groupBy(*named).agg(F.collect_list(F.struct("n", "quantile", "estimate")).alias("asked"), F.array_sort(F.array_distinct(F.collect_list("estimate"))).alias("cuts"))
        both = told.alias("e").join(slots.alias("x"), same("e", "x", named)).select("e.*", "slots").select(*named, "cuts", "slots", F.explode("asked").alias("q")).select(*named, "cuts", "slots", "q.*")
        out.append(
            both.withColumn("below", below).withColumn("upto", upto).select(*named, "n", "quantile", "estimate", "below", "upto")
            .withColumn("rank_error", F.greatest(F.lit(0.0), F.col("below") / F.col("n") - F.col("quantile"), F.col("quantile") - F.col("upto") / F.col("n")))
        )
    return out


def rank_bound(quantile: str = "quantile", n: str = "n", delta: float = DELTA, merges: int = 2):
    """The stated bound on the rank error at a quantile: the widest cluster the scale allows there, once per merge, plus one value."""
    q = F.col(quantile)
    return F.lit(merges * 2 * np.pi / delta) * F.sqrt(q * (1 - q)) + F.lit((np.pi / delta) ** 2 * merges) + 1 / F.col(n)
