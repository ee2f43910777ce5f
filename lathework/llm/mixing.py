"""Drawing sources at target shares of all tokens (problem 9).

Rates are found by entropy balancing: among all document rates that meet each source's
token target, those closest in relative entropy to one copy of everything have the form
``r = min(R, exp(lambda_s * t / tau_s))`` with t the document's tokens, tau_s the mean of
its source and R the source's repeat limit. The dual in the lambdas is convex; Newton steps
on it (halved where they overshoot) need only a few sums per source, which one aggregation
over the documents gives. The drawn total is the largest that no source's limit forbids, so
the scarcest source is used to its limit and the others are thinned or repeated to match.

Rates become copies by ``floor(rate + u + shift_s)`` with u a hash of the document's id;
the shift of a source is the one of a grid, refined twice, whose copies come nearest the
source's token target.

Defined results: sources are compared trimmed and in lower case; documents of no listed
source, without tokens, or without id are not drawn; of a repeated id one row counts;
listed sources without documents are reported with share 0 and do not limit the total;
``max_repeats`` below 1 or null draws nothing from the source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.llm import tokens
from lathework.runtime import settle

STEPS = 60
TOLERANCE = 1e-6
GRID = 32


def named(column: str) -> Column:
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def _pick(values: dict[str, float], default: float = 0.0) -> Column:
    """A per-source constant as an expression; the sources are those of the fixed target table."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(default)) if pairs else F.lit(default)


def drawn(documents: DataFrame, targets: DataFrame, vocabulary: str = tokens.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, rate, copies) of every document of a listed source, and the report per source."""
    spark = documents.sparkSession
    wanted = {
        r["source"]: (r["share"], r["repeats"])
        for r in targets.select(named("source").alias("source"), "target_share", "max_repeats").dropna(subset=["source"])
        .groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()
    }  # a fixed table of few rows
    base = documents.select("doc_id", named("source").alias("source"), "text").filter(F.col("source").isin(list(wanted)) & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sized = settle(
        tokens.sizes(base, "doc_id", "text", ["source"], vocabulary).filter("n_tokens > 0").groupBy("doc_id").agg(F.min_by(F.struct("source", "n_tokens"), F.struct("source", "n_tokens")).alias("r"))
        .select("doc_id", "r.source", "r.n_tokens")
    )
    have = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    live = {s: (float(share or 0), int(rep or 0)) for s, (share, rep) in wanted.items() if s in have and (share or 0) > 0 and (rep or 0) >= 1}
    whole = sum(share for share, _ in live.values())
    goal: dict[str, float] = {}
    if live:
        total = min(rep * have[s][0] * whole / share for s, (share, rep) in live.items())
        goal = {s: total * share / whole for s, (share, _) in live.items()}
    repeats = {s: rep for s, (_, rep) in live.items()}
    tau = {s: have[s][0] / have[s][1] for s in live}
    full = {s for s in live if goal[s] >= repeats[s] * have[s][0] * (1 - 1e-9)}  # used to the limit, no tilt to find

    lam = {s: 0.0 for s in live}
    x = F.col("n_tokens") / _pick(tau, 1.0)

    def rate(of: dict[str, float]) -> Column:
        tilted = F.least(_pick(repeats), F.exp(F.least(F.lit(50.0), _pick(of) * x)))
        return F.when(F.col("source").isin(list(full)), _pick(repeats)).when(F.col("source").isin(list(live)), tilted).otherwise(0.0)

    def sums(of: dict[str, float]) -> dict[str, tuple[float, float]]:
        r = rate(of)
        slope = F.when(r < _pick(repeats) - 1e-12, r * F.col("n_tokens") * x).otherwise(0.0)
        # a source held at its limit has no slope from above; its way back down is the slope at the limit
        back = F.when(r >= _pick(repeats) - 1e-12, r * F.col("n_tokens") * x).otherwise(0.0)
        return {q["source"]: (q["g"], q["h"] or q["b"]) for q in sized.groupBy("source").agg(F.sum(r * F.col("n_tokens")).alias("g"), F.sum(slope).alias("h"), F.sum(back).alias("b")).collect()}

    brackets = {s: [-math.inf, math.inf] for s in live}
    open_ = [s for s in live if s not in full]
    for _ in range(STEPS if open_ else 0):
        now = sums(lam)
        open_ = [s for s in open_ if abs(now[s][0] - goal[s]) > TOLERANCE * goal[s]]
        if not open_:
            break
        for s in open_:
            gap = now[s][0] - goal[s]
            brackets[s][1 if gap > 0 else 0] = lam[s]
            step = lam[s] - gap / now[s][1] if now[s][1] else lam[s] - math.copysign(1.0, gap)
            low, high = brackets[s]
            if not low < step < high:  # overshoot: halve the bracket instead
                step = (low + high) / 2 if math.isfinite(low) and math.isfinite(high) else (lam[s] - math.copysign(max(1.0, abs(lam[s])), gap))
            lam[s] = step

    rated = settle(sized.withColumn("rate", rate(lam)).withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(1 << 40)) / F.lit(float(1 << 40))).withColumn("limit", _pick(repeats)))

    def copies(shift: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.col("limit"), F.floor(F.col("rate") + F.col("u") + shift - 1e-12)))

    shift, width = {s: 0.0 for s in live}, 2.0
    for _ in range(4 if live else 0):
        grid = [(i / GRID - 0.5) * width for i in range(GRID + 1)]
        found = rated.groupBy("source").agg(*[F.sum(copies(_pick(shift) + g) * F.col("n_tokens")).alias(f"g{i}") for i, g in enumerate(grid)]).collect()
        for r in found:
            if (s := r["source"]) in live:
                shift[s] += grid[min(range(len(grid)), key=lambda i: (abs(r[f"g{i}"] - goal[s]), abs(grid[i])))]
        width /= GRID / 2
    result = rated.select("doc_id", "source", "n_tokens", "rate", copies(_pick(shift)).cast("int").alias("copies"))

    target_rows = [(s, float(share) if share is not None else None, int(rep) if rep is not None else None, lam.get(s)) for s, (share, rep) in sorted(wanted.items())]
    target = spark.createDataFrame(target_rows, "source string, target_share double, max_repeats int, tilt double")
    got = result.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.count_if(F.col("copies") > 0).alias("n_drawn"), F.sum("copies").alias("n_copies"),
        F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("n_tokens")).alias("drawn_tokens"),
    )
    all_tokens = got.agg(F.sum("drawn_tokens").alias("all_tokens"))
    report = (
        target.join(got, "source", "left").fillna(0, ["n_documents", "n_drawn", "n_copies", "most_repeats", "drawn_tokens"])
        .join(F.broadcast(all_tokens))  # one row
        .withColumn("actual_share", F.when(F.col("all_tokens") > 0, F.col("drawn_tokens") / F.col("all_tokens")).otherwise(0.0)).drop("all_tokens")
    )
    return result, report
