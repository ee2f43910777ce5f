"""Filling containers of fixed capacity with texts (problem 8).

A text larger than the capacity is divided into full pieces and a rest; nothing else is
divided. Pieces are spread over blocks by a hash of their text's id, each block with about
``WINDOWS`` windows' worth of tokens, so a block fits one task at any scale. A block is packed
by multiway differencing: partial partitions start as one item each, the two with the largest
spread between their fullest and emptiest window are joined with opposing imbalances until one
is left. It starts with the least count of windows that could hold the block. Where windows
exceed the capacity, those that don't are kept and the pieces of the others are differenced
again, over one window more at least, until none is exceeded.

Defined results: null and blank texts without tokens get no container; repeated ids count
once (the largest size); a capacity below 1 or null holds nothing; an empty table gives no
rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm import tokens
from lathework.runtime import settle

#: A block holds about so many windows' worth of tokens, and about so many pieces at most.
WINDOWS, PIECES = 384, 16_384


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp over ``k`` windows: the item numbers of each window, empty windows left out."""
    links: list[tuple[int, ...]] = [(i,) for i in range(len(sizes))]  # a slot: one item, or two slots joined
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            sums, ids = np.concatenate([a, b]), np.concatenate([ia, ib])
        else:  # the fullest windows of one meet the emptiest of the other; both are sorted downwards
            low, high = a[len(a) - over :], b[len(b) - over :][::-1]
            first = len(links)
            links += list(zip(ia[len(a) - over :].tolist(), ib[len(b) - over :][::-1].tolist()))
            sums = np.concatenate([a[: len(a) - over], b[: len(b) - over], low + high])
            ids = np.concatenate([ia[: len(a) - over], ib[: len(b) - over], np.arange(first, first + over)])
        order = np.argsort(-sums, kind="stable")
        sums, ids = sums[order], ids[order]
        spread = sums[0] - (sums[-1] if len(sums) == k else 0)
        heapq.heappush(heap, (-int(spread), tick, sums, ids))
        tick += 1
    out = []
    for slot in heap[0][3].tolist():
        todo, items = [slot], []
        while todo:
            link = links[todo.pop()]
            items.append(link[0]) if len(link) == 1 else todo.extend(link)
        out.append(items)
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers, none beyond ``capacity``; every size is at most the capacity."""
    done: list[list[int]] = []
    pool, least = list(range(len(sizes))), 1
    while pool:
        held = [sizes[i] for i in pool]
        windows = [[pool[j] for j in w] for w in differencing(held, max(least, -(-sum(held) // capacity)))]
        over = [w for w in windows if sum(sizes[i] for i in w) > capacity]
        done += [w for w in windows if sum(sizes[i] for i in w) <= capacity]
        pool, least = [i for w in over for i in w], len(over) + 1
    return done


def containers_of(documents: DataFrame, containers: DataFrame, vocabulary: str = tokens.VOCABULARY, windows: int = WINDOWS) -> DataFrame:
    """(container_name, doc_id, piece_no, n_tokens, container_id): where each piece of each text goes."""
    kinds = [(r[0], int(r[1])) for r in containers.dropna().filter("capacity_tokens >= 1").select("container_name", "capacity_tokens").distinct().collect()]  # a fixed table of few rows
    sized = settle(
        tokens.sizes(documents.filter("doc_id is not null and text is not null"), "doc_id", "text", vocabulary=vocabulary)
        .groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")).filter("n_tokens > 0")
    )
    schema = "container_name string, doc_id long, piece_no int, n_tokens long, container_id string"
    if not kinds:
        return documents.sparkSession.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("container_name"), F.lit(c).cast("long").alias("capacity")) for n, c in kinds])).alias("c")
    wanted = sized.select("doc_id", "n_tokens", each).select("doc_id", "n_tokens", "c.*")
    whole = (
        wanted.filter("n_tokens >= capacity")
        .select("container_name", "doc_id", F.explode(F.sequence(F.lit(0), (F.floor(F.col("n_tokens") / F.col("capacity")) - 1).cast("int"))).alias("piece_no"), F.col("capacity").alias("n_tokens"))
        .withColumn("container_id", F.concat_ws("-", F.lit("full"), "doc_id", "piece_no"))
    )
    left = sized.agg(*[x for i, (_, c) in enumerate(kinds) for x in (F.sum(F.col("n_tokens") % c).alias(f"t{i}"), F.count_if(F.col("n_tokens") % c > 0).alias(f"n{i}"))]).first()  # one row
    blocks = F.lit(1)
    for i, (name, c) in enumerate(kinds):
        n = max(1, -(-(left[f"t{i}"] or 0) // (windows * c)), -(-left[f"n{i}"] // PIECES))
        blocks = F.when((F.col("container_name") == name) & (F.col("capacity") == c), n).otherwise(blocks)
    rest = (
        wanted.withColumn("piece_no", F.floor(F.col("n_tokens") / F.col("capacity")).cast("int"))
        .withColumn("n_tokens", F.col("n_tokens") % F.col("capacity")).filter("n_tokens > 0")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks))
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        container = np.empty(len(pdf), dtype=object)
        for number, items in enumerate(pack(pdf["n_tokens"].tolist(), int(pdf["capacity"].iloc[0]))):
            container[items] = f"{pdf['block'].iloc[0]}-{number}"
        pdf["container_id"] = container
        return pdf[["container_name", "doc_id", "piece_no", "n_tokens", "container_id"]]

    packed = rest.groupBy("container_name", "capacity", "block").applyInPandas(fill, schema)
    return whole.select("container_name", "doc_id", "piece_no", "n_tokens", "container_id").unionByName(packed)


def fill_report(placed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind of container: containers used, tokens, the least number that could hold them, and the fill."""
    used = placed.groupBy("container_name").agg(
        F.countDistinct("container_id").alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens")
    )
    return used.join(containers.dropna().distinct(), "container_name").select(
        "container_name", "capacity_tokens", "n_containers", "n_pieces", "n_tokens",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"),
    )
