"""Streams over the append-only logs of a running benchmark; each has a batch twin with the same columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.operators import dedup
from lathework.runtime import shared_path

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def log(df: DataFrame) -> DataFrame:
    """The events table as a job log."""
    return df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_type").alias("status"), "value")


def burn(df: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and value per state in tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    micros = F.round(F.col("value") * 1_000_000).cast("bigint")
    return df.groupBy(w.alias("w"), "status").agg(F.count("*").alias("n"), F.sum(micros).alias("value_micros")).select(F.col("w.start").alias("starts_at"), "status", "n", "value_micros")


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return df.groupBy("job_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("job_id", F.col("s.start").alias("starts_at"), F.col("s.end").alias("ends_at"), "n")


def over_budget(df: DataFrame, limit: float) -> DataFrame:
    """Running totals per job, kept as state: a row for each batch in which a job passes ``limit``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (spent,) = state.get if state.exists else (0.0,)
        before = spent
        for pdf in batches:
            spent += float(pdf["value"].fillna(0).sum())
        state.update((spent,))
        if before <= limit < spent:
            yield pd.DataFrame({"job_id": [key[0]], "spent": [spent]})

    return df.groupBy("job_id").applyInPandasWithState(step, "job_id string, spent double", "spent double", "update", "NoTimeout")


def final_states(df: DataFrame) -> DataFrame:
    """The last state of every job, deliveries of one event within the watermark counted once."""
    once = df.dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("r")).select("job_id", F.col("r.status").alias("status"), F.col("r.event_id").alias("event_id"))


def replay(spark: SparkSession, folder: str, files: str, transform: Callable[[DataFrame], DataFrame], keys: Sequence[str], watermark: str = "2 days") -> DataFrame:
    """Drive the stream of the ``files`` in a folder through ``transform`` to its end, into files of the shared folder.

    Every batch is written under its number (so a batch done again replaces itself), with the
    offsets and the state beside it; of the updates of one key the last batch's counts.
    """
    path = shared_path(spark, "stream")
    stream = log(spark.readStream.schema(EVENTS).option("pathGlobFilter", files).parquet(folder)).withWatermark("ts", watermark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = transform(stream).writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return dedup.last_per(spark.read.parquet(f"{path}/out"), list(keys), ["batch"]).drop("batch")
