"""Commit texts joined with the issues and pull requests they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def looked_up(commits: DataFrame, cache: DataFrame, id_column: str, repo: str, refs: str, kind: str) -> DataFrame:
    """(id, pos, ref, title, body) of every reference of ``kind``, in order; a reference that the cache hasn't, or has as missing, has no title."""
    each = commits.select(id_column, F.lower(F.trim(repo)).alias("repo"), F.posexplode(refs).alias("pos", "ref"))
    known = cache.filter((F.col("kind") == kind) & (F.col("status") == "ok")).select("repo", F.col("number").alias("ref"), "title", "body")
    return each.join(known, ["repo", "ref"], "left").select(id_column, "pos", "ref", "title", "body")


def first_titled(found: DataFrame, id_column: str) -> DataFrame:
    """Per commit: its references in order, and of the first with a title the reference, title and body."""
    titled = F.coalesce(F.col("title"), F.lit("")) != ""
    return found.groupBy(id_column).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]), ",").alias("refs"),  # the references in one text
        F.min(F.when(titled, F.struct("pos", "ref", "title", F.coalesce("body", F.lit("")).alias("body")))).alias("_f"),
    ).select(id_column, "refs", F.col("_f.ref").alias("ref"), F.col("_f.title").alias("title"), F.col("_f.body").alias("body"))


def merged_contexts(contexts: DataFrame, id_column: str, pos: str = "pos") -> DataFrame:
    """Contexts of one record under one key (reference, else title, else body, else address): of each field the first that is filled, in order of the keys' first places."""
    fields = ("ref", "title", "body", "url")
    key = F.coalesce(*[F.nullif(F.trim(F.coalesce(F.col(f), F.lit(""))), F.lit("")) for f in fields])
    keyed = contexts.withColumn("_key", key).filter("_key is not null")
    first = lambda f: F.min_by(F.when(F.coalesce(F.trim(f), F.lit("")) != "", F.trim(f)), F.when(F.coalesce(F.trim(f), F.lit("")) != "", F.col(pos)))
    return keyed.groupBy(id_column, "_key").agg(F.min(pos).alias("first_pos"), *[first(f).alias(f) for f in fields]).drop("_key")


def named_in(texts: DataFrame, id_column: str, column: str, known: DataFrame, key: str, pattern: str = r"\b[A-Za-z0-9_]+-[A-Za-z0-9]+\b") -> DataFrame:
    """(id, key) of the tokens of a text that ``known`` has."""
    tokens = texts.select(id_column, F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(pattern), 0))).alias(key))
    return tokens.join(known.select(key).distinct(), key, "left_semi").select(id_column, key)
