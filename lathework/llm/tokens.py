"""Sizes of texts in tokens of a public tokenizer; the vocabulary file is a parameter, read by the driver only."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(ranks: bytes) -> Any:
    """The tokenizer of a rank file's content, kept for later tasks of the same Python worker."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_by_content", {})
    key = zlib.crc32(ranks)
    if key not in kept:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        kept[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return kept[key]


def sizes(df: DataFrame, id_column: str, text_column: str, keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """id, kept columns and ``n_tokens`` of each text; a null text has none (0), lone surrogates count as replacement characters."""
    keep = keep or []
    types = dict(df.dtypes)
    with open(vocabulary, "rb") as f:
        given = df.sparkSession.sparkContext.broadcast(f.read())  # a rank file of fixed size; executors need not have it

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoding(given.value)
        for pdf in batches:
            out = pdf.drop(columns=["text_"])
            out["n_tokens"] = [len(bpe.encode_ordinary(t)) if t else 0 for t in pdf["text_"]]
            yield out

    schema = ", ".join([f"`{c}` {types[c]}" for c in [id_column, *keep]]) + ", n_tokens long"
    return df.select(id_column, *keep, F.col(text_column).alias("text_")).mapInPandas(measure, schema)
