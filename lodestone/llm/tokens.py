"""Token counts with public tokenizers.

The vocabulary file is read once on the driver and broadcast (about one megabyte, the
size of the file is checked); every Python worker builds its tokenizer once.
"""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

#: Rank file of a public byte-level vocabulary; a parameter of every operator that counts.
DEFAULT_VOCABULARY = os.environ.get("LODESTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pattern that splits a text before merges are applied (part of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 32_000_000

_encodings: dict[int, object] = {}


def load(spark: SparkSession, vocabulary: str):
    """Broadcast bytes of a rank file; "bytes" stands for one token per UTF-8 byte."""
    if vocabulary == "bytes":
        return None
    size = os.path.getsize(vocabulary)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has {size} bytes, more than a vocabulary may have")
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoding(shared):
    """The worker's tokenizer for broadcast rank bytes."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        _encodings[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def count_tokens(spark: SparkSession, text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Number of tokens of a text column; NULL texts count 0."""
    if vocabulary == "bytes":
        return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    ship(spark)
    shared = load(spark, vocabulary)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(shared)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if isinstance(t, str) else 0).astype("int64")

    return count(text)
