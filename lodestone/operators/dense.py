"""Vector search by exact products, and the hashing embedder.

A batch of queries of checked size is broadcast as one matrix; every Arrow batch of rows
is scored by one matrix product and reduced to its best k per query before anything is
shuffled.  Larger query sets are searched in blocks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import ship, spread

MAX_QUERIES = 4096  # rows of a query block, times at most MAX_DIM numbers
MAX_DIM = 4096
BUCKETS = 64
DIGITS = 12  # scores keep so many decimals: the order of summation moves only later ones


def pinned(queries: DataFrame) -> DataFrame:
    """A batch of queries of checked size as local rows, so that no plan that uses it makes it again."""
    rows = queries.limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries; search in blocks")
    return queries.sparkSession.createDataFrame(rows, queries.schema)


def dense_topk(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding"
) -> DataFrame:
    """(query_id, id, score, rank): the k rows with the largest dot product for every query.

    Rows whose vector is NULL or of another dimension take no part.
    """
    ship(vectors.sparkSession)
    asked = queries.select(F.col(query_id).cast("bigint"), F.col(query_vector).cast("array<double>")).filter(F.col(query_vector).isNotNull()).limit(MAX_QUERIES + 1).collect()
    if len(asked) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries; search in blocks")
    if not asked:
        return vectors.select(F.lit(0).cast("bigint").alias("query_id"), F.col(id_col).cast("bigint"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rank")).filter(F.lit(False))
    dim = len(asked[0][1])
    if dim > MAX_DIM or any(len(r[1]) != dim for r in asked):
        raise ValueError("queries must share one dimension")
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in asked], np.int64), np.array([r[1] for r in asked], np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for b in batches:
            lengths = np.asarray(pc.fill_null(pc.list_value_length(b.column(1)), -1).to_numpy(zero_copy_only=False))
            keep = pa.array(lengths == dim)
            if not (lengths == dim).any():
                continue
            x = np.asarray(b.column(1).filter(keep).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            rows = b.column(0).filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)
            s = np.round(q @ x.T, DIGITS)
            take = min(k, s.shape[1])
            kth = -np.partition(-s, take - 1, axis=1)[:, take - 1] if take < s.shape[1] else np.full(len(ids), -np.inf)
            who, col = np.nonzero(s >= kth[:, None])  # ties at the edge are settled by the final ranking
            yield pa.record_batch([pa.array(ids[who]), pa.array(rows[col]), pa.array(s[who, col])], names=["query_id", "id", "score"])

    partial = vectors.select(F.col(id_col).cast("bigint"), F.col(vector_col)).filter(F.col(vector_col).isNotNull()).mapInArrow(score, "query_id bigint, id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "score", F.col("rank").cast("bigint").alias("rank"))


def dense_topk_blocks(
    vectors: DataFrame, queries: DataFrame, k: int, blocks: int | None = None, id_col: str = "chunk_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding"
) -> DataFrame:
    """``dense_topk`` for any number of queries: a scan of the vectors for every block of them.

    Without ``blocks`` there are so many that a block is half full on average.
    """
    if blocks is None:
        blocks = max(1, math.ceil(queries.count() / (MAX_QUERIES // 2)))
    part = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    return reduce(DataFrame.unionByName, (dense_topk(vectors, queries.filter(part == b), k, id_col, vector_col, query_id, query_vector) for b in range(blocks)))


# ------------------------------------------------------------------ hashing embedder

_RUN = re.compile(r"[A-Za-z0-9_]+")
_PART = re.compile(r"_|(?<=[a-z0-9])(?=[A-Z])")


def _tokens(text: str) -> list[str]:
    out = []
    for raw in _RUN.findall(text):
        whole = raw.lower()
        out.append(whole)
        out += [p for p in (x.lower() for x in _PART.split(raw)) if p and p != whole]
    return out


class _Hasher(dict):
    def __missing__(self, token: str) -> int:
        b = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % BUCKETS
        if len(self) < 1_000_000:
            self[token] = b
        return b


_HASHER = _Hasher()


def _embed_all(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        v = np.zeros(BUCKETS)
        for token in _tokens(t) if isinstance(t, str) else ():
            v[_HASHER[token]] += 1.0
        size = np.sqrt((v * v).sum())
        out.append(v / size if size else v)
    return pd.Series(out)


def hash_embedding(text):
    """Default offline embedder: token counts by hash bucket, unit length; NULL counts as empty."""
    return F.pandas_udf(_embed_all, "array<double>")(text)


def hash_buckets(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, bucket, n): the hashing embedder before its length is normalised, as built-ins only."""
    token = spread(docs.select(id_col, text_col)).select(F.col(id_col), F.explode_outer(T.token_bag(F.col(text_col))).alias("token")).filter(F.col("token").isNotNull())
    return token.groupBy(id_col, _bucket_of("token").alias("bucket")).agg(F.count("*").alias("n"))


def from_postings(ids: DataFrame, postings: DataFrame) -> DataFrame:
    """(id, embedding): the hashing embedder's unit vectors from (id, token, tf), as built-ins only; ids without tokens get zeros."""
    counts = postings.select("id", _bucket_of("token").alias("bucket"), "tf").groupBy("id", "bucket").agg(F.sum("tf").cast("double").alias("n"))
    slots = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    value = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)) / F.coalesce("size", F.lit(1.0)))
    return ids.distinct().join(slots, "id", "left").select("id", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), BUCKETS)).otherwise(value).alias("embedding"))


def _bucket_of(token) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(BUCKETS)).cast("int")


def embed(docs: DataFrame, text_col: str = "text", out_col: str = "embedding", embedder=None) -> DataFrame:
    """All rows with an embedding; ``embedder`` is any function from Column to Column."""
    ship(docs.sparkSession)
    return spread(docs).withColumn(out_col, (embedder or hash_embedding)(F.col(text_col)))


#: What some embedding models want in front of a query, but not in front of a passage.
QUERY_FORMAT = "{query}"


def embed_queries(queries: DataFrame, text_col: str = "query", out_col: str = "embedding", embedder=None, query_format: str = QUERY_FORMAT) -> DataFrame:
    """Queries with an embedding, each written into the model's query format first."""
    before, after = query_format.split("{query}")
    wrapped = queries.withColumn("__q", F.concat(F.lit(before), F.col(text_col), F.lit(after)))
    ship(queries.sparkSession)
    return wrapped.withColumn(out_col, (embedder or hash_embedding)(F.col("__q"))).drop("__q")
