"""Reciprocal-rank fusion, re-ranking rules, final order and the evidence verdict."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions import vectors as X
from . import dense as dense_op
from . import lexical, symbols


def fuse(dense: DataFrame, bm25: DataFrame, symbol: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """One row per (query, chunk) of any list, with ranks, scores and the fused score.

    ``first_list`` and ``first_rank`` (the first list a chunk is in, and its rank there)
    break ties of the final order.
    """
    keys = ["query_id", "id"]
    ranked = lambda df, n, *more: df.select("query_id", F.col(id_col).alias("id"), F.col("rank").alias(f"r{n}"), *more)
    merged = (
        ranked(dense, 0, F.col("score").alias("dense_score")).join(ranked(bm25, 1, F.col("score").alias("bm25_score")), keys, "full").join(ranked(symbol, 2), keys, "full")
    )
    part = lambda c: F.coalesce(X.reciprocal_rank(F.col(c), V.RRF_K), F.lit(0.0))
    first = F.when(F.col("r0").isNotNull(), 0).when(F.col("r1").isNotNull(), 1).otherwise(2)
    return merged.select(
        "query_id", F.col("id").alias(id_col), (part("r0") + part("r1") + part("r2")).alias("rrf"), "dense_score", "bm25_score",
        first.alias("first_list"), F.coalesce("r0", "r1", "r2").alias("first_rank"),
    )


def adjustment(python_query: Column, python_chunk: Column, forum_chunk: Column, flagged: Column) -> tuple[Column, ...]:
    """The three corrections of a fused score, in the order in which they are added."""
    return (
        F.when(python_query & python_chunk, F.lit(V.PYTHON_BOOST)).otherwise(0.0),
        F.when(forum_chunk, F.lit(-V.FORUM_PENALTY)).otherwise(0.0),
        F.when(flagged, F.lit(-V.INJECTION_PENALTY)).otherwise(0.0),
    )


def rerank(fused: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = V.TOP_K, id_col: str = "chunk_id", profile: V.Profile = V.GENERAL) -> DataFrame:
    """The k best chunks of every query with their texts; texts are joined to candidates only."""
    details = chunks.select(
        F.col(id_col), "path", "line", "language", "chunk_type", "symbol", "text",
        T.is_python_chunk(F.col("language"), F.col("path"), profile).alias("python_chunk"), T.is_forum_chunk(F.col("language"), F.col("source"), profile).alias("forum_chunk"),
    )
    asked = queries.select("query_id", T.is_python_query(F.col("query"), profile).alias("python_query"))
    joined = fused.join(details, id_col).join(asked, "query_id").withColumn("flagged_injection", T.looks_like_injection(F.col("text")))
    a, b, c = adjustment(F.col("python_query"), F.col("python_chunk"), F.col("forum_chunk"), F.col("flagged_injection"))
    scored = joined.withColumn("fused", F.col("rrf") + a + b + c)
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "first_list", "first_rank", id_col)
    return (
        scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= T.clamped_k(k))
        .select(
            "query_id", F.col("rank").cast("bigint").alias("rank"), F.round("fused", 5).alias("score"), id_col, "path", "line", "language", "chunk_type", "symbol", "text",
            F.round(F.coalesce("dense_score", F.lit(0.0)), 4).alias("dense_score"), F.round(F.coalesce("bm25_score", F.lit(0.0)), 4).alias("bm25_score"), "flagged_injection",
        )
    )


def verdicts(queries: DataFrame, dense: DataFrame, symbol: DataFrame, floor: float = V.DENSE_FLOOR, label: str | None = None) -> DataFrame:
    """One row per query: whether the index holds enough evidence, and how confident that is.

    The floor is held against the best score as it was ranked; only ``confidence`` is rounded.
    """
    top = dense.groupBy("query_id").agg(F.max("score").alias("top"))
    hit = symbol.select("query_id").distinct().withColumn("hit", F.lit(True))
    joined = queries.select("query_id").join(top, "query_id", "left").join(hit, "query_id", "left")
    best = F.coalesce("top", F.lit(0.0))
    symbol_hit = F.coalesce("hit", F.lit(False))
    insufficient = (best < floor) & ~symbol_hit
    return joined.select(
        "query_id", best.alias("top_dense"), symbol_hit.alias("symbol_hit"), insufficient.alias("insufficient_evidence"),
        F.round(F.greatest(F.least(best, F.lit(1.0)), F.lit(0.0)), 3).alias("confidence"),
        F.lit(label or V.DEFAULT_SCOPE).alias("version_label"),
        F.when(insufficient, F.array(F.lit(V.INSUFFICIENT_NOTE))).otherwise(F.array().cast("array<string>")).alias("notes"),
    )


class Search:
    """Hybrid search of a batch of queries over chunks: three candidate lists, fused and re-ranked.

    ``chunks`` needs the columns of an index; ``queries`` needs ``query_id``, ``query`` and
    ``embedding``.  With ``index`` (an opened ``search_index``) the lexical and dense lists come
    from its postings and vectors; without it, from the texts and the column ``embedding`` of
    ``chunks``.  The batch of queries, whose size is checked, is read once; all else is lazy.
    """

    def __init__(
        self, chunks: DataFrame, queries: DataFrame, candidates: int = V.CANDIDATES, floor: float = V.DENSE_FLOOR, label: str | None = None, index=None,
        profile: V.Profile = V.GENERAL,
    ):
        queries = dense_op.pinned(queries)
        self.chunks, self.queries, self.floor, self.label, self.profile = chunks, queries, floor, label, profile
        self.index, self.candidates = index, candidates

    @cached_property
    def dense(self) -> DataFrame:
        return dense_op.dense_topk(self.index.vectors() if self.index else self.chunks, self.queries, self.candidates)

    @cached_property
    def bm25(self) -> DataFrame:
        return self.index.bm25(self.queries, self.candidates) if self.index else lexical.bm25(self.chunks, self.queries, self.candidates)

    @cached_property
    def symbol(self) -> DataFrame:
        return symbols.lookup(self.chunks, self.queries)

    def fused(self) -> DataFrame:
        return fuse(self.dense, self.bm25, self.symbol)

    def results(self, k: int = V.TOP_K) -> DataFrame:
        return rerank(self.fused(), self.chunks, self.queries, k, profile=self.profile)

    def verdicts(self) -> DataFrame:
        return verdicts(self.queries, self.dense, self.symbol, self.floor, self.label)
