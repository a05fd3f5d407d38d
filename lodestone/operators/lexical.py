"""Lexical index and Okapi BM25 for batches of queries.

Statistics cover the whole corpus: document frequencies come from a map-side combined
count over distinct tokens per document, so the shuffle carries vocabulary entries and
not occurrences.  Term frequencies are only built for tokens that some query asks for;
texts are not shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..runtime import spread

DIGITS = 9  # scores are rounded before they are ranked, so that summation order cannot flip ties


def _exploded(docs: DataFrame, tokens: Column, *columns: Column) -> DataFrame:
    """One row per token.

    The outer form keeps the optimizer from testing the size of the array in front of the
    exchange of ``spread``, which would take every text apart twice.
    """
    return docs.select(*columns, F.explode_outer(tokens).alias("token")).filter(F.col("token").isNotNull())


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n): occurrences in the corpus."""
    return _exploded(spread(docs.select(text_col)), T.token_bag(F.col(text_col))).groupBy("token").agg(F.count("*").alias("n"))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, df)."""
    return _exploded(spread(docs.select(text_col)), F.array_distinct(T.token_bag(F.col(text_col)))).groupBy("token").agg(F.count("*").alias("df"))


def weighed(df: DataFrame, n: DataFrame) -> DataFrame:
    """(token, df, idf) from document frequencies and one row with the number of documents."""
    raw = df.crossJoin(n).withColumn("raw", F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(mean).select(  # both sides of these products are one-row aggregates
        "token", "df", F.when(F.col("raw") < 0, V.BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf")
    )


def inverse_document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, df, idf): negative values are replaced by a share of the vocabulary's mean."""
    return weighed(document_frequencies(docs, text_col), docs.agg(F.count("*").alias("docs")))


def asked_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, times)."""
    return queries.select("query_id", F.explode(T.tokenize(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))


def postings(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(id, token, tf, len) of all tokens, or of those of a table of tokens."""
    tokens = spread(docs.select(F.col(id_col), F.col(text_col))).select(F.col(id_col).alias("id"), T.token_bag(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    rows = _exploded(tokens, F.col("tokens"), F.col("id"), F.size("tokens").alias("len"))
    if only is not None:
        rows = rows.join(only, "token", "left_semi")
    return rows.groupBy("id", "token").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def ranked(found: DataFrame, asked: DataFrame, idf: DataFrame, stats: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score, rank) from postings, asked tokens, their idf and one row with ``mean_len``."""
    part = F.col("times") * F.col("idf") * (
        F.col("tf") * (V.BM25_K1 + 1) / (F.col("tf") + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("len") / F.col("mean_len")))
    )
    scored = (
        found.join(asked, "token").join(idf.select("token", "idf"), "token").crossJoin(stats.select("mean_len"))  # one row
        .groupBy("query_id", "id").agg(F.round(F.sum(part), DIGITS).alias("score")).filter(F.col("score") > 0)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "score", F.col("rank").cast("bigint").alias("rank"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = V.CANDIDATES, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score, rank): the k best documents of every query with a positive score.

    Takes the whole corpus apart; ``search_index`` does that once for many batches of queries.
    """
    asked = asked_tokens(queries)
    vocabulary = asked.select("token").distinct()
    idf = inverse_document_frequencies(docs, text_col).join(vocabulary, "token", "left_semi")
    length = F.size(T.token_bag(F.coalesce(F.col(text_col), F.lit(""))))
    stats = spread(docs.select(text_col)).agg(F.coalesce(F.avg(length), F.lit(0.0)).alias("mean_len"))
    return ranked(postings(docs, id_col, text_col, vocabulary), asked, idf, stats, k, id_col)
