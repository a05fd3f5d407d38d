"""Symbol index and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T


def symbol_index(chunks: DataFrame, id_col: str = "chunk_id", symbol_col: str = "symbol", per_key: int | None = None) -> DataFrame:
    """(key, id, ord): every key of every symbol, numbered by id within its key.

    With ``per_key`` only the first ones are kept: a partial top-k runs before the shuffle,
    so a key that every row has (an empty tail, a common file name) sends few rows.
    """
    keys = chunks.select(F.explode(T.symbol_keys(F.col(symbol_col))).alias("key"), F.col(id_col).alias("id"))
    order = Window.partitionBy("key").orderBy("id")
    numbered = keys.withColumn("ord", F.row_number().over(order))
    if per_key is not None:
        numbered = numbered.filter(F.col("ord") <= per_key)
    return numbered.select("key", F.col("id").alias(id_col), F.col("ord").cast("bigint").alias("ord"))


def lookup(chunks: DataFrame, queries: DataFrame, limit: int = V.CANDIDATES, per_key: int = V.SYMBOL_HITS, id_col: str = "chunk_id", symbol_col: str = "symbol") -> DataFrame:
    """(query_id, id, rank): chunks whose symbol is named by a query.

    Order: identifiers as they stand in the query, then ids; a chunk keeps its first place.
    """
    asked = queries.select("query_id", F.posexplode(T.query_identifiers(F.col("query"))).alias("pos", "key"))
    wanted = asked.select("key").distinct()
    keys = chunks.select(F.explode(T.symbol_keys(F.col(symbol_col))).alias("key"), F.col(id_col).alias("id")).join(wanted, "key", "left_semi")
    order = Window.partitionBy("key").orderBy("id")
    few = keys.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= per_key)
    hits = few.join(asked, "key").groupBy("query_id", "id").agg(F.min(F.struct("pos", "ord")).alias("first"))
    best = Window.partitionBy("query_id").orderBy("first.pos", "first.ord", "id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).select("query_id", F.col("id").alias(id_col), F.col("rank").cast("bigint").alias("rank"))
