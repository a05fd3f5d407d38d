"""A stored search index: postings, token statistics and vectors of a corpus.

Built once, searched by many batches of queries.  Postings are laid out by a hash of their
token and sorted by token inside their files, so a search reads the directories of the tokens
it asks for, and inside them only the row groups that can hold them.  A token that a third of
all documents have is spread over ``SALTS`` files.

    postings-n/bucket=b token, id, tf, len   in n buckets
    terms               token, df, idf       sorted by token
    stats               docs, mean_len       one row
    vectors             id, embedding
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..runtime import checkpoint_dir, ship
from . import dense, lexical

LAYOUT = 2  # changes when the files of an index do
BUCKET_DOCS = 50_000  # documents for each directory of postings
BUCKETS = (16, 4096)  # fewest and most directories
SALTS = 4
POSTINGS = "id bigint, token string, tf bigint, len int, bucket int"
MAX_ASKED = 20_000  # tokens of a batch of queries that are looked up by name; more of them are joined


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _bucket(token, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def build(chunks: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "text", vector_col: str | None = None) -> None:
    """Write the index of all rows; NULL and empty texts count as documents without tokens.

    Without a column of vectors they are the hashing embedder's, summed up from the postings.
    """
    spark = chunks.sparkSession
    ship(spark)
    docs = chunks.count()
    buckets = max(BUCKETS[0], min(BUCKETS[1], docs // BUCKET_DOCS))
    rows = lexical.postings(chunks, id_col, text_col).withColumn("id", F.col("id").cast("bigint")).withColumn("bucket", _bucket("token", buckets))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    rows.repartition(F.col("bucket"), salt).sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings-{buckets}")
    stored = spark.read.schema(POSTINGS).parquet(f"{path}/postings-{buckets}")

    ids = chunks.select(F.col(id_col).cast("bigint").alias("id"))
    lengths = stored.select(F.sum(F.col("tf")).alias("tokens"))
    stats = lengths.select(F.lit(docs).cast("bigint").alias("docs"), F.coalesce(F.col("tokens") / F.nullif(F.lit(docs), F.lit(0)), F.lit(0.0)).alias("mean_len"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")

    df = stored.groupBy("token").agg(F.count("*").alias("df"))
    lexical.weighed(df, stats.select("docs")).repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/terms")

    if vector_col is None:
        vectors = dense.from_postings(ids, stored)
    else:
        vectors = chunks.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("embedding"))
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")


class SearchIndex:
    """An index on disk, opened for searching."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "chunk_id"):
        self.spark, self.path, self.id_col = spark, path, id_col
        p, fs = _path(spark, path)
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        self.postings = next(n for n in names if n.startswith("postings-"))
        self.buckets = int(self.postings.split("-")[1])

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def vectors(self) -> DataFrame:
        return self._read("vectors").withColumnRenamed("id", self.id_col)

    def terms(self) -> DataFrame:
        return self._read("terms")

    def bm25(self, queries: DataFrame, k: int = V.CANDIDATES) -> DataFrame:
        """(query_id, id, score, rank), from the postings of asked tokens only."""
        asked = lexical.asked_tokens(queries)
        tokens = asked.select("token").distinct()
        named = tokens.select("token", _bucket("token", self.buckets).alias("bucket")).limit(MAX_ASKED + 1).collect()
        found, terms = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/{self.postings}"), self.terms()
        if len(named) <= MAX_ASKED:
            words = [r["token"] for r in named]
            found = found.filter(F.col("bucket").isin(sorted({r["bucket"] for r in named})) & F.col("token").isin(words))
            terms = terms.filter(F.col("token").isin(words))
        else:
            found, terms = found.join(tokens, "token", "left_semi"), terms.join(tokens, "token", "left_semi")
        return lexical.ranked(found.drop("bucket"), asked, terms, self._read("stats"), k, self.id_col)


def state_of(spark: SparkSession, source: str) -> str:
    """Digest of the files of a table (names, sizes and times) and of the layout of the index; changes with either."""
    p, fs = _path(spark, source)
    names, files = [f"layout {LAYOUT}", source], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        names.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:24]


def of_table(spark: SparkSession, source: str) -> SearchIndex:
    """The index of a Parquet table of chunks, in the shared folder; built where the table's present state has none.

    It is built beside its place and renamed when it is whole, so an index that was cut short is
    never read, and of two sessions that build it at once the later one takes the other's.
    """
    place = f"{checkpoint_dir(spark).rstrip('/')}/search-index-{state_of(spark, source)}"
    final, fs = _path(spark, place)
    if not fs.exists(final):
        staged = f"{place}-{uuid.uuid4().hex}"
        build(spark.read.parquet(source), staged)
        p, _ = _path(spark, staged)
        if fs.exists(final) or not fs.rename(p, final):
            fs.delete(p, True)
    return SearchIndex(spark, place)
