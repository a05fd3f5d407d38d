"""Messages as a stream: running numbers per thread, and a sink of posts that is idempotent by key.

Both are functions for ``foreachBatch``.  Every batch writes a directory of its own and reads
only those of earlier batches, so a batch that is run again overwrites what it wrote, and a
message that comes again in a later batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import indexing, mail
from ..sources.indexes import exists

KEY = ("mailbox", "msg_ord")


def _earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    return spark.read.parquet(path).filter(F.col("batch") < batch_id).drop("batch") if batch_id > 0 and exists(spark, path) else None


def number_messages(target: str, key: tuple[str, ...] = KEY):
    """Writes messages with their number inside their thread to ``target/messages``.

    State is one counter per thread and batch in ``target/counts``.  A batch is numbered by
    ``mail.running_numbers``, which splits threads of any size over partitions; the counters of
    earlier batches are then added, so no task holds a thread.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([*key])
        before = _earlier(spark, f"{target}/messages", batch_id)
        if before is not None:
            fresh = fresh.join(before.select(*key), [*key], "left_anti")
        numbered = mail.running_numbers(fresh, order_col=[*key])
        seen = _earlier(spark, f"{target}/counts", batch_id)
        if seen is not None:
            total = seen.groupBy(F.col("thread_id").alias("__t")).agg(F.sum("n").alias("__n"))
            thread = F.coalesce("thread_id", F.lit("unknown"))
            numbered = numbered.join(total, thread == F.col("__t"), "left").withColumn("number", F.col("number") + F.coalesce("__n", F.lit(0))).drop("__t", "__n")
        numbered.write.mode("overwrite").parquet(f"{target}/messages/batch={batch_id}")
        written = spark.read.parquet(f"{target}/messages/batch={batch_id}")
        written.groupBy(F.coalesce("thread_id", F.lit("unknown")).alias("thread_id")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{target}/counts/batch={batch_id}")

    return write


def upsert_posts(target: str, key: tuple[str, ...] = KEY):
    """Writes each batch of posts to its own directory; ``read_posts`` gives the latest of every key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates([*key]).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def read_posts(spark: SparkSession, target: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """Every post once, as the latest batch that has it delivered it."""
    latest = Window.partitionBy(*key).orderBy(F.desc("batch"))
    return spark.read.parquet(target).withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n", "batch")


def merged_index(index: DataFrame, posts: DataFrame) -> DataFrame:
    """The index with its posts replaced by those the stream has written."""
    return indexing.replace_posts(index, posts)
