"""Mail records to forum chunks: filters, scrubbing, running numbers, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import headers as H
from ..functions import text as T
from ..runtime import checkpoint_dir, ship


def skip_reason(year: Column, subject: Column, stripped: Column, profile: V.Profile = V.GENERAL) -> Column:
    """Why a message is left out; NULL for messages that stay.  Unreadable dates stay."""
    return (
        F.when(F.coalesce(year < V.MIN_POST_YEAR, F.lit(False)), "old")
        .when(T.is_install_topic(F.coalesce(subject, F.lit("")), profile), "install")
        .when(F.length(stripped) < V.MIN_POST_CHARS, "short")
    )


def with_year(messages: DataFrame, date_col: str = "date_raw") -> DataFrame:
    ship(messages.sparkSession)
    return messages.withColumn("year", H.year_of(F.col(date_col)))


def running_numbers(messages: DataFrame, thread_col: str = "thread_id", order_col: str | list[str] = "msg_ord") -> DataFrame:
    """Messages with their number inside their thread.

    The unknown thread may hold a large part of all rows.  Messages are range-partitioned by
    their order and written once to the shared checkpoint folder; they are numbered inside
    (thread, partition), and the offsets of a thread's partitions are added.  No task holds
    more than a partition of messages, or a row per partition of one thread.
    """
    order = [order_col] if isinstance(order_col, str) else order_col
    checkpoint_dir(messages.sparkSession)
    rows = messages.withColumn("__t", F.coalesce(F.col(thread_col), F.lit("unknown"))).repartitionByRange(*order).checkpoint().withColumn("__b", F.spark_partition_id())
    counts = rows.groupBy("__t", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__t").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__t", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    inside = Window.partitionBy("__t", "__b").orderBy(*order)
    numbered = rows.withColumn("__r", F.row_number().over(inside)).join(starts, ["__t", "__b"])
    return numbered.withColumn("number", (F.col("__s") + F.col("__r")).cast("bigint")).drop("__t", "__b", "__s", "__r")


def distinct_messages(messages: DataFrame) -> DataFrame:
    """Each delivered message once."""
    return messages.dropDuplicates(["msg_ord"])


def counters(judged: DataFrame) -> DataFrame:
    """One row: messages seen and left out by reason, kept messages and their threads."""
    return judged.agg(
        F.count("*").alias("messages"), F.count_if(F.col("reason") == "old").alias("old"), F.count_if(F.col("reason") == "install").alias("install"),
        F.count_if(F.col("reason") == "short").alias("short"), F.count_if(F.col("reason").isNull()).alias("kept"),
        F.countDistinct(F.when(F.col("reason").isNull(), F.coalesce(F.col("thread_id"), F.lit("unknown")))).alias("threads"),
    )


def post_rows(messages: DataFrame, profile: V.Profile = V.GENERAL, key: str | list[str] = "msg_ord") -> DataFrame:
    """Forum rows (path, number, text, symbol) of messages with subject, sender, date_raw, body.

    Quoted lines go first and decide what is too short; then scrubbing; then the header.
    """
    ship(messages.sparkSession)
    name = T.sender_name(F.coalesce("sender", F.lit("")))
    prepared = with_year(messages).withColumn("stripped", T.without_quoted_lines(F.coalesce("body", F.lit("")))).withColumn("clean_subject", T.without_emails(T.trimmed(F.coalesce("subject", F.lit("")))))
    kept = prepared.filter(skip_reason(F.col("year"), F.col("subject"), F.col("stripped"), profile).isNull())
    numbered = running_numbers(kept, order_col=key)
    return numbered.select(
        *([key] if isinstance(key, str) else key), F.concat(F.lit("forum/"), F.coalesce("thread_id", F.lit("unknown"))).alias("path"), F.col("number").alias("line"),
        F.concat(F.lit("Subject: "), F.col("clean_subject"), F.lit("\nDate: "), F.coalesce("date_raw", F.lit("")), F.lit("\n\n"), T.trimmed(T.scrubbed(F.col("stripped"), name))).alias("text"),
        F.col("clean_subject").alias("symbol"), F.lit("forum").alias("language"), F.lit("post").alias("chunk_type"), F.lit(profile.forum_source).alias("source"),
    )
