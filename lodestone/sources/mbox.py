"""Mailboxes as DataFrames, in batch and as a stream, through Spark's own text source.

A message begins at a line that starts with ``From ``, which is a record separator: the text
source splits mailboxes of any size at byte ranges, on any file system that Spark reads, and
finishes the last message of a range.  Messages are parsed in Arrow batches.
"""

from __future__ import annotations

import email
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import headers as H
from ..functions import text as T
from ..runtime import ship

SEPARATOR = "\nFrom "
_PARSED = pa.schema([(n, pa.int64() if n == "msg_ord" else pa.string()) for n in ("mailbox", "msg_ord", "thread_raw", "subject_raw", "sender_raw", "date_raw", "plain", "markup")])
_DDL = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'string'}" for f in _PARSED)


def _header(message: email.message.Message, name: str) -> str | None:
    value = message.get(name)
    return None if value is None else str(value)


def parsed_message(raw: str) -> tuple[str | None, ...]:
    """(thread, subject, sender, date, plain, markup) of one message, headers not yet decoded."""
    whole = raw if raw.startswith("From ") else "From " + raw
    whole = whole.replace("�", "")  # bytes that are no UTF-8 are dropped
    m = email.message_from_string(whole)
    return (*(_header(m, h) for h in ("X-GM-THRID", "Subject", "From", "Date")), *H.body_of(whole))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place: tuple[str, int] | None = None
    seen = 0
    for b in batches:
        rows = []
        for path, start, raw in zip(*(c.to_pylist() for c in b.columns)):
            if (path, start) != place:  # the records of a byte range come one after another
                place, seen = (path, start), 0
            rows.append((path, start + seen, *parsed_message(raw)))
            seen += 1
        if rows:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), _PARSED)], schema=_PARSED)


def _messages(records: DataFrame) -> DataFrame:
    ship(records.sparkSession)
    raw = records.select("_metadata.file_path", "_metadata.file_block_start", "value").filter(F.length(T.trimmed(F.col("value"))) > 0).mapInArrow(_parse, _DDL)
    body = F.when(F.col("plain") != "", F.col("plain")).otherwise(F.left(H.unescape(T.html_to_text(F.col("markup"))), F.lit(V.MAX_BODY_CHARS)))
    thread = F.coalesce(H.decoded("thread_raw"), F.lit(""))
    return raw.select(
        "mailbox", "msg_ord", H.decoded("subject_raw").alias("subject"), H.decoded("sender_raw").alias("sender"), "date_raw", body.alias("body"),
        F.when(thread == "", "unknown").otherwise(thread).alias("thread_id"),
    )


def read_mailbox(spark: SparkSession, path: str) -> DataFrame:
    """(mailbox, msg_ord, subject, sender, date_raw, body, thread_id): decoded headers and selected bodies.

    ``msg_ord`` is the first byte of the range a message was read from plus its number inside
    that range, which orders the messages of a mailbox as the file does.
    """
    return _messages(spark.read.option("lineSep", SEPARATOR).text(path))


def stream_mailboxes(spark: SparkSession, directory: str, files_per_batch: int = 64) -> DataFrame:
    """The same rows as a stream of the mailboxes that are put into a directory."""
    return _messages(spark.readStream.option("lineSep", SEPARATOR).option("maxFilesPerTrigger", files_per_batch).text(directory))
