"""Records of several sources mixed to target shares of the total size.

Every document of a source has the same expected number of copies; systematic sampling
turns it into whole numbers: expected copies are summed up in a random but stable order
(small sizes first, by size class, so that each source's size is met closely), one random
offset is added, and a document is emitted once per whole number its stretch crosses.  No
document can be emitted more often than its source's cap, because the expected number of
copies is at most the cap.

Prefix sums never meet in one task: documents are numbered inside buckets of bounded
size, and only one row per bucket takes part in the sum over buckets.

Defined results for odd input: NULL and empty texts have no size and are not drawn;
sources without a target (NULL included) are left out; a target source without documents
is reported with a share of 0; repeated rows are drawn as rows of their own; ties in the
order fall to the smaller id; an empty table gives no draws and a report of zeros.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir
from . import tokens
from .common import need, spread

MAX_TARGETS = 10_000
BUCKET_ROWS = 200_000  # documents of a bucket, on average, if all were of one source and size class
MAX_BITS = 20  # buckets of a source and size class: at most two to this power


def _sizes(documents: DataFrame, vocabulary: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    need(documents, id_col, text_col, source_col)
    work = spread(
        documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")).filter(
            (F.length("text") > 0) & F.col("source").isNotNull()
        )
    )
    return work.select("doc_id", "source", tokens.count_tokens(documents.sparkSession, F.col("text"), vocabulary).alias("n_tokens"))


def draw(
    documents: DataFrame, targets: DataFrame, vocabulary: str = tokens.DEFAULT_VOCABULARY, total_tokens: int | None = None, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every drawn document.

    Without ``total_tokens`` the mix is as large as the caps allow at the exact shares; with
    it, a source that cannot supply its share is drawn up to its cap.
    """
    spark = documents.sparkSession
    wanted = targets.select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap"))
    listed = wanted.filter(F.col("source").isNotNull()).limit(MAX_TARGETS + 1).collect()
    if len(listed) > MAX_TARGETS:
        raise ValueError("too many targets")
    sized = _sizes(documents, vocabulary, id_col, text_col, source_col).filter(F.col("source").isin([r[0] for r in listed]) & (F.col("n_tokens") > 0))

    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 1)
    size_class = F.floor(F.log2(F.col("n_tokens").cast("double"))).cast("int")
    rows = sized.select("doc_id", "source", "n_tokens", key.alias("key"), size_class.alias("size_class"))

    # sizes are used three times; a checkpoint of ids and sizes in the shared folder spares counting again
    checkpoint_dir(spark)
    rows = rows.checkpoint()

    # buckets are stretches of the order by key, so that their number, which grows with the rows, changes no draw
    bits = min(MAX_BITS, math.ceil(math.log2(max(1.0, rows.count() / BUCKET_ROWS))))
    stats_key = ["source", "size_class", "coarse"]
    rows = rows.withColumn("coarse", F.shiftright("key", 63 - bits).cast("int"))
    buckets = rows.groupBy(*stats_key).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("size"))
    supply = {r[0]: (r[1], r[2]) for r in buckets.groupBy("source").agg(F.sum("size"), F.sum("docs")).collect()}
    usable = [(s, share, cap, supply[s][0]) for s, share, cap in listed if s in supply and share and share > 0 and cap and cap > 0]
    if total_tokens is None:
        total = min((size * cap / share for _, share, cap, size in usable), default=0.0)
    else:
        total = float(total_tokens)
    rates = {s: min(float(cap), total * share / size) for s, share, cap, size in usable}
    offsets = {s: (zlib.crc32(f"{seed}/{s}".encode()) % 1_000_003) / 1_000_003 for s in rates}
    if not rates:
        return rows.select("doc_id", "source", "n_tokens", F.lit(0).cast("int").alias("copies")).filter(F.lit(False))

    def of(table: dict[str, float]):
        return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("source"))

    before = Window.partitionBy("source").orderBy("size_class", "coarse").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(*stats_key, F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*stats_key).orderBy("key", "doc_id")
    numbered = rows.withColumn("r", F.row_number().over(inside)).join(starts, stats_key)
    rate, offset = of(rates), of(offsets)
    upto = F.floor((F.col("start") + F.col("r")) * rate + offset)
    below = F.floor((F.col("start") + F.col("r") - 1) * rate + offset)
    return (
        numbered.filter(F.col("source").isin(list(rates)))
        .select("doc_id", "source", "n_tokens", (upto - below).cast("int").alias("copies"))
        .filter(F.col("copies") > 0)
    )


def share_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Wanted and reached share of every target source, with its size and largest repetition."""
    per = drawn.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("records"), F.countDistinct("doc_id").alias("documents"), F.max("copies").alias("most_copies")
    )
    everything = Window.partitionBy(F.lit(1))  # over one row per target source
    return (
        targets.select("source", F.col("target_share").cast("double").alias("target_share"), "max_repeats").join(per, "source", "left")
        .select(
            "source", "target_share", "max_repeats", *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("tokens", "records", "documents", "most_copies")),
        )
        .withColumn("share", F.round(F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(everything), F.lit(0)), F.lit(0.0)), 6))
    )
