"""Registered queries of this subpackage; every one runs over its whole tables."""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import docpairs, mailclean, mixing, neighbours, packing, pii, splitting, srcfilter

#: Key of the surrogates; without one in the environment each run has its own.
SURROGATE_KEY = os.environ.get("LODESTONE_SURROGATE_KEY") or secrets.token_hex(16)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented_functions(_t(spark, sf_dir, "meta"))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.document_pairs(_t(spark, sf_dir, "meta"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.link_report(docpairs.document_pairs(_t(spark, sf_dir, "meta"), direct_only=False))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srcfilter.machine_files(_t(spark, sf_dir, "meta")).select("path")


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srcfilter.machine_files(_t(spark, sf_dir, "meta"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours.nearest_pairs(_t(spark, sf_dir, "vector_store"))
    return pairs.selectExpr("id_a AS chunk_id_a", "id_b AS chunk_id_b")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_t(spark, sf_dir, "meta"), _t(spark, sf_dir, "members"))


def p4_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scrub(_t(spark, sf_dir, "meta"), _t(spark, sf_dir, "members")).select("chunk_id", "clean_text")


def p4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scrub(_t(spark, sf_dir, "meta"), _t(spark, sf_dir, "members"), mode="surrogate", key=SURROGATE_KEY).select("chunk_id", "clean_text")


def p4_surrogate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_report(_t(spark, sf_dir, "meta"), _t(spark, sf_dir, "members"), SURROGATE_KEY)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailclean.removed_lines(_t(spark, sf_dir, "meta")).distinct()


def p5_newly_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _t(spark, sf_dir, "meta").filter("path LIKE 'forum/%'")
    return mailclean.newly_written(posts).select("chunk_id", "new_text")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_t(spark, sf_dir, "documents"), packing.capacities_of(_t(spark, sf_dir, "token_limits")))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, sf_dir))


def p6_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing must keep to, in bytes as tokens: nothing lost, nothing twice, no container too full, no text divided without need."""
    packed = packing.pack(_t(spark, sf_dir, "documents"), packing.capacities_of(_t(spark, sf_dir, "token_limits")), "bytes")
    texts = packed.groupBy("capacity", "doc_id").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("parts"))
    kept = texts.groupBy("capacity").agg(
        F.count("*").alias("texts"), F.sum("size").alias("tokens"), F.count_if((F.col("parts") > 1) & (F.col("size") <= F.col("capacity"))).alias("divided"),
        F.count_if((F.col("parts") == 1) & (F.col("size") > F.col("capacity"))).alias("undivided"),
    )
    full = packed.groupBy("capacity", "container").agg(F.sum("n_tokens").alias("used")).groupBy("capacity").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"))
    return kept.join(full, "capacity")


def p7_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(p7_drawn(spark, sf_dir), _t(spark, sf_dir, "mix_targets"))


def p7_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every draw must keep to, in bytes as tokens: each source's number of records within one of its expectation, no text beyond its cap."""
    documents, targets = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets")
    sized = documents.filter(F.length("text") > 0).groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("size"))
    rated = targets.join(sized, "source").withColumn("most", F.col("size") * F.col("max_repeats") / F.col("target_share"))
    total = rated.agg(F.min("most").alias("total"))
    drawn = mixing.draw(documents, targets, "bytes")
    per = drawn.join(targets, "source").groupBy("source").agg(F.sum("copies").alias("records"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("beyond_cap"))
    expected = F.col("docs") * F.least(F.col("max_repeats").cast("double"), F.col("total") * F.col("target_share") / F.col("size"))
    return rated.crossJoin(total).join(per, "source").select(  # one row
        "source", "docs", (F.abs(F.col("records") - expected) <= 1).alias("as_expected"), "beyond_cap"
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "token_limits"))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "token_limits"))


def p8_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all pieces must keep to, in bytes as tokens: the text covered from end to end, no piece beyond its limit, the overlap kept."""
    documents, limits = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "token_limits")
    cut = F.broadcast(limits.filter("purpose = 'cut' AND source IS NOT NULL").select("source", "max_tokens", "overlap_tokens"))  # one row per listed source
    other = limits.filter("purpose = 'cut' AND source IS NULL").select(F.col("max_tokens").alias("m0"), F.col("overlap_tokens").alias("o0"))
    rules = documents.select("doc_id", "source").join(cut, "source", "left").crossJoin(other).select(  # one row
        "doc_id", F.coalesce("max_tokens", "m0").alias("most"), F.coalesce("overlap_tokens", "o0").alias("wanted")
    )
    pieces = splitting.split_documents(documents, limits, "bytes")
    order = Window.partitionBy("doc_id").orderBy("piece_no")
    shared = F.octet_length(F.left("piece", F.lag("end_char").over(order) - F.col("start_char")))
    rows = pieces.withColumn("shared", shared).withColumn("fresh", F.col("end_char") - F.coalesce(F.lag("end_char").over(order), F.lit(0))).join(rules, "doc_id")
    return rows.groupBy("doc_id").agg(
        F.sum("fresh").alias("chars"), (F.count("*") > 1).alias("cut"), F.count_if(F.col("n_tokens") > F.col("most")).alias("too_long"),
        F.count_if((F.col("shared") < F.col("wanted")) | (F.col("shared") > F.col("wanted") + 3)).alias("wrong_overlap"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_pairs, p1_links, p2_found, p2_reasons, p3_found, p4_found, p4_placeholders, p4_surrogates, p4_surrogate_report, p5_found, p5_newly_written,
            p6_packed, p6_fill, p6_bytes, p7_drawn, p7_shares, p7_bytes, p8_found, p8_pieces, p8_bytes,
        )
    }
