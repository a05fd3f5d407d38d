"""Indexes on disk: read, checked, written, replaced in one step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indexing

CHUNKS, MANIFEST = "chunks", "manifest"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return fs.exists(p)


def write(chunks: DataFrame, manifest: dict, path: str) -> None:
    """Chunks with their vectors as Parquet, and a manifest of one row beside them."""
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/{CHUNKS}")
    n = spark.read.parquet(f"{path}/{CHUNKS}").count()
    rows = [(k, None if v is None else str(v)) for k, v in (manifest | {"n_chunks": n}).items()]
    spark.createDataFrame(rows, "field string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/{MANIFEST}")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """Fields of the manifest; empty where there is none."""
    if not exists(spark, f"{path}/{MANIFEST}"):
        return {}
    return {r["field"]: r["value"] for r in spark.read.schema("field string, value string").json(f"{path}/{MANIFEST}").collect()}


def read(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Chunks and manifest; raises where the index is missing, incomplete or contradicts its manifest."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no index at {path}")
    if not exists(spark, f"{path}/{CHUNKS}"):
        raise FileNotFoundError(f"{path} has no chunks")
    chunks, manifest = spark.read.parquet(f"{path}/{CHUNKS}"), read_manifest(spark, path)
    if "embedding" in chunks.columns:
        c = chunks.agg(F.count("*").alias("n"), F.count("embedding").alias("v"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
        if c["n"] != c["v"]:
            raise ValueError(f"{c['n']} chunks but {c['v']} vectors")
        if c["n"] and (c["low"] != c["high"] or manifest.get("dim") not in (None, str(c["low"]))):
            raise ValueError(f"vectors of {c['low']} to {c['high']} numbers, the manifest says {manifest.get('dim')}")
    return chunks, manifest


def read_many(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, dict]:
    """Rows of several indexes in their order; the first manifest with the list of all."""
    loaded = [read(spark, p) for p in paths]
    dims = {m.get("dim") for _, m in loaded}
    if len(dims) > 1:
        raise ValueError(f"indexes of different dimensions: {sorted(map(str, dims))}")
    return indexing.union([c for c, _ in loaded]), loaded[0][1] | {"combined_from": ",".join(paths)}


def validate(spark: SparkSession, path: str, channel: str) -> dict:
    """The manifest of an index that may be used or replace another; raises otherwise."""
    chunks, manifest = read(spark, path)
    if channel != "forum" and manifest.get("channel") != channel:
        raise ValueError(f"the index is of channel {manifest.get('channel')}, {channel} was asked for")
    n = chunks.count()
    if not n or not manifest.get("model") or manifest.get("n_chunks") != str(n):
        raise ValueError("the index is empty or its manifest incomplete")
    return manifest


def publish(spark: SparkSession, staged: str, final: str, channel: str) -> dict:
    """Put a staged index in place of another, or leave the old one untouched.

    The staged index is validated first; both moves are renames beside each other, and a
    failed second one is undone.
    """
    manifest = validate(spark, staged, channel)
    jvm, src, fs = _fs(spark, staged)
    dst, backup = jvm.org.apache.hadoop.fs.Path(final), jvm.org.apache.hadoop.fs.Path(final.rstrip("/") + ".backup")
    had = fs.exists(dst)
    if fs.exists(backup):
        fs.delete(backup, True)
    if had and not fs.rename(dst, backup):
        raise OSError(f"{final} could not be moved aside")
    try:
        if not fs.rename(src, dst):
            raise OSError(f"{staged} could not be moved to {final}")
    except Exception:
        if had and not fs.exists(dst):
            fs.rename(backup, dst)
        raise
    if had:
        fs.delete(backup, True)
    return manifest


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries from JSON lines; blank lines do not count."""
    return spark.read.schema("query string, kind string, relevant array<string>, channels array<string>").json(path).filter(F.col("query").isNotNull())
