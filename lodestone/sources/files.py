"""File trees as DataFrames: listed by Spark, filtered by name before any content is read."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import headers as H
from ..functions import text as T
from ..runtime import ship


def tracked_paths(root: str) -> list[str] | None:
    """Paths under version control below a local root; None where there is none."""
    try:
        done = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, check=True, timeout=60)
    except (OSError, subprocess.SubprocessError):
        return None
    names = [n for n in done.stdout.decode("utf-8", "ignore").split("\0") if n]
    return names or None


def scan_tree(spark: SparkSession, root: str, tracked: list[str] | None = None, limit_size: bool = True, profile: V.Profile = V.GENERAL) -> DataFrame:
    """(path, size, text) of the wanted files below a root, paths relative to it.

    Name, directory and size filters only touch the listing columns, so the file source
    reads no other file's bytes.  ``tracked`` restricts to given relative paths.
    """
    path = F.col("path")
    kept = _listed(spark, root).filter(T.is_wanted_file(path, F.col("size") if limit_size else None) & ~T.in_skipped_directory(path, profile))
    if tracked is not None:
        kept = kept.join(spark.createDataFrame([(p,) for p in tracked], "path string"), "path", "left_semi")
    return kept.select("path", "size", H.utf8_text("content").alias("text"))


def scan_examples(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, text) of all examples below a root: by extension, outside of output folders, of any size."""
    path = F.col("path")
    kept = _listed(spark, root).filter(T.extension(path).isin(*V.EXAMPLES_EXTENSIONS) & ~T.in_skipped_directory(path, names=V.EXAMPLES_SKIPPED_DIRECTORIES))
    return kept.select("path", "size", H.utf8_text("content").alias("text"))


def _listed(spark: SparkSession, root: str) -> DataFrame:
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    at = F.instr(plain, base)
    relative = F.when(at > 0, F.substring(plain, at + len(base), F.length(plain))).otherwise(plain)
    return files.select(relative.alias("path"), F.col("length").alias("size"), "content")


def project_version(text: str, default: str = "10.0") -> str:
    """Version named by a CMake project call, or a default."""
    import re

    m = re.search(r"project\s*\([^)]*VERSION\s+([0-9]+\.[0-9]+(?:\.[0-9]+)?)", text, re.I)
    return m[1] if m else default


def tree_version(root: str) -> str:
    """Version that the build file at the top of a local tree names."""
    try:
        with open(f"{root}/CMakeLists.txt", encoding="utf-8", errors="ignore") as f:
            return project_version(f.read())
    except OSError:
        return project_version("")
