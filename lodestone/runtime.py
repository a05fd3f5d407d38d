"""Session helpers: shipping the package to executors and the folder for checkpoints."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark application.

    Workers started with the repository on their path find it anyway; for all others the
    driver serves one archive of a few hundred kilobytes.
    """
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    folder = tempfile.mkdtemp(prefix="ship-")  # read by the driver only, which serves it to executors
    path = os.path.join(folder, f"{_PACKAGE.name}_package.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(path)
    sc._lodestone_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made only where none is named and all executors are threads of
    this process; on a cluster a missing setting is an error, because a folder of one machine
    cannot be read by the others.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    have = sc._jsc.sc().getCheckpointDir()
    if named:
        if have.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if have.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def spread(df: DataFrame) -> DataFrame:
    """A table over at least half as many partitions as there are cores.

    A table delivered as one small file is read by one task, and everything behind that
    scan would leave all other cores idle.  Larger tables have enough splits of their own
    and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
