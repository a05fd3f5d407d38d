"""Indexes as tables: union, shards, replacement, validation, dense ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..runtime import checkpoint_dir


def union(indexes: list[DataFrame]) -> DataFrame:
    """Rows of all indexes with ``index_ord``, the place of their index; missing columns become NULL."""
    tagged = [df.drop("index_ord").withColumn("index_ord", F.lit(n)) for n, df in enumerate(indexes)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def with_dense_ids(rows: DataFrame, order: list[str], out_col: str = "chunk_id") -> DataFrame:
    """Consecutive ids from 0 in the order of the given columns, without one task for all rows.

    Rows are range-partitioned, sorted and written once to the shared checkpoint folder, which
    fixes what a partition holds; the count of every partition and the place of a row inside
    its partition are then read from those same files, whatever columns are asked for.  The
    order should tell rows apart: rows that are equal in it share a partition and get their
    ids in any order.
    """
    checkpoint_dir(rows.sparkSession)
    fixed = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    place = F.monotonically_increasing_id()  # number of the partition, then 33 bits for the row inside it
    counts = fixed.select(F.shiftright(place, 33).alias("__p")).groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(1)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = fixed.withColumn("__m", place).withColumn("__p", F.shiftright("__m", 33))
    return numbered.join(F.broadcast(starts), "__p").withColumn(out_col, F.col("__start") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__m", "__start")


def shard_of(position: Column, total: Column, shards: int | Column) -> Column:
    """Shard that owns a 0-based position when shard i owns floor(T*i/n) up to floor(T*(i+1)/n)."""
    n = F.lit(shards) if isinstance(shards, int) else shards
    return F.floor(((position + 1) * n - 1) / total).cast("int")


def shard_bounds(total: Column, shards: Column) -> Column:
    """Array of (shard, first, last + 1) of contiguous shards."""
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), shards.cast("bigint") - 1),
        lambda i: F.struct(
            i.cast("int").alias("shard"), F.floor(total * i / shards).cast("bigint").alias("start"), F.floor(total * (i + 1) / shards).cast("bigint").alias("stop")
        ),
    )


def parse_shard(spec: str) -> tuple[int, int]:
    """"i/n" as (i, n); anything else, and an i outside of 0..n-1, is an error."""
    left, slash, right = spec.partition("/")
    if not slash or not left.strip().isdigit() or not right.strip().isdigit():
        raise ValueError(f"a shard is written i/n, not {spec!r}")
    i, n = int(left), int(right)
    if not 0 <= i < n:
        raise ValueError(f"shard {i} is outside of 0..{n - 1}")
    return i, n


def shard_errors(manifests: DataFrame, counts: DataFrame) -> DataFrame:
    """One row (n_shards, errors): what keeps a set of shards from being merged; empty if nothing.

    ``manifests``: one row per shard with shard_index, shard_of, total_chunks and all keys
    that must match; ``counts``: shard_index, rows, vectors.
    """
    first = F.min_by
    keys = V.SHARD_KEYS
    if missing := [k for k in keys if k not in manifests.columns]:
        raise ValueError(f"the manifests of shards lack {', '.join(missing)}")
    summary = manifests.agg(
        F.count("*").alias("n"), F.count("shard_index").alias("with_shard"), F.countDistinct("shard_index").alias("different"), F.min("shard_index").alias("low"), F.max("shard_index").alias("high"),
        F.countDistinct("shard_of").alias("ofs"), first("shard_of", "shard_index").alias("of"), F.countDistinct("total_chunks").alias("totals"), first("total_chunks", "shard_index").alias("total"),
        *(F.countDistinct(F.coalesce(F.col(k).cast("string"), F.lit("\0"))).alias(f"k_{k}") for k in keys),
    )
    sums = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("vectors"), F.lit(0)).alias("vectors"))
    j = summary.crossJoin(sums)  # one row each
    say = lambda c, m: F.when(c, F.lit(m))
    return j.select(
        F.col("n").alias("n_shards"),
        F.array_compact(
            F.array(
                say(F.col("n") == 0, "no shards"),
                say(F.col("with_shard") < F.col("n"), "not a shard"),
                say((F.col("different") != F.col("with_shard")) | (F.col("low") != 0) | (F.col("high") + 1 != F.col("of")) | (F.col("different") != F.col("of")), "incomplete set"),
                say((F.col("ofs") > 1) | (F.col("totals") > 1), "counts disagree"),
                *(say(F.col(f"k_{k}") > 1, f"{k} differs") for k in keys),
                say(F.col("rows") != F.col("total"), "rows differ from promise"),
                say(F.col("vectors") != F.col("total"), "vectors differ from promise"),
            )
        ).alias("errors"),
    )


def merge_shards(shards: DataFrame, manifests: DataFrame) -> DataFrame:
    """Rows of all shards in order of their shard; raises where ``shard_errors`` finds any."""
    counts = shards.groupBy("shard_index").agg(F.count("*").alias("rows"), F.count("embedding").alias("vectors"))
    found = shard_errors(manifests, counts).first()
    if found is None or found["errors"]:
        raise ValueError("; ".join(found["errors"]) if found else "no shards")
    return shards.orderBy("shard_index", "chunk_id")


def replace_posts(index: DataFrame, posts: DataFrame, prefix: str = "forum/") -> DataFrame:
    """The index without its posts, then the new ones; running it again changes nothing."""
    kept = index.filter(~F.coalesce(F.col("path").startswith(prefix), F.lit(False)))
    return kept.unionByName(posts, allowMissingColumns=True)


def index_errors(chunks: DataFrame, vectors: DataFrame, manifest: DataFrame) -> DataFrame:
    """(index_ord, rows, vectors, dims, errors) per index: counts, dimensions and manifest compared.

    A vector counts once per chunk; all checks are aggregates, and the dimension of an
    index is compared with its manifest and with the other indexes.
    """
    rows = chunks.groupBy("index_ord").agg(F.count("*").alias("rows"))
    own = chunks.select("chunk_id", "index_ord")
    sized = vectors.filter(F.col("embeddings").isNotNull()).select("chunk_id", F.size("embeddings").alias("dim")).distinct()
    per = own.join(sized, "chunk_id").groupBy("index_ord").agg(
        F.countDistinct("chunk_id").alias("vectors"), F.countDistinct("dim").alias("dims"), F.min("dim").alias("low"), F.max("dim").alias("high")
    )
    j = manifest.select("index_ord", "dim", "model").join(rows, "index_ord", "full").join(per, "index_ord", "left")
    n = F.coalesce("rows", F.lit(0))
    v = F.coalesce("vectors", F.lit(0))
    say = lambda c, m: F.when(F.coalesce(c, F.lit(False)), F.lit(m))
    return j.select(
        "index_ord", n.alias("rows"), v.alias("vectors"), F.coalesce("dims", F.lit(0)).alias("dims"),
        F.array_join(
            F.array_compact(
                F.array(
                    say(n == 0, "empty"), say(F.coalesce("model", F.lit("")) == "", "no model"), say(v != n, "vectors missing"),
                    say(F.col("dims") > 1, "dimensions differ"), say((F.col("low") != F.col("dim")) | (F.col("high") != F.col("dim")), "dimension differs from manifest"),
                )
            ), ";",
        ).alias("errors"),
    )
