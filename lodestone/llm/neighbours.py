"""The most similar vectors of every vector, by a forest of random-projection trees.

1. Equal vectors of a batch become one class with its k + 1 smallest ids, so a class that
   holds a third of all rows sends few rows per task; what is left is merged in the cells.
2. A tree fitted on a bounded sample cuts the space into cells of about ``cell_rows`` rows.
   Where cells are few, a row enters its own and every other one whose priority is above
   ``-near``.  There a forest is searched through one priority queue shared by its trees,
   rows of crowds are scored against the whole cell, and the best candidates are scored
   again in double precision from the original numbers.
3. Copies grow with the number of cells.  Where the sample shows that it moves fewer rows, a row
   enters its own cell alone at first, and every row is averaged with the neighbours found so far, which takes away the noise by
   which neighbours fall on different sides of a hyperplane.  By the mean, the row enters its cell
   of a second tree, and every other one whose priority is above ``-near``; the margin shrinks
   with the number of rows averaged.  There the rows themselves are searched as before.
4. A crowd larger than half a cell, which every hyperplane would cut through its middle, is parted
   from the rest by one hyperplane and kept whole: blocks of it meet in pairs and are scored
   exactly.  Rows within ``near`` of that hyperplane are on both sides.
5. The trees have at most ``max_cells`` leaves; where that leaves cells too large, each of those is
   cut by a tree of its own, again and again until none is (``_cut_again``).
6. The lists of a class are merged, and every id gets its class's list by an equi-join.

Every row is indexed and every row is a query.  The sample is bounded by ``sample_rows``
(documented parameter), the broadcast tree by ``max_cells`` hyperplanes.

Defined results for odd input: NULL, zero, NaN or infinite vectors and vectors of another
dimension take no part; a row delivered twice counts once; where an id is delivered with
different vectors each distinct vector takes part and no id is paired with itself; ties
go to the smaller id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import neighbours_kernel as kernel
from ..runtime import checkpoint_dir, ship
from .common import need, spread

SUBSAMPLE = 16  # rows of the sample for each leaf of a tree that cuts a cell again
SALT_ROWS = 200_000  # rows of a cell that one task routes
BLOCK_ROWS = 100_000  # rows of a block of a crowd
LEAST_MARGIN = 0.45  # of `near`, for rows averaged with many neighbours


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of float32 numbers as one matrix, without copying rows one by one."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in chunks:
        if len(c):
            width = np.int64 if pa.types.is_large_binary(c.type) else np.int32
            edges = np.frombuffer(c.buffers()[1], width)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[edges[0] : edges[-1]])
    data = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint8)
    return np.frombuffer(np.ascontiguousarray(data), np.float32).reshape(-1, dim)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit32(raw: np.ndarray) -> np.ndarray:
    """Unit rows in single precision, made in blocks."""
    out = np.empty(raw.shape, np.float32)
    for a in range(0, len(raw), 8192):
        out[a : a + 8192] = _unit(raw[a : a + 8192])
    return out


def _valid(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float32 rows of the vectors that take part."""
    ids, vectors = batch.column(0), batch.column(1)
    length = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False))
    ok = (length == dim) & ~np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
    if not ok.any():
        return np.empty(0, np.int64), np.empty((0, dim), np.float32)
    keep = pa.array(ok)
    flat = vectors.filter(keep).flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)
    i = ids.filter(keep).to_numpy(zero_copy_only=False)
    good = np.isfinite(x).all(1) & (np.abs(x).max(1, initial=0.0) > 0)
    return i[good].astype(np.int64), np.ascontiguousarray(x[good])


_NONE = np.iinfo(np.int64).max


def _first_ids(group: np.ndarray, ids: np.ndarray, groups: int, first: int) -> pa.ListArray:
    """The smallest distinct ids of each group."""
    order = np.lexsort((ids, group))
    group, ids = group[order], ids[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])
    group, ids = group[fresh], ids[fresh]
    keep = np.arange(len(ids)) - np.searchsorted(group, np.arange(groups))[group] < first
    offsets = np.concatenate([[0], np.cumsum(np.bincount(group[keep], minlength=groups))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[keep]))


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the lists, and where each begins and how many it has."""
    edges = np.asarray(lists.offsets)
    return lists.values.to_numpy(zero_copy_only=False), edges[:-1], np.diff(edges)


def _merged(table: pa.Table, first: int) -> pa.Table:
    """One row for each key, with its smallest ids."""
    keys = np.array(table["key"].to_pylist(), "S16")
    _, place, group = np.unique(keys, return_index=True, return_inverse=True)
    if len(place) == len(keys):
        return table
    values, starts, sizes = _flat(_one(table["ids"]))
    ids = _first_ids(np.repeat(group, sizes), values[starts[0] : starts[-1] + sizes[-1]], len(place), first)
    return pa.table({"cell": table["cell"].take(place), "key": table["key"].take(place), "ids": ids, "v": table["v"].take(place)})


def _ranked(table: pa.Table, raw: np.ndarray, found: np.ndarray, first: int, min_cosine: float) -> tuple[pa.ListArray, pa.ListArray, np.ndarray]:
    """Ids and cosines (in millionths) of the nearest of every row, itself included, and which of the rows found are near enough."""
    n = len(raw)
    score = np.empty(found.shape)
    for a in range(0, n, 2048):  # again in double precision, from the numbers as delivered
        near, own = raw[found[a : a + 2048]].astype(np.float64), raw[a : a + 2048].astype(np.float64)
        length = np.linalg.norm(near, axis=2) * np.linalg.norm(own, axis=1)[:, None]
        score[a : a + 2048] = np.round(np.einsum("ijk,ik->ij", near, own) / length, 6)
    good = (found >= 0) & (score >= min_cosine)
    flat, starts, sizes = _flat(_one(table["ids"]))
    # classes of one id with neighbours of one id: ranked all at once
    own = flat[starts]
    pairs_i = np.concatenate([own[:, None], np.where(good, own[found], _NONE)], 1)
    pairs_c = np.concatenate([np.ones((n, 1)), np.where(good, score, -2.0)], 1)
    order = np.lexsort((pairs_i, -pairs_c), axis=1)[:, :first]
    pairs_i, pairs_c = np.take_along_axis(pairs_i, order, 1), np.take_along_axis(pairs_c, order, 1)
    there = pairs_c > -2.0
    lists_i: list = [r[m] for r, m in zip(pairs_i, there)]
    lists_c: list = [r[m] for r, m in zip(pairs_c, there)]
    for r in np.nonzero((sizes > 1) | (good & (sizes[found] > 1)).any(1))[0]:
        best = {(-1.0, int(i)) for i in flat[starts[r] : starts[r] + sizes[r]]}
        for c, j in zip(score[r][good[r]], found[r][good[r]]):
            best.update((-float(c), int(i)) for i in flat[starts[j] : starts[j] + sizes[j]])
        ranked = sorted(best)[:first]
        lists_i[r], lists_c[r] = np.array([i for _, i in ranked]), np.array([-c for c, _ in ranked])
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists_i])]).astype(np.int32))
    return (
        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists_i).astype(np.int64))),
        pa.ListArray.from_arrays(offsets, pa.array(np.rint(np.concatenate(lists_c) * 1e6).astype(np.int32))),
        good,
    )


_CELLS = "cell bigint, key binary, ids array<bigint>, v binary"
_CELLS_ARROW = pa.schema([("cell", pa.int64()), ("key", pa.binary()), ("ids", pa.list_(pa.int64())), ("v", pa.binary())])


def _routed(tree: kernel.Tree | None, vectors: pa.Array | pa.ChunkedArray, dim: int, near: float, least_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the leaves they enter."""
    n = len(vectors)
    if tree is None or tree.leaves == 1:
        return np.arange(n), np.zeros(n, np.int64)
    who, cell = [], []
    for a in range(0, n, 2000):
        r, c = kernel.close_leaves(tree, _unit32(_matrix(vectors.slice(a, 2000), dim)), near, least_cells)
        who.append(r + a)
        cell.append(c.astype(np.int64))
    return np.concatenate(who), np.concatenate(cell)


def _copies(tree: kernel.Tree, x: np.ndarray, near: float) -> float:
    """Cells that a row enters, on average."""
    return sum(len(kernel.close_leaves(tree, x[a : a + 2000], near)[0]) for a in range(0, len(x), 2000)) / len(x)


def _cut_again(cells: DataFrame, dim: int, near: float, cell_rows: int, max_cells: int) -> DataFrame:
    """Cells that hold more than twice ``cell_rows`` rows, cut by trees of their own until none is left.

    Each round writes the cells to the shared checkpoint folder and cuts a cell into at most
    ``max_cells`` parts; those with negative numbers stay as they are.  Its tree is fitted by one task on a bounded sample (a partial top-k by
    hash); its rows are routed by as many tasks as their number asks for.
    """
    checkpoint_dir(cells.sparkSession)
    done = None
    for _ in range(5):  # five rounds of 1024 parts are more cells than a bigint can name
        cells = cells.checkpoint()
        sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
        large = sizes.filter((F.col("n") > 2 * cell_rows) & (F.col("cell") >= 0)).select(
            "cell", F.least(F.lit(max_cells), F.ceil(F.col("n") / cell_rows)).cast("int").alias("parts"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")
        ).checkpoint()
        small = cells.join(large, "cell", "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        big = cells.join(large, "cell")
        by_hash = Window.partitionBy("cell").orderBy(F.xxhash64("key"), "key")
        sample = big.withColumn("r", F.row_number().over(by_hash)).filter(F.col("r") <= SUBSAMPLE * max_cells).filter(F.col("r") <= SUBSAMPLE * F.col("parts"))

        def fit(table: pa.Table) -> pa.Table:
            x = np.unique(_unit32(_matrix(table["v"], dim)), axis=0)
            tree, _ = kernel.build_tree(x, max(2, math.ceil(len(x) / table["parts"][0].as_py())), np.random.default_rng(13), max_leaves=max_cells, tries=16)
            # in a crowd every row lies close to every hyperplane; the margin shrinks with the spread of the cell
            margin = min(near, float((x @ tree.normals[0]).std()) / 4) if len(tree.normals) else near
            return pa.table({"cell": table["cell"].slice(0, 1), "salts": table["salts"].slice(0, 1), "tree": pa.array([pickle.dumps((tree, margin))], pa.binary())})

        trees = sample.select("cell", "parts", "salts", "v").groupBy("cell").applyInArrow(fit, "cell bigint, salts int, tree binary")
        salted = big.withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")).select("cell", "salt", "key", "ids", "v")
        spread_trees = trees.select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "tree")

        def cut(rows: pa.Table, tree: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return _CELLS_ARROW.empty_table()
            own, margin = pickle.loads(tree["tree"][0].as_py())
            who, part = _routed(own, rows["v"], dim, margin, 1)
            taken = rows.take(pa.array(who))
            cell = rows["cell"][0].as_py() * max_cells + max_cells + part  # parts of different cells and rounds differ
            return pa.table({"cell": pa.array(cell.astype(np.int64)), "key": taken["key"], "ids": taken["ids"], "v": taken["v"]})

        cells = salted.groupBy("cell", "salt").cogroup(spread_trees.groupBy("cell", "salt")).applyInArrow(cut, _CELLS)
    return done.unionByName(cells)


def nearest_pairs(
    vectors: DataFrame, id_col: str = "chunk_id", vector_col: str = "embeddings", k: int = 5, min_cosine: float = 0.82, dim: int = 128,
    cell_rows: int = 24_000, max_cells: int = 1024, sample_rows: int = 20_000, near: float = 0.03,
    trees: int = 2, leaf_rows: int = 256, least: int = 4, most: int = 56, reach: float = 0.055,
) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: one is among the k nearest of the other, at least ``min_cosine``.

    ``least``, ``most`` and ``reach`` tell how many leaves of a cell's forest a row looks into;
    rows that would look into more than ``most`` are scored against their whole cell.
    """
    if k < 1 or max_cells < 2:
        raise ValueError("k must be 1 at least, max_cells 2")
    first = k + 1  # ids kept of a class of equal vectors: its neighbours and the id itself
    need(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))

    # --- the trees over cells, from a bounded sample
    total = base.count()
    wanted = max(1, round(total / cell_rows))
    n_cells = min(max_cells, wanted)
    share = min(1.0, 1.2 * sample_rows / max(total, 1))
    buckets = 1 << 20
    chosen = base.filter(F.pmod(F.xxhash64("id"), F.lit(buckets)) < max(1, int(share * buckets)))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, x = _valid(b, dim)
            if len(i):
                yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary())], names=["v"])

    tree = second = None
    pairs: list[list[list[int]]] = []  # of each crowd: the task in which two of its blocks meet
    meet: dict[int, tuple[int, int, int]] = {}  # of each such task: number of blocks, the two blocks
    raw = chosen.mapInArrow(sample, "v binary").toArrow()["v"].slice(0, sample_rows) if n_cells > 1 else []
    if len(raw):
        x = np.unique(_unit(_matrix(raw, dim)).astype(np.float32), axis=0)
        leaf_size = max(2, math.ceil(1.45 * len(x) / n_cells))  # halved parts hold about two thirds of the largest
        crowds = kernel.find_crowds(x, leaf_size // 3, min_cosine, near, np.random.default_rng(17))
        tree, parts = kernel.build_tree(x, leaf_size, np.random.default_rng(11), max_leaves=max_cells, tries=16, crowds=crowds)
        for leaf in range(tree.crowds):
            blocks = math.ceil(len(parts[leaf]) / len(x) * total / BLOCK_ROWS)
            pairs.append([[0] * blocks for _ in range(blocks)])
            for i in range(blocks):
                for j in range(i, blocks):
                    pairs[-1][i][j] = pairs[-1][j][i] = -1 - len(meet)
                    meet[-1 - len(meet)] = (blocks, i, j)
        x = x[kernel.route(tree, x) >= tree.crowds]
        if len(x) and _copies(tree, x, near) > 1 + _copies(tree, x, 0.6 * near):  # 0.6: what the margins of means come to
            second, _ = kernel.build_tree(x, leaf_size, np.random.default_rng(12), max_leaves=max_cells, tries=16)
    shared = spark.sparkContext.broadcast((tree, second, pairs, meet))  # at most 2 * max_cells hyperplanes of dim numbers

    # --- valid rows, as bytes with a digest that names the class of equal vectors
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            i, x = _valid(b, dim)
            if len(i):
                rows = [r.tobytes() for r in x]
                keys = [hashlib.blake2b(r, digest_size=16).digest() for r in rows]
                yield pa.record_batch([pa.array(i, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], names=["id", "key", "v"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in clean(batches):
            yield b.select(["id", "key"])

    members = spread(base).mapInArrow(keyed, "id bigint, key binary")  # a row delivered twice gives its pairs twice, which are one in the end

    # --- first cells
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, second, pairs, _ = shared.value
        for b in clean(batches):
            n = b.num_rows
            ids = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), b["id"])
            rows = _merged(pa.table({"cell": pa.array(np.zeros(n, np.int64)), "key": b["key"], "ids": ids, "v": b["v"]}), first)
            if tree is not None:
                who, cell = _entered(rows, tree, pairs, second is not None)
                rows = rows.take(pa.array(who)).set_column(0, "cell", pa.array(cell))
            yield from rows.combine_chunks().to_batches()

    def _entered(rows: pa.Table, tree: kernel.Tree, pairs: list, twice: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the cells they enter: their own and those they lie close to, the latter across a crowd's border alone if there are second cells."""
        p = kernel.priorities(tree, _unit32(_matrix(rows["v"], dim)))
        home = p.argmax(1)
        into = p >= -near
        if twice:
            into[home >= tree.crowds, tree.crowds :] = False
        into[np.arange(len(p)), home] = True
        who, leaf = np.nonzero(into)
        inside = leaf < tree.crowds
        cells_who, cells = [who[~inside]], [leaf[~inside].astype(np.int64)]
        keys = _prefix(rows)
        for c in range(tree.crowds):
            mine = who[leaf == c]
            table = np.array(pairs[c], np.int64)
            cells_who.append(np.repeat(mine, len(table)))
            cells.append(table[keys[mine] % len(table)].ravel())
        return np.concatenate(cells_who), np.concatenate(cells)

    def _prefix(rows: pa.Table) -> np.ndarray:
        return np.array([int.from_bytes(key[:4], "little") for key in rows["key"].to_pylist()], np.int64)

    def _searched(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.ListArray, pa.ListArray, np.ndarray]:
        """Rows of a cell, one for each class, as unit vectors, with what was found for them: row numbers, ids, cosines and which are near enough."""
        cell = table["cell"][0].as_py()
        table = _merged(table, first)
        border = 0
        if cell < 0:
            blocks, i, j = shared.value[3][cell]
            if i != j:
                block = _prefix(table) % blocks
                table = table.take(pa.array(np.argsort(block != i, kind="stable")))
                border = int((block == i).sum())
        raw = _matrix(table["v"], dim)
        x = _unit32(raw)
        if cell >= 0:
            found = kernel.search(x, k + 4, trees, leaf_rows, least, most, reach)[0]
        elif i == j or 0 < border < len(raw):
            found = kernel.scan(x, k + 4, border)
        else:  # one of the two blocks is empty
            found = np.full((len(raw), k + 4), -1, np.int32)
        return table, x, found, *_ranked(table, raw, found, first, min_cosine)

    def look_once(table: pa.Table) -> pa.Table:
        table, _, _, n, c, _ = _searched(table)
        return pa.table({"key": table["key"], "n": n, "c": c}).filter(_told(n))

    def _told(n: pa.ListArray) -> pa.Array:
        """Lists that hold more than the row itself."""
        return pc.greater(pc.list_value_length(n), 1)

    def look(table: pa.Table) -> pa.Table:
        """Lists of the rows of a cell, each with the row as it enters its second cells, or without (cell below zero) where it enters none."""
        tree, second, _, _ = shared.value
        cell = table["cell"][0].as_py()
        table, x, found, n, c, good = _searched(table)
        who = part = np.empty(0, np.int64)
        if cell >= 0:
            mine = np.nonzero(kernel.route(tree, x) >= tree.crowds)[0]  # rows of a crowd have met all others
            margin = near * np.maximum(LEAST_MARGIN, 1 / np.sqrt(1 + good.sum(1))).astype(np.float32)
            mean = kernel.smoothed(x, found, good)
            for a in range(0, len(mine), 2000):
                m = mine[a : a + 2000]
                r, p = kernel.close_leaves(second, mean[m], margin[m][:, None])
                who, part = np.concatenate([who, m[r]]), np.concatenate([part, p])
        rest = np.setdiff1d(np.nonzero(_told(n).to_numpy(zero_copy_only=False))[0], who)
        again = np.zeros(len(who), bool)
        again[1:] = who[1:] == who[:-1]  # the list goes with the first copy only
        rows = pa.array(np.concatenate([who, rest]).astype(np.int64))
        once = pa.array(rows.to_numpy(), mask=np.concatenate([again, np.zeros(len(rest), bool)]))
        copied = pa.array(rows.to_numpy(), mask=np.arange(len(rows)) >= len(who))
        cells = np.concatenate([part, -1 - _prefix(table)[rest] % 997])
        return pa.table(
            {"cell": pa.array(cells.astype(np.int64)), "key": table["key"].take(rows), "ids": table["ids"].take(copied), "v": table["v"].take(copied), "n": n.take(once), "c": c.take(once)}
        )

    def look_again(table: pa.Table) -> pa.Table:
        """Lists of the rows of a second cell, beside those that come with them."""
        carried = table.filter(pc.is_valid(table["n"])).select(["key", "n", "c"])
        if table["cell"][0].as_py() < 0:
            return carried
        return pa.concat_tables([carried, look_once(table.select(["cell", "key", "ids", "v"]))])

    found_lists = "key binary, n array<bigint>, c array<int>"
    cells = spread(base).mapInArrow(route, _CELLS)
    if wanted > max_cells:
        cells = _cut_again(cells, dim, 0.0 if second else near, cell_rows, max_cells)
    if second is None:
        lists = cells.groupBy("cell").applyInArrow(look_once, found_lists)
    else:
        once = cells.groupBy("cell").applyInArrow(look, f"{_CELLS}, n array<bigint>, c array<int>")
        if wanted > max_cells:
            once = once.checkpoint()
            apart = _cut_again(once.filter("cell >= 0").select("cell", "key", "ids", "v"), dim, near, cell_rows, max_cells)
            lists = once.filter("n IS NOT NULL").select("key", "n", "c").unionByName(apart.groupBy("cell").applyInArrow(look_once, found_lists))
        else:
            lists = once.groupBy("cell").applyInArrow(look_again, found_lists)
    zipped = F.transform(F.arrays_zip("n", "c"), lambda s: F.struct((-s["c"]).alias("m"), s["n"].alias("n")))
    merged = (
        lists.select("key", zipped.alias("l")).groupBy("key")
        .agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("l")))), 1, first).alias("l"))  # one list per cell of the class
    )
    directed = (
        members.join(merged, "key")
        .select("id", F.slice(F.filter("l", lambda s: s["n"] != F.col("id")), 1, k).alias("l"))
        .select("id", F.explode("l").alias("s"))
        .withColumn("cosine", -F.col("s.m") / F.lit(1e6))
        .filter(F.col("cosine") >= min_cosine)
    )
    return (
        directed.select(F.least("id", "s.n").alias("id_a"), F.greatest("id", "s.n").alias("id_b"), "cosine")
        .groupBy("id_a", "id_b").agg(F.max("cosine").alias("cosine"))
    )
