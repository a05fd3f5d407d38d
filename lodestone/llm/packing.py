"""Items of varying size combined into containers of fixed capacity.

Each input partition packs its own items online with a fixed number of open windows
(best fit; the fullest window leaves when nothing fits), and a window that has left is final.
Windows still open at the end of the partitions are merged, many partitions at a time, in a
second pass over rows of ids and sizes only; texts and closed windows are never shuffled.

An item is divided only if it exceeds the capacity by itself; its parts follow natural
boundaries.  Defined results for odd input: NULL and empty texts have no size and are in
no container; repeated rows are packed as often as they occur; equal sizes keep the order
of the scan; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing_kernel as kernel
from . import splitting_kernel, tokens
from ..runtime import checkpoint_dir
from .common import need, spread

MAX_CAPACITIES = 64
FAN_IN = 64  # partitions whose open windows are merged by one task

_ROWS = pa.schema(
    [("capacity", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("closed", pa.bool_()), ("doc_id", pa.int64()), ("part_no", pa.int32()), ("n_tokens", pa.int32()), ("position", pa.int32())]
)
_CONTAINERS = pa.schema(
    [("capacity", pa.int32()), ("container", pa.string()), ("doc_id", pa.int64()), ("part_no", pa.int32()), ("n_tokens", pa.int32()), ("position", pa.int32())]
)
_OUT = "capacity int, container string, doc_id bigint, part_no int, n_tokens int, position int"


def capacities_of(limits: DataFrame) -> list[int]:
    rows = limits.filter(F.col("purpose") == "pack").select("max_tokens").distinct().limit(MAX_CAPACITIES + 1).collect()
    if len(rows) > MAX_CAPACITIES:
        raise ValueError("too many capacities")
    return sorted(int(r[0]) for r in rows)


def pack(
    documents: DataFrame, capacities: list[int], vocabulary: str = tokens.DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text",
    open_windows: int = 64,
) -> DataFrame:
    """(capacity, container, doc_id, part_no, n_tokens, position): where every part of every text lies."""
    need(documents, id_col, text_col)
    shared = tokens.load(documents.sparkSession, vocabulary)
    work = spread(documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0))

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        if shared is None:
            encode, sizes = (lambda t: t.encode()), None
        else:
            enc = tokens.encoding(shared)
            encode = enc.encode_ordinary
            sizes = lambda t: np.fromiter((len(b) for b in enc.decode_tokens_bytes(enc.encode_ordinary(t))), np.int64)
        packers = {c: kernel.Packer(c, open_windows) for c in capacities}
        seq = 0
        out: list[tuple] = []

        def leave(capacity: int, window: kernel.Window | None, closed: bool) -> None:
            nonlocal seq
            if window is not None:
                out.extend((capacity, part, seq, closed, *item, at) for at, item in enumerate(window[1]))
                seq += 1

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), _ROWS)], schema=_ROWS)
            out.clear()
            return batch

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(encode(t))
                for c, packer in packers.items():
                    if n <= c:
                        parts = [(i, 0, n)]
                    else:
                        parts = [(i, k, m) for k, (_, _, m) in enumerate(splitting_kernel.split_text(t, c, 0, sizes))]
                    for item in parts:
                        leave(c, packer.put(item[2], [item]), True)
            if len(out) > 20_000:
                yield flush()
        for c, packer in packers.items():
            for window in packer.rest():
                leave(c, window, window[0] == c)
        if out:
            yield flush()

    # one row per part of a text, ids and sizes only; written once to the shared folder, so that texts are
    # counted once and a container keeps its name when a task is repeated
    checkpoint_dir(documents.sparkSession)
    placed = work.mapInArrow(online, "capacity int, part int, seq int, closed boolean, doc_id bigint, part_no int, n_tokens int, position int").checkpoint()
    final = placed.filter("closed").select("capacity", F.concat_ws("-", "capacity", "part", "seq").alias("container"), "doc_id", "part_no", "n_tokens", "position")

    def finish(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[n].to_pylist() for n in ("part", "seq", "position", "doc_id", "part_no", "n_tokens"))))
        windows: dict[tuple[int, int], list] = {}
        for r in rows:
            windows.setdefault(r[:2], []).append(r[3:])
        capacity = table["capacity"][0].as_py()
        merged = kernel.merge(capacity, ((sum(x[2] for x in items), items) for items in windows.values()))
        first = min(p for p, _ in windows) // FAN_IN
        flat = [(capacity, f"{capacity}-m{first}-{k}", *item, at) for k, (_, items) in enumerate(merged) for at, item in enumerate(items)]
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*flat), _CONTAINERS)], schema=_CONTAINERS)

    # only windows that are still open meet, those of FAN_IN partitions in one task
    group = F.floor(F.col("part") / FAN_IN).cast("int")
    late = placed.filter("NOT closed").withColumn("grp", group).groupBy("capacity", "grp").applyInArrow(finish, _OUT)
    return final.unionByName(late)


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and the share of room used, by capacity."""
    per = packed.groupBy("capacity", "container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return per.groupBy("capacity").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * F.first("capacity")), 6).alias("fill"),
    )
