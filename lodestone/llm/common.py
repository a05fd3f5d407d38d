"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..runtime import ship


def spread(df: DataFrame) -> DataFrame:
    """Ready a table for Python kernels: the package at hand, rows over the cores."""
    ship(df.sparkSession)
    return runtime.spread(df)


def arrow_rows(df: DataFrame, function: Callable[[list[tuple]], list[tuple]], schema: pa.Schema, batch: int = 1000) -> DataFrame:
    """Apply ``function`` to lists of rows, Arrow-batched; its rows get ``schema``.

    Batches are cut into at most ``batch`` rows so that texts of many kilobytes never pile
    up as Python strings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                rows = function(list(zip(*(c.to_pylist() for c in part.columns))))
                if rows:
                    columns = list(zip(*rows))
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    return df.mapInArrow(run, _ddl(schema))


_DDL = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_type(f.type)}" for f in schema)


def _type(t: pa.DataType) -> str:
    return f"array<{_type(t.value_type)}>" if pa.types.is_list(t) else _DDL[t]


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")


def extension_of(path: str):
    """Lower-case file extension of a path column; empty where there is none."""
    return F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]+)$", 1))
