"""Emails reduced to what their sender newly wrote.

Line rules find quotations (with their introductions and wrapped ends), forwarded and
original messages, signatures, notes of mail programs, disclaimers and list footers;
replies between quotations stay.

Defined results for odd input: NULL, empty and blank texts lose nothing; rows whose path
is not a post's give no lines; repeated rows give repeated lines; line ends may be mixed
(lines are split at line feeds, a carriage return belongs to its line); an empty table
gives an empty result; other columns are kept by ``newly_written`` and ignored by
``removed_lines``.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mailclean_kernel as kernel
from ..runtime import ship
from .common import arrow_rows, need, spread

SCHEMA = pa.schema([("chunk_id", pa.int64()), ("line_no", pa.int32())])


def removed_lines(posts: DataFrame, id_col: str = "chunk_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(chunk_id, line_no) of every line of a post that its sender did not newly write."""
    need(posts, id_col, path_col, text_col)

    def rows(batch: list[tuple]) -> list[tuple]:
        return [(i, n) for i, t in batch for n in kernel.cut_lines(t)]

    source = posts.filter(F.col(path_col).startswith("forum/") & F.col(text_col).isNotNull())
    return arrow_rows(spread(source.select(F.col(id_col).cast("bigint"), F.col(text_col))), rows, SCHEMA)


def newly_written(posts: DataFrame, path_col: str = "path", text_col: str = "text", out_col: str = "new_text") -> DataFrame:
    """All rows with ``out_col``: the post reduced to its sender's own words; other rows keep NULL."""
    need(posts, path_col, text_col)
    ship(posts.sparkSession)

    @F.pandas_udf("string")
    def reduce(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: kernel.keep_text(t) if isinstance(t, str) else None)

    return posts.withColumn(out_col, F.when(F.col(path_col).startswith("forum/"), reduce(F.col(text_col))))
