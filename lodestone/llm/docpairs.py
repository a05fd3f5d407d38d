"""Functions paired with their documentation.

``document_pairs`` turns chunks of source files into one row per documented function.
Every comment in reach of a function (its docstring, comments above it with no code
between, comments inside it before its first statement, comments behind its signature) is a
candidate.  Functions and comments are linked one to one on a sparse bipartite graph at least
cost; costs come from the comment's place and distance, from parameter tags and from mentions
of the function and its parameters.  Links beyond a cost, comments whose tags name none of the
parameters and descriptions that say nothing beyond the function's name are rejected.
``place`` tells where the comment stands; ``docstring`` and ``above`` are in touch with the
definition, and unless ``direct_only`` is False only these are given out, after all comments
have competed.

Defined results for odd input: NULL, empty and blank texts, NULL paths, posts
(``forum/...``) and files of other languages give no rows; repeated rows give repeated
pairs; texts of any length are read whole; extra columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import docpairs_kernel as kernel
from .common import arrow_rows, extension_of, need, spread

SCHEMA = pa.schema(
    [
        ("chunk_id", pa.int64()), ("path", pa.string()), ("func_name", pa.string()), ("start_line", pa.int32()),
        ("end_line", pa.int32()), ("code", pa.string()), ("documentation", pa.string()), ("place", pa.string()), ("rivals", pa.int32()),
    ]
)


def _candidates(chunks: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    need(chunks, id_col, path_col, text_col)
    return chunks.select(
        F.col(id_col).cast("bigint").alias("chunk_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text")
    ).filter(
        ~F.col("path").startswith("forum/")
        & extension_of("path").isin(*kernel.FAMILY_BY_EXT)
        & F.col("text").contains("(")
    )


def document_pairs(
    chunks: DataFrame, id_col: str = "chunk_id", path_col: str = "path", text_col: str = "text", min_words: int = kernel.MIN_NEW_WORDS,
    direct_only: bool = True,
) -> DataFrame:
    """One row per function with an informative description: its code and its documentation.

    ``rivals`` counts the other comments that were plausible for the function.
    """

    def rows(batch: list[tuple]) -> list[tuple]:
        return [
            (i, p, x.name, x.start + 1, x.end + 1, x.code, x.text, x.place, x.rivals)
            for i, p, t in batch
            for x in kernel.pairs(p, t, min_words, direct_only)
        ]

    return arrow_rows(spread(_candidates(chunks, id_col, path_col, text_col)), rows, SCHEMA)


def documented_functions(chunks: DataFrame, **columns: str) -> DataFrame:
    """Distinct (chunk_id, func_name) of ``document_pairs``."""
    return document_pairs(chunks, **columns).select("chunk_id", "func_name").distinct()


def link_report(pairs: DataFrame) -> DataFrame:
    """(place, pairs, contested): links by the place of the comment, and those of functions with several plausible comments."""
    return pairs.groupBy("place").agg(F.count("*").alias("pairs"), F.count_if(F.col("rivals") > 0).alias("contested"))
