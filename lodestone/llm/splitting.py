"""Texts longer than a limit cut into pieces at natural boundaries, with overlap.

Limits and overlaps come from a small table by source; a row without a source holds for
all others.  Cuts prefer paragraphs, then lines, sentences and words; a token is cut only
where no pause exists at all, and never inside a character.

Defined results for odd input: NULL texts give no piece; empty texts and texts within the
limit give one piece; repeated rows give repeated pieces; a limit below four tokens (which
one character may have) and an overlap that is no smaller than its limit are an error, found
before any text is read; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import splitting_kernel as kernel
from . import tokens
from .common import arrow_rows, need, spread

MAX_SOURCES = 10_000  # rows of the table of limits, which becomes part of the plan

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("n_tokens", pa.int64()), ("piece", pa.string())]
)


def limits_of(limits: DataFrame, purpose: str = "cut") -> list[tuple[str | None, int, int]]:
    """The rows of a table of limits; of bounded size by definition, and checked."""
    rows = limits.filter(F.col("purpose") == purpose).select("source", "max_tokens", "overlap_tokens").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("too many limits")
    found = [(r[0], int(r[1]), int(r[2] or 0)) for r in rows]
    for source, most, overlap in found:
        if most < kernel.LEAST_LIMIT or not 0 <= overlap < most:
            raise ValueError(f"a limit of {most} tokens and an overlap of {overlap} for {source!r} cannot be kept")
    return found


def _by_source(rows: list[tuple[str | None, int, int]], pick: int) -> Column:
    default = next((r[pick] for r in rows if r[0] is None), None)
    value = F.lit(default).cast("int")
    named = {r[0]: r[pick] for r in rows if r[0] is not None}
    if named:
        table = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))
        value = F.coalesce(F.element_at(table, F.col("source")).cast("int"), value)
    return value


def split_documents(
    documents: DataFrame, limits: DataFrame, vocabulary: str = tokens.DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", only_cut: bool = False, with_text: bool = True,
) -> DataFrame:
    """Pieces of every text: (doc_id, piece_no, start_char, end_char, n_tokens, piece).

    ``only_cut`` leaves out texts that need no cut; ``with_text`` False leaves ``piece`` NULL.
    """
    need(documents, id_col, text_col, source_col)
    rules = limits_of(limits)
    spark = documents.sparkSession
    shared = tokens.load(spark, vocabulary)
    work = documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")
    ).filter(F.col("text").isNotNull())
    work = work.select("doc_id", "text", _by_source(rules, 1).alias("limit"), _by_source(rules, 2).alias("overlap")).filter(F.col("limit").isNotNull())
    if only_cut:  # a token has at least one byte
        work = work.filter(F.octet_length("text") > F.col("limit"))

    def rows(batch: list[tuple]) -> list[tuple]:
        sizes = None
        if shared is not None:
            enc = tokens.encoding(shared)
            sizes = lambda t: np.fromiter((len(b) for b in enc.decode_tokens_bytes(enc.encode_ordinary(t))), np.int64)
        out = []
        for i, t, limit, overlap in batch:
            pieces = kernel.split_text(t, limit, overlap, sizes)
            if only_cut and len(pieces) < 2:
                continue
            out += [(i, n, a, b, c, t[a:b] if with_text else None) for n, (a, b, c) in enumerate(pieces)]
        return out

    return arrow_rows(spread(work), rows, SCHEMA)


def oversized(documents: DataFrame, limits: DataFrame, vocabulary: str = "bytes") -> DataFrame:
    """Distinct ids of the texts that have to be cut."""
    return split_documents(documents, limits, vocabulary, only_cut=True, with_text=False).select("doc_id").distinct()
