"""Personal information in free text: found, and replaced.

``find`` lists every item with its type and place.  ``scrub`` replaces items either by a
placeholder of their type or by a keyed surrogate of the same type, gender ending, script
and format.  Surrogates are permutations of the units items are made of (``pii_surrogates``):
different items get different surrogates, the same unit gets the same one everywhere, and
``settle`` moves surrogates that are themselves units of the texts until none is left.

Defined results for odd input: NULL, empty and blank texts have no items and stay as they
are; overlapping candidates are settled in favour of the more certain type and the longer
span; odd blanks (no-break spaces, tabs) may stand inside an item and are kept in its
value; repeated rows give repeated items; extra columns are ignored by ``find`` and kept
by ``scrub``; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pii_kernel as kernel
from . import pii_surrogates as surrogates
from ..runtime import checkpoint_dir, ship
from .common import arrow_rows, need, spread

NUMBER_VARIANTS = 6
MAX_DIRECTORY = 50_000  # names of a directory that is shipped to every task; a larger one is joined
MAX_WORDS = 50  # different numbers of words that names may have

SCHEMA = pa.schema(
    [("chunk_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("pii_type", pa.string()), ("pii_value", pa.string())]
)


def directory_of(members: DataFrame | None, name_col: str = "display_name") -> list[str] | None:
    """Names of a directory that fits into every task; None for a larger one, which is joined instead."""
    if members is None:
        return []
    rows = members.select(name_col).filter(F.col(name_col).isNotNull()).distinct().limit(MAX_DIRECTORY + 1).collect()
    return None if len(rows) > MAX_DIRECTORY else sorted(r[0] for r in rows)


def _with_names(source: DataFrame, members: DataFrame, name_col: str = "display_name") -> DataFrame:
    """Rows (id, path, text) with those forms of a directory of any size that their text may have.

    Strings of a text that could be a name meet the forms in a semi-join on the whole string,
    so a common first name brings no rows together.
    """
    forms = arrow_rows(
        members.select(F.col(name_col)).filter(F.col(name_col).isNotNull()).distinct(), lambda batch: [(f,) for (d,) in batch for f in kernel.forms_of(d)], pa.schema([("form", pa.string())])
    ).distinct()
    words = {r[0] for r in forms.select(F.size(F.split("form", " "))).distinct().limit(MAX_WORDS + 1).collect()}
    if len(words) > MAX_WORDS:
        raise ValueError("names of a directory have too many different numbers of words")
    keyed = source.toDF("chunk_id", "path", "text").withColumn("__k", F.xxhash64("chunk_id", "path", "text"))
    pairs = arrow_rows(
        keyed.select("__k", "text"), lambda batch: [(k, c) for k, t in batch for c in kernel.directory_candidates(t, words)], pa.schema([("__k", pa.int64()), ("form", pa.string())]), batch=100
    )
    names = pairs.join(forms, "form", "left_semi").groupBy("__k").agg(F.collect_set("form").alias("names"))
    return keyed.join(names, "__k", "left").drop("__k")


def find(chunks: DataFrame, members: DataFrame | None = None, id_col: str = "chunk_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(chunk_id, start, end, pii_type, pii_value) of every item; offsets in characters."""
    need(chunks, id_col, path_col, text_col)
    names = directory_of(members)
    finder: list[kernel.Finder] = []

    def rows(batch: list[tuple]) -> list[tuple]:
        if not finder:
            finder.append(kernel.Finder(names))
        spans = finder[0].spans
        return [(r[0], a, b, kind, r[2][a:b]) for r in batch for a, b, kind in spans(r[2], bool(r[1]) and r[1].startswith("forum/"), *r[3:])]

    source = spread(chunks.select(F.col(id_col).cast("bigint"), F.col(path_col), F.col(text_col)).filter(F.col(text_col).isNotNull()))
    return arrow_rows(source if names is not None else _with_names(source, members), rows, SCHEMA)


def found(chunks: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Distinct (chunk_id, pii_type, pii_value)."""
    return find(chunks, members).select("chunk_id", "pii_type", "pii_value").distinct()


def scrub(
    chunks: DataFrame, members: DataFrame | None = None, mode: str = "placeholder", key: str = "", id_col: str = "chunk_id",
    path_col: str = "path", text_col: str = "text", out_col: str = "clean_text",
) -> DataFrame:
    """All rows with ``out_col``: the text with every item replaced.

    ``placeholder`` writes ``[EMAIL]``, ``[PHONE]`` and so on and needs no shuffle (unless the directory is joined);
    ``surrogate`` writes keyed replacements and shuffles items and the texts that have any.
    """
    need(chunks, id_col, path_col, text_col)
    ship(chunks.sparkSession)
    names = directory_of(members)
    if mode == "placeholder" and names is not None:
        finder: list[kernel.Finder] = []

        @F.pandas_udf("string")
        def replace(paths: pd.Series, texts: pd.Series) -> pd.Series:
            if not finder:  # once for a worker
                finder.append(kernel.Finder(names))
            f = finder[0]
            return texts.combine(paths, lambda t, p: surrogates.placeholders(t, f.spans(t, bool(p) and p.startswith("forum/"))) if isinstance(t, str) else None)

        return chunks.withColumn(out_col, replace(F.col(path_col), F.col(text_col)))
    if mode not in ("placeholder", "surrogate"):
        raise ValueError("mode is placeholder or surrogate")
    if mode == "surrogate" and not key:
        raise ValueError("surrogates need a key")

    items = find(chunks, members, id_col, path_col, text_col)
    if mode == "placeholder":
        marked = items.groupBy("chunk_id").agg(F.collect_set(F.struct("start", "end", "pii_type")).alias("__items")).withColumnRenamed("chunk_id", "__id")

        @F.pandas_udf("string")
        def mark(texts: pd.Series, found: pd.Series) -> pd.Series:
            rows = zip(texts, found)
            return pd.Series([t if not isinstance(t, str) or f is None else surrogates.placeholders(t, sorted((s["start"], s["end"], s["pii_type"]) for s in f)) for t, f in rows], dtype=object)

        joined = chunks.join(marked, F.col(id_col).cast("bigint") == F.col("__id"), "left")
        return joined.withColumn(out_col, mark(F.col(text_col), F.col("__items"))).drop("__id", "__items")
    moved = settle(units_of(items), key).filter("variant > 0").select("kind", "value", "variant")
    # where units were moved, their variants go along with the chunk; usually there are few
    by_chunk = items.groupBy("chunk_id").agg(F.collect_set(F.struct("start", "end", "pii_type")).alias("__items"))
    of_chunk = units_of(items, "chunk_id").join(moved, ["kind", "value"]).groupBy("chunk_id").agg(F.collect_set(F.struct("kind", "value", "variant")).alias("__moved"))

    @F.pandas_udf("string")
    def write(texts: pd.Series, found: pd.Series, variants: pd.Series) -> pd.Series:
        def one(t, spans, changed):
            if not isinstance(t, str) or spans is None:
                return t
            writer = surrogates.Writer(key, {(m["kind"], m["value"]): m["variant"] for m in changed} if changed is not None else None)
            return writer.text(t, [(s["start"], s["end"], s["pii_type"]) for s in spans])

        return pd.Series([one(*row) for row in zip(texts, found, variants)], dtype=object)

    extra = by_chunk.join(of_chunk, "chunk_id", "left").withColumnRenamed("chunk_id", "__id")
    joined = chunks.join(extra, F.col(id_col).cast("bigint") == F.col("__id"), "left")
    return joined.withColumn(out_col, write(F.col(text_col), F.col("__items"), F.col("__moved"))).drop("__id", "__items", "__moved")


def units_of(items: DataFrame, *keep: str) -> DataFrame:
    """Distinct (kind, value) of the units of items, with the columns to keep."""
    schema = pa.schema([*((n, pa.int64()) for n in keep), ("kind", pa.string()), ("value", pa.string())])

    def rows(batch: list[tuple]) -> list[tuple]:
        return [(*r[2:], *u) for r in batch for u in surrogates.units(r[0], r[1])]

    return arrow_rows(items.select("pii_type", "pii_value", *keep).distinct(), rows, schema).distinct()


def _made(key: str, kind: Column, value: Column, variant: Column) -> Column:
    @F.pandas_udf("string")
    def make(kinds: pd.Series, values: pd.Series, variants: pd.Series) -> pd.Series:
        return pd.Series([surrogates.MAKERS[k](v, key, n) for k, v, n in zip(kinds, values, variants)], dtype=object)

    return make(kind, value, variant)


def settle(units: DataFrame, key: str) -> DataFrame:
    """(kind, value, variant, surrogate) of all units: no two surrogates of a kind are equal, and none is a unit of the texts.

    Variant 0 is a permutation, so only surrogates that are units themselves have to move.
    Every round tries the next variant of those that are left, against all units and all
    surrogates so far; only the first round has many rows.  Words grow with their variant, so
    there is always a free one.  Numbers cannot grow: where the texts hold so many that
    ``NUMBER_VARIANTS`` tries meet none that is free, a number keeps its variant 0, which is
    still no other number's surrogate.  Tables are cut off by checkpoints in the shared folder.
    """
    checkpoint_dir(units.sparkSession)
    made = lambda df, n: df.select("kind", "value", F.lit(n).alias("variant")).withColumn("surrogate", _made(key, F.col("kind"), F.col("value"), F.col("variant")))
    first = made(units.select("kind", "value"), 0).checkpoint()
    pending = first.join(first.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "value").checkpoint()
    left, settled, variant = pending, None, 0
    taken = first.select("kind", F.explode(F.array("value", "surrogate")).alias("surrogate"))
    while not left.isEmpty():
        variant += 1
        if variant > NUMBER_VARIANTS:
            left = left.filter(F.col("kind") == surrogates.WORD)
        free = made(left, variant).join(taken, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["kind", "surrogate"], "left_anti")
        one = Window.partitionBy("kind", "surrogate").orderBy("value")
        chosen = free.withColumn("n", F.row_number().over(one)).filter("n = 1").select("kind", "value", "variant", "surrogate").checkpoint()
        left = left.join(chosen, ["kind", "value"], "left_anti").checkpoint()
        settled = chosen if settled is None else settled.unionByName(chosen)
    if settled is None:
        return first
    return first.join(settled, ["kind", "value"], "left_anti").unionByName(settled.select(*first.columns))


def surrogate_report(chunks: DataFrame, members: DataFrame | None, key: str) -> DataFrame:
    """(kind, units, surrogates, met): distinct units and surrogates of each kind, and surrogates that are units of the texts."""
    s = settle(units_of(find(chunks, members)), key).checkpoint()
    met = s.join(s.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_semi").groupBy("kind").agg(F.count("*").alias("met"))
    return s.groupBy("kind").agg(F.count("*").alias("units"), F.countDistinct("surrogate").alias("surrogates")).join(met, "kind", "left").fillna(0, ["met"])
