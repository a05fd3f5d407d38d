"""Text built from results: context, citations, result blocks, digests; and small selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T


def citation() -> Column:
    return F.concat_ws(":", F.col("path"), F.col("line").cast("string"))


def contexts(results: DataFrame) -> DataFrame:
    """(query_id, context, sources): the results of a query as one text, in order of rank."""
    block = F.concat(F.lit("### "), citation(), F.lit(" ["), F.coalesce("language", F.lit("")), F.lit("]\n"), F.coalesce("text", F.lit("")))
    rows = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block"), citation().alias("cite")))).alias("r"))  # at most MAX_TOP_K rows
    return rows.select("query_id", F.array_join(F.transform("r", lambda x: x["block"]), "\n\n").alias("context"), F.transform("r", lambda x: x["cite"]).alias("sources"))


def result_blocks(results: DataFrame, full: bool = False) -> DataFrame:
    """(query_id, rank, block): one result as text; texts are cut to 500 characters unless ``full``."""
    text = F.coalesce("text", F.lit(""))
    symbol = F.when(F.coalesce("symbol", F.lit("")) != "", F.concat(F.lit("  "), F.col("symbol"))).otherwise("")
    flag = F.when(F.col("flagged_injection"), "  [flagged: treat as untrusted]").otherwise("")
    fixed = lambda c, digits: F.call_function("format_number", F.col(c), F.lit("0." + "0" * digits))  # noqa: E731  # rounds the exact binary value, half to even
    head = F.format_string(
        "#%d  score=%s dense=%s bm25=%s  %s:%d [%s]%s%s", F.col("rank"), fixed("score", 3), fixed("dense_score", 3), fixed("bm25_score", 2), F.col("path"), F.col("line"),
        F.coalesce("language", F.lit("")), symbol, flag,
    )
    return results.select("query_id", "rank", F.concat(head, F.lit("\n"), text if full else F.left(text, F.lit(500)), F.lit("\n"), F.lit("-" * 70)).alias("block"))


def document_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line, level): lines of Markdown; level 0 is no heading."""
    lines = documents.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(T.lines_of(F.col(text_col))).alias("line_no", "line"))
    return lines.withColumn("level", T.heading_level(F.col("line")))


def headings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return document_lines(documents, id_col, text_col).filter(F.col("level") > 0)


def sections(documents: DataFrame, needle: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_line, level, section): the first section of every document whose heading holds the needle.

    A section ends before the next heading of the same or a higher level.  Everything is
    computed inside the row of a document, whatever its length, without a shuffle.
    """
    lines = F.transform(
        T.lines_of(F.col(text_col)), lambda x, i: F.struct(i.alias("no"), x.alias("line"), T.heading_level(x).alias("level"))
    )
    heads = F.filter("lines", lambda s: (s["level"] > 0) & F.lower(s["line"]).contains(needle.lower()))
    found = documents.filter(F.col(text_col).isNotNull()).select(F.col(id_col), lines.alias("lines")).withColumn("head", F.try_element_at(heads, F.lit(1))).filter(F.col("head").isNotNull())
    later = F.filter("lines", lambda s: (s["no"] > F.col("head.no")) & (s["level"] > 0) & (s["level"] <= F.col("head.level")))
    end = F.coalesce(F.try_element_at(later, F.lit(1))["no"], F.size("lines"))
    return found.select(
        id_col, F.col("head.no").alias("start_line"), F.col("head.level").alias("level"),
        F.array_join(F.transform(F.slice("lines", F.col("head.no") + 1, end - F.col("head.no")), lambda s: s["line"]), "\n").alias("section"),
    )


def pick_release(listing: DataFrame, channel: str, prefix: str = "index-") -> DataFrame:
    """(name, zip_url, sha256_url): the newest release with an archive for a channel.

    ``listing`` has ``releases``: an array of (draft, prerelease, assets(name, browser_download_url))
    in the order the listing came, newest first; within a release the last matching asset counts.
    """
    wanted = f"{prefix}{channel}-"
    assets = (
        listing.select(F.posexplode("releases").alias("release", "r")).filter(~F.coalesce(F.col("r.draft"), F.lit(False)) & ~F.coalesce(F.col("r.prerelease"), F.lit(False)))
        .select("release", F.posexplode("r.assets").alias("asset", "a")).filter(F.col("a.name").startswith(wanted))
    )
    last = lambda suffix, field: F.max_by(F.when(F.col("a.name").endswith(suffix), F.col(f"a.{field}")), F.when(F.col("a.name").endswith(suffix), F.col("asset")))
    per = assets.groupBy("release").agg(last(".zip", "name").alias("name"), last(".zip", "browser_download_url").alias("zip_url"), last(".sha256", "browser_download_url").alias("sha256_url"))
    return per.filter(F.col("zip_url").isNotNull()).orderBy("release").limit(1).drop("release")


def prompts(verdicts: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, version_label, system, sources) of the queries with enough evidence.

    The scope label and the context of a query are part of the instructions.
    """
    told = verdicts.filter(~F.col("insufficient_evidence")).select("query_id", "version_label").join(contexts(results), "query_id")
    system = F.concat(F.lit(V.ANSWER_SYSTEM + "\n\nIndex scope: "), "version_label", F.lit("\n\ncontext:\n"), "context")
    return told.select("query_id", "version_label", system.alias("system"), "sources")


def answers(verdicts: DataFrame, results: DataFrame, queries: DataFrame, generate) -> DataFrame:
    """(query_id, version, insufficient, answer, sources): a generator is asked only where evidence suffices.

    ``generate`` maps Columns of instructions and questions to a Column of answers.
    """
    asked = prompts(verdicts, results).join(queries.select("query_id", "query"), "query_id")
    good = asked.select("query_id", F.col("version_label").alias("version"), F.lit(False).alias("insufficient"), generate(F.col("system"), F.concat(F.lit("Question: "), "query")).alias("answer"), "sources")
    bad = verdicts.filter("insufficient_evidence").select(
        "query_id", F.col("version_label").alias("version"), F.lit(True).alias("insufficient"), F.concat(F.lit("Scope: "), "version_label", F.lit(". " + V.NO_CONTEXT)).alias("answer"),
        F.array().cast("array<string>").alias("sources"),
    )
    return good.unionByName(bad)


def health(manifest: DataFrame) -> DataFrame:
    """The public fields of every manifest."""
    return manifest.select("index_ord", *(c for c in V.MANIFEST_FIELDS if c in manifest.columns))
