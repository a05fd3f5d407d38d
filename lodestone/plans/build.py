"""Registered queries of the retrieval engine, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import fixed_values as V
from ..functions import text as T
from ..functions import vectors as X
from ..operators import chunking, dense, evaluation, fusion, indexing, lexical, mail, rendering, search_index, symbols

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gold_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation queries with an id in the order of their text; the table is fixed and small."""
    g = t(spark, sf_dir, "gold").distinct()
    return g.withColumn("query_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("query", "kind", F.to_json("relevant"), F.to_json("channels"))).cast("bigint"))


_PROFILES: dict[str, V.Profile] = {}


def profile(spark: SparkSession, sf_dir: str) -> V.Profile:
    """The product whose forum the chunks name as their source; read until the first such chunk."""
    if sf_dir not in _PROFILES:
        row = t(spark, sf_dir, "meta").select(F.regexp_extract("source", r"^project([a-z0-9]+)-forum$", 1).alias("p")).filter("p <> ''").first()
        _PROFILES[sf_dir] = V.Profile(row["p"] if row else "")
    return _PROFILES[sf_dir]


def stored_index(spark: SparkSession, sf_dir: str) -> search_index.SearchIndex:
    return search_index.of_table(spark, f"{sf_dir}/meta.parquet")


def embedded_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.embed_queries(dense.pinned(gold_queries(spark, sf_dir)), "query")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "meta").filter(F.col("path").startswith("forum/"))


def search(spark: SparkSession, sf_dir: str) -> fusion.Search:
    return fusion.Search(t(spark, sf_dir, "meta"), embedded_gold(spark, sf_dir), index=stored_index(spark, sf_dir), profile=profile(spark, sf_dir))


# ------------------------------------------------------------------ lexical


@query
def tokenize_counts(spark, sf_dir):
    return lexical.token_counts(t(spark, sf_dir, "meta"))


@query
def token_df_idf(spark, sf_dir):
    return lexical.inverse_document_frequencies(t(spark, sf_dir, "meta")).select("token", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(spark, sf_dir):
    found = stored_index(spark, sf_dir).bm25(dense.pinned(gold_queries(spark, sf_dir)))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query
def bm25_scan(spark, sf_dir):
    """The same ranking without a stored index."""
    found = lexical.bm25(t(spark, sf_dir, "meta"), gold_queries(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query
def stored_terms(spark, sf_dir):
    """Statistics of the tokens, as the stored index holds them."""
    return stored_index(spark, sf_dir).terms().select("token", "df", F.round("idf", 6).alias("idf"))


@query
def stored_vectors(spark, sf_dir):
    """The hashing embedder's vectors of all chunks, as the stored index holds them."""
    v = stored_index(spark, sf_dir).vectors()
    return v.select("chunk_id", F.size("embedding").alias("dim"), F.round(X.norm(F.col("embedding")), 6).alias("norm"), F.round(F.reduce("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# ------------------------------------------------------------------ dense


@query
def l2_normalize(spark, sf_dir):
    v = t(spark, sf_dir, "vector_store").filter(F.col("embeddings").isNotNull() & ~F.exists("embeddings", lambda x: F.isnan(x))).distinct()
    return v.select("chunk_id", X.l2_normalized(F.col("embeddings")).alias("unit")).select(
        "chunk_id", F.size("unit").alias("dim"), F.round(F.reduce("unit", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(X.norm(F.col("unit")), 6).alias("norm")
    )


@query
def dense_topk(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    asked = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.dense_topk(e, asked, 10, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query
def hash_embed(spark, sf_dir):
    return dense.hash_buckets(t(spark, sf_dir, "documents"), "doc_id")


# ------------------------------------------------------------------ symbols, fusion


@query
def symbol_keys(spark, sf_dir):
    return symbols.symbol_index(t(spark, sf_dir, "meta"), per_key=V.SYMBOL_HITS)


@query
def symbol_lookup(spark, sf_dir):
    m = t(spark, sf_dir, "meta")
    named = m.filter(F.coalesce("symbol", F.lit("")) != "")
    asked = named.groupBy("symbol").agg(F.min("chunk_id").alias("query_id")).select("query_id", F.col("symbol").alias("query"))
    return symbols.lookup(m, asked)


@query
def chunk_flags(spark, sf_dir):
    m = t(spark, sf_dir, "meta")
    p = profile(spark, sf_dir)
    return m.select(
        "chunk_id", T.is_python_chunk(F.col("language"), F.col("path"), p).alias("python_chunk"), T.is_forum_chunk(F.col("language"), F.col("source"), p).alias("forum_chunk"),
        T.looks_like_injection(F.col("text")).alias("flagged"),
    )


@query
def query_flags(spark, sf_dir):
    return gold_queries(spark, sf_dir).select("query_id", "query", T.is_python_query(F.col("query"), profile(spark, sf_dir)).alias("python_query"), F.array_join(T.query_identifiers(F.col("query")), " ").alias("identifiers"))


@query
def rrf_fusion(spark, sf_dir):
    f = search(spark, sf_dir).fused()
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first_list", "first_rank", "chunk_id")
    return f.withColumn("place", F.row_number().over(order)).select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), F.col("first_list").cast("bigint").alias("first_list"), F.col("first_rank").cast("bigint").alias("first_rank"), F.col("place").cast("bigint").alias("place"))


@query
def hybrid_search(spark, sf_dir):
    return search(spark, sf_dir).results().drop("text")


@query
def abstention(spark, sf_dir):
    return search(spark, sf_dir).verdicts().select("query_id", F.round("top_dense", 6).alias("top_dense"), "symbol_hit", "insufficient_evidence", F.round("confidence", 3).alias("confidence"))


@query
def context_assembly(spark, sf_dir):
    return rendering.contexts(search(spark, sf_dir).results())


@query
def rendered_results(spark, sf_dir):
    return rendering.result_blocks(search(spark, sf_dir).results())


# ------------------------------------------------------------------ evaluation


@query
def channel_filter(spark, sf_dir):
    g = gold_queries(spark, sf_dir)
    channels = t(spark, sf_dir, "manifest").select("index_ord", "channel")
    return g.crossJoin(channels).select(  # 30 evaluation queries, 3 indexes: both tables are fixed
        "query_id", "index_ord", evaluation.applies_to(F.col("channels"), F.col("channel")).alias("applies")
    )


@query
def recall_mrr(spark, sf_dir):
    """Quality of the lexical list alone, with the verdicts of the whole search."""
    s, q = search(spark, sf_dir), gold_queries(spark, sf_dir)
    listed = s.bm25.filter(F.col("rank") <= V.EVAL_K).join(t(spark, sf_dir, "meta").select("chunk_id", "path"), "chunk_id")
    return evaluation.quality(evaluation.first_hits(listed, q), s.verdicts())


@query
def search_quality(spark, sf_dir):
    s, q = search(spark, sf_dir), gold_queries(spark, sf_dir)
    return evaluation.quality(evaluation.first_hits(s.results(), q), s.verdicts())


@query
def floor_sweep(spark, sf_dir):
    return evaluation.floor_sweep(search(spark, sf_dir).verdicts(), gold_queries(spark, sf_dir))


# ------------------------------------------------------------------ chunking


@query
def window_split(spark, sf_dir):
    w = chunking.split_windows(t(spark, sf_dir, "documents"), "doc_id")
    return w.select("doc_id", "window_no", "line_offset", F.md5("piece").alias("digest"))


@query
def post_split(spark, sf_dir):
    w = chunking.split_windows(posts(spark, sf_dir), "chunk_id", overlap=V.POST_OVERLAP_LINES, strip=True)
    return w.select("chunk_id", "window_no", "line_offset", F.length("piece").alias("chars"))


@query
def structural_chunks(spark, sf_dir):
    m = t(spark, sf_dir, "meta").filter(~F.col("path").startswith("forum/"))
    # every chunk of the index is taken for a file of its own; its id makes the path unique
    files = m.select(F.concat(F.col("chunk_id").cast("string"), F.lit("/"), F.col("path")).alias("path"), "text")
    return chunking.chunk_files(files, profile=profile(spark, sf_dir))


# ------------------------------------------------------------------ files


@query
def file_predicates(spark, sf_dir):
    p = t(spark, sf_dir, "meta").select("path").filter(F.col("path").isNotNull()).distinct()
    path = F.col("path")
    return p.select(
        "path", T.basename(path).alias("base"), T.extension(path).alias("extension"), T.language_of(path).alias("language_of_path"),
        T.is_wanted_file(path).alias("wanted"), T.in_skipped_directory(path, profile(spark, sf_dir)).alias("skipped_directory"),
    )


# ------------------------------------------------------------------ mail


@query
def subject_normalize(spark, sf_dir):
    m, p = t(spark, sf_dir, "messages").distinct(), profile(spark, sf_dir)
    return m.select("msg_ord", T.normalized_subject(F.col("subject"), p).alias("subject"), F.coalesce(T.is_install_topic(F.col("subject"), p), F.lit(False)).alias("install"), T.sender_name(F.col("sender")).alias("sender_name"))


@query
def email_scrub(spark, sf_dir):
    return t(spark, sf_dir, "meta").select("chunk_id", T.without_emails(F.col("text")).alias("text"))


@query
def quoted_strip(spark, sf_dir):
    return posts(spark, sf_dir).select("chunk_id", T.without_quoted_lines(F.col("text")).alias("text"))


@query
def quote_boundary(spark, sf_dir):
    return posts(spark, sf_dir).select("chunk_id", T.above_quotation(F.col("text")).alias("text"))


@query
def scrub_chain(spark, sf_dir):
    m = t(spark, sf_dir, "messages").select("chunk_id", "sender").filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min("sender").alias("sender"))
    joined = posts(spark, sf_dir).join(m, "chunk_id", "left")
    return joined.select("chunk_id", T.scrubbed(F.col("text"), T.sender_name(F.coalesce("sender", F.lit("")))).alias("text"))


@query
def message_years(spark, sf_dir):
    m = mail.with_year(mail.distinct_messages(t(spark, sf_dir, "messages")))
    return m.select("msg_ord", "year", F.coalesce(F.col("year") < V.MIN_POST_YEAR, F.lit(False)).alias("old"))


@query
def thread_running_count(spark, sf_dir):
    return mail.running_numbers(mail.distinct_messages(t(spark, sf_dir, "messages"))).select("msg_ord", "number")


@query
def thread_numbers_by_offset(spark, sf_dir):
    """Running numbers where the order is a byte offset with wide gaps, as in a mailbox."""
    m = mail.distinct_messages(t(spark, sf_dir, "messages")).withColumn("offset", F.col("msg_ord") * 7919)
    return mail.running_numbers(m, order_col="offset").select("msg_ord", "number")


@query
def forum_rows(spark, sf_dir):
    bodies = t(spark, sf_dir, "meta").select("chunk_id", F.col("text").alias("body"))
    return mail.post_rows(mail.distinct_messages(t(spark, sf_dir, "messages")).join(bodies, "chunk_id"), profile(spark, sf_dir)).drop("msg_ord")


@query
def build_counters(spark, sf_dir):
    bodies = t(spark, sf_dir, "meta").select("chunk_id", T.without_quoted_lines(F.col("text")).alias("stripped"))
    m = mail.with_year(mail.distinct_messages(t(spark, sf_dir, "messages"))).join(bodies, "chunk_id", "left")
    return mail.counters(m.withColumn("reason", mail.skip_reason(F.col("year"), F.col("subject"), F.coalesce("stripped", F.lit("")), profile(spark, sf_dir))))


@query
def html_to_text(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(T.html_to_text(F.col("text"))).alias("digest"))


# ------------------------------------------------------------------ indexes


@query
def index_union(spark, sf_dir):
    m = t(spark, sf_dir, "meta")
    parts = [m.filter(F.col("index_ord") == n).drop("index_ord") for n in (0, 1, 2)]  # the manifest has three indexes
    return indexing.union([parts[0].drop("source"), parts[1].drop("source"), parts[2]]).groupBy("index_ord", "source").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query
def dense_ids(spark, sf_dir):
    d = indexing.with_dense_ids(t(spark, sf_dir, "meta").select("chunk_id", "path", "line"), ["path", "line", "chunk_id"], "position")
    return d.select("chunk_id", "position")


@query
def index_build_ids(spark, sf_dir):
    """Ids of a whole index build: rows with their texts, numbered in the order of path and place."""
    m = t(spark, sf_dir, "meta").drop("index_ord")
    d = indexing.with_dense_ids(m.withColumnRenamed("chunk_id", "own_id"), ["path", "line", "own_id"])
    return d.select("chunk_id", "own_id", F.md5("text").alias("digest"))


@query
def shard_assignment(spark, sf_dir):
    d = indexing.with_dense_ids(t(spark, sf_dir, "meta").select("chunk_id"), ["chunk_id"], "position")
    total = d.agg(F.count("*").alias("total"))
    return d.crossJoin(total).select("chunk_id", indexing.shard_of(F.col("position"), F.col("total"), 8).alias("shard"))  # one row


@query
def shard_bounds(spark, sf_dir):
    n = t(spark, sf_dir, "meta").groupBy("index_ord").agg(F.count("*").alias("total"))
    return n.select("index_ord", F.explode(indexing.shard_bounds(F.col("total"), F.lit(8))).alias("b")).select("index_ord", "b.shard", "b.start", "b.stop")


@query
def shard_merge_check(spark, sf_dir):
    m = t(spark, sf_dir, "meta")
    man = t(spark, sf_dir, "manifest").withColumnsRenamed({"index_ord": "shard_index"}).withColumn("shard_of", F.lit(3))
    total = m.agg(F.count("*").alias("total_chunks"))
    counts = m.groupBy(F.col("index_ord").alias("shard_index")).agg(F.count("*").alias("rows"), F.count("*").alias("vectors"))
    return indexing.shard_errors(man.crossJoin(total), counts).select("n_shards", F.array_join("errors", ";").alias("errors"))  # one row


@query
def forum_upsert(spark, sf_dir):
    m = t(spark, sf_dir, "meta")
    fresh = m.filter(F.col("path").startswith("forum/")).select("chunk_id", "path", "line", T.without_emails(F.col("text")).alias("text"), "symbol", "language", "chunk_type", "source", "index_ord")
    return indexing.replace_posts(m, fresh).select("chunk_id", "path", F.md5("text").alias("digest"))


@query
def index_validate(spark, sf_dir):
    return indexing.index_errors(t(spark, sf_dir, "meta"), t(spark, sf_dir, "vector_store"), t(spark, sf_dir, "manifest"))


@query
def manifest_health(spark, sf_dir):
    return rendering.health(t(spark, sf_dir, "manifest"))


@query
def manifest_json(spark, sf_dir):
    """Every manifest as the JSON object that a service answers with, and one of its fields read back."""
    fields = ("model", "dim", "channel", "version_label", "commit_sha")
    m = t(spark, sf_dir, "manifest").select("index_ord", F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields))).alias("body"))
    return m.select("index_ord", "body", F.get_json_object("body", "$.model").alias("model"))


@query
def channel_slug(spark, sf_dir):
    m = t(spark, sf_dir, "manifest").select("index_ord", F.coalesce("engine_ref", F.lit("feature/x y")).alias("ref"), F.coalesce("engine_version", F.lit("0.0")).alias("version"), "built_at")
    return m.select("index_ord", T.channel_of(F.col("ref")).alias("channel"), T.version_label(F.col("version"), F.col("ref"), F.col("built_at"), profile(spark, sf_dir)).alias("label"))


@query
def content_hash(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


# ------------------------------------------------------------------ digests, releases, services


@query
def digest_headings(spark, sf_dir):
    return rendering.headings(t(spark, sf_dir, "documents")).select("doc_id", "line_no", "level", "line")


@query
def digest_section(spark, sf_dir):
    return rendering.sections(t(spark, sf_dir, "documents"), "solver")


RELEASES = """[
 {"draft": true, "prerelease": false, "assets": [{"name": "index-main-5.zip", "browser_download_url": "u/5z"}]},
 {"draft": false, "prerelease": true, "assets": [{"name": "index-main-4.zip", "browser_download_url": "u/4z"}]},
 {"draft": false, "prerelease": false, "assets": [{"name": "index-10.0.0-3.zip", "browser_download_url": "u/3z"}, {"name": "index-main-3.sha256", "browser_download_url": "u/3s"}]},
 {"draft": false, "prerelease": false, "assets": [{"name": "index-main-2a.zip", "browser_download_url": "u/2a"}, {"name": "index-main-2b.zip", "browser_download_url": "u/2b"}, {"name": "index-main-2b.sha256", "browser_download_url": "u/2s"}]},
 {"draft": false, "prerelease": false, "assets": [{"name": "index-main-1.zip", "browser_download_url": "u/1z"}]}
]"""
RELEASE_TYPE = "array<struct<draft: boolean, prerelease: boolean, assets: array<struct<name: string, browser_download_url: string>>>>"


@query
def release_pick(spark, sf_dir):
    listing = spark.range(1).select(F.from_json(F.lit(RELEASES), RELEASE_TYPE).alias("releases"))
    return rendering.pick_release(listing, "main")


PROVIDER_CASES = (
    (1, " OpenAI ", None, None, None, False), (2, None, "local", "http://h", "gpt-x", False), (3, None, None, "http://h", "claude-x", True),
    (4, None, None, None, "GPT-4", True), (5, None, None, None, "claude-3", False), (6, None, None, None, "other", True), (7, None, None, None, None, False),
)


@query
def provider_resolve(spark, sf_dir):
    rows = [(n, EngineConfig(provider=env or "", base_url=url or "", has_key=key).resolved_provider(asked or "", model or "")) for n, asked, env, url, model, key in PROVIDER_CASES]
    return spark.createDataFrame(rows, "case_id int, resolved string")


@query
def language_counts(spark, sf_dir):
    return chunking.language_counts(t(spark, sf_dir, "meta"))
