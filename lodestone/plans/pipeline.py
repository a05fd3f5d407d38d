"""End to end: trees and mailboxes to indexes, indexes to answers."""

from __future__ import annotations

import json
import os
import tempfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..operators import chunking, dense, fusion, indexing, mail, rendering, search_index
from ..sources import archives, files, indexes, mbox, revisions

SEARCH = "search"
INDEX_FORMAT = "3"
CHUNKER_VERSION = "1"
RELEASES = "array<struct<draft: boolean, prerelease: boolean, assets: array<struct<name: string, browser_download_url: string>>>>"
COLUMNS = ("chunk_id", "path", "line", "text", "symbol", "language", "chunk_type", "source", "embedding")


def tree_chunks(spark: SparkSession, root: str, profile: V.Profile = V.GENERAL) -> DataFrame:
    """Chunks of all wanted files of a tree with dense ids in the order of path and place."""
    tree = files.scan_tree(spark, root, files.tracked_paths(root), profile=profile)
    return _numbered(chunking.chunk_files(tree, profile=profile), None)


def example_chunks(spark: SparkSession, root: str, profile: V.Profile = V.GENERAL, release: str = "") -> DataFrame:
    """Chunks of all examples of a tree; their source, with the release, is also the first part of their paths."""
    source = profile.examples_source + (f"-{release}" if release else "")
    found = files.scan_examples(spark, root).withColumn("path", F.concat(F.lit(source + "/"), "path"))
    return _numbered(chunking.chunk_files(found, profile=profile), source)


def _numbered(chunks: DataFrame, source: str | None) -> DataFrame:
    return indexing.with_dense_ids(chunks, ["path", "chunk_ord"]).withColumn("source", F.lit(source).cast("string")).drop("chunk_ord")


def mailbox_chunks(spark: SparkSession, path: str, profile: V.Profile = V.GENERAL) -> DataFrame:
    """Chunks of all kept messages of a mailbox."""
    return post_chunks(mail.post_rows(mbox.read_mailbox(spark, path), profile))


def post_chunks(posts: DataFrame) -> DataFrame:
    pieces = chunking.split_windows(posts, "msg_ord", overlap=V.POST_OVERLAP_LINES, strip=True).filter(F.col("piece") != "")
    joined = pieces.join(posts.drop("text"), "msg_ord")
    rows = joined.select(
        "msg_ord", "window_no", "path", (F.col("line") + F.col("line_offset")).cast("int").alias("line"), F.col("piece").alias("text"), "symbol", "language", "chunk_type", "source"
    )
    return indexing.with_dense_ids(rows, ["msg_ord", "window_no"]).drop("msg_ord", "window_no")


def write_index(chunks: DataFrame, manifest: dict, out: str) -> None:
    """Chunks, manifest, and the postings that make them searchable."""
    indexes.write(chunks, manifest, out)
    spark = chunks.sparkSession
    search_index.build(spark.read.parquet(f"{out}/{indexes.CHUNKS}"), f"{out}/{SEARCH}", vector_col="embedding")


def build_index(chunks: DataFrame, out: str, manifest: dict, shard: str | None = None, embedder=None) -> None:
    """Embed chunks (of one contiguous shard, if given) and write them with their manifest."""
    total = chunks.count()
    manifest = dict(manifest)
    if shard:
        i, n = indexing.parse_shard(shard)
        chunks = chunks.filter((F.col("chunk_id") >= total * i // n) & (F.col("chunk_id") < total * (i + 1) // n))
        manifest |= {"shard_index": i, "shard_of": n, "total_chunks": total}
    manifest = {"dim": dense.BUCKETS, "built_at": datetime.now(timezone.utc).strftime("%Y-%m-%d"), "index_format": INDEX_FORMAT, "chunker_version": CHUNKER_VERSION} | manifest
    write_index(dense.embed(chunks, "text", "embedding", embedder).select(*COLUMNS), manifest, out)


def build_tree_index(
    spark: SparkSession, root: str, out: str, model: str = "hashing-64", shard: str | None = None, embedder=None, ref: str | None = None, profile: V.Profile = V.GENERAL
) -> None:
    name = revisions.resolve_ref(root, ref)
    version = files.tree_version(root)
    today = datetime.now(timezone.utc).strftime("%Y-%m-%d")
    named = spark.range(1).select(T.channel_of(F.lit(name)).alias("channel"), T.version_label(F.lit(version), F.lit(name), F.lit(today), profile).alias("label")).first()
    label = {
        "model": model, "engine_ref": name, "engine_version": version, "channel": named["channel"], "version_label": named["label"], "built_at": today,
        "commit_sha": revisions.revision(root),
    }
    build_index(tree_chunks(spark, root, profile), out, label, shard, embedder)


def build_examples_index(spark: SparkSession, root: str, out: str, model: str = "hashing-64", release: str = "", embedder=None, profile: V.Profile = V.GENERAL) -> None:
    """A supplemental index of examples; what was at ``out`` is overwritten."""
    build_index(example_chunks(spark, root, profile, release), out, {"model": model, "built_by": "examples"}, None, embedder)


def merge(spark: SparkSession, out: str, parts: list[str]) -> None:
    """Join the shards of a build; everything is checked before anything is written."""
    loaded = [indexes.read(spark, p) for p in parts]
    if not loaded or any("shard_index" not in m for _, m in loaded):
        raise ValueError("not a set of shards")
    rows = [(int(m["shard_index"]), int(m["shard_of"]), int(m["total_chunks"]), *(m.get(k) for k in V.SHARD_KEYS)) for _, m in loaded]
    manifests = spark.createDataFrame(rows, "shard_index int, shard_of int, total_chunks long, " + ", ".join(f"{k} string" for k in V.SHARD_KEYS))
    shards = None
    for c, m in loaded:
        one = c.withColumn("shard_index", F.lit(int(m["shard_index"])))
        shards = one if shards is None else shards.unionByName(one)
    merged = indexing.merge_shards(shards, manifests).drop("shard_index")
    first = min(loaded, key=lambda x: int(x[1]["shard_index"]))[1]
    write_index(merged, {k: v for k, v in first.items() if k not in ("shard_index", "shard_of", "total_chunks", "n_chunks")}, out)


def upsert_mailbox(spark: SparkSession, index: str, mailbox: str, staged: str, embedder=None, profile: V.Profile = V.GENERAL) -> None:
    """Replace an index's posts by those of a mailbox: staged beside it, checked, swapped in."""
    have, manifest = indexes.read(spark, index)
    posts = dense.embed(mailbox_chunks(spark, mailbox, profile), "text", "embedding", embedder).select(*COLUMNS)
    kept = have.agg(F.coalesce(F.max("chunk_id"), F.lit(-1)).alias("top"))
    moved = posts.crossJoin(kept).withColumn("chunk_id", F.col("chunk_id") + F.col("top") + 1).drop("top")  # one row
    write_index(indexing.replace_posts(have, moved), {k: v for k, v in manifest.items() if k != "n_chunks"}, staged)
    indexes.publish(spark, staged, index, manifest.get("channel", ""))


def get_index(
    spark: SparkSession, listing: str, channel: str, dest: str, client: archives.Client, prefix: str = "index-", force: bool = False, if_missing: bool = False
) -> dict:
    """The manifest of an index fetched from a listing of releases and put in place of what was there.

    Pages are read until one has an archive for the channel; the archive is downloaded beside
    the destination, checked, unpacked, validated and swapped in.  What was installed stays
    where any step fails.  ``dest`` is a local folder.
    """
    if os.path.isdir(dest) and os.listdir(dest) and not force:
        if not if_missing:
            raise ValueError(f"{dest} has an index already; it is replaced only by force")
        return indexes.validate(spark, dest, channel)
    found = None
    for page in archives.release_pages(client, listing):
        row = spark.createDataFrame([(json.dumps(page),)], "page string").select(F.from_json("page", RELEASES).alias("releases"))
        if found := rendering.pick_release(row, channel, prefix).first():
            break
    if not found:
        raise FileNotFoundError(f"no index of channel {channel!r} at {listing}")
    os.makedirs(os.path.dirname(os.path.abspath(dest)), exist_ok=True)
    with tempfile.TemporaryDirectory(dir=os.path.dirname(os.path.abspath(dest))) as work:  # beside the destination, for a rename
        archive, staged = os.path.join(work, "index.zip"), os.path.join(work, "index")
        archives.download(client, found["zip_url"], archive)
        if found["sha256_url"]:
            archives.verify(archive, client.get(found["sha256_url"], "checksum", lambda r: r.read().decode()))
        archives.unpack(archive, staged)
        return indexes.publish(spark, staged, dest, channel)


def open_search(
    spark: SparkSession, paths: list[str], texts: list[str], embedder=None, floor: float = V.DENSE_FLOOR, profile: V.Profile = V.GENERAL
) -> fusion.Search:
    """A search of given query texts over one or several indexes; a single one is searched by its stored postings."""
    chunks, manifest = indexes.read_many(spark, paths)
    index = None
    if len(paths) > 1:
        chunks = indexing.with_dense_ids(chunks.withColumnRenamed("chunk_id", "own_id"), ["index_ord", "own_id"])
    elif indexes.exists(spark, f"{paths[0]}/{SEARCH}"):
        index = search_index.SearchIndex(spark, f"{paths[0]}/{SEARCH}")
    queries = dense.embed_queries(spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, query string"), "query", "embedding", embedder)
    return fusion.Search(chunks, queries, floor=floor, label=manifest.get("version_label"), index=index, profile=profile)


def search_text(
    spark: SparkSession, paths: list[str], text: str, k: int = V.TOP_K, full: bool = False, embedder=None, floor: float = V.DENSE_FLOOR, profile: V.Profile = V.GENERAL
) -> str:
    """The results of one query as a text block."""
    s = open_search(spark, paths, [text], embedder, floor, profile)
    verdict = s.verdicts().first()
    blocks = [r["block"] for r in rendering.result_blocks(s.results(k), full).orderBy("rank").collect()]
    head = [V.RESULTS_HEAD.format(n=len(blocks), query=text, scope=verdict["version_label"])]
    if verdict["insufficient_evidence"]:
        head.append(V.LOW_CONFIDENCE.format(note=verdict["notes"][0]))
    return "\n".join([*head, "", *blocks, V.RESULTS_TAIL.format(scope=verdict["version_label"])])


def retrieve(spark: SparkSession, paths: list[str], text: str, k: int = V.TOP_K, embedder=None, profile: V.Profile = V.GENERAL) -> dict:
    """Raw results of one query: scope, verdict, confidence and rows."""
    s = open_search(spark, paths, [text], embedder, profile=profile)
    v = s.verdicts().first()
    rows = [r.asDict() for r in s.results(k).orderBy("rank").drop("query_id", "chunk_id").collect()]  # at most MAX_TOP_K
    return {"version": v["version_label"], "insufficient_evidence": v["insufficient_evidence"], "confidence": v["confidence"], "results": rows}


def answer(spark: SparkSession, paths: list[str], text: str, complete, k: int = V.TOP_K, embedder=None, profile: V.Profile = V.GENERAL) -> dict:
    """{answer, version, insufficient, sources}; ``complete(system, user)`` is only called with enough evidence."""
    s = open_search(spark, paths, [text], embedder, profile=profile)
    v = s.verdicts().first()
    if v["insufficient_evidence"]:
        return {"answer": f"Scope: {v['version_label']}. {V.NO_CONTEXT}", "version": v["version_label"], "insufficient": True, "sources": []}
    told = rendering.prompts(s.verdicts(), s.results(k)).first()
    if told is None:
        return {"answer": f"Scope: {v['version_label']}. {V.NO_CONTEXT}", "version": v["version_label"], "insufficient": True, "sources": []}
    return {"answer": complete(system=told["system"], user=f"Question: {text}"), "version": v["version_label"], "insufficient": False, "sources": list(told["sources"])}


def digest_text(spark: SparkSession, path: str, section: str = "") -> str:
    """Headings of a Markdown file, or the first section whose heading holds a word."""
    doc = spark.read.text(path, wholetext=True).select(F.lit(1).alias("doc_id"), F.col("value").alias("text"))
    if not section.strip():
        return "\n".join(r["line"] for r in rendering.headings(doc).orderBy("line_no").collect())
    found = rendering.sections(doc, section.strip()).first()
    return found["section"].rstrip("\n") if found else f"No section matching {section!r}."
