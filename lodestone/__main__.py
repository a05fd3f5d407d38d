"""Command line: build, examples, merge, search, ask, digest, evaluate, get-index, serve, tools, mcp-config, doctor."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .config import EngineConfig


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="index a tree of files")
    b.add_argument("root")
    b.add_argument("out")
    b.add_argument("--shard", help="i/n")
    b.add_argument("--ref")
    x = sub.add_parser("examples", help="index a tree of examples")
    x.add_argument("root")
    x.add_argument("out")
    x.add_argument("--release", default="")
    m = sub.add_parser("merge", help="join shards")
    m.add_argument("out")
    m.add_argument("parts", nargs="+")
    s = sub.add_parser("search", help="search the configured indexes")
    s.add_argument("words", nargs="+")
    s.add_argument("-k", type=int, default=8)
    s.add_argument("--full", action="store_true")
    a = sub.add_parser("ask", help="search, and answer by a model")
    a.add_argument("words", nargs="+")
    a.add_argument("-k", type=int, default=8)
    a.add_argument("--model", default="")
    a.add_argument("--provider", default="")
    d = sub.add_parser("digest", help="headings or a section of a Markdown file")
    d.add_argument("section", nargs="*")
    e = sub.add_parser("eval", help="quality on evaluation queries")
    e.add_argument("gold")
    g = sub.add_parser("get-index", help="fetch a published index")
    g.add_argument("listing", help="URL of the listing of releases")
    g.add_argument("--channel", default="main")
    g.add_argument("--prefix", default="index-")
    replace = g.add_mutually_exclusive_group()
    replace.add_argument("--force", action="store_true")
    replace.add_argument("--if-missing", action="store_true")
    w = sub.add_parser("serve", help="answer over HTTP")
    w.add_argument("--host", default="127.0.0.1")
    w.add_argument("--port", type=int, default=8000)
    sub.add_parser("tools", help="serve tools to an editor over standard input and output")
    sub.add_parser("mcp-config", help="print the editor's entry for the tools")
    sub.add_parser("doctor", help="check the set-up")
    return p


def _evaluate(spark, config: EngineConfig, path: str) -> int:
    from pyspark.sql import functions as F

    from .operators import evaluation
    from .plans import pipeline
    from .sources import indexes

    channel = indexes.read_manifest(spark, config.index_dir).get("channel")
    gold = indexes.read_gold(spark, path).filter(evaluation.applies_to(F.col("channels"), channel)).collect()
    table = spark.createDataFrame([(n, g["kind"], g["relevant"]) for n, g in enumerate(gold, 1)], "query_id long, kind string, relevant array<string>")
    found = pipeline.open_search(spark, config.indexes(), [g["query"] for g in gold], profile=config.profile)
    result = evaluation.quality(evaluation.first_hits(found.results(), table), found.verdicts()).first()
    print(result.asDict())
    evaluation.floor_sweep(found.verdicts(), table).orderBy("floor").show(20)
    return 0 if result["passed"] else 1


def main(argv: list[str] | None = None, complete=None) -> int:
    """Run a command; ``complete`` stands in for a model service."""
    args = parser().parse_args(argv)
    config = EngineConfig.from_env()
    if args.command == "mcp-config":
        from .surfaces import tools

        print(json.dumps(tools.editor_config(config), indent=2))
        return 0

    from pyspark.sql import SparkSession

    from .plans import pipeline
    from .sources import archives
    from .surfaces import doctor, models, tools, web

    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if args.command == "build":
        pipeline.build_tree_index(spark, args.root, args.out, shard=args.shard, ref=args.ref, profile=config.profile)
    elif args.command == "examples":
        pipeline.build_examples_index(spark, args.root, args.out, release=args.release, profile=config.profile)
    elif args.command == "merge":
        pipeline.merge(spark, args.out, args.parts)
    elif args.command == "search":
        print(pipeline.search_text(spark, config.indexes(), " ".join(args.words), args.k, args.full, profile=config.profile))
    elif args.command == "ask":
        def by_service(system: str, user: str) -> str:
            return models.Model.of(config, args.provider, args.model).complete(system, user)

        told = pipeline.answer(spark, config.indexes(), " ".join(args.words), complete or by_service, args.k, profile=config.profile)
        print("\n".join([f"[scope] {told['version']}", told["answer"], *(f"  {s}" for s in told["sources"])]))
    elif args.command == "digest":
        print(pipeline.digest_text(spark, config.digest, " ".join(args.section)))
    elif args.command == "eval":
        return _evaluate(spark, config, args.gold)
    elif args.command == "get-index":
        client = archives.Client(os.environ.get("LODESTONE_TOKEN", ""), os.environ.get("LODESTONE_TOKEN_HOST", ""))
        try:
            manifest = pipeline.get_index(spark, args.listing, args.channel, config.index_dir, client, args.prefix, args.force, args.if_missing)
        except Exception as e:
            print(f"error: get-index failed: {e}", file=sys.stderr)
            return 1
        print(f"index at {config.index_dir}, scope {manifest.get('version_label', args.channel)}")
    elif args.command == "serve":
        web.server(web.Service(spark, config), args.host, args.port).serve_forever()
    elif args.command == "tools":
        tools.Tools(spark, config).serve(sys.stdin, sys.stdout)
    else:
        text, ready = doctor.report(spark, config)
        print(text)
        return 0 if ready else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
