"""Command line: ingest, merge, search, serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from clauseworks.plans import service, shards
from clauseworks.plans.engine import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clauseworks")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest", help="parse, roll up and index a corpus")
    ingest.add_argument("--corpus-dir", required=True)
    ingest.add_argument("--storage-dir", required=True)
    ingest.add_argument("--cache-path")
    ingest.add_argument("--shard", help="number/size: one shard of so many documents")
    shard = sub.add_parser("ingest-shard", help="ingest one shard of a corpus")
    shard.add_argument("--corpus-dir", required=True)
    shard.add_argument("--storage-dir", required=True)
    shard.add_argument("--cache-path")
    shard.add_argument("--shard-index", type=int, required=True, help="from 0")
    shard.add_argument("--shard-size", type=int, required=True, help="documents of record in a shard")
    every = sub.add_parser("ingest-shards", help="ingest all shards that are not done yet; one that fails stops no other")
    every.add_argument("--corpus-dir", required=True)
    every.add_argument("--storage-dir", required=True)
    every.add_argument("--cache-path")
    every.add_argument("--shard-size", type=int, default=300, help="documents of record in a shard")
    for name, what in (("compact", "make one segment of each collection"), ("vacuum", "delete what only old versions have")):
        keep = sub.add_parser(name, help=what)
        keep.add_argument("--storage-dir", required=True)
        if name == "vacuum":
            keep.add_argument("--keep-hours", type=float, default=168.0)
    merge = sub.add_parser("merge", aliases=["merge-shards"], help="merge shards")
    merge.add_argument("--storage-dirs", "--shard-storage-dirs", required=True, help="separated by commas")
    merge.add_argument("--cache-paths", "--shard-cache-paths", default="", help="separated by commas")
    merge.add_argument("--output-storage-dir", required=True)
    merge.add_argument("--output-cache-path")
    search = sub.add_parser("search", help="hybrid search")
    search.add_argument("query")
    search.add_argument("--storage-dir", required=True)
    search.add_argument("--limit", type=int, default=5)
    search.add_argument("--act")
    search.add_argument("--provision-type")
    serve = sub.add_parser("serve", help="answer over HTTP")
    serve.add_argument("--storage-dir", required=True)
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    sub.add_parser("mcp", help=f"answer tool calls on standard input and output; ${service.STORAGE} names the store")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    # the environment is asked before a session is begun
    storage = service.storage_of_environment() if args.command == "mcp" else getattr(args, "storage_dir", None)
    spark = spark or SparkSession.builder.appName("clauseworks").getOrCreate()
    match args.command:
        case "ingest":
            shard = tuple(map(int, args.shard.split("/"))) if args.shard else None
            print(json.dumps(Engine(spark, storage).ingest(args.corpus_dir, args.cache_path, shard), ensure_ascii=False))
        case "ingest-shard":
            got = Engine(spark, storage).ingest(args.corpus_dir, args.cache_path, (args.shard_index, args.shard_size))
            print(json.dumps(got, ensure_ascii=False))
        case "ingest-shards":
            report = shards.ingest(Engine(spark, storage), args.corpus_dir, args.shard_size, args.cache_path)
            print(json.dumps(report, ensure_ascii=False))
            return 1 if report["failed"] else 0
        case "compact":
            Engine(spark, storage).compact()
        case "vacuum":
            print(json.dumps(Engine(spark, storage).vacuum(args.keep_hours)))
        case "merge" | "merge-shards":
            lists = [[x.strip() for x in s.split(",") if x.strip()] for s in (args.storage_dirs, args.cache_paths)]
            print(json.dumps(Engine(spark, args.output_storage_dir).merge(*lists, args.output_cache_path)))
        case "search":
            print(Engine(spark, storage).search_text(args.query, args.limit, args.act, args.provision_type))
        case "serve":
            service.serve(service.Service(Engine(spark, storage)), args.host, args.port)
        case "mcp":
            service.speak(service.Service(Engine(spark, storage)), sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
