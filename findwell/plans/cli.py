"""Command line: index, search, delete, watch, server, status."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from findwell import __version__
from findwell.config import PLAIN_MIN_SCORE, Config, SearchQuery, load_config, save_config
from findwell.sources.writers import WRITERS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="findwell")
    p.add_argument("--store", default="./findwell-store")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="search the store")
    s.add_argument("words", nargs="+")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--keyword", action=argparse.BooleanOptionalAction, default=True)
    s.add_argument("--semantic", action=argparse.BooleanOptionalAction, default=True)
    s.add_argument("--fuzzy", action="store_true")
    s.add_argument("--rerank", action="store_true")
    s.add_argument("--min-score", type=float)
    s.add_argument("--min-keyword-score", type=float)
    s.add_argument("--min-semantic-score", type=float)
    s.add_argument("--output", choices=list(WRITERS), default="text")
    i = sub.add_parser("index", help="index a folder or a file")
    i.add_argument("path")
    d = sub.add_parser("delete", help="delete documents by id, or by the path of their file")
    d.add_argument("ids", nargs="+")
    d.add_argument("--path", action="store_true", help="the arguments are paths")
    w = sub.add_parser("watch", help="run on a folder, or keep the list of folders in the configuration file")
    w.add_argument("action", choices=["run", "add", "remove", "list"])
    w.add_argument("folder", nargs="?")
    w.add_argument("--once", action="store_true")
    v = sub.add_parser("server", help="answer over HTTP, and follow the configured folders")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8080)
    sub.add_parser("status", help="what the store holds")
    sub.add_parser("version")
    return p


def least_scores(args, config: Config | None) -> tuple[float, float, float]:
    """(common, keyword, semantic): as given, else as configured, else the fixed default for want of a configuration."""
    common = args.min_score or 0.0
    plain = (config.search.min_keyword_score, config.search.min_semantic_score) if config else (PLAIN_MIN_SCORE, PLAIN_MIN_SCORE)
    own = [x if x is not None else 0.0 if args.min_score is not None else y for x, y in zip((args.min_keyword_score, args.min_semantic_score), plain)]
    return common, own[0], own[1]


def watch_list(args, config: Config, path: str | None, out) -> int:
    """Change or show the folders that the configuration file names."""
    folders = list(config.directories)
    if args.action == "list":
        print("\n".join(folders), file=out)
        return 0
    if not path or not args.folder:
        print("a configuration file and a folder are needed", file=out)
        return 1
    folder = os.path.abspath(args.folder)
    if args.action == "add":
        folders = sorted({*folders, folder})
    elif folder in folders:
        folders.remove(folder)
    else:
        print(f"{folder} isn't watched", file=out)
        return 1
    save_config(replace(config, directories=tuple(folders)), path)
    return 0


def main(argv: list[str] | None = None, spark=None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__, file=out)
        return 0
    loaded = load_config(args.config) if args.config and os.path.exists(args.config) else None
    config = loaded or Config()
    if args.command == "watch" and args.action != "run":
        return watch_list(args, config, args.config, out)
    from pyspark.sql import SparkSession

    from findwell.plans.engine import SearchEngine

    spark = spark or SparkSession.builder.appName("findwell").getOrCreate()
    engine = SearchEngine(spark, args.store, config, config_path=args.config)
    if args.command == "search":
        q = SearchQuery(" ".join(args.words), args.limit, args.offset, args.keyword, args.semantic, args.fuzzy, *least_scores(args, loaded))
        print(WRITERS[args.output](engine.search(q, args.rerank, auto_fuzzy=True)), file=out)
    elif args.command == "index":
        print(engine.sync_directory(args.path) if os.path.isdir(args.path) else {"indexed": int(engine.index_file(os.path.abspath(args.path)))}, file=out)
    elif args.command == "delete":
        named = spark.createDataFrame([(os.path.abspath(i) if args.path else i,) for i in args.ids], "path string" if args.path else "id string")
        engine.delete_files(named) if args.path else engine.delete(named)
    elif args.command == "watch":
        running = [engine.watch(args.folder, args.once)] if args.folder else engine.watch_configured()
        for query in running:
            query.awaitTermination()
    elif args.command == "server":
        from findwell.plans.server import serve

        engine.watch_configured()
        serve(engine, args.host, args.port).serve_forever()
    else:
        print(engine.status(), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
