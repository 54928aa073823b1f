"""Command line: ``python -m textloom ingest FILE... --stage PATH --collection PATH``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import Config
from .operators import chunking
from .plans.ingest import chunk_files, ingest
from .session import cut
from .sources import readers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("ingest", help="files to chunks, a stage and the points of a collection")
    p.add_argument("files", nargs="*")
    p.add_argument("--stage", required=True, help="folder of chunks and vectors")
    p.add_argument("--collection", help="folder of points")
    p.add_argument("--with-sparse", action="store_true")
    p.add_argument("--recreate", action="store_true", help="forget the points that the collection has")
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--stage-only", action="store_true")
    mode.add_argument("--upsert-only", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Returns 1 if no file could be read, else 0; prints the first chunks and what failed."""
    args = parser().parse_args(argv)
    if not args.upsert_only and not args.files:
        parser().error("files are needed, unless with --upsert-only")
    if not args.stage_only and not args.collection:
        parser().error("--collection is needed, unless with --stage-only")
    spark = spark or SparkSession.builder.getOrCreate()
    chunks, config = None, Config.from_env()
    if not args.upsert_only:
        files = cut(readers.load_files(spark, args.files))
        for r in files.where("error is not null").select("path", "error").toLocalIterator():
            print(f"{r['path']}: {r['error']}", file=sys.stderr)
        if files.where("error is null").isEmpty():
            return 1
        chunks = cut(chunk_files(files, config))
        for r in chunking.summary(chunks).collect():
            print(r["id"][:8], r["n_chars"], r["n_tokens"], r["type"], " > ".join(r["path"]), r["pages"])
    points = ingest(
        chunks, args.stage, args.collection, spark, config=config, with_sparse=args.with_sparse, stage_only=args.stage_only, upsert_only=args.upsert_only, recreate=args.recreate
    )
    if points is not None:
        print(f"{points.count()} points")
    return 0


if __name__ == "__main__":
    sys.exit(main())
