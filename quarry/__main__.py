"""Command line: ``python -m quarry chunk|index|search ...``."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import SparkSession

from quarry.functions import text
from quarry.operators import chunking, index
from quarry.plans import hybrid
from quarry.sources import readers, sinks


def _named(place: str | None) -> Callable | None:
    """A function of one's own, named as ``package.module:function``: takes a text column, gives an array."""
    if not place:
        return None
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def main() -> None:
    parser = argparse.ArgumentParser(prog="quarry")
    commands = parser.add_subparsers(dest="command", required=True)
    chunk = commands.add_parser("chunk", help="markdown folder to chunk table")
    chunk.add_argument("markdown")
    chunk.add_argument("chunks")
    build = commands.add_parser("index", help="chunk table to postings, lengths and n-grams")
    build.add_argument("chunks")
    build.add_argument("index")
    build.add_argument("--embed", help="package.module:function that makes vectors of a text column, such as quarry.functions.vectors:hashed_words")
    build.add_argument("--analyse", help="package.module:function that makes tokens of a text column")
    find = commands.add_parser("search", help="search a chunk table")
    find.add_argument("chunks")
    find.add_argument("query")
    find.add_argument("--mode", default="hybrid", choices=hybrid.MODES)
    find.add_argument("--index", help="index of these chunks")
    find.add_argument("--embed", help="what made the index's vectors")
    find.add_argument("--analyse", help="what made the index's tokens")
    find.add_argument("--words", help="JSON file of a user's words, kept as single tokens (for an index that was made with them)")
    find.add_argument("--top", type=int, default=10)
    build.add_argument("--words", help="JSON file of a user's words, kept as single tokens")
    a = parser.parse_args()
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    how = {}
    if a.command != "chunk":
        how = {name: hook for name in ("analyse", "embed") if (hook := _named(getattr(a, name)))}
        if a.words:
            how["analyse"] = text.tokens_with_words([r["word"] for r in readers.user_words(spark, a.words).collect()])  # a user's list
    if a.command == "chunk":
        docs = readers.markdown_folder(spark, a.markdown)
        found = chunking.with_toc(chunking.chunks(docs)).join(docs.select("doc_id", "source", "year_month"), "doc_id")
        sinks.write_chunks(found, a.chunks)
    elif a.command == "index":
        index.write_index(spark.read.parquet(a.chunks), a.index, **how)
    else:
        asked = spark.createDataFrame([(1, a.query)], "query_id long, query string")
        stored = index.read_index(spark, a.index, **how) if a.index else None
        hybrid.search(asked, spark.read.parquet(a.chunks), mode=a.mode, top_n=a.top, stored=stored).orderBy("rk").show(a.top, 100)


if __name__ == "__main__":
    main()
