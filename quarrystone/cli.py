"""python -m quarrystone.cli index|search|embed|semantic|impact|path|report FOLDER [ARGUMENTS]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import chunks, extract, graph, report, resolve, retrieve, search
from quarrystone.session import build_session, staged
from quarrystone.sources import files as sources


def build_index(spark: SparkSession, folder: str) -> retrieve.Index:
    scanned = staged(sources.scan(spark, folder), "files")
    indexed = staged(extract.index_files(scanned), "indexed")
    files = scanned.join(indexed.select("path", "module"), "path").withColumn("decorators", F.array().cast("array<string>"))
    symbols, imports = extract.symbols_of(indexed), extract.imports_of(indexed)
    return retrieve.Index(staged(files, "files"), symbols, imports, staged(resolve.file_edges(resolve.resolve_imports(imports, files)), "edges"))


def match_path(files: DataFrame, wanted: str) -> str | None:
    """The file of this path, else the first whose path contains it, whatever the case."""
    row = files.where(F.lower("path").contains(wanted.lower())).orderBy((F.col("path") != wanted), "path").select("path").first()
    return row[0] if row else None


def embedded(index: retrieve.Index) -> DataFrame:
    made = chunks.symbol_chunks(index.files, index.symbols).select("id", "path", "start_line", "end_line", "text")
    whole = chunks.line_windows(index.files.join(index.symbols.select("path").distinct(), "path", "left_anti"))
    windows = whole.select(F.concat("path", F.lit("#window:"), "start_line").alias("id"), "path", "start_line", "end_line", F.col("body").alias("text"))
    every = made.unionByName(windows)
    return every.join(search.hashed_embedding(every, "id", "text"), "id")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarrystone")
    parser.add_argument("command", choices=["index", "search", "embed", "semantic", "impact", "path", "report"])
    parser.add_argument("folder")
    parser.add_argument("arguments", nargs="*")
    parser.add_argument("--depth", type=int, default=4)
    parser.add_argument("--limit", type=int, default=12)
    options = parser.parse_args(argv)
    spark = spark or build_session()
    index = build_index(spark, options.folder)
    known = [match_path(index.files, a) for a in options.arguments] if options.command in ("impact", "path") else []
    if None in known or (options.command == "path" and len(known) != 2) or (options.command == "impact" and len(known) != 1):
        print("unknown file", file=sys.stderr)
        return 1
    if options.command == "index":
        out: object = {"files": index.files.count(), "symbols": index.symbols.count(), "edges": index.edges.count()}
    elif options.command == "search":
        found = retrieve.retrieve(index, " ".join(options.arguments))
        out = {"files": [r.asDict() for r in found.files.limit(options.limit).collect()], "symbols": [r.asDict() for r in found.symbols.limit(20).collect()]}
    elif options.command == "embed":
        out = embedded(index).agg(F.count("*").alias("chunks"), F.count_distinct("path").alias("files")).first().asDict()
    elif options.command == "semantic":
        query = search.hashed_embedding(spark.createDataFrame([(0, " ".join(options.arguments))], "q int, text string"), "q", "text")
        hits = search.top_k(query, embedded(index), "q", "id", k=options.limit, least=0.25)
        out = [r.asDict() for r in hits.select("id", F.round("similarity", 4).alias("similarity")).orderBy(F.desc("similarity"), "id").collect()]
    elif options.command == "impact":
        seeds = spark.createDataFrame([(known[0],)], "path string")
        out = sorted(r["path"] for r in graph.impact_set(index.edges, seeds, options.depth).select("path").collect())
    elif options.command == "path":
        found = graph.shortest_path(index.edges, *known)
        out = {"found": found is not None, "path": found or [], "hops": len(found) - 1 if found else None}
    else:
        usage = resolve.usage_counts(resolve.symbol_references(resolve.resolve_imports(index.imports, index.files), index.symbols))
        print(report.build_report(index.files, index.symbols, index.imports, index.edges, usage).markdown())
        return 0
    print(json.dumps(out, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
