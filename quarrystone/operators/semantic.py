"""A stored index of chunk vectors: built anew only where chunks changed, searched, and fused with keyword retrieval."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import chunks, rank, retrieve, search
from quarrystone.session import staged

Embed = Callable[[DataFrame, str, str], DataFrame]
STORED = "id string, path string, kind string, symbol string, start_line int, end_line int, hash string, provider string, vector array<float>"


@dataclass
class Refreshed:
    """The index after a refresh, and how many chunks there are, were embedded, were kept, and were dropped."""

    rows: DataFrame
    chunks: int
    embedded: int
    reused: int
    pruned: int


def chunk_files(files: DataFrame, symbols: DataFrame, imports: DataFrame, most_chars: int = 1500, per_file: int = 200) -> DataFrame:
    """``(id, path, kind, symbol, start_line, end_line, text, hash)``: of each file with a text its summary, and its symbols
    or, where it has none, windows of its lines."""
    known = files.where("path is not null and text is not null")
    summary = chunks.file_summaries(known, symbols, imports).join(known.select("path", F.size(T.lines(F.col("text"))).alias("n")), "path")
    whole = summary.select(F.concat("path", F.lit("#file")).alias("id"), "path", F.lit("file-summary").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit(1).alias("start_line"), F.col("n").alias("end_line"), F.col("doc").alias("text"), "hash")
    named = chunks.symbol_chunks(known, symbols, most_chars, per_file)
    rest = known.join(symbols.select("path").distinct(), "path", "left_anti")
    body = chunks.cut_body(F.col("body"), most_chars)
    text = F.concat(chunks.header(F.col("path"), F.concat(F.lit("lines "), "start_line", F.lit("-"), "end_line")), F.lit("\n"), body)
    windows = chunks.line_windows(rest).select(F.concat("path", F.lit("#window:"), "start_line").alias("id"), "path", F.lit("window").alias("kind"), F.lit(None).cast("string").alias("symbol"), "start_line", "end_line", text.alias("text")).withColumn("hash", T.short_hash(F.col("text")))
    return whole.unionByName(named).unionByName(windows)


def refresh(made: DataFrame, stored: DataFrame | None, provider: str, embed: Embed = search.hashed_embedding) -> Refreshed:
    """Embeds the chunks that aren't stored or have another hash, keeps the others, and drops what is no chunk any more.
    Vectors of another provider can't be compared: an index of one is started over."""
    made = staged(made.dropDuplicates(["id"]), "chunks")
    old = stored.where(F.col("provider") == provider) if stored is not None else made.sparkSession.createDataFrame([], STORED)
    known = old.dropDuplicates(["id"])
    fresh = chunks.stale_chunks(made, known)
    vectors = embed(fresh, "id", "text")
    names = [x.split()[0] for x in STORED.split(", ")]
    added = fresh.join(vectors, "id").withColumn("provider", F.lit(provider)).select(*names)
    result = staged(chunks.upsert(chunks.prune(known, made, "id"), added.select(*names), "id").select(*names), "vectors")
    total, new = made.count(), fresh.count()
    gone = known.join(made.select("id"), "id", "left_anti").count()
    return Refreshed(result, total, new, total - new, gone)


def hits(stored: DataFrame, asked: DataFrame, k: int = 24, least: float = 0.25) -> DataFrame:
    """``(query, id, path, similarity)``: for each ``(query, vector)`` the nearest chunks."""
    near = search.top_k(asked, stored, "query", "id", k=k, least=least)
    return near.join(stored.select("id", "path").dropDuplicates(["id"]), "id").select("query", "id", "path", "similarity")


def decorated(found: DataFrame, stored: DataFrame, texts: DataFrame, lines: int = 12) -> DataFrame:
    """Hits with place, similarity to four digits, and the first lines of the chunk."""
    where = stored.select("id", "kind", "symbol", "start_line", "end_line").dropDuplicates(["id"])
    joined = found.join(where, "id").join(texts.select("path", "text"), "path", "left")
    count = F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(lines))
    shown = F.when(count >= 1, F.array_join(F.slice(T.lines(F.col("text")), F.greatest(F.col("start_line"), F.lit(1)), count), "\n"))
    return joined.select("query", "id", "path", "kind", "symbol", "start_line", "end_line", F.round("similarity", 4).alias("similarity"), shown.alias("snippet"))


def hybrid(index: retrieve.Index, stored: DataFrame | None, task: str, embed: Embed = search.hashed_embedding, hints: rank.Hints = rank.Hints(), k: int = 24) -> retrieve.Retrieval:
    """Retrieval with the best chunk of each file as a hint; without an index, or without a hit, by keywords alone."""
    if stored is None:
        return retrieve.retrieve(index, task, hints)
    spark = index.files.sparkSession
    asked = embed(spark.createDataFrame([(0, task)], "query int, text string"), "query", "text")
    similar = staged(search.pooled(hits(stored, asked, k)), "similar")
    if similar.isEmpty():
        return retrieve.retrieve(index, task, hints)
    return retrieve.retrieve(index, task, rank.Hints(hints.active, hints.opened, hints.changed, similar))
