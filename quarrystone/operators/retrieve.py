"""Retrieval for a task: files, symbols, the flow between the files, and tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import graph, rank, report
from quarrystone.session import shuffled, staged


@dataclass
class Index:
    """The tables of an indexed repository; ``edges`` are kept, not resolved anew for each task."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    edges: DataFrame


@dataclass
class Retrieval:
    files: DataFrame
    symbols: DataFrame
    flow: DataFrame
    tests: DataFrame


def rank_files(index: Index, task: str, hints: rank.Hints = rank.Hints(), rounds: int = 30) -> DataFrame:
    """``(path, score)`` of the files with a positive score: keyword scores and hints, neighbours of what matched, a
    nudge of up to 8 by fused rankings (keywords, similarity, centrality), and hints again by their kind."""
    spark = index.files.sparkSession
    terms = rank.terms_of(spark, task)
    table = staged(hints.table(spark), "hints")
    base = staged(rank.merge_scores(rank.score_files(index.files, index.imports, index.symbols, terms), rank.hint_matches(index.files, table)), "scores")
    matched = base.where("score > 0")
    boost = F.when(F.col("active"), 30).otherwise(0) + F.when(F.col("opened"), 10).otherwise(0) + F.when(F.col("changed"), 20).otherwise(0)
    seeds = matched.select("path", F.col("score").cast("double").alias("weight")).union(table.select("path", boost.cast("double")))
    central = rank.scaled(graph.pagerank(index.files.select("path"), index.edges, seeds, rounds=rounds), "rank")
    rankings = [
        rank.ranked(matched, [F.desc("score"), F.col("path")]),
        rank.ranked(table.where("similarity is not null"), [F.desc("similarity"), F.col("path")]),
        rank.ranked(central.where("rank >= 0.05").withColumnRenamed("rank", "value"), [F.desc("value"), F.col("path")]),
    ]
    fused = rank.scaled(rank.fuse(rankings), "score").withColumnRenamed("score", "fused")
    boosted = rank.boost_by_neighbours(base, index.edges, matched, bool(set(terms) & set(rank.TEST_WORDS)))
    nudge = F.when((F.col("score") > 0) & (F.col("fused") >= 0.05), T.half_up(F.col("fused") * 8)).otherwise(0)
    nudged = boosted.join(shuffled(fused), "path", "left").select("path", (F.col("score") + F.coalesce(nudge, F.lit(0))).alias("score")).where("score > 0")
    return rank.boost_by_hints(nudged, table)


def retrieve(index: Index, task: str, hints: rank.Hints = rank.Hints(), files: int = 16, symbols: int = 28) -> Retrieval:
    spark = index.files.sparkSession
    terms = rank.terms_of(spark, task)
    squashed = spark.range(1).select(T.squash(F.lit(task))).first()[0]
    scores = staged(rank_files(index, task, hints), "ranked")
    chosen = staged(rank.top_files(rank.expand(scores, index.edges), files), "chosen")
    named = rank.score_symbols(index.symbols.join(shuffled(scores), "path", "left_semi"), index.imports, scores, terms, squashed)
    return Retrieval(chosen.orderBy(F.desc("score"), "path"), named.where("score > 0").orderBy(F.desc("score"), "name", "path", "id").limit(symbols), report.dependency_flow(chosen, index.edges), report.related_tests(index.files, index.symbols, chosen, terms))
