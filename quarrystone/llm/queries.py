"""The queries of the llm subpackage over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import leaks, mixing, neighbours, peaks, provenance, splitting, truncation


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.not_hand_written(table(spark, folder, "files"), table(spark, folder, "upstream_files")).select("path")


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    found = provenance.not_hand_written(table(spark, folder, "files"), table(spark, folder, "upstream_files"))
    return found.groupBy("reason").agg(F.count("*").alias("files"), F.round(F.avg("probability"), 3).alias("mean_probability"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    grouped = peaks.clusters(table(spark, folder, "chunks"))
    return grouped.where("id <> first_id").select("first_id", "id")


def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks")
    return peaks.describe(peaks.clusters(chunks), chunks)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, folder, "chunks"))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, folder, "chunks")).withColumn("cosine", F.round("cosine", 6))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized(table(spark, folder, "code_chunks"), table(spark, folder, "chunk_options"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(table(spark, folder, "code_chunks"), table(spark, folder, "chunk_options"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items")
    return leaks.leak_report(leaks.leaks(table(spark, folder, "documents"), items), items)


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.select_mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"))


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_reasons": p1_reasons,
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p7_selection": p7_selection,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_rates": p8_rates,
}
