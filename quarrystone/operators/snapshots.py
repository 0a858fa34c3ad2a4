"""What changed between full snapshots of a table of files."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.session import remove, shared_dir, shuffle_partitions, staged


@dataclass(frozen=True)
class SnapshotParams:
    """buckets: of the index, 0 for the session's number of shuffle partitions. small: repos up to which their list is
    broadcast; a longer one is joined by shuffle."""

    buckets: int = 0
    small: int = 200_000


def normal_path(path: Column) -> Column:
    """Forward slashes, without empty and ``.`` segments; null if nothing is left."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    return F.nullif(F.array_join(parts, "/"), F.lit(""))


def normal_hash(digest: Column) -> Column:
    """Lower-case hex digits, without the name of the algorithm; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(digest)), r"^(?:sha-?256[:=\-]|0x)", ""), F.lit(""))


def listings(snapshots: DataFrame) -> DataFrame:
    """``(snapshot_no, loaded_at, repo, path, hash)`` of the rows that count."""
    path = normal_path(F.col("path"))
    rows = snapshots.select("snapshot_no", "loaded_at", F.col("repo"), path.alias("path"), normal_hash(F.col("content_hash")).alias("hash"))
    return rows.where("snapshot_no is not null and path is not null").withColumn("repo", F.coalesce("repo", F.split_part("path", F.lit("/"), F.lit(1))))


def latest(rows: DataFrame) -> DataFrame:
    """Of several rows for a file in a snapshot the one loaded last; of equally late ones that with a hash, then the larger."""
    order = Window.partitionBy("snapshot_no", "path").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("hash").desc_nulls_last(), "repo")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def snapshot_changes(snapshots: DataFrame, params: SnapshotParams = SnapshotParams()) -> DataFrame:
    """``(snapshot_no, path, change, old_hash, new_hash)`` of every file added, removed or changed in a snapshot.

    The listings are written once, by snapshot and bucketed by path. An index of path to last hash in the same buckets
    stands for the snapshots seen so far: the next listing is merged with it without a shuffle, what comes out is the
    next index with the changes marked. The changes are written apart and the index before is deleted, so that there
    are never more than two, and every row is read a fixed number of times, however many snapshots there are.

    Rows without a path or a snapshot number don't count. A repo without rows in a snapshot keeps its files, and is
    compared with the last snapshot that had it; a repo's first snapshot gives no changes. A null hash leaves the last
    known hash in force, also that of a file that was gone in between; a hash that follows none is no change. Repeated
    rows are one; an empty table gives no rows.
    """
    spark = snapshots.sparkSession
    rows = listings(snapshots)
    buckets = params.buckets or shuffle_partitions(spark)
    folder, run = shared_dir(spark), uuid.uuid4().hex

    def bucketed(df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).bucketBy(buckets, "path").sortBy("path").option("path", f"{folder}/{name}").saveAsTable(name)
        return spark.table(name)

    def drop(name: str) -> None:
        spark.sql(f"drop table {name}")
        remove(spark, f"{folder}/{name}")

    delivered = staged(rows.select("snapshot_no", "repo").distinct(), "delivered")
    numbers = [r[0] for r in delivered.select("snapshot_no").distinct().orderBy("snapshot_no").collect()]
    listing = f"snapshot_listing_{run}"
    every = bucketed(latest(rows.repartition(buckets, "path")).select("path", "repo", "hash", "snapshot_no"), listing, "snapshot_no") if numbers else None
    first = delivered.groupBy("repo").agg(F.min("snapshot_no").alias("first"))
    index, name, found = None, None, []
    for step, number in enumerate(numbers):
        fresh = every.where(F.col("snapshot_no") == number).select("path", F.col("repo").alias("new_repo"), F.col("hash").alias("new_hash"), F.lit(True).alias("here"))
        if index is None:
            merged = fresh.select("path", F.col("new_repo").alias("repo"), F.col("new_hash").alias("hash"), F.lit(True).alias("present"), F.lit(None).cast("string").alias("change"), F.lit(None).cast("string").alias("old_hash"))
        else:
            repos = first.where(F.col("first") <= number).join(delivered.where(F.col("snapshot_no") == number).select("repo", F.lit(True).alias("now")), "repo", "left").withColumn("before", F.col("first") < number)
            if repos.count() <= params.small:
                repos = F.broadcast(repos)
            both = index.drop("change", "old_hash").join(fresh, "path", "full").withColumn("repo", F.coalesce("new_repo", "repo")).join(repos, "repo", "left")
            gone = F.col("here").isNull() & F.col("present") & F.col("now").isNotNull()
            added = F.col("here").isNotNull() & ~F.coalesce("present", F.lit(False)) & F.col("before")
            changed = F.col("here").isNotNull() & F.coalesce("present", F.lit(False)) & (F.col("new_hash") != F.col("hash"))
            change = F.when(gone, "removed").when(added, "added").when(changed, "changed")
            merged = both.select("path", "repo", F.coalesce("new_hash", "hash").alias("hash"), (F.col("here").isNotNull() | (F.coalesce("present", F.lit(False)) & ~gone)).alias("present"), change.alias("change"), F.when(change.isNotNull() & F.col("present"), F.col("hash")).alias("old_hash"))
        following = f"snapshot_index_{run}_{step}"
        index = bucketed(merged, following)
        if name:
            drop(name)
            marked = index.where("change is not null").select(F.lit(number).alias("snapshot_no"), "path", "change", "old_hash", F.when(F.col("change") != "removed", F.col("hash")).alias("new_hash"))
            found.append(staged(marked, "changes"))
        name = following
    for last in (name, listing) if numbers else ():
        drop(last)
    empty = spark.createDataFrame([], f"snapshot_no {rows.schema['snapshot_no'].dataType.simpleString()}, path string, change string, old_hash string, new_hash string")
    return reduce(DataFrame.unionByName, found, empty)
