"""Change capture: events of files are reduced to the last one of each path and applied to a stored index."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.operators.chunks import upsert


def last_events(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key; a change after a deletion, or the other way round, cancels it."""
    window = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return events.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def apply_changes(stored: DataFrame, events: DataFrame, key: str = "path", digest: str = "content_hash", order: str = "seq") -> DataFrame:
    """The stored rows after ``events`` (the stored columns, ``op`` of upsert or delete, and ``order``).

    Upserts whose hash is stored already change nothing; an upsert without a hash is an unreadable file and deletes.
    """
    last = last_events(events, key, order)
    gone = last.where((F.col("op") == "delete") | F.col(digest).isNull()).select(key)
    fresh = last.where((F.col("op") != "delete") & F.col(digest).isNotNull()).select(stored.columns)
    same = stored.select(key, digest)
    return upsert(stored, fresh.join(same, [key, digest], "left_anti"), key, gone)


class StoredIndex:
    """A table that is replaced as a whole: each version is a folder of its own, and a pointer names the current one,
    so that a writer that dies leaves the last version in place."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self) -> str:
        return f"{self.folder}/current"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, place: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(place)

    def exists(self) -> bool:
        return self._files().exists(self._path(self._pointer()))

    def read(self) -> DataFrame:
        version = self.spark.read.text(self._pointer()).first()[0]
        return self.spark.read.parquet(f"{self.folder}/{version}")

    def replace(self, rows: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{version}")
        fs, fresh = self._files(), f"{self.folder}/current-{version}"
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.text(fresh)
        if self.exists():
            fs.delete(self._path(self._pointer()), True)
        fs.rename(self._path(fresh), self._path(self._pointer()))

    def clear(self) -> None:
        self._files().delete(self._path(self.folder), True)


def run_changes(spark: SparkSession, source: str, schema: str, index: StoredIndex, checkpoint: str, after: Callable[[DataFrame], None] | None = None, order: str = "seq"):
    """Applies all event files that are there and weren't yet applied, one batch after the other, and returns the query.

    ``after`` is given each batch's last events, as for embedding what changed.
    """

    def batch(events: DataFrame, number: int) -> None:
        index.replace(apply_changes(index.read(), events, order=order))
        if after:
            after(last_events(events, "path", order))

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """``(start, event_type, n)`` of events by tumbling windows, for tables and streams; later ones than ``late`` are
    not waited for in a stream."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(time, late)
    return timed.groupBy(F.window(time, size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
