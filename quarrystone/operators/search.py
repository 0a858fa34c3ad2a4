"""Search by vectors: embedding, cosine top-k of a query set against all rows, pooling of chunks to files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarrystone.functions import vectors as V


def hashed_embedding(rows: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """``(key, vector)``: words hashed to signed places and scaled to length 1; a stand-in where no model is at hand."""
    import hashlib
    import re

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body in batch.column(1).to_pylist():
                v = np.zeros(dim, np.float32)
                for word in re.findall(r"[a-z0-9_]+", (body or "").lower()):
                    h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                    v[int.from_bytes(h[:4], "little") % dim] += 1 if h[4] & 1 else -1
                size = np.linalg.norm(v)
                out.append((v / size if size else v).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], names=[key, "vector"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, vector array<float>")


def usable(rows: DataFrame, vector: str, dim: int | None = None) -> DataFrame:
    """Rows with a vector (of ``dim`` entries) that isn't all zero and has no nulls."""
    rows = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()) & F.exists(vector, lambda x: x != 0))
    return rows if dim is None else rows.where(F.size(vector) == dim)


def top_k(queries: DataFrame, rows: DataFrame, query: str, key: str, vector: str = "vector", k: int = 8, least: float = 0.3, block: int = 2048) -> DataFrame:
    """``(query, key, similarity)``: for each query the k rows of the highest cosine of at least ``least``, ties by key.

    Queries are taken in blocks of at most ``block``, each sent to all executors; every partition of the rows is
    multiplied with a block at once and keeps k rows (and ties of the last) for each query, which a window then ranks.
    """
    dims = [r["n"] for r in queries.select(F.size(vector).alias("n")).distinct().collect()]
    asked = usable(queries, vector).select(query, vector)
    total = asked.count()
    kinds = queries.schema[query].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    found = None
    parts = max(1, -(-total // block))
    for number in range(parts):
        part = asked.where(F.pmod(F.xxhash64(query), F.lit(parts)) == number) if parts > 1 else asked
        held = [(r[0], r[1]) for r in part.collect()]
        for dim in dims:
            some = [(i, v) for i, v in held if len(v) == dim]
            if some:
                near = usable(rows, vector, dim).select(key, vector).mapInArrow(_nearest(some, to_arrow_type(queries.schema[query].dataType), query, key, k, least), f"{query} {kinds[0]}, {key} {kinds[1]}, similarity double")
                found = near if found is None else found.union(near)
    if found is None:
        return rows.sparkSession.createDataFrame([], f"{query} {kinds[0]}, {key} {kinds[1]}, similarity double")
    order = Window.partitionBy(query).orderBy(F.desc("similarity"), key)
    return found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def _nearest(held: list[tuple], kind: pa.DataType, query: str, key: str, k: int, least: float):
    names = [i for i, _ in held]
    q = np.array([v for _, v in held], np.float64)
    q /= np.linalg.norm(q, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            near = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
            if near.shape[1] > k:
                limit = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - 1e-9
                near[near < limit[:, None]] = -2
            a, b = np.nonzero(near >= least)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in a], kind), batch.column(0).take(pa.array(b)), pa.array(near[a, b])], names=[query, key, "similarity"])

    return run


def pooled(matches: DataFrame, key: str = "path", within: tuple[str, ...] = ()) -> DataFrame:
    """``(within…, key, similarity)``: the best match of each."""
    return matches.groupBy(*within, key).agg(F.max("similarity").alias("similarity"))


def vector_stats(rows: DataFrame, path: str = "path", vector: str = "vector") -> DataFrame:
    """One row: vectors, different paths, and the size that most vectors have (the larger of equally common ones)."""
    sizes = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("c"))
    dims = sizes.agg(F.max_by("n", F.struct("c", "n")).alias("dims"))
    return rows.agg(F.count("*").alias("vectors"), F.count_distinct(path).alias("paths")).crossJoin(F.broadcast(dims))


def similarity(left: str, right: str):
    return V.cosine(F.col(left), F.col(right))
