"""Source files, logs and stored tables."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import paths as P

FILE = "uri string, path string, text string, is_ts boolean"
AUDIT = "id string, timestamp string, task string, taskType string, modelId string, modelVendor string, promptBytes long, promptSha256 string, filesIncluded array<string>, symbolsIncluded array<string>, snippetsIncluded int, outcome string, durationMs long, errorMessage string, naiveBaselineBytes long, promptTokens long, baselineTokens long, totalInputTokens long, modelRounds int, outputTokens long"
TOOL_AUDIT = "id string, timestamp string, tool string, arguments string, outcome string, durationMs long, errorMessage string, detail string"


def scan(spark: SparkSession, root: str, most_bytes: int = 1_500_000, most_files: int | None = 20_000) -> DataFrame:
    """``(uri, path, text, is_ts)`` of the supported files below a folder, by path; large ones and dot folders left out.

    ``most_files`` is the feature's own limit (None: all files).
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()), "/+$", "")
    plain = F.regexp_replace("path", "^file:/*", "/")
    rows = read.where(F.col("length") <= most_bytes).select(F.col("path").alias("uri"), F.substring(plain, F.length(base) + 2, F.length(plain)).alias("path"), "content")
    rows = rows.where(P.is_supported(F.col("path")) & ~F.col("path").rlike(r"(^|/)\.[^/]+/"))
    rows = rows.select("uri", "path", F.decode("content", "utf-8").alias("text"), P.is_script(F.col("path")).alias("is_ts")).orderBy("path")
    return rows if most_files is None else rows.limit(most_files)


def read_log(spark: SparkSession, path: str, schema: str = AUDIT) -> DataFrame:
    """Rows of a JSON-lines log; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends entries with an id, the time and the prompt's hash where they lack them."""
    known = set(rows.columns)
    if "id" not in known:
        rows = rows.withColumn("id", F.uuid())
    if "timestamp" not in known:
        rows = rows.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    if "prompt" in known:
        rows = rows.withColumn("promptSha256", F.sha2("prompt", 256)).drop("prompt")
    rows.write.mode("append").json(path)


def encode_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """The vector as base64 of little-endian 32-bit floats."""
    import base64
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    at = rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if v is None else base64.b64encode(np.array(v, "<f4").tobytes()).decode() for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    schema = ", ".join(f"`{f.name}` {'string' if f.name == vector else f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, schema)


def decode_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Vectors from base64 of little-endian 32-bit floats; null where the text isn't that."""
    import base64
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    at = rows.columns.index(vector)

    def one(text: str | None) -> list[float] | None:
        try:
            raw = base64.b64decode(text or "", validate=True)
            return np.frombuffer(raw, "<f4").tolist() if text and len(raw) % 4 == 0 else None
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([one(t) for t in batch.column(at).to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([values if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    schema = ", ".join(f"`{f.name}` {'array<float>' if f.name == vector else f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, schema)


def git_changes(spark: SparkSession, root: str, most_chars: int = 20_000) -> DataFrame:
    """One row: changed paths that are supported, the diff of scripts cut to ``most_chars``, and the error if there is one."""
    try:
        call = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, timeout=30, check=True).stdout
        names = call("diff", "--name-only", "HEAD").splitlines()
        diff, error = call("diff", "HEAD", "--", "*.ts", "*.tsx", "*.js", "*.jsx")[:most_chars], None
    except (OSError, subprocess.SubprocessError) as failure:
        names, diff, error = [], "", str(failure)
    rows = spark.createDataFrame([(names, diff, error)], "changed array<string>, diff string, error string")
    return rows.withColumn("changed", F.filter("changed", P.is_supported))
