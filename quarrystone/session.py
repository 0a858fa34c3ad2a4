"""Session helpers: the shared folder, staged tables and session defaults."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quarrystone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` overrides any of it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder that is deleted at exit; on a cluster that is an error, as
    no folder of one machine would do.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not configured:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="quarrystone-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        context.setCheckpointDir(configured)
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    This cuts lineage, survives the loss of executors, and keeps ids given by position fixed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    result = spark.read.schema(df.schema).parquet(path)
    result._staged_at = path
    return result


def discard(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more, such as those of the last round but one."""
    for table in tables:
        if path := getattr(table, "_staged_at", None):
            remove(table.sparkSession, path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not broadcast it: sorted and merged instead, whatever its size seems to be.

    For tables that grow with the data. Spark takes the compressed bytes of a file or a shuffle for a table's size; paths
    repeat so much that a table a tenth of the threshold can fill the driver, which has to hold all that is broadcast.
    """
    return df.hint("merge")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
