"""Session settings, and where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SPLIT_BYTES = 16 << 20
# Names of the bucketed tables of an application.
_TABLES: dict[str, list[str]] = {}


def build_session(app: str = "claimscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Expressions of wide tables are built faster without a stack trace per column.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder of its machine. On a cluster that is an error: executors would
    write to their own disks, and readers would miss those files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="claimscope-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; all paths of one application lie in one folder, to be removed after it."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder, so that later steps read it instead of computing it again.

    The table outlives executors; it is columnar, so a later step reads the columns it needs.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``cut`` into a table bucketed and sorted by ``key``: steps that group or join by the key read it without a shuffle.

    The table has a name of its own in the session's catalog, which ``clean_up`` takes out again.
    """
    spark = df.sparkSession
    name = f"stage_{uuid.uuid4().hex}"
    bucketed = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    bucketed.option("path", scratch_path(spark, "stage")).saveAsTable(name)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Within, files are read in splits of at most ``SPLIT_BYTES``, or less where the session says so.

    For a step whose tasks hold sums of all that they read: their memory follows the split, and Spark's grow up to 128 MB.
    """
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", before.strip().lower()).groups()
    spark.conf.set(key, f"{min(SPLIT_BYTES, int(number) << 10 * ' kmgtp'.index(unit or ' '))}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def clean_up(spark: SparkSession, folder: str | None = None) -> None:
    """Remove the application's folder of intermediate tables (or ``folder``), in whatever file system it lies."""
    for name in _TABLES.pop(spark.sparkContext.applicationId, []) if folder is None else []:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = folder or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
