"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Bytes of files up to which a table may be broadcast without having been measured.
SMALL_FILES = 256 << 10
#: With it the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STATIC, _RUNNING = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def true_sizes(spark: SparkSession) -> None:
    """Let only tables that are small in memory be broadcast.

    Spark plans broadcasts by the size of files, and ids compress so well that
    a file of some MB holds millions of rows, which the driver would then hash.
    Above ``SMALL_FILES`` the choice is left to the running query, which knows
    the rows' own size and keeps the session's threshold for it.
    """
    held = spark.conf.get(_STATIC)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held) if not held.startswith("-") else -1
    if size > SMALL_FILES:
        if spark.conf.get(_RUNNING) is None:
            spark.conf.set(_RUNNING, held)
        spark.conf.set(_STATIC, str(SMALL_FILES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where it is unset and the session is local a folder of this machine is
    made and set, so that one session keeps one folder; on a cluster executors
    would each write to their own disk, so there the setting is required.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        made = tempfile.mkdtemp(prefix="arcweave-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "cut", **stats: Column) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result has no lineage beyond its files: a lost executor costs only the
    tasks it ran, and later plans see true sizes.  ``stats`` are aggregates
    taken while writing, without a job of their own; :func:`stat` gives them.
    """
    spark = df.sparkSession
    true_sizes(spark)
    path = new_path(spark, name)
    watch = Observation() if stats else None
    held = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.observe(watch, *[v.alias(k) for k, v in stats.items()]) if watch else df).write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, held)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    out._stats = watch.get if watch else {}
    return out


def stat(df: DataFrame, name: str):
    """An aggregate that :func:`materialize` took of ``df``."""
    return df._stats[name]


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of frames from :func:`materialize` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_written", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_path`."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
