"""Cut lineage in a way that outlives executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_kept: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Only a local session without the setting gets a temporary folder; a
    cluster, whose machines don't share one, is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Spark takes a file's compressed size for that of its rows, which are
    # larger in the driver's memory by a factor of ten and more.
    "spark.sql.autoBroadcastJoinThreshold": "1048576",
    # Rows dealt by the first of a join's keys are not dealt again by all.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes in this block go when each has ended."""
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def kept_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, as Parquet in the shared folder: for what several
    joins or rounds read. The files go by ``forget`` or when the application
    ends."""
    spark = df.sparkSession
    path = kept_folder(spark, "kept")
    with _tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Remove the files of kept frames that nothing reads later."""
    for df in frames:
        for name in {p.rsplit("/", 2)[-2] for p in df.inputFiles()}:
            for entry in [k for k in _kept if k[1].rsplit("/", 1)[-1] == name]:
                _remove(*entry)
                _kept.remove(entry)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_kept() -> None:
    for spark, path in _kept:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already
            return
