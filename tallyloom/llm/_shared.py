"""Helpers shared by the training-data operators.

Words everywhere in this subpackage are maximal runs of bytes other than
space and U+0009..U+000D; on UTF-8 bytes ``bytes.split()`` finds the same
runs, as no multi-byte sequence holds one of those bytes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 spelling of one white-space character and of one word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: ``body`` gets a variable."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of ``text`` as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def free(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a temporary folder; a cluster,
    whose machines don't share one, is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Spark takes a file's compressed size for that of its rows, which are
    # larger in the driver's memory by a factor of ten and more.
    "spark.sql.autoBroadcastJoinThreshold": "1048576",
}


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes in this block go when each has ended, and
    only small files are broadcast without a hint."""
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


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The files outlive executors; they go by ``forget`` or when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Remove the files behind materialised frames that nothing reads later."""
    for df in frames:
        for name in {p.rsplit("/", 2)[-2] for p in df.inputFiles()}:
            for entry in [w for w in _written if w[1].rsplit("/", 1)[-1] == name]:
                _remove(*entry)
                _written.remove(entry)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    name = path.rsplit("/", 1)[-1]
    if name.startswith("tallyloom_"):  # a bucketed table is in the catalogue
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already
            return


def parts_for(n_bytes: int, each: int, least: int) -> int:
    """Number of partitions so that each holds about ``each`` bytes."""
    return max(least, -(-n_bytes // each))
