"""Structured Streaming: drop-folder ingest, version gate, live counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from tallyloom.operators import library
from tallyloom.operators.events import version_gate_state


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).format(kind).load(path)


def ingest(stream: DataFrame, store: str, key: list[str], checkpoint: str, newer: str | None = None, keep_old: tuple[str, ...] = (), buckets: int = 64) -> StreamingQuery:
    """Merge each micro-batch into the table at ``store``.

    The table lies in buckets of the key; a batch writes the buckets it
    touches, in a folder named by the batch, so a batch that runs again after
    a failure writes the same folder: exactly once. Of each bucket two
    versions stay. A late, older row is dropped by the merge condition and not
    by a watermark.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, place = batch.sparkSession, F.pmod(F.hash(*key), F.lit(buckets))
        fresh = batch.dropDuplicates(key) if newer is None else batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), F.col(newer)).alias("r")).select("r.*")
        have = _buckets(spark, store, number - 1)
        touched = {r[0] for r in fresh.select(place.alias("b")).distinct().collect()}  # ``buckets`` at most
        paths = [have[b][-1] for b in sorted(touched & set(have))]
        merged = fresh if not paths else library.upsert(spark.read.parquet(*paths).select(fresh.columns), fresh, key, list(keep_old), newer)
        merged.withColumn("_bucket", place).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{store}/v{number:012d}")
        for b, versions in have.items():
            if b in touched:
                for old in versions[:-1]:
                    _path(spark, old)[1].delete(_path(spark, old)[0], True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, name: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _buckets(spark: SparkSession, store: str, most: int) -> dict[int, list[str]]:
    """Folders of each bucket, oldest first, in versions up to ``most``."""
    where, fs = _path(spark, store)
    out: dict[int, list[str]] = {}
    if fs.exists(where):
        names = sorted(s.getPath().getName() for s in fs.listStatus(where))
        for name in (n for n in names if n.startswith("v") and int(n[1:]) <= most):
            if fs.exists(_path(spark, f"{store}/{name}/_SUCCESS")[0]):
                for s in fs.listStatus(_path(spark, f"{store}/{name}")[0]):
                    if (folder := s.getPath().getName()).startswith("_bucket="):
                        out.setdefault(int(folder.split("=")[1]), []).append(f"{store}/{name}/{folder}")
    return out


def current(spark: SparkSession, store: str) -> DataFrame | None:
    have = _buckets(spark, store, 1 << 40)
    return spark.read.parquet(*[v[-1] for v in have.values()]) if have else None


def refetch(events: DataFrame, snapshot: Callable[[], DataFrame], key: list[str], emit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A snapshot kept fresh by events: the events say which keys changed, and
    each micro-batch reads the present rows of those keys again. ``snapshot``
    is called once the stream has begun, so no change falls between the two."""

    def fetch(batch: DataFrame, number: int) -> None:
        dirty = batch.select(*key).distinct()
        emit(snapshot().join(dirty, key, "left_semi"), number)

    return events.writeStream.foreachBatch(fetch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version_gate(stream: DataFrame) -> DataFrame:
    """Columns key, seq, version: rows above all earlier versions of a key."""
    return stream.groupBy("key").applyInPandasWithState(version_gate_state, "key long, seq long, version long", "version long", "append", GroupStateTimeout.NoTimeout)


def live_counts(stream: DataFrame, key: str = "batch_id", status: str = "status") -> DataFrame:
    """Running counts by status, for complete-mode output."""
    return stream.groupBy(key, status).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, size: str, late: str, by: list[str] = ()) -> DataFrame:
    """Extension: event-time windows with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"))


def change_feed(stream: DataFrame, order: list[str], emit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Numbered changes: one rising sequence, by micro-batch and then in
    ``order``, the same when a batch runs again. The window is over one
    micro-batch, which the trigger bounds."""

    def numbered(batch: DataFrame, number: int) -> None:
        emit(batch.withColumn("event_seq", F.lit(number).cast("long") * (1 << 32) + F.row_number().over(W.orderBy(*order))), number)

    return stream.writeStream.foreachBatch(numbered).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
