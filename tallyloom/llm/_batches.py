"""Documents in batches, and the exchange of packed keys between them.

Operators that need facts about the whole corpus for every place in a text
(how often does this string occur?) work in batches of a few megabytes: a
batch sends its distinct keys, sorted, to the buckets of the key space, gets
an answer for each in the same order, and applies the answers to its texts.
Keys travel as compressed blocks of differences, a few bytes each, and a
batch sends a key once however often it holds it: no key is hot.

The texts are dealt to batches once, into a table bucketed by batch, so that
later passes read them where they lie, without another shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import _written, parts_for, shared_folder, tidy_shuffles

BLOCK = "batch int, bucket int, n int, data binary"


def batch_table(docs: DataFrame, key: list[str], text: str = "text", each: int = 4_000_000, only: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``docs`` (no null texts) with an int ``batch``, bucketed by it.

    ``only`` keeps the rows whose ``key`` it holds. The texts move once: the
    batch is the partition in which they meet it.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = parts_for(n_bytes, each, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"tallyloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    dealt = docs.repartition(n, *key)
    if only is not None:
        dealt = dealt.join(only.repartition(n, *key), key, "left_semi")
    dealt = dealt.withColumn("batch", F.pmod(F.hash(*key), F.lit(n)))
    with tidy_shuffles(spark):
        dealt.write.bucketBy(n, "batch").sortBy("batch").option("path", path).option("compression", "zstd").saveAsTable(name)
    _written.append((spark, path))
    return spark.table(name), n


def pack(values: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes, kind: np.dtype | type) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.zeros(1, keys.dtype)))


def unpack_sorted(data: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit keys whose high bits are even."""
    x = keys.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def bucket_count(n_batches: int, each: int = 2) -> int:
    """A power of two near the number of batches over ``each``."""
    return 1 << max(4, (max(1, n_batches // each) - 1).bit_length())


def bounds(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the key space begins in sorted keys, and the end."""
    shift = 64 - (buckets.bit_length() - 1)
    cuts = (np.arange(1, buckets, dtype=np.uint64) << np.uint64(shift)) if buckets > 1 else np.zeros(0, np.uint64)
    return np.r_[0, np.searchsorted(sorted_keys, cuts), len(sorted_keys)]


def framed(parts: list[bytes]) -> bytes:
    """Several byte strings as one."""
    head = np.array([len(p) for p in parts], np.int64)
    return np.int64(len(parts)).tobytes() + head.tobytes() + b"".join(parts)


def unframed(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8).tolist()
    out, at = [], 8 + 8 * n
    for s in sizes:
        out.append(data[at : at + s])
        at += s
    return out


def block_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["batch", "bucket", "n", "data"])


def send(table: DataFrame, work: Callable[[int, pa.Table], list[tuple[int, int, int, bytes]]]) -> DataFrame:
    """Blocks that ``work`` makes of each batch."""
    return table.groupBy("batch").applyInArrow(lambda t: block_table(work(t.column("batch")[0].as_py(), t)), BLOCK)


def answer(blocks: DataFrame, work: Callable[[list[int], list[bytes]], list[tuple[int, int, int, bytes]]]) -> DataFrame:
    """Blocks that ``work`` makes of all blocks of one bucket."""

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("batch").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        return block_table(work(t.column("batch").to_pylist(), t.column("data").to_pylist()))

    return blocks.groupBy("bucket").applyInArrow(run, BLOCK)


def apply(table: DataFrame, answers: DataFrame, work: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``work`` makes of each batch of texts and its answer blocks."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("bucket").to_numpy(), kind="stable") if right.num_rows else np.zeros(0, np.int64)
        return work(key[0].as_py(), left, right.take(pa.array(order)) if right.num_rows else right)

    return table.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)


def texts(t: pa.Table, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a column of texts or of bytes."""
    values = t.column(column)
    if not pa.types.is_binary(values.type):
        values = values.cast(pa.large_string())
    for chunk in values.cast(pa.large_binary()).chunks:
        for v in chunk:
            yield v.as_py() or b""


def low(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))
