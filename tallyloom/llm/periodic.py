"""Periodic runs of words, by comparing a text with every shift of itself.

A run is a stretch of words with smallest period q, as long as ``min_words``
and ``min_exponent`` periods at least, that no neighbouring word extends. For
every lag q up to n / min_exponent the array of word numbers is compared with
itself moved by q; a stretch of m equal places makes a run of m + q words.
Many lags are compared in one numpy call, and only lags that hold eight equal
places in a row are measured, as every shorter stretch is too short by rule.

The work of a text grows with the square of its words, so long texts are cut
into ranges of lags of even work that Spark deals to its tasks; short ones are
one range each. Lags that are multiples of a run's period find the same words
again: of all finds with one start and length the smallest period is the run's
(a stretch of two periods q with a period p < q has a period that divides q).

Defined cases: a null or empty text has no words and no runs; rows are judged
one by one, ids don't matter and may be null or repeated; equal long texts are
scanned once; other columns pass through, and the new column takes an
underscore more where its name is taken; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import WORD, free

_RUN = "array<struct<start:long,length:long,period:long>>"
#: Eight equal places in a row, seen as one number.
_EIGHT = np.uint64(0x0101010101010101)
_BLOCK = 1 << 18


def word_numbers(ws: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers; the largest number of the type is free."""
    codes, kinds = pd.factorize(np.array(ws, dtype=object))
    return codes.astype(np.uint16 if len(kinds) < 0xFFFF else np.uint32)


def _stretches(ids: np.ndarray, low: int, high: int, min_words: int, min_exponent: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, lengths, lags) of stretches long enough to be runs, by rising lag."""
    n = len(ids)
    while low < high:
        width = n - low
        padded = (width // 8 + 1) * 8  # one place at least ends a stretch
        rows = max(1, min(high - low, _BLOCK // padded))
        base = np.full(padded + rows, np.iinfo(ids.dtype).max, dtype=ids.dtype)
        base[:width] = ids[low:]
        step = base.strides[0]
        moved = np.lib.stride_tricks.as_strided(base, (rows, padded), (step, step), writeable=False)
        still = np.zeros(padded, dtype=ids.dtype)
        still[:width] = ids[:width]
        equal = np.equal(moved, still)
        likely = (equal.view(np.uint64) == _EIGHT).any(axis=1)
        likely[: max(0, 15 - low)] = True  # short periods make runs without eight aligned places
        lags = low + likely.nonzero()[0]
        places = equal[likely].ravel().nonzero()[0]
        if len(places):
            ends = (places[1:] - places[:-1] > 1).nonzero()[0]
            first, last = np.concatenate((places[:1], places[ends + 1])), np.concatenate((places[ends], places[-1:]))
            q = lags[first // padded]
            length = last - first + 1 + q
            long = (length >= min_words) & (length >= min_exponent * q)
            if long.any():
                yield (first % padded)[long], length[long], q[long]
        low += rows


def runs_at_lags(ids: np.ndarray, low: int, high: int, min_words: int = 12, min_exponent: float = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) found at lags low <= q < high, least period of each stretch."""
    found: dict[tuple[int, int], int] = {}
    for starts, lengths, lags in _stretches(ids, low, min(high, int(len(ids) // min_exponent) + 1), min_words, min_exponent):
        for s, n, q in zip(starts.tolist(), lengths.tolist(), lags.tolist(), strict=True):
            found.setdefault((s, n), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def kept_words(ws: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: of each run its first period stays."""
    steps = np.zeros(len(ws) + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [ws[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _structs(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = [x for r in rows for x in r]
    parts = [pa.array([x[k] for x in flat], pa.int64()) for k in range(3)]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))


_Batches = Iterator[pa.RecordBatch]


def _scanned(text: str, name: str, min_words: int, min_exponent: float) -> Callable[[_Batches], _Batches]:
    """Whole texts in one range of lags each: the batch and one more column."""

    def run(batches: _Batches) -> _Batches:
        for batch in batches:
            runs, sizes, kept = [], [], []
            for t in batch.column(text):
                ws = _words(t.as_py())
                found = runs_at_lags(word_numbers(ws), 1, len(ws), min_words, min_exponent) if len(ws) >= min_words else []
                runs.append(found)
                sizes.append(len(ws))
                kept.append(b" ".join(kept_words(ws, found) if found else ws).decode())
            struct = pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), _structs(runs), pa.array(kept, pa.string())], names=["n_words", "runs", "collapsed"])
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, name])

    return run


def _range_scanned(key: str, min_words: int, min_exponent: float) -> Callable[[_Batches], _Batches]:
    """The finds of ranges of lags, an empty list where there are none."""

    def run(batches: _Batches) -> _Batches:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "low", "high")), strict=True)
            found = [runs_at_lags(word_numbers(_words(t)), a, b, min_words, min_exponent) for t, a, b in rows]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n"), _structs(found)], names=[key, "n", "runs"])

    return run


def _collapsed(text: str, n: str, runs: str, name: str) -> Callable[[_Batches], _Batches]:
    def run(batches: _Batches) -> _Batches:
        for batch in batches:
            found = batch.column(runs)
            kept = [b" ".join(kept_words(_words(t.as_py()), [(x["start"], x["length"], x["period"]) for x in rs.as_py()])).decode() for t, rs in zip(batch.column(text), found, strict=True)]
            struct = pa.StructArray.from_arrays([batch.column(n), found, pa.array(kept, pa.string())], names=["n_words", "runs", "collapsed"])
            rest = [(c, x) for c, x in zip(batch.schema.names, batch.columns, strict=True) if c not in (n, runs)]
            yield pa.RecordBatch.from_arrays([*(x for _, x in rest), struct], names=[*(c for c, _ in rest), name])

    return run


def lag_ranges(n: Column, compares: int, min_exponent: float = 2) -> Column:
    """Ranges of lags of n words, each of about ``compares`` comparisons.

    Lag q costs n - q; up to lag x they are n x - x² / 2, so the k-th border is
    where that reaches k shares.
    """
    most = F.floor(n / F.lit(float(min_exponent))) + 1
    work = n * most - most * most / 2
    parts = F.greatest(F.lit(1), F.ceil(work / F.lit(float(compares)))).cast("int")
    border = lambda k: F.when(k >= parts, most).otherwise(F.floor(n - F.sqrt(F.greatest(F.lit(0.0), n * n - 2 * work * k / parts))) + 1)
    return F.transform(F.sequence(F.lit(1), parts), lambda k: F.struct(border(k - 1).cast("long").alias("low"), border(k).cast("long").alias("high")))


def with_runs(
    docs: DataFrame,
    text: str = "text",
    name: str = "periodic",
    min_words: int = 12,
    min_exponent: float = 2,
    long_bytes: int = 1 << 16,
    compares: int = 1 << 26,
) -> DataFrame:
    """``docs`` plus one struct: n_words, runs by start and period, collapsed.

    ``collapsed`` is the text's words joined by one space without those that a
    run repeats. Texts over ``long_bytes`` are dealt by ranges of lags.
    """
    if min_exponent < 2:
        raise ValueError("min_exponent under 2 is not supported")
    name, t = free(docs.columns, name), F.col(f"`{text}`")
    taken = [*docs.columns, name]
    key, salt, n, runs = (free(taken, c) for c in ("__text_hash", "__salt", "__n", "__runs"))
    none = F.lit(None).cast(f"struct<n_words:long,runs:{_RUN},collapsed:string>")
    schema = docs.limit(0).withColumn(name, none).schema
    short = docs.filter(F.coalesce(F.octet_length(t), F.lit(0)) <= long_bytes).mapInArrow(_scanned(text, name, min_words, min_exponent), schema)

    long = docs.filter(F.octet_length(t) > long_bytes).withColumn(key, F.sha2(t, 256))
    once = long.groupBy(key).agg(F.first(t).alias("text")).select(key, "text", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n"))
    ranges = once.select(key, "text", "n", F.explode(lag_ranges(F.col("n"), compares, min_exponent)).alias("lags"))
    dealt = ranges.select(key, "text", "n", "lags.low", "lags.high").repartition(F.col(key), F.col("low"))
    finds = dealt.mapInArrow(_range_scanned(key, min_words, min_exponent), f"{key} string, n long, runs {_RUN}").select(key, "n", F.explode_outer("runs").alias("run"))
    # A run is found at each multiple of its period: the smallest stays.
    least = finds.groupBy(key, "n", "run.start", "run.length").agg(F.min("run.period").alias("period"))
    every = F.sort_array(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "length", "period"))))
    whole = least.groupBy(key, F.col("n").alias(n)).agg(every.alias(runs))
    # A third of all rows may be copies of one long text: spread them.
    whole = whole.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(15))))
    rest = [F.col(f"`{c}`").cast("string") for c in docs.columns if c != text] or [F.lit(0)]
    salted = long.withColumn(salt, F.pmod(F.xxhash64(*rest), F.lit(16)).cast("int"))
    joined = salted.join(whole, [key, salt]).select(*(F.col(f"`{c}`") for c in docs.columns), n, runs)
    return short.unionByName(joined.mapInArrow(_collapsed(text, n, runs, name), schema))
