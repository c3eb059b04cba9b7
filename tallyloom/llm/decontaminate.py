"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased letter and digit runs, compared by 64-bit hashes. A
document and a benchmark item that share a seed of ``least`` tokens may form a
pair. Running Karp-Rabin greedy string tiling then marks, longest first,
non-overlapping matches of at least ``least`` tokens (an item shorter than
that must occur whole), and the item counts as leaked where the marked tokens
cover at least ``coverage`` of it, in whatever order its parts stand.

No task holds the benchmark. A bitmap of its seeds, of ``most_bits`` bits at
most, is all that goes to every task; it lets through each seed of a document
that may be the benchmark's, and the tokens in such seeds, the only ones that
can be tiled. Seeds of documents and items then meet by a shuffle on their
hashes. An item of n seeds that is covered by tiles has q of them or more in
the document, so its q - 1 most frequent seeds needn't ask: what every item
and every other document have in common forms no pairs.

Defined cases: null or empty texts and items without a token match nothing;
repeated items each count; repeated documents are judged one by one; no
document is cut short; a column of the name of the new one stays, and the new
one gets an underscore; empty tables give no leaks.
"""

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm._shared import forget, free, materialise

TOKENS = re.compile(r"[^\W_]+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MOD, _MUL = (1 << 61) - 1, 1_000_003
BREAK = -1  # between stretches of tokens


def tokens(text: str | None) -> list[str]:
    return TOKENS(text.lower()) if text else []


def _windows(ids: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, rolling hash) of the windows of ``size`` unmarked tokens."""
    top = pow(_MUL, size, _MOD)
    run = value = 0
    for i, x in enumerate(ids):
        if not free[i]:
            run = value = 0
            continue
        value = (value * _MUL + x + 2) % _MOD
        run += 1
        if run > size:
            value = (value - (ids[i - size] + 2) * top) % _MOD
        if run >= size:
            yield i - size + 1, value


def tiles(a: list[int], b: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token sequences: (start in a, in b, length).

    BREAK matches nothing. The search length starts at half the shorter
    sequence and halves; a match of over twice the search length restarts the
    search at its length. Matches are marked longest first, and a match that
    others have cut comes back as the parts that are left.
    """
    free_a, free_b = [x != BREAK for x in a], [x != BREAK for x in b]
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(a), len(b)) // 2)
    while True:
        table: dict[int, list[int]] = defaultdict(list)
        for s, h in _windows(b, free_b, size):
            table[h].append(s)
        found: list[tuple[int, int, int]] = []
        longest = 0
        for s, h in _windows(a, free_a, size):
            for t in table.get(h, ()):
                if s and t and free_a[s - 1] and free_b[t - 1] and a[s - 1] == b[t - 1]:
                    continue  # part of the match one token before
                k = 0
                while s + k < len(a) and t + k < len(b) and a[s + k] == b[t + k] and free_a[s + k] and free_b[t + k]:
                    k += 1
                if k >= size:
                    found.append((-k, s, t))
                    longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        heapq.heapify(found)
        while found:
            k, s, t = heapq.heappop(found)
            run = 0
            parts = []
            for i in range(-k + 1):
                if i < -k and free_a[s + i] and free_b[t + i]:
                    run += 1
                    continue
                if run >= size:
                    parts.append((-run, s + i - run, t + i - run))
                run = 0
            if parts == [(k, s, t)]:
                out.append((s, t, -k))
                free_a[s : s - k] = free_b[t : t - k] = [False] * -k
            else:
                for part in parts:
                    heapq.heappush(found, part)
        if size <= least:
            return out
        size = max(least, size // 2)


class Tokens:
    """Token hashes of texts, each distinct token hashed once."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        found, known = tokens(text), self.known
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w) >> 2
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))


def hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` tokens."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = (h ^ x[j : j + n]) * _BASE
        h ^= h >> np.uint64(29)
    return h


def _items(least: int):
    """Each item's tokens and seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for b in batches:
            ids = [known.of(t.as_py()) for t in b.column(1)]
            seeds = [np.unique(hashes(x, min(least, len(x)))).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int32()), pa.array(seeds, pa.list_(pa.int64()))], names=["item", "ids", "n", "seeds"]
            )

    return run


def _parts(sizes: list[int], bits: int, shared):
    """Of each text the seeds that the bitmap lets through, and the tokens in
    them in order, a BREAK where others stood between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bitmap, low = Tokens(), shared.value, np.uint64((1 << bits) - 1)
        for b in batches:
            keep, seeds, parts = [], [], []
            for i, t in enumerate(b.column(2)):
                ids = known.of(t.as_py())
                mask, own = np.zeros(len(ids), bool), []
                for size in sizes:
                    h = hashes(ids, size)
                    p = h & low
                    hit = np.flatnonzero(bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1))
                    if len(hit):
                        own.append(h[hit])
                        for j in range(size):
                            mask[hit + j] = True
                if own:
                    at = np.flatnonzero(mask)
                    keep.append(i)
                    seeds.append(np.unique(np.concatenate(own)).view(np.int64))
                    parts.append(np.insert(ids[at], np.flatnonzero(np.diff(at) > 1) + 1, BREAK).tobytes())
            if len(known.known) > 1_000_000:
                known = Tokens()
            if keep:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array(seeds, pa.list_(pa.int64())), pa.array(parts, pa.binary())], names=["t1", "t2", "seeds", "part"])

    return run


def _tiled(least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, share = [], []
            for i, (part, ids) in enumerate(zip(b.column("part"), b.column("ids"))):
                own = np.frombuffer(ids.as_py(), np.int64)
                text = np.frombuffer(part.as_py(), np.int64)
                # Tokens of other items are breaks too.
                text = np.where(np.isin(text, own), text, BREAK)
                text = text[np.r_[True, (text[1:] != BREAK) | (text[:-1] != BREAK)]]
                done = sum(k for _, _, k in tiles(text.tolist(), own.tolist(), min(least, len(own))))
                if done >= coverage * len(own):
                    keep.append(i)
                    share.append(done / len(own))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("t1").take(at), b.column("t2").take(at), b.column("item").take(at), pa.array(share, pa.float64())], names=["t1", "t2", "item", "coverage"])

    return run


def _bitmap(items: DataFrame, n_seeds: int, most_bits: int) -> tuple[int, np.ndarray]:
    """A bitmap of all seeds, 64 bits for each, ``most_bits`` bits at most."""
    bits = min(max(12, (64 * max(1, n_seeds) - 1).bit_length()), most_bits.bit_length() - 1)
    place = F.col("k").bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = items.select(F.explode("seeds").alias("k")).groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return bits, bitmap


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = 5,
    coverage: float = 0.6,
    most_bits: int = 1 << 27,
    few: int = 1 << 16,
    name: str = "leaks",
) -> DataFrame:
    """``docs`` plus an array column of (item, coverage) that each text leaks."""
    spark, name = docs.sparkSession, free(docs.columns, name)
    kind = benchmark.schema[item_id].dataType.simpleString()
    every = benchmark.select(F.col(f"`{item_id}`"), F.col(f"`{item_text}`")).mapInArrow(_items(least), f"item {kind}, ids binary, n int, seeds array<bigint>").filter("n > 0")
    items = materialise(every.select(F.monotonically_increasing_id().alias("i"), "*"), "leak-items")
    facts = items.agg(F.sum(F.size("seeds")), F.collect_set(F.least("n", F.lit(least)))).first()  # sizes up to ``least``
    empty = F.array().cast(f"array<struct<item:{kind},coverage:double>>")
    if not facts[0]:
        return docs.withColumn(name, empty)
    bits, bitmap = _bitmap(items, facts[0], most_bits)
    t = F.col(f"`{text}`")
    key = [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit("second"), t).alias("t2")]
    found = docs.filter(t.isNotNull()).select(*key, t).mapInArrow(_parts(sorted(facts[1]), bits, spark.sparkContext.broadcast(bitmap)), "t1 long, t2 long, seeds array<bigint>, part binary")
    parts = materialise(found, "leak-parts")
    asked = parts.select("t1", "t2", F.explode("seeds").alias("k")).distinct()
    times = asked.groupBy("k").agg(F.count("*").alias("times"))
    # A tile of m tokens, m >= least, holds m - least + 1 seeds; the fewest that
    # cover the share asked for are tiles of ``least`` tokens. Seeds may repeat
    # in an item, so only what its distinct ones leave beyond the need is spared.
    size = F.least("n", F.lit(least))
    need = F.greatest(F.lit(1), F.ceil(F.lit(coverage) * F.col("n") / size) - (F.col("n") - size + 1 - F.size("seeds")))
    own = items.select("i", need.alias("need"), F.explode("seeds").alias("k"))
    ranked = own.join(times, "k").withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy(F.desc("times"), "k")))
    # Seeds that no document has count as the rarest.
    there = ranked.withColumn("there", F.count("*").over(W.partitionBy("i"))).filter("there >= need and rank >= need").select("i", "k")
    pairs = materialise(asked.join(there, "k").select("t1", "t2", "i").distinct(), "leak-pairs")
    once = parts.groupBy("t1", "t2").agg(F.first("part").alias("part"))
    both = pairs.join(once, ["t1", "t2"]).join(items.select("i", "item", "ids"), "i")
    tiled = both.select("t1", "t2", "item", "part", "ids").mapInArrow(_tiled(least, coverage), f"t1 long, t2 long, item {kind}, coverage double")
    per_text = materialise(tiled.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("item", "coverage"))).alias("found")), "leak-texts")
    forget(items, parts, pairs)
    names = [free([*docs.columns, name], x) for x in ("__t1", "__t2", "__found")]
    per_text = per_text.toDF(*names)
    if per_text.count() <= few:
        per_text = F.broadcast(per_text)
    joined = docs.join(per_text, (key[0] == F.col(names[0])) & (key[1] == F.col(names[1])), "left")
    return joined.withColumn(name, F.coalesce(names[2], empty)).drop(*names)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """Documents that leak no benchmark item; columns as given."""
    name = free(docs.columns, "__leaks")
    return leaks(docs, benchmark, text=text, name=name, **how).filter(F.size(name) == 0).drop(name)
