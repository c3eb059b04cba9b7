"""Exact removal of repeated byte strings by per-shard suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else is removed. Texts that occur more than once are settled first, by their
hash: one row stands for them all. The others are dealt to shards, texts over
``stretch`` bytes as stretches that overlap by ``length`` - 1 bytes, so that
every window lies in one of them and a task holds no longer text.

Anchors choose what the suffix arrays must hold: a window of ``length`` bytes
has as its anchor the least rolling hash of its ``gram``-byte strings, equal
windows have equal anchors, so only windows whose anchor occurs twice can be
repeated; a packed exchange of anchors finds those. Each shard then sorts the
suffixes of its open stretches by Larsson-Sadakane refinement (only unsorted
groups, doubling the compared length), gets common prefixes by Kasai's
property, evaluated for all suffixes at once: a suffix whose predecessor
agrees one byte earlier has the common prefix of the one before it less one.
Runs of suffixes with a common prefix of ``length`` or more are one window
each. Shards are merged by binary search: each sends the sorted keys of its
windows, once each, to the buckets, which look every key up among all others.

Inside a shard windows are compared byte for byte. Between shards they are
compared by 128 bits of two rolling hashes; for n windows the chance of any
false match is about n * n / 2**129, 1.5e-11 for 1e14 windows.

Defined cases: a null text is empty and loses nothing; texts under ``length``
bytes lose nothing; repeated rows are occurrences of their own, so both lose
all; rows are told apart by place and not by id, so null and repeated ids do
no harm; matches never cross documents; overlaps within a document count;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import _batches as B
from tallyloom.llm._shared import forget, materialise

_RNG = np.random.Generator(np.random.PCG64(20))
_TABLES = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(factor: int, n: int) -> np.ndarray:
    """factor ** 0 ... factor ** n, modulo 2 ** 64."""
    have = _powers.get(factor)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        have = np.full(size + 1, factor, np.uint64)
        have[0] = 1
        have = _powers[factor] = np.cumprod(have, dtype=np.uint64)
    return have[: n + 1]


def rolling(a: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash for each window of ``size`` bytes of a byte array."""
    n = len(a)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLES[which][a] * _power(_INVERSE, n)[:n], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * _power(_FACTOR, n)[: n - size + 1]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def sliding(x: np.ndarray, width: int, ufunc: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours, by block scans."""
    n = len(x)
    if n < width:
        return x[:0]
    pad = -n % width
    fill = np.full(pad, np.iinfo(x.dtype).max if ufunc is np.minimum else 0, x.dtype)
    blocks = np.concatenate([x, fill]).reshape(-1, width)
    ahead = ufunc.accumulate(blocks, axis=1).reshape(-1)
    back = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return ufunc(back[: n - width + 1], ahead[width - 1 : n])


def anchors(a: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each window, hash of each place that is some window's anchor)."""
    h = rolling(a, gram)
    width = length - gram + 1
    m = sliding(h, width, np.minimum)
    if not len(m):
        return m, m
    edge = np.zeros(width - 1, np.uint64)
    chosen = h == sliding(np.concatenate([edge, m, edge]), width, np.maximum)
    return m, h[chosen]


def suffix_array(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of concatenated stretches of bytes.

    ``ends``: for each place, the end of its stretch. A suffix ends there, and
    ends are all different, in the order of the stretches.
    """
    n = len(s)
    left = np.minimum(ends - np.arange(n), 8)
    key = np.zeros(n, np.uint64)
    wide = np.concatenate([s, np.zeros(8, np.uint8)])
    for j in range(8):
        key = (key << np.uint64(8)) | np.where(j < left, wide[j : j + n], 0).astype(np.uint64)
    order = np.lexsort((left, key)) if (s == 0).any() or (left < 8).any() else np.argsort(key, kind="stable")
    differs = (key[order][1:] != key[order][:-1]) | (left[order][1:] != left[order][:-1])
    head = np.maximum.accumulate(np.where(np.r_[True, differs], np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    # A place at an end has a rank of its own, below all others.
    after = lambda at, h: np.where(at + h < ends[at], rank[np.minimum(at + h, n - 1)], -1 - (n - at))
    h = 8
    while True:
        starts = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
        sizes = np.diff(np.r_[starts, n])
        unsorted = np.repeat(sizes > 1, sizes)
        if not unsorted.any():
            return order
        slots = np.flatnonzero(unsorted)
        at = order[slots]
        second = after(at, h)
        again = np.lexsort((second, head[slots]))
        at, second, group = at[again], second[again], head[slots]
        order[slots] = at
        new = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        first = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
        head[slots] = slots[first]
        rank[at] = head[slots]
        h *= 2


def common_prefixes(s: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in
    order, by Kasai's property: only places whose predecessor differs one byte
    earlier are compared byte by byte."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    starts = np.r_[True, ends[1:] != ends[:-1]]
    start_of = np.zeros(n, bool)
    start_of[starts] = True
    b = before
    same = (b > 0) & ~start_of & ~start_of[np.maximum(b, 0)] & (s[np.maximum(i - 1, 0)] == s[np.maximum(b - 1, 0)])
    same[0] = False
    out = np.zeros(n, np.int64)
    todo = np.flatnonzero(~same & (b >= 0))
    k = np.zeros(len(todo), np.int64)
    step = 32
    wide = np.concatenate([s, np.zeros(step, np.uint8)])
    spread = np.arange(step)
    while len(todo):
        x, y = todo + k, b[todo] + k
        room = np.minimum(np.minimum(ends[todo] - x, ends[b[todo]] - y), step)
        x, y = np.minimum(x, n), np.minimum(y, n)
        unequal = wide[x[:, None] + spread] != wide[y[:, None] + spread]
        got = np.minimum(np.where(unequal.any(axis=1), unequal.argmax(axis=1), step), room)
        k += got
        out[todo] = k
        on = got == step
        todo, k = todo[on], k[on]
    settled = np.maximum.accumulate(np.where(~same, i, 0))
    return np.where(same, out[settled] - (i - settled), out)[order]


class Shard:
    """The open windows of a batch of documents."""

    def __init__(self, docs: list[bytes], repeated: np.ndarray, length: int, gram: int):
        self.length = length
        self.spots: list[tuple[int, np.ndarray]] = []  # document, starts of open windows
        stretches, keys, checks = [], [], []
        self.ends_at: list[int] = []
        for n, d in enumerate(docs):
            if len(d) < length or not len(repeated):
                continue
            a = np.frombuffer(d, np.uint8)
            m, _ = anchors(a, length, gram)
            heads = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
            own = B.mixed(m[heads])
            at = np.minimum(np.searchsorted(repeated, own), len(repeated) - 1)
            hit = np.repeat(repeated[at] == own, np.diff(np.r_[heads, len(m)]))
            where = np.flatnonzero(hit)
            if not len(where):
                continue
            self.spots.append((n, where))
            keys.append(rolling(a, length)[where])
            checks.append(rolling(a, length, 1)[where])
            cuts = np.flatnonzero(np.diff(where) > 1)
            for x, y in zip(where[np.r_[0, cuts + 1]].tolist(), where[np.r_[cuts, len(where) - 1]].tolist()):
                stretches.append((a[x : y + length], y - x + 1))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.checks = np.concatenate(checks) if checks else np.zeros(0, np.uint64)
        self.stretches = stretches

    def local(self) -> np.ndarray:
        """Whether each open window occurs twice in this shard."""
        if not self.stretches:
            return np.zeros(0, bool)
        s = np.concatenate([x for x, _ in self.stretches])
        sizes = np.array([len(x) for x, _ in self.stretches])
        stop = np.cumsum(sizes)
        ends = np.repeat(stop, sizes)
        order = suffix_array(s, ends)
        long = common_prefixes(s, ends, order) >= self.length
        long |= np.r_[long[1:], False]
        twice = np.zeros(len(s), bool)
        twice[order] = long
        return np.concatenate([twice[e - n : e - n + w] for e, n, (_, w) in zip(stop.tolist(), sizes.tolist(), self.stretches)])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct windows: first index, keys, and each window's number."""
        order = np.lexsort((self.checks, self.keys))
        k, c = self.keys[order], self.checks[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.zeros(0, bool)
        number = np.empty(len(k), np.int64)
        number[order] = np.cumsum(new) - 1
        return order[new], k[new], number


def _anchor_blocks(length: int, gram: int, buckets: int):
    def work(batch: int, t: pa.Table):
        found = [anchors(np.frombuffer(d, np.uint8), length, gram)[1] for d in B.texts(t) if len(d) >= length]
        if not found:
            return []
        # Least hashes lie low in their range: spread them over the buckets.
        keys, counts = np.unique(B.mixed(np.concatenate(found)), return_counts=True)
        cut = B.bounds(keys, buckets)
        return [(batch, b, int(y - x), B.framed([B.pack_sorted(keys[x:y]), np.packbits(counts[x:y] > 1).tobytes()])) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]

    return work


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _anchor_answers(batches: list[int], blocks: list[bytes]):
    parts = [B.unframed(x) for x in blocks]
    keys = [B.unpack_sorted(p[0]) for p in parts]
    often = [_flags(p[1], len(k)) for p, k in zip(parts, keys)]
    every, counts = np.unique(np.concatenate(keys), return_counts=True)
    several = counts > 1
    for k, o in zip(keys, often):
        several[np.searchsorted(every, k[o])] = True
    out = []
    for batch, k in zip(batches, keys):
        hit = k[several[np.searchsorted(every, k)]]
        if len(hit):
            out.append((batch, 0, len(hit), B.pack_sorted(hit)))
    return out


def _repeated(right: pa.Table) -> np.ndarray:
    """The anchors of a batch that occur twice anywhere: rows of kind 0."""
    found = [B.unpack_sorted(d) for d in right.column("data").to_pylist()]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _window_blocks(length: int, gram: int, buckets: int):
    def work(batch: int, left: pa.Table, right: pa.Table) -> pa.Table:
        repeated = _repeated(right)
        if not len(repeated) or not left.num_rows:
            return B.block_table([])
        shard = Shard(list(B.texts(left)), repeated, length, gram)
        first, keys, _ = shard.distinct()
        twice, checks = shard.local()[first], shard.checks[first]
        cut = B.bounds(keys, buckets)
        rows = [
            (batch, b, int(y - x), B.framed([B.pack_sorted(keys[x:y]), B.pack(checks[x:y]), np.packbits(twice[x:y]).tobytes()]))
            for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist()))
            if y > x
        ]
        return B.block_table(rows)

    return work


def _window_answers(bucket_of: int):
    def work(batches: list[int], blocks: list[bytes]):
        parts = [B.unframed(x) for x in blocks]
        keys = [B.unpack_sorted(p[0]) for p in parts]
        checks = [B.unpack(p[1], np.uint64) for p in parts]
        local = [_flags(p[2], len(k)) for p, k in zip(parts, keys)]
        k, c = np.concatenate(keys), np.concatenate(checks)
        order = np.lexsort((c, k))
        new = np.r_[True, (k[order][1:] != k[order][:-1]) | (c[order][1:] != c[order][:-1])]
        number = np.empty(len(k), np.int64)
        number[order] = np.cumsum(new) - 1
        several = np.bincount(number) > 1
        out, at = [], 0
        shift = np.uint64(64 - (bucket_of.bit_length() - 1))
        for batch, own, mine in zip(batches, keys, local):
            flags = several[number[at : at + len(own)]] | mine
            out.append((batch, int(own[0] >> shift) if bucket_of > 1 else 0, len(own), np.packbits(flags).tobytes()))
            at += len(own)
        return out

    return work


def spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that windows at sorted ``starts`` cover."""
    new = np.r_[True, starts[1:] > starts[:-1] + length]
    return starts[new], np.r_[starts[np.flatnonzero(new)[1:] - 1], starts[-1]] + length


RESULT = "row long, spans array<struct<start:long,stop:long>>, n_removed long, kept_sha256 string, kept string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def without(text: bytes, cut: list[tuple[int, int]]) -> tuple[int, bytes]:
    """Number of bytes in the sorted, separate spans, and the text without."""
    rest, at = [], 0
    for x, y in cut:
        rest.append(text[at:x])
        at = y
    rest.append(text[at:])
    return sum(y - x for x, y in cut), b"".join(rest)


def _apply(length: int, gram: int, stretch: int, with_text: bool):
    names = [x.split()[0] for x in RESULT.split(", ")]

    def work(batch: int, left: pa.Table, right: pa.Table) -> pa.Table:
        docs = list(B.texts(left))
        kinds = right.column("kind").to_numpy() if right.num_rows else np.zeros(0, np.int64)
        repeated = _repeated(right.filter(pa.array(kinds == 0))) if right.num_rows else np.zeros(0, np.uint64)
        shard = Shard(docs, repeated, length, gram)
        _, keys, number = shard.distinct()
        answers = right.filter(pa.array(kinds == 1)) if right.num_rows else right
        flags = [_flags(d, n) for d, n in zip(answers.column("data").to_pylist(), answers.column("n").to_pylist())]
        hit = np.concatenate(flags)[number] if flags else np.zeros(0, bool)
        ids, parts, whole, at = left.column("row").to_pylist(), left.column("part").to_pylist(), left.column("whole").to_pylist(), 0
        rows: list[tuple] = []
        for n, where in shard.spots:
            own = where[hit[at : at + len(where)]]
            at += len(where)
            if not len(own):
                continue
            cut = [(p + stretch * parts[n], q + stretch * parts[n]) for p, q in zip(*(x.tolist() for x in spans(own, length)))]
            size, rest = without(docs[n], cut) if whole[n] else (None, b"")
            rows.append((ids[n], [{"start": p, "stop": q} for p, q in cut], size, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
        cols = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), _SPANS, pa.int64(), pa.string(), pa.string()))], names=names)

    return work


def _joined(with_text: bool):
    """Spans of the stretches of one long text, as one result."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for row, text, found in zip(*(c.to_pylist() for c in b.columns)):
                cut: list[list[int]] = []
                for x in sorted((x["start"], x["stop"]) for x in found):
                    if cut and x[0] <= cut[-1][1]:
                        cut[-1][1] = max(cut[-1][1], x[1])
                    else:
                        cut.append(list(x))
                size, rest = without(text.encode(), cut)
                rows.append((row, [{"start": p, "stop": q} for p, q in cut], size, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), _SPANS, pa.int64(), pa.string(), pa.string()))], names=names)

    return run


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, gram: int = 320, stretch: int = 16_000_000, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, n_removed, kept_sha256, kept): what each text
    loses, and with ``with_text`` what is left of it."""
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    texts = named.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    texts = materialise(texts, "suffix-texts")
    facts = texts.drop("text")
    classes = materialise(facts.groupBy("sha").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes")), "suffix-classes")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("n_bytes") - 1, F.lit(0)) / stretch))).alias("part")
    single = classes.filter(F.col("n_bytes") >= length).select(F.col("rep").alias("row"), part)
    cut_up = texts.select("row", part, "n_bytes", "text").select(
        "row", "part", (F.col("n_bytes") <= stretch).alias("whole"), F.col("text").cast("binary").substr((F.col("part") * stretch + 1).cast("int"), F.lit(stretch + length - 1)).alias("text")
    )
    table, n = B.batch_table(cut_up, ["row", "part"], only=single)
    buckets = B.bucket_count(n)
    kind0 = materialise(B.answer(B.send(table, _anchor_blocks(length, gram, buckets)), _anchor_answers), "suffix-anchors")
    windows = B.apply(table, kind0, _window_blocks(length, gram, buckets), B.BLOCK)
    kind1 = materialise(B.answer(windows, _window_answers(buckets)), "suffix-windows")
    both = kind0.withColumn("kind", F.lit(0)).unionByName(kind1.withColumn("kind", F.lit(1)))
    cut = materialise(B.apply(table, both, _apply(length, gram, stretch, with_text), RESULT), "suffix-cuts")
    parts = cut.filter("n_removed IS NULL").groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    long = texts.filter(F.col("n_bytes") > stretch).select("row", "text").join(parts, "row").mapInArrow(_joined(with_text), RESULT)
    cut = materialise(cut.filter("n_removed IS NOT NULL").unionByName(long), "suffix-results")
    forget(table, kind0, kind1)
    # One row for each class: copies lose everything, if long enough.
    lost = classes.join(cut.withColumnRenamed("row", "rep"), "rep", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    lost = lost.select(
        "sha",
        F.when(gone, span).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>"))).alias("spans"),
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
    return facts.join(lost, "sha").select("doc_id", "n_bytes", "spans", "n_removed", "kept_sha256", "kept")
