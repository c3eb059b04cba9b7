"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` with the counts of the
training documents. A symbol is coded in its longest context seen in training;
where the context hasn't seen the symbol, an escape is coded and the next
shorter context is used without the symbols that the longer one would have
coded (symbol exclusion). Escapes are estimated as d / 2n and symbols as
(2c - 1) / 2n, for c of n counts and d distinct symbols; below the empty
context the symbols left are equally likely. The pretrained score of a text
is a sum over its (ORDER + 1)-byte strings, so only the distinct strings of a
batch travel: counts to the buckets of the key space, log probabilities back.
A bucket holds all strings that end their context in the same three bytes,
hence the whole trie below those; the counts of the lower orders, by two
context bytes and a symbol, are a table of 2 ** 24 numbers at most whatever the
corpus, and go to every task.

A text is coded as its lower-cased words, joined by one space, and an end
symbol; that is the event that the base score (words one by one) gives a
probability to.

Defined cases: a null or empty text is the end symbol alone; a null id counts
as the text None when the fold is drawn; documents that repeat a row are
learned and scored each; without any training document every symbol costs
log10(256) and the base is that of an empty table; a text of any length is
whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import _batches as B
from tallyloom.llm._shared import forget, materialise

ORDER = 5
START, END = 0xFE, 0xFF  # neither is a byte of UTF-8
_U8 = np.uint64(8)


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def coded(tokens: list[bytes]) -> bytes:
    return b"\xfe" * ORDER + b" ".join(tokens) + b"\xff"


def grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The (ORDER + 1)-byte strings that end at each coded symbol of texts
    given as words, and how many of them each text has."""
    parts = [coded(t) for t in texts]
    # Big-endian eight-byte words at every place, less the bytes before.
    raw = b"".join([b"\0\0", *parts])
    a = np.frombuffer(raw, np.uint8)
    g = np.ndarray((len(a) - 7,), ">u8", buffer=raw, strides=(1,)).astype(np.uint64)
    g &= np.uint64((1 << (8 * (ORDER + 1))) - 1)
    sizes = np.array([len(p) for p in parts], np.int64)
    # The string that ends at place i of the texts is g[i - ORDER].
    real = np.ones(len(a) - 2, bool)
    starts = np.cumsum(sizes) - sizes
    for j in range(ORDER):
        real[starts + j] = False
    return g[real[ORDER:]], sizes - ORDER


def _pieces(texts: list[list[bytes]], most: int = 400_000):
    """Ranges of texts with about ``most`` words."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _words(t: pa.Table) -> list[list[bytes]]:
    return [x.lower().split() for x in B.texts(t)]


def _tally(arrays: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and their counts."""
    found = [pc.value_counts(pa.array(a)) for a in arrays]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    v = np.concatenate([f.field(0).to_numpy() for f in found])
    c = np.concatenate([f.field(1).to_numpy() for f in found])
    keys, at = np.unique(v, return_inverse=True)
    return keys, np.bincount(at, weights=c, minlength=len(keys)).astype(np.int64)


def _narrow(c: np.ndarray) -> tuple[bytes, int]:
    """Counts in the smallest width that holds them."""
    for code, kind in enumerate((np.uint8, np.uint16, np.uint32, np.uint64)):
        if not len(c) or c.max() <= np.iinfo(kind).max:
            return B.pack(c.astype(kind)), code
    raise OverflowError


def _widen(data: bytes, code: int) -> np.ndarray:
    return B.unpack(data, (np.uint8, np.uint16, np.uint32, np.uint64)[code]).astype(np.int64)


def _place(keys: np.ndarray) -> np.ndarray:
    """Even bucket keys for packed strings: by the last three context bytes."""
    return B.mixed((keys >> _U8) & np.uint64(0xFFFFFF))


def _train(texts: list[list[bytes]], learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of a batch with their training counts."""
    own, others = ([texts[i] for i in np.flatnonzero(x)] for x in (learn, ~learn))
    keys, counts = _tally(grams(own[a:b])[0] for a, b in _pieces(own))
    rest = np.setdiff1d(_tally(grams(others[a:b])[0] for a, b in _pieces(others))[0], keys, assume_unique=True)
    every = np.concatenate([keys, rest])
    order = np.argsort(every)
    return every[order], np.concatenate([counts, np.zeros(len(rest), np.int64)])[order]


def word_tally(tokens: list[list[bytes]], learn: np.ndarray) -> dict[bytes, int]:
    """Training count of every distinct word of a batch."""
    out: Counter[bytes] = Counter()
    for own, learned in zip(tokens, learn.tolist()):
        if learned:
            out.update(own)
    for own, learned in zip(tokens, learn.tolist()):
        if not learned:
            out.update(dict.fromkeys((w for w in set(own) if w not in out), 0))
    return out


def _word_keys(words) -> tuple[np.ndarray, np.ndarray]:
    """64 and 16 more bits of hash for each word."""
    d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words), np.dtype([("a", "<u8"), ("b", "<u8")]))
    return d["a"].astype(np.uint64), (d["b"] & np.uint64(0xFFFF)).astype(np.uint16)


def _send(buckets: int):
    def work(batch: int, t: pa.Table):
        texts = _words(t)
        learn = np.array([not held_out(x) for x in t.column("doc_id").to_pylist()], bool)
        keys, counts = _train(texts, learn)
        place = _place(keys)
        shift = np.uint64(64 - (buckets.bit_length() - 1))
        bucket = (place >> shift).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[order], counts[order], bucket[order]
        rows = []
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if y > x:
                data, code = _narrow(counts[x:y])
                rows.append((batch, b, code, B.framed([B.pack_sorted(keys[x:y]), data])))
        # Order 2, and through it the lower ones: counts of (context, symbol).
        some, at = np.unique((keys[counts > 0] & np.uint64(0xFFFFFF)).astype(np.uint32), return_inverse=True)
        if len(some):
            data, code = _narrow(np.bincount(at, weights=counts[counts > 0]).astype(np.int64))
            rows.append((batch, -1, code, B.framed([B.pack_sorted(some), data])))
        words = word_tally(texts, learn)
        a, c = _word_keys(words)
        n = np.fromiter(words.values(), np.int64, len(words))
        order = np.lexsort((c, a))
        a, c, n = a[order], c[order], n[order]
        cut = B.bounds(a, buckets)
        for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if y > x:
                data, code = _narrow(n[x:y])
                rows.append((batch, buckets + b, code, B.framed([B.pack_sorted(a[x:y]), B.pack(c[x:y]), data])))
        return rows

    return work


def _sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(groups, weights=values, minlength=n)


def log_probabilities(keys: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of the last byte of each string after the others.

    ``keys``: distinct packed strings, sorted; ``counts`` their training counts
    (0: only asked for). They must hold every string of the training texts
    that shares the last three context bytes with one of them. ``low``: the
    strings of two context bytes and a symbol, sorted, and their training
    counts, for the orders from 2 down.
    """
    total = np.bincount((low[0] & np.uint64(0xFFFF)).astype(np.int64), weights=low[1], minlength=1 << 16)
    out = np.zeros(len(keys))
    open_ = np.arange(len(keys))
    longer: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # contexts, and (context number, symbol) of the level above
    rows, count = keys[counts > 0], counts[counts > 0].astype(np.float64)
    for order in range(ORDER, -1, -1):
        mask = np.uint64((1 << (8 * (order + 1))) - 1)
        if order == 2:
            # Those under the contexts that are asked for.
            own = np.isin(low[0] >> _U8, np.unique((keys >> _U8) & np.uint64(0xFFFF)))
            rows, count = low[0][own], low[1][own].astype(np.float64)
        elif order == 1:
            some = np.flatnonzero(total)
            rows, count = some.astype(np.uint64), total[some]
        elif order == 0:
            zero = total.reshape(256, 256).sum(axis=0)
            some = np.flatnonzero(zero)
            rows, count = some.astype(np.uint64), zero[some]
        elif order < ORDER:
            rows, at = np.unique(rows & mask, return_inverse=True)
            count = np.bincount(at, weights=count, minlength=len(rows))
        contexts, of = np.unique(rows >> _U8, return_inverse=True)
        n = _sums(count, of, len(contexts))
        d = np.bincount(of, minlength=len(contexts)).astype(np.float64)
        ask = keys[open_] & mask
        ctx = ask >> _U8

        def find(table: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(table):
                return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
            at = np.minimum(np.searchsorted(table, want), len(table) - 1)
            return at, table[at] == want

        c_at, c_seen = find(contexts, ctx)
        left_n = np.where(c_seen, n[c_at] if len(n) else 0.0, 0.0)
        left_d = np.where(c_seen, d[c_at] if len(d) else 0.0, 0.0)
        if longer is not None:
            # What the longer context excludes here: its symbols' counts.
            up_contexts, up_of, up_rows = longer
            r_at, r_seen = find(rows, up_rows & mask)
            gone = _sums(np.where(r_seen, count[r_at] if len(count) else 0.0, 0.0), up_of, len(up_contexts))
            gone_d = np.bincount(up_of[r_seen], minlength=len(up_contexts)).astype(np.float64)
            u_at, u_seen = find(up_contexts, keys[open_] >> _U8 & np.uint64((1 << (8 * (order + 1))) - 1))
            if len(gone):
                left_n -= np.where(u_seen, gone[u_at], 0.0)
                left_d -= np.where(u_seen, gone_d[u_at], 0.0)
        s_at, s_seen = find(rows, ask)
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = np.log10((2 * (count[s_at] if len(count) else 0.0) - 1) / (2 * left_n))
            escape = np.where(left_d > 0, np.log10(left_d / (2 * left_n)), 0.0)
        out[open_] += np.where(s_seen, hit, escape)
        longer = (contexts, of, rows)
        open_ = open_[~s_seen]
        if not len(open_):
            return out
    unseen = 256 - len(rows)
    out[open_] -= np.log10(max(1, unseen))
    return out


def _answer(buckets: int, low):
    def work(batches: list[int], codes: list[int], blocks: list[bytes], bucket: int):
        parts = [B.unframed(x) for x in blocks]
        first = [B.unpack_sorted(p[0]) for p in parts]
        counts = [_widen(p[-1], c) for p, c in zip(parts, codes)]
        if bucket < buckets:
            keys, at = np.unique(np.concatenate(first), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate(counts), minlength=len(keys))
            values = log_probabilities(keys, total, low.value)[at]
            stats: list = []
        else:
            a, c = np.concatenate(first), np.concatenate([B.unpack(p[1], np.uint16) for p in parts])
            order = np.lexsort((c, a))
            new = np.r_[True, (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])]
            at = np.empty(len(a), np.int64)
            at[order] = np.cumsum(new) - 1
            total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
            values = total[at]
            stats = [(-1, bucket, 0, np.array([int(total.sum()), int((total > 0).sum())], np.int64).tobytes())]
        out, x = [], 0
        for batch, own in zip(batches, first):
            part = values[x : x + len(own)]
            x += len(own)
            data, code = (B.pack(part), 0) if bucket < buckets else _narrow(part)
            out.append((batch, bucket, code, data))
        return out + stats

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("batch").to_numpy(), kind="stable")))
        return B.block_table(work(t.column("batch").to_pylist(), t.column("n").to_pylist(), t.column("data").to_pylist(), t.column("bucket")[0].as_py()))

    return run


def _score(buckets: int, end_count: int, n_train: int, n_distinct: int, kind: pa.DataType):
    def work(batch: int, left: pa.Table, right: pa.Table) -> pa.Table:
        texts = _words(left)
        ids = left.column("doc_id").to_pylist()
        learn = np.array([not held_out(x) for x in ids], bool)
        number, codes, data = right.column("bucket").to_pylist(), right.column("n").to_pylist(), right.column("data").to_pylist()
        parts = [(a, b, *grams(texts[a:b])) for a, b in _pieces(texts)]
        keys, _ = _tally(g for _, _, g, _ in parts)
        shift = np.uint64(64 - (buckets.bit_length() - 1))
        order = np.argsort((_place(keys) >> shift).astype(np.int64), kind="stable")
        logs = np.empty(len(keys), np.float64)
        got = [B.unpack(d, np.float64) for b, d in zip(number, data) if 0 <= b < buckets]
        logs[order] = np.concatenate(got) if got else np.zeros(0, np.float64)
        value_set = pa.array(keys)
        score = np.zeros(len(texts))
        for a, b, g, sizes in parts:
            each = logs[pc.index_in(pa.array(g), value_set=value_set).to_numpy()]
            score[a:b] = np.add.reduceat(each, np.cumsum(sizes) - sizes)
        words = dict.fromkeys(chain.from_iterable(texts))
        k, c = _word_keys(words)
        order = np.lexsort((c, k))
        got_n = [_widen(d, code) for b, code, d in zip(number, codes, data) if b >= buckets]
        counts = np.zeros(len(words) + 1, np.int64)
        counts[order] = np.concatenate(got_n) if got_n else np.zeros(0, np.int64)
        counts[-1] = end_count
        cost = np.log10((counts + 0.1) / (n_train + 0.1 * (n_distinct + 1)))
        index = {w: i for i, w in enumerate(words)}
        at = index.__getitem__
        n_tokens, n_known, base = [], [], []
        for t in texts:
            own = np.fromiter(map(at, t), np.int64, len(t))
            own = np.append(own, len(words))
            n_tokens.append(len(own))
            n_known.append(int((counts[own] > 0).sum()))
            base.append(float(cost[own].sum()))
        n = len(texts)
        return pa.table(
            [pa.array(ids, kind), pa.array(~learn), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([n_train] * n, pa.int64()), pa.array(base, pa.float64()), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return work


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).alias("doc_id"), B.low(text).alias("text"))
    table, n = B.batch_table(named, ["doc_id"], each=8_000_000)
    buckets = B.bucket_count(n)
    sent = materialise(B.send(table, _send(buckets)), "ppm-sent")
    found = sent.filter("bucket = -1").mapInArrow(_low_of, "low int, n long").groupBy("low").agg(F.sum("n").alias("n")).toArrow()  # 2 ** 24 rows at most
    order = np.argsort(found.column("low").to_numpy())
    low = (found.column("low").to_numpy()[order].astype(np.uint64), found.column("n").to_numpy()[order])
    shared = spark.sparkContext.broadcast(low)
    answers = materialise(sent.filter("bucket >= 0").groupBy("bucket").applyInArrow(_answer(buckets, shared), B.BLOCK), "ppm-answers")
    stats = answers.filter("batch = -1").mapInArrow(_stats_of, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    forget(sent)
    ends = int(low[1][low[0] & np.uint64(0xFF) == END].sum())
    n_train, n_distinct = (stats[0] or 0) + ends, (stats[1] or 0) + (ends > 0)
    kind = docs.schema[doc_id].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return B.apply(table, answers.filter("batch >= 0"), _score(buckets, ends, n_train, n_distinct, arrow), schema)


def _low_of(batches):
    """The low counts of all blocks of a task, added up: a row for each string."""
    keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for t in batches:
        for code, data in zip(t.column("n").to_pylist(), t.column("data").to_pylist()):
            low, n = B.unframed(data)
            keys, at = np.unique(np.concatenate([keys, B.unpack_sorted(low, np.uint32)]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, _widen(n, code)]), minlength=len(keys)).astype(np.int64)
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(counts)], names=["low", "n"])


def _stats_of(batches):
    for t in batches:
        rows = [np.frombuffer(d, np.int64) for d in t.column("data").to_pylist()]
        if rows:
            x = np.stack(rows)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["tokens", "words"])
