"""Periodic runs against their definition, and the query against brute force."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import periodic, queries


def brute(ws, min_words=12, exponent=2):
    found = []
    for q in range(1, int(len(ws) // exponent) + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            part = ws[i : j + q]
            if j > i and len(part) >= max(min_words, exponent * q) and q == next(p for p in range(1, len(part) + 1) if part[p:] == part[: len(part) - p]):
                found.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(found)


def some_words(rnd):
    n, kinds = rnd.randint(0, 90), rnd.choice([1, 2, 3, 30])
    ws = [f"w{rnd.randrange(kinds)}" for _ in range(n)]
    for _ in range(rnd.randint(0, 2)):
        at = rnd.randrange(len(ws) + 1)
        ws[at:at] = [f"x{rnd.randrange(5)}" for _ in range(rnd.randint(1, 20))] * rnd.randint(1, 4)
    return ws


def test_kernel():
    rnd = random.Random(1)
    for _ in range(100):
        ws = some_words(rnd)
        ids = periodic.word_numbers([w.encode() for w in ws])
        assert periodic.runs_at_lags(ids, 1, len(ws) + 1) == brute(ws), ws
        assert periodic.runs_at_lags(ids, 1, len(ws) + 1, 4, 3) == brute(ws, 4, 3), ws
        cut = rnd.randint(1, max(1, len(ws) // 2))  # two ranges of lags, put together
        both = periodic.runs_at_lags(ids, cut, len(ws) + 1) + periodic.runs_at_lags(ids, 1, cut)
        assert sorted((s, n, q) for (s, n), q in {(s, n): q for s, n, q in both}.items()) == brute(ws)


def test_many_kinds_of_words():
    ws = [b"%d" % k for k in range(70_000)] + [b"a", b"b"] * 9
    ids = periodic.word_numbers(ws)
    assert ids.dtype == np.uint32 and periodic.runs_at_lags(ids, 1, 9) == [(70_000, 18, 2)]


def test_lag_ranges_cover_every_lag_once(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 40, 999, 5000)], "n long").select("n", periodic.lag_ranges(F.col("n"), 20_000).alias("r")).collect()
    for n, ranges in rows:
        assert [x for r in ranges for x in range(r.low, r.high)] == list(range(1, n // 2 + 1)), n
        costs = [sum(n - x for x in range(r.low, r.high)) for r in ranges]
        assert max(costs) <= 20_000 + 2 * n


def query_rows(rows):
    """The contract, word by word, in plain Python."""
    out = []
    for doc_id, text in rows:
        ws = (text or "").encode().split()
        n = len(ws)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        runs = brute(ws)
        drop = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        kept = b" ".join(w for k, w in enumerate(ws) if k not in drop)
        facts = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((doc_id, len(runs), *facts, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(kept)))
    return out


def order(rows):
    return sorted(map(str, rows))


def test_query_by_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(k, " ".join(some_words(rnd))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (None, "a b " * 9), (None, None), (3, rows[3][1]), (3, "été \n" * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("periodic", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert order(map(tuple, got.collect())) == order(query_rows(rows))


def test_long_texts_by_ranges_of_lags(spark):
    rnd = random.Random(3)
    rows = [(k, " ".join(some_words(rnd) * rnd.choice([1, 1, 2])), "x") for k in range(60)]
    rows += [(None, rows[0][1], None), (None, "a b " * 3000, None), (7, rows[7][1], "x"), (7, rows[7][1], "x"), (8, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, periodic string")
    whole = periodic.with_runs(docs)
    cut = periodic.with_runs(docs, long_bytes=40, compares=200)
    assert whole.columns == [*docs.columns, "periodic_"] == cut.columns
    assert order(map(tuple, whole.collect())) == order(map(tuple, cut.collect()))
    assert whole.filter("doc_id is null and periodic_.n_words = 6000").first().periodic_.runs == [(0, 6000, 2)]
    assert periodic.with_runs(docs.limit(0)).count() == 0
