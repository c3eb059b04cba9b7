"""Near copies against all pairs, and the planted near copy of the pipeline."""

import random

import numpy as np

import corpus_pipeline
from tallyloom.llm import simhash


def _set(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [_set(t) for _, t in rows]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))


def test_near_copies_against_all_pairs(spark):
    rnd = random.Random(11)
    voc = [f"w{k}" for k in range(500)]
    line, rows = [rnd.choice(voc) for _ in range(12)], []
    for g in range(12):
        base = [rnd.choice(voc) for _ in range(rnd.randint(5, 200))] + line
        for c in range(14):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 40))):
                t[rnd.randrange(len(t))] = rnd.choice(voc)
            rows.append((g * 100 + c, " ".join(t)))
    # Versions that are near copies of the original, but not of each other.
    base = [rnd.choice(voc) for _ in range(200)]
    rows.append((5000, " ".join(base)))
    for c in range(20):
        t = list(base)
        for p in rnd.sample(range(40), 4):
            t[p * 5] = f"new{c}"
        rows.append((5001 + c, " ".join(t)))
    rows += [(9000, None), (9001, " "), (9002, "a b"), (9003, "A  B"), (9004, "a b c")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = dict(_brute(rows))
    got = {r.doc_id: r.class_id for r in simhash.near_copies(df).collect()}
    # Verified links only, so no class spans two; few links are missed.
    assert set(got) == set(want) and all(want[c] == want[d] for d, c in got.items())
    assert sum(got[d] == want[d] for d in want) >= 0.95 * len(want)
    first = simhash.first_of_each(df.withColumn("__sha", df.text)).collect()
    assert sorted(r.doc_id for r in first) == sorted({c for c in got.values()}) and all(r["__sha"] == r.text for r in first)
    assert simhash.near_copies(df.limit(0)).count() == 0 and simhash.first_of_each(df.limit(0)).count() == 0


def test_wide_fingerprints_differ_as_expected():
    rnd = random.Random(2)
    known, apart = simhash.Words(), []
    for _ in range(200):
        t = [f"w{rnd.randrange(100_000)}" for _ in range(200)]
        u = list(t)
        for p in range(0, 20, 5):
            u[p * 10] = "other"
        x, y = _set(" ".join(t)), _set(" ".join(u))
        if len(x & y) >= 0.8 * len(x | y):
            a, b = (simhash.wide_fingerprint(simhash.shingles(known, " ".join(w), 5)) for w in (t, u))
            apart.append(int(simhash._apart(a, b)))
    assert len(apart) > 100 and sum(d <= simhash.wide_radius(0.8) for d in apart) >= 0.97 * len(apart)


def test_tiles_find_all_pairs_of_different_classes():
    rnd = np.random.Generator(np.random.PCG64(1))
    fp = rnd.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    fp = np.concatenate([fp, fp ^ (np.uint64(1) << rnd.integers(0, 63, (40, 4)).astype(np.uint64)), fp[:5]])
    of = np.arange(len(fp)) % 7
    for against in (None, 30):
        x, y = simhash.cross_pairs(fp, of, 40, tile=16, against=against)
        got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
        want = {(a, b) for b in range(len(fp)) for a in range(b) if of[a] != of[b] and np.bitwise_count(fp[a] ^ fp[b]).sum() <= 40 and (against is None or a < against <= b)}
        assert got == want


def test_pipeline_stage_drops_near_copies(spark, tmp_path):
    rnd = random.Random(12)
    voc = [f"term{k}" for k in range(4000)]
    docs = [[rnd.choice(voc) for _ in range(200)] for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    for i, w in enumerate(docs):
        rows.append((100 + i, " ".join(w[:90] + ["changed"] + w[91:])))
    rows += [(100, "another text under the id of a near copy"), (None, rows[0][1])]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    out = dict(corpus_pipeline.STAGES)[corpus_pipeline.STAGES[2][0]](spark, df, str(tmp_path))
    assert out.columns == df.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(left, key=str) == sorted(rows[:20] + rows[-2:], key=str)
