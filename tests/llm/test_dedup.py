"""Fingerprints, suffix arrays, passages and components by brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash

from tallyloom.llm import components, passages, simhash, suffix_dedup


def test_fingerprint():
    def brute(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
        sh = [" ".join(w)] if len(w) < 4 else [" ".join(w[k : k + 4]) for k in range(len(w) - 3)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    rnd = random.Random(1)
    for n in (0, 1, 3, 4, 5, 60, 40000):
        t = " ".join(rnd.choice(["A", "b", "É", "dd"]) for _ in range(n))
        if n < 1000:
            assert simhash.fingerprint(t) == brute(t)
        else:
            assert simhash.fingerprint(t) > 0
    assert simhash.fingerprint(None) == 0


def test_near_edges_span_components(spark):
    rnd = random.Random(2)
    f = {rnd.getrandbits(64) for _ in range(60)}
    for x in list(f)[:12]:
        for _ in range(15):
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                x ^= 1 << b
            f.add(x)
    f = sorted(f)
    parent = {x: x for x in f}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(f):
        for y in f[:i]:
            if (x ^ y).bit_count() <= 4:
                parent[max(find(x), find(y))] = min(find(x), find(y))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in f], "fp long")
    for most in (4096, 7):
        got = {r.node: r.root for r in components.connected(simhash.near_edges(nodes, len(f), most=most)).collect()}
        for x in f:
            for y in f:
                same = got.get(signed(x), signed(x)) == got.get(signed(y), signed(y))
                assert same == (find(x) == find(y))


def test_near_components(spark):
    rnd = random.Random(3)
    text = " ".join(f"w{rnd.randrange(900)}" for _ in range(2000))
    rows = [(5, text), (2, text.replace("w1 ", "w2 ", 1)), (9, " ".join(f"v{k}" for k in range(200))), (1, None), (7, " \n"), (9, " ".join(f"v{k}" for k in range(200)))]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_components(df).collect()) == [(1, 1), (2, 2), (5, 2), (7, 1), (9, 9), (9, 9)]
    assert sorted(r.doc_id for r in simhash.first_of_each(df).collect()) == [1, 2, 9]
    assert simhash.near_components(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(50, 40), (41, 50), (60, 60)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 31)}, 41: 40, 50: 40}


def test_suffix_array_and_prefixes():
    rnd = random.Random(1)
    for _ in range(120):
        parts = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 4))]
        sizes = [len(p) for p in parts]
        s, ends = np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.cumsum(sizes), sizes)
        order = suffix_dedup.suffix_array(s, ends)
        suffixes = [bytes(s[i : ends[i]]) for i in order]
        assert suffixes == sorted(suffixes)

        def lcp(a, b):
            return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))

        assert suffix_dedup.common_prefixes(s, ends, order).tolist() == [0] + [lcp(a, b) for a, b in zip(suffixes, suffixes[1:])]


def test_repeated_bytes(spark):
    rnd = random.Random(4)
    body = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    shared, rows = body(130), []
    for i in range(25):
        t = body(rnd.randint(0, 300))
        if i % 3 == 0:
            k = rnd.randint(0, len(t))
            t = t[:k] + shared[rnd.randint(0, 40) : rnd.randint(80, 130)] + t[k:]
        rows.append((i, t))
    rows += [(30, "xy" * 200), (31, None), (32, ""), (33, rows[5][1]), (33, rows[5][1]), (34, "short"), (35, "short")]
    length, seen = 48, {}
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    want = []
    for (i, _), b in zip(rows, raw):
        gone = set()
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone |= set(range(k, k + length))
        rest = bytes(x for k, x in enumerate(b) if k not in gone)
        want.append((i, len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(rest).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.repeated_bytes(df, length=length, gram=32).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.repeated_bytes(df.limit(0)).count() == 0
    # The same in short overlapping stretches, with what is left of the texts.
    cut = suffix_dedup.repeated_bytes(df, length=length, gram=32, stretch=100, with_text=True).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in cut) == sorted(want)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in cut if r.n_removed and r.kept.isascii())


def test_suffix_rows_without_ids(spark):
    rnd = random.Random(3)
    own = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = own(600)
    rows = [(None, own(50) + shared, b"x"), (None, shared + own(70), b"y"), (4, own(900), None), (4, own(40) + shared[:300], b"")]
    got = suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string, sha binary")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == [(0, 650, 600), (0, 670, 600), (4, 340, 0), (4, 900, 0)]


def test_chains_and_alignment():
    x, y, size = passages.merged(np.array([0, 3, 50, 53, 200]), np.array([10, 13, 61, 64, 5]), np.full(5, 5), 3)
    assert passages.chains(x, y, size, 0.05, 100)[0] == (0, 58, 10, 69)
    rnd = random.Random(1)
    for _ in range(100):
        a, b = (np.array([rnd.randrange(5) for _ in range(rnd.randint(1, 30))], np.uint64) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert passages.common_words(a, b) == table[-1, -1]


def test_passages(spark):
    rnd = random.Random(5)
    voc = [f"w{k}" for k in range(3000)]
    docs = {i: [rnd.choice(voc) for _ in range(rnd.randint(60, 200))] for i in range(80)}
    groups = []
    for _ in range(10):
        p, g = [rnd.choice(voc) for _ in range(70)], rnd.sample(range(60), 3)
        for d in g:
            q, k = list(p), rnd.choice([0, len(docs[d])])  # whole: no passage lands inside another
            q[35] = rnd.choice(voc)
            docs[d][k:k] = q
        groups.append(g)
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(90, " ".join(docs[70]).upper()), (91, None), (92, ""), (93, "a b")]
    got = {r.doc_id: r for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len({got[d].class_id for d in g}) == 1 for g in groups)
    inside = {d for g in groups for d in g}
    assert all(r.n_links == 0 and r.class_id == i for i, r in got.items() if i not in inside and i not in (70, 90))
    assert got[90].class_id == 70 and {got[k].class_id for k in (91, 92, 93)} == {91, 92, 93}
    assert all(got[d].repeated_words >= 60 for d in inside)


def test_passages_in_pieces_elsewhere(spark):
    """Texts that hold pieces of a passage don't hide it from others; links by
    brute force over runs of words."""
    rnd = random.Random(8)
    voc = [f"w{k}" for k in range(5000)]
    own = lambda n: [rnd.choice(voc) for _ in range(n)]
    docs, groups = {}, []
    for g in range(6):
        p, ids = own(62), []
        for size in [62, 62, 62] + [20] * 22 + [28] * 15:
            i, k = len(docs), rnd.randint(0, 62 - size)
            docs[i] = own(rnd.randint(0, 80)) + p[k : k + size] + own(rnd.randint(0, 80))
            ids.append(i)
        groups.append(ids[:3])
    order = list(docs)
    rnd.shuffle(order)
    rows = [(i, " ".join(docs[i])) for i in order]
    grams = {}
    for i, w in docs.items():
        for k in range(len(w) - 44):
            grams.setdefault(tuple(w[k : k + 45]), set()).add(i)
    want = {(a, b) for g in grams.values() for a in g for b in g if a < b}
    assert want == {(g[a], g[b]) for g in groups for a, b in ((0, 1), (0, 2), (1, 2))}
    got = {r.doc_id: r.class_id for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[a] == got[b] for a, b in want)
    linked = {x for p in want for x in p}
    assert all(got[i] == i for i in docs if i not in linked)


def test_passages_defined_cases(spark):
    rnd = random.Random(9)
    own = lambda n: " ".join(f"v{rnd.randrange(4000)}" for _ in range(n))
    p, other = own(200), own(60)
    rows = [(None, p + " " + own(50), "x"), (None, own(40) + " " + p, "y"), (7, own(30) + " " + p, "z"), (8, other, ""), (8, own(70), ""), (9, other.upper(), None), (10, "w " * 200_000, ""), (11, p[: len(p) // 2], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = passages.passage_classes(df).collect()
    assert len(got) == len(rows) and passages.passage_classes(df.limit(0)).collect() == []
    assert sorted((r.doc_id or 0, r.class_id) for r in got) == [(0, 7), (0, 7), (7, 7), (8, 8), (8, 8), (9, 8), (10, 10), (11, 7)]
    assert sum(r.n_links > 0 for r in got) == 4


def test_passages_of_versions_unlike_each_other(spark):
    """Versions resemble an original and not their neighbours: classes are
    those of a comparison of all pairs by all the seeds that they share."""
    rnd = random.Random(7)
    voc = [f"w{k}" for k in range(4000)]
    own = lambda n: [rnd.choice(voc) for _ in range(n)]
    line, docs = own(13), []
    for _ in range(4):
        p = own(120)
        docs.append(own(rnd.randint(0, 60)) + p + own(rnd.randint(0, 60)))
        for _ in range(18):
            docs.append(own(rnd.randint(0, 60)) + [rnd.choice(voc) if rnd.random() < 0.14 else w for w in p] + own(rnd.randint(0, 60)))
    docs += [own(40) + line + own(40) for _ in range(30)]
    rnd.shuffle(docs)

    words = [passages.Words().of(" ".join(d).encode()) for d in docs]
    every = [[dict(zip(*(x.tolist() for x in f))) for f in (passages.seeds(w, 5, 4), passages.long_seeds(w, 30, 16))] for w in words]

    def linked(i, j):
        shared = [(a[key], b[key], size) for a, b, size in zip(every[i], every[j], (5, 30)) for key in a.keys() & b.keys()]
        if not shared:
            return False
        a, b = words[i], words[j]
        for x0, x1, y0, y1 in passages.chains(*passages.merged(*(np.array(c) for c in zip(*shared)), 3), 0.25, 30):
            head = passages.extended(a[:x0][::-1], b[:y0][::-1], 8)
            tail = passages.extended(a[x1:], b[y1:], 8)
            u, v = a[x0 - head : x1 + tail], b[y0 - head : y1 + tail]
            if min(len(u), len(v)) >= 30 and passages.common_words(u, v) / max(len(u), len(v)) >= 0.8:
                return True
        return False

    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if linked(i, j):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {r.doc_id: r.class_id for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(docs))] == root


def _met(docs):
    """Pairs of texts that the second pass would compare, each its own class."""
    words = [passages.Words().of(" ".join(d).encode()) for d in docs]
    found = [[(key[i], at[i], long) for long, (key, at) in enumerate((passages.seeds(w, 5, 4), passages.long_seeds(w, 30, 16))) for i in range(len(key))] for w in words]
    owner = np.repeat(np.arange(len(docs)), [len(f) for f in found])
    key = np.array([int(x[0]) & ~1 | x[2] for f in found for x in f], np.uint64)
    at = np.array([x[1] for f in found for x in f], np.int32)
    around = passages.around_seeds([" ".join(d).encode() for d in docs], owner, at, 5)
    groups = {}
    for two, i, close, before, after in zip(*(x.tolist() for x in passages.two_seeds(owner, key, at, around, 5, 4, 14, 30, 64, 56, 24))):
        groups.setdefault(two, []).append((i, close, before, after))
    pairs = set()
    for g in groups.values():
        for i, close, before, after in g:
            for j, other, b, a in g:
                if i < j and (close or other) and (before == 0 or before != b) and (after == 0 or after != a):
                    pairs.add((i, j))
    return words, pairs


def test_batch_seeds_are_those_of_each_text():
    rnd = random.Random(4)
    sizes = [0, 1, 4, 5, 6, 7, 8, 30, 31, 44, 45, 46, 300]
    for _ in range(40):
        docs = [" ".join(rnd.choice("abcd") for _ in range(rnd.choice(sizes))) for _ in range(rnd.randint(1, 8))]
        key, doc, at, words = passages.batch_seeds(pa.table({"text": docs}), 5, 4, 30, 16)
        want = []
        for i, d in enumerate(docs):
            w = passages.Words().of(d.encode())
            assert (words[i] == w).all()
            for long, (k, p) in enumerate((passages.seeds(w, 5, 4), passages.long_seeds(w, 30, 16))):
                want += zip((passages.B.mixed(k) & ~np.uint64(1) | np.uint64(long)).tolist(), [i] * len(k), p.tolist())
        assert list(zip(key.tolist(), doc.tolist(), at.tolist())) == sorted(want)


def test_frequent_lines_do_not_meet_and_passages_do():
    """Texts that share a line of up to 24 words are no pairs; every two texts
    that a comparison of all shared seeds links are."""
    rnd = random.Random(11)
    voc = [f"w{k}" for k in range(6000)]
    own = lambda n: [rnd.choice(voc) for _ in range(n)]
    for size in range(14, 25):
        line = own(size)
        assert len(_met([own(40) + line + own(40) for _ in range(20)])[1]) <= 10  # of 190

    links = 0
    for _ in range(60):
        p = own(rnd.randint(28, 75))
        docs = []
        for _ in range(8):
            q = [w for w in p]
            for _ in range(rnd.randint(0, len(p) // 5)):
                i = rnd.randrange(len(q))
                q[i : i + rnd.choice([1, 1, 0])] = own(rnd.choice([1, 1, 1, 0, rnd.randint(2, 8)]))
            docs.append(own(rnd.choice([0, 1, 3, 20])) + q + own(rnd.choice([0, 1, 3, 20])))
        words, pairs = _met(docs)
        every = [[dict(zip(*(x.tolist() for x in f))) for f in (passages.seeds(w, 5, 4), passages.long_seeds(w, 30, 16))] for w in words]
        for i in range(len(docs)):
            for j in range(i + 1, len(docs)):
                shared = [(a[key], b[key], n) for a, b, n in zip(every[i], every[j], (5, 30)) for key in a.keys() & b.keys()]
                if not shared:
                    continue
                a, b = words[i], words[j]
                for x0, x1, y0, y1 in passages.chains(*passages.merged(*(np.array(c) for c in zip(*shared)), 3), 0.25, 30):
                    if min(x1 - x0, y1 - y0) < 14:
                        continue
                    head = passages.extended(a[max(0, x0 - 8) : x0][::-1], b[max(0, y0 - 8) : y0][::-1], 8)
                    tail = passages.extended(a[x1:], b[y1:], 8)
                    u, v = a[x0 - head : x1 + tail], b[y0 - head : y1 + tail]
                    if min(len(u), len(v)) >= 30 and passages.common_words(u, v) / max(len(u), len(v)) >= 0.8:
                        links += 1
                        assert (i, j) in pairs
                        break
    assert links > 300
