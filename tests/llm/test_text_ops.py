"""Decontamination, scoring, extraction and token counts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyloom.llm import _batches as B
from tallyloom.llm import decontaminate, html_text, ppm, token_counts

V = [f"w{k}" for k in range(500)]


def test_tiles_cover_what_brute_force_covers():
    rnd = random.Random(2)
    for _ in range(150):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randint(0, 40))] for _ in range(2))
        found = decontaminate.tiles(a, b, 3)
        free_a, free_b, want = [True] * len(a), [True] * len(b), 0
        while True:
            best = (0,)
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                        k += 1
                    if k > best[0]:
                        best = (k, i, j)
            if best[0] < 3:
                break
            k, i, j = best
            free_a[i : i + k] = free_b[j : j + k] = [False] * k
            want += k
        used_a = [x for s, _, k in found for x in range(s, s + k)]
        assert len(used_a) == len(set(used_a)) and all(a[s : s + k] == b[t : t + k] and k >= 3 for s, t, k in found)
        assert sum(k for *_, k in found) == want


def test_leaks(spark):
    rnd = random.Random(5)
    item = [rnd.choice(V) for _ in range(40)]
    clean = lambda n: " ".join(rnd.choice(V) for _ in range(n))
    moved = item[20:30] + item[:20] + item[30:]
    edited = [w if k % 12 else "changed" for k, w in enumerate(item)]
    docs = [(1, clean(80) + " " + " ".join(item).upper() + "! " + clean(30)), (2, clean(200)), (3, " ".join(moved)), (4, clean(9) + "\n" + " ".join(edited)), (5, None), (6, ""), (7, " ".join(item[:15])), (8, "x " * 30000 + " ".join(item))]
    bench = [(10, " ".join(item)), (11, None), (12, ""), (10, " ".join(item)), (13, "only four words here")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for bits in (1 << 27, 1 << 7):  # a full bitmap lets every seed through
        got = {r.doc_id: [x["item"] for x in r.leaks] for r in decontaminate.leaks(d, b, most_bits=bits).collect()}
        assert got == {1: [10, 10], 2: [], 3: [10, 10], 4: [10, 10], 5: [], 6: [], 7: [], 8: [10, 10]}
    assert {r.doc_id for r in decontaminate.without_leaks(d, b).collect()} == {2, 5, 6, 7}
    assert decontaminate.leaks(d, b.limit(0)).filter("size(leaks) > 0").count() == 0


def test_leaks_by_brute_force(spark):
    """Every document against every item by whole tiling, on few words."""
    rnd = random.Random(6)
    voc = [f"t{k}" for k in range(25)]
    own = lambda n: [rnd.choice(voc) for _ in range(n)]
    stem = own(7)
    items = [(k, stem + own(rnd.randint(0, 25)) + stem[: rnd.randint(0, 7)]) for k in range(40)] + [(90, own(3)), (91, own(5))]
    docs = []
    for i in range(60):
        t = own(rnd.randint(0, 30)) + stem
        for _ in range(rnd.randint(0, 3)):
            w = items[rnd.randrange(len(items))][1]
            k = rnd.randint(0, len(w))
            t += w[k:] + w[: rnd.randint(0, k)] + own(rnd.randint(0, 4))
        docs.append((i, t))
    want = {}
    for i, t in docs:
        for k, w in items:
            done = sum(n for *_, n in decontaminate.tiles([int(x[1:]) for x in t], [int(x[1:]) for x in w], min(5, len(w))))
            if done >= 0.6 * len(w):
                want.setdefault(i, []).append((k, done / len(w)))
    d = spark.createDataFrame([(i, " ".join(t), "own") for i, t in docs] + [(100, " ".join(docs[0][1]), None)], "doc_id long, text string, leaks string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {r.doc_id: [(x["item"], x["coverage"]) for x in r.leaks_] for r in decontaminate.leaks(d, b).collect()}
    assert len(got) == 61 and got.pop(100) == want.get(0, []) and {i: x for i, x in got.items() if x} == want
    assert decontaminate.leaks(d.limit(0), b).collect() == []


def brute_ppm(train, texts):
    k = ppm.ORDER
    counts = [defaultdict(Counter) for _ in range(k + 1)]
    for t in train:
        b = ppm.coded(t)
        for i in range(k, len(b)):
            for n in range(k + 1):
                counts[n][b[i - n : i]][b[i]] += 1
    out = []
    for t in texts:
        b, total = ppm.coded(t), 0.0
        for i in range(k, len(b)):
            gone: set = set()
            for n in range(k, -1, -1):
                seen = counts[n].get(b[i - n : i])
                if not seen:
                    continue
                live = {s: c for s, c in seen.items() if s not in gone}
                size = sum(live.values())
                if b[i] in live:
                    total += math.log10((2 * live[b[i]] - 1) / (2 * size))
                    break
                if live:
                    total += math.log10(len(live) / (2 * size))
                gone |= set(seen)
            else:
                total -= math.log10(256 - len(gone))
        out.append(total)
    return out


def test_ppm(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, 14)))) for i in range(60)] + [(70, None), (71, ""), (3, "aa  BB\n")]
    got = ppm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    tokens = {(i, t): (t or "").encode().lower().split() for i, t in rows}
    train = [w for (i, _), w in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in [*t, None])
    n, v = sum(c.values()), len(c)
    want = []
    for ((i, _), w), s in zip(tokens.items(), brute_ppm(train, tokens.values())):
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None])
        want.append((i, zlib.crc32(str(i).encode()) % 10 == 0, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(base, 4), round(s, 8)))
    assert sorted(want) == sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 8)) for r in got)


def test_probabilities_sum_to_one():
    texts = [[b"ab", b"abc"], [b"abd"], [b"b"]]
    keys, counts = ppm._train(texts, np.array([True, True, True]))
    ask = np.array([(int(keys[3]) & ~0xFF) | s for s in range(256)], np.uint64)
    every, at = np.unique(np.concatenate([keys, ask]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([counts, np.zeros(256)]))
    low, of = np.unique(keys & np.uint64(0xFFFFFF), return_inverse=True)
    p = 10 ** ppm.log_probabilities(every, total, (low, np.bincount(of, weights=counts).astype(np.int64)))[np.searchsorted(every, ask)]
    assert abs(p.sum() - 1) < 1e-9


PAGE = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-banner">We use cookies for the good of all the users of this site and it is what you want to have.</div>
{0}<h2>A &amp; B</h2><p>This is the main text of the page, and it is long enough to be decided by the rule.<p>Short&nbsp;one.</p>
<p>Another   long text of the page that is here for the reader of the article <b>and</b> to be read.{1}
<div id="comments"><p>I think that this is the best of all the articles that I have read in a long time.</p></div><aside>More of the same in the box</aside><footer>&copy; me</footer></body></html>"""
MAIN = "A & B\nThis is the main text of the page, and it is long enough to be decided by the rule.\nShort one.\nAnother long text of the page that is here for the reader of the article and to be read."


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<div>", "</div>"), ("<main><section>", "</section></main>")])
def test_extraction(spark, around):
    rows = [(1, "u", PAGE.format(*around)), (2, "u", None), (3, "u", ""), (4, "u", "<p>&lt;p&gt; cut off <"), (1, "u", "<script>only"), (5, None, "<div><nav>" * 3000)]
    got = {(r.page_id, r.n_chars): r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1, len(MAIN)] == MAIN and got[2, 0] == got[3, 0] == got[1, 0] == got[5, 0] == ""


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    rnd = random.Random(1)
    pool = "abc ABC'sS't reİΣσßéẞǅÅ　\u0085​\xad\x00\x1f\x7f\t\n12١½中文\U0001f600<|endoftext|>_-ͅﬁⅠⒶ한가க்"
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + ["<|endoftext|> x<|startoftext|>", "internationalization's", "long word" * 500]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count_batch(texts) == want
    # Any characters, known to the tables here or not.
    drawn = lambda: chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(128, 0xD800), rnd.randrange(0xE000, 0x32000), rnd.randrange(0xE000, 0x110000)]))
    odd = ["".join(drawn() for _ in range(rnd.randint(1, 12))) for _ in range(20_000)]
    assert counter.count_batch(odd) == [len(e.ids) for e in library.encode_batch(odd, add_special_tokens=False)]
    for w in ("internationalization", "thethethe", "straße"):
        raw = w.encode()
        assert counter.prefix_counts(w)[len(raw) - 1] == len(library.encode(w, add_special_tokens=False).ids)
        if w.isascii():
            assert counter.prefix_counts(w) == [len(library.encode(w[: k + 1], add_special_tokens=False).ids) for k in range(len(w))]
    table = counter.prefix_table("the cat's hat, 42")
    assert table[-1] == len(library.encode("the cat's hat, 42", add_special_tokens=False).ids) and token_counts.words_within(table, table[2]) == 3
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a " * 3000, 0), (3, "a " * 3000, 0)], "doc_id long, text string, n_tokens int")
    assert sorted(tuple(r) for r in token_counts.token_counts(df, path).collect()) == [(1, 0, 0, False), (2, 0, 0, False), (3, 6000, 3000, True), (3, 6000, 3000, True)]
    assert token_counts.token_counts(df.limit(0), path).collect() == []
    nameless = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in token_counts.token_counts(nameless, path).collect()] == [(None, 3, 2, False)]


def test_low_counts_of_a_task_are_one_row_each():
    """Blocks of many batches in one task give a row for each string, not for each block."""
    blocks = [(i, -1, 0, B.framed([B.pack_sorted(np.array([3, 7 + i % 2, 900], np.uint32)), B.pack(np.array([1, 2, i], np.uint8))])) for i in range(50)]
    t = B.block_table(blocks)
    out = list(ppm._low_of(t.slice(a, 20).to_batches()[0] for a in (0, 20, 40)))
    got = [(r["low"], r["n"]) for b in out for r in b.to_pylist()]
    assert got == [(3, 50), (7, 50), (8, 50), (900, sum(range(50)))]
    assert list(ppm._low_of(iter([]))) == []
