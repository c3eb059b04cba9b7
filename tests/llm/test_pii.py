"""Base spans against Python's own matcher; what the labelers add; hard texts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tallyloom.llm import pii, queries

STRICT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(int(c) for c in reversed(d))) % 10 == 0


def valid(kind, m):
    d = "".join(c for c in m if c in "0123456789")
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def base(text):
    """(kind, start, end) of the contract's base spans."""
    out = [(m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(STRICT.items()) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def messy(rnd):
    bits = ["a@b.c", "@", ".", "_", "x.y+z@q-r.st.uv", "a@b", "1.2.3.4", "256.1.1.1", "0001.2.3.04", ".5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-1234", "+", "(", ")", " ", "-", "\n", "é", "😀", "0", "79927398713", "12", "word", "+49.30.1234567", "name (at) host (dot) com", "tel 030 1234567", "::1", "fe80::1:2"]
    return "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))


def test_base_spans(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(k, messy(rnd)) for k in range(800)] + [(None, None), (900, ""), (None, "a@b.c"), (5, "a@b.c"), (5, "a@b.c"), (901, "".join(f"u{k}@host{k}.example.com " for k in range(300)))]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("t", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = [], []
    for r in queries.op13_personal_data(spark, str(tmp_path)).collect():
        got.append((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
    for i, t in rows:
        found = base(t)
        sha = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()
        want.append((i, *(sum(k == kind for k, _, _ in found) for kind in pii.KINDS), sha))
    assert sorted(map(str, got)) == sorted(map(str, want))


def corpus():
    """Documents with base spans, written-out and regrouped data, and numbers that are none."""
    rnd, rows, wanted = random.Random(9), [], {}
    words = lambda n: " ".join(rnd.choice("the quick brown fox jumps over a lazy dog near our old house".split()) for _ in range(n))
    card = lambda: next(d for d in (f"4{rnd.randrange(10**15):015d}" for _ in range(99)) if luhn(d))
    group = lambda d, sep: sep.join(d[k : k + 4] for k in range(0, 16, 4))
    for k in range(600):
        kind = k % 12
        c, x = card(), rnd.randrange(1000, 9999)
        body = {
            0: (f"mail user{x}@mail.example.com", None),
            1: (f"card {c}", None),
            2: (f"call +1 (212) 555-{x}", None),
            3: (f"host 12.34.{x % 250}.7", None),
            4: (f"contact john{x} [at] mail{x} [dot] com", "email"),
            5: (f"card {group(c, '.')}", "card"),
            6: (f"tel 212-555-{x}", "phone"),
            7: (f"number {c[:-1]}{(int(c[-1]) + 3) % 10}", ""),
            8: (f"version 2.{x}.300.4 of 2024-10-12 and 12:30:45", ""),
            9: (f"order {x}{x}{x}9", ""),
            10: ("look at this dot here at home. We met at noon", ""),
            11: (f"mail info{x}@example.org and write to anna{x}(at)site{x}(dot)de", "email"),
        }[kind]
        rows.append((k, f"{words(9)} {body[0]} {words(8)}"))
        wanted[k] = body[1]
    return rows, wanted


def test_labelers_add_what_is_meant_and_nothing_else(spark):
    rows, wanted = corpus()
    found = {r.doc_id: r.spans for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = misses = wrong = 0
    for k, text in rows:
        assert [(s.kind, s.start, s.end) for s in found[k] if s.base] == base(text)
        added = [s.kind for s in found[k] if not s.base]
        if wanted[k]:
            hits, misses = hits + (wanted[k] in added), misses + (wanted[k] not in added)
        wrong += sum(a != wanted[k] for a in added)
    assert hits >= 0.95 * (hits + misses), (hits, misses)
    assert wrong <= 0.01 * len(rows), wrong


def test_reliabilities_come_near_the_truth():
    rnd = random.Random(1)
    truth, sure, counts = 0.3, [0.99, 0.8, 0.9, 0.7, 0.85], {}
    for _ in range(20_000):
        y = 1 if rnd.random() < truth else -1
        v = tuple(0 if rnd.random() < 0.3 else (y if rnd.random() < s else -y) for s in sure)
        counts[v] = counts.get(v, 0) + 1
    share, got = pii.reliabilities(counts)
    assert abs(share - truth) < 0.03
    assert all(abs(a - b) < 0.04 for a, b in zip(got, sure, strict=True)), got


def test_hard_texts_stay_linear(spark):
    hard = ["a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1(" * 130_000, "1 " * 200_000, ".a" * 200_000 + "@b" + ".c" * 200_000, "a:" * 200_000, "+1" + "(" * 400_000, "12 " * 130_000, "é " * 200_000 + "a@b.c"]
    got = {r.doc_id: r.spans for r in pii.spans(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")).collect()}
    assert [(s.start, s.end) for s in got[10]] == [(400_000, 400_005)]
    assert [(s.kind, s.start) for s in got[6] if s.base] == [("email", 0)]


def test_no_python_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id string, text string, votes int")
    assert pii.spans(empty).collect() == []
    plan = pii.candidates(empty)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
