"""Quality rules, line dedup and mixing against brute force, and their edges."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import line_dedup, mixing, quality_rules

SCHEMA = "doc_id long, text string, source string, mix string"


def words(t):
    return (t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("the of a b c. d".split()) for _ in range(rnd.randint(1, 90))).replace("d", "d\n"), f"s{i % 4}", "x") for i in range(40)]
    rows += [(100, None, None, None), (101, "", "s1", None), (102, " \n\t ", None, "y"), (3, rows[3][1], "s3", "x"), (103, "long " * 30000, "s1", None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_quality_counts(docs):
    df, rows = docs
    got = {(r.doc_id, r.source): r.quality for r in quality_rules.quality_report(df).collect()}
    for i, t, s, _ in rows:
        ws = [w for w in words(t) if w]
        grams = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(ws) < 5000 else set(range(len(ws)))
        q = got[i, s]
        lines = [l for l in (t or "").split("\n") if any(words(l))]
        assert (q.n_words, q.word_chars, q.n_repeat_words, q.n_dup_lines) == (len(ws), sum(map(len, ws)), len(covered), len(lines) - len(set(lines))), (i, t)
        assert q.base_failed == (len(ws) < 50 or 2 * len(covered) > len(ws))
        assert not (q.base_failed and q.kept)


def test_quality_cleaning(spark):
    body = "\n".join("Line " + " ".join(f"word{k}{j}" for j in range(9)) + "." for k in range(9))
    furniture = ["Alle Rechte vorbehalten, Muster GmbH und Partner.", "Tous droits réservés par la société du même nom.", "Todos los derechos reservados por la misma empresa."]
    rows = [(1, body + "\nHome | About | Contact\nAll rights reserved.\nMENU\n" + "\n".join(furniture)), (3, body + "\n\n \n" + body.replace("word", "term") + "\n"), (2, "\n".join(["A | b | c | d | e | f | g"] * 3 + ["REALLY BAD!! SHOUTING!! TEXT!! " * 8]))]
    out = quality_rules.clean_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.text) for r in out] == [(1, body), (3, rows[1][1])]  # blank lines stay


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules.clean_documents(empty).columns == empty.columns
    assert quality_rules.quality_report(empty).count() == 0
    assert line_dedup.without_repeated_lines(empty).collect() == []
    assert mixing.curriculum(empty.drop("mix")).collect() == []


def changed(rnd, s, n):
    s = list(s)
    for _ in range(n):
        k, p = rnd.randrange(3), rnd.randrange(len(s) + 1)
        if k == 0:
            s.insert(p, rnd.choice("abé"))
        elif p < len(s):
            s[p : p + 1] = [] if k == 1 else [rnd.choice("abé")]
    return "".join(s)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_within_is_edit_distance(spark):
    rnd = random.Random(3)
    pairs = [("".join(rnd.choice("abé") for _ in range(rnd.randint(4, 30))),) for _ in range(200)]
    pairs = [(a, changed(rnd, a, rnd.randint(0, 4))) for (a,) in pairs]
    for edits in (1, 2, 3):
        r = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within(F.col("a"), F.col("b"), edits).alias("w")).collect()
        assert all(x.w == (distance(x.a, x.b) <= edits) for x in r)


@pytest.mark.parametrize("most", [16, 1])
def test_line_dedup(spark, most):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(12, 32))) for _ in range(20)] + ["Read more here", "x"]
    docs = [(i % 20, "\n".join(changed(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 3, 4])) for _ in range(rnd.randint(1, 7)))) for i in range(30)]
    docs += [(90, None), (91, ""), (5, docs[3][1]), (None, docs[4][1] + "\nonly under no id at all"), (7, docs[7][1]), (92, "long line " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    key = {t: r for t, r in df.select("text", F.xxhash64("text")).collect()}
    first, gone = {}, {}
    places = sorted({((i is not None, i or 0, key[t], n), l.strip().lower()) for i, t in docs if t for n, l in enumerate(t.split("\n")) if l.strip()})
    for at, l in places:
        first.setdefault(l, at)
    order = list(first)
    near = {l for k, l in enumerate(order) if len(l) >= 20 and any(abs(len(l) - len(o)) < 3 and len(o) >= 20 and distance(l, o) <= 2 for o in order[:k])}
    for at, l in places:
        if first[l] != at or l in near:
            gone.setdefault((at[1] if at[0] else None, at[2]), []).append(at[3])
    assert {(r.doc, r.row): r.removed for r in line_dedup.removed_lines(df, most=most).collect()} == gone
    left = line_dedup.without_repeated_lines(df.withColumn("lines", F.lit("own")), most=most).collect()
    want = []
    for i, t in docs:
        lost = gone.get((i, key[t]), []) if t else []
        kept = "\n".join(l for n, l in enumerate(t.split("\n")) if n not in lost) if t else t
        if not lost or kept.strip():
            want.append((i, kept))
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted(want, key=str) and left[0].lines == "own"
    clash = line_dedup.with_verdicts(df.withColumn("Lines", F.lit(1)), most=most)
    assert clash.columns == ["doc_id", "text", "Lines", "lines_"] and clash.count() == len(docs)


def test_mixing(docs):
    df, rows = docs
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len([w for w in words(t) if w])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left, free = {}, 1.5 * sum(sizes.values()), dict(weight)
    while free:
        over = [s for s in free if left * free[s] / sum(free.values()) > 2 * sizes[s]]
        if not over:
            target |= {s: left * w / sum(free.values()) for s, w in free.items()}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        free = {s: w for s, w in free.items() if s not in over}
    clash = mixing.mix(df.withColumn("__m", F.lit("own")), docs_a_bucket=5)
    assert clash.columns == [*df.columns, "__m", "mix_"] and clash.filter("__m = 'own' AND mix_.size >= 0").count() == len(rows)
    out = mixing.mix(df.drop("mix"), docs_a_bucket=5).collect()
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        assert abs(r.mix.target - target[r.source]) < 1e-6 and 0 <= r.mix.taken <= 2 * r.mix.size
        taken[r.source] = taken.get(r.source, 0) + r.mix.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    named = mixing.curriculum(df.withColumns({"taken": F.lit("t"), "Position": F.lit("p")}), docs_a_bucket=5)
    assert named.columns == [*df.columns, "taken", "Position", "epoch", "taken_", "position_"] and named.filter("taken = 't' AND taken_ > 0").count() > 0
    seq = mixing.curriculum(df.drop("mix"), docs_a_bucket=5).collect()
    assert sum(r.taken for r in seq) == sum(taken.values()) and [r.position for r in seq] == sorted(r.position for r in seq)
    assert all(0 <= r.position <= 1 for r in seq)


def test_mix_of_rows_without_ids(spark):
    """They are spread by their text, and nothing of them is lost or fixed by chance."""
    rows = [(None, "word " * (k % 7) + f"t{k}", "s", "x") for k in range(300)] + [(5, "one two", "s", None), (5, "two one", "s", None), (None, None, None, None), (None, "", "s", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(docs.drop("mix"), docs_a_bucket=20)
    sizes = {t: len([w for w in words(t) if w]) for _, t, _, _ in rows}
    got = [(r.text, r.mix.size, r.mix.taken, r.mix.start) for r in found.collect()]
    assert len(got) == len(rows) and all(n == sizes[t] and 0 <= taken <= 2 * n for t, n, taken, _ in got)
    again = mixing.mix(docs.drop("mix").repartition(7), docs_a_bucket=20).collect()
    assert sorted(map(str, got)) == sorted(str((r.text, r.mix.size, r.mix.taken, r.mix.start)) for r in again)
    sized = mixing.with_sizes(docs, name="m")
    assert sized.select("m.bucket").distinct().count() > 50


def test_quality_of_rows_without_ids(spark):
    text = "\n".join("Line " + " ".join(f"w{k}{j}" for j in range(9)) + "." for k in range(9))
    docs = spark.createDataFrame([(None, text, None, None), (None, text, "s", None), (None, None, None, None)], SCHEMA)
    assert [r.quality.kept for r in quality_rules.quality_report(docs).orderBy(F.col("text").isNull()).collect()] == [True, True, False]
    assert quality_rules.clean_documents(docs).count() == 2


def test_phrases_in_context(spark):
    cut = ["Copyright © 2021 Muster GmbH and all its many partners.", "© 2020 The Example Company and its many friends.", "We use cookies to make this site better for you.", "Please read our cookie policy before you go on here.", "Wir verwenden Cookies auf allen unseren vielen Seiten.", "Impressum: Muster GmbH, Musterweg 1, Musterstadt."]
    stay = ["The cook put the cookies into the oven and waited.", "The history of copyright begins with the printing press.", "Datenschutz ist ein Grundrecht, das in vielen Ländern durch Gesetze geschützt wird.", "Copyright law was changed in the year of 1976."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cut + stay)], "k int, t string")
    assert [r.k for r in df.filter(quality_rules.line_fails(F.col("t"))).orderBy("k").collect()] == list(range(len(cut)))
