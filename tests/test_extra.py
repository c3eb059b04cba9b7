"""Layout, page splits, imports and quality against hand-made cases, and the
queries that SQL can't express against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyloom import plans
from tallyloom.functions import questions, similarity
from tallyloom.operators import imports, layout, metrics, quality, reading, split


def glyph(text, x, y=10.0, size=10.0, n=0, angle=0.0):
    return {"text": text, "x": x, "y": y, "width": 5.0, "height": size, "baseline": y + 0.9 * size, "font_size": size, "angle": angle, "source_order": n}


def test_lines_are_cut_at_wide_gaps():
    row = [glyph(c, 10 + 6 * i, n=i) for i, c in enumerate("abcd")] + [glyph(c, 200 + 6 * i, n=9 + i) for i, c in enumerate("xy")]
    assert [l["text"] for l in layout.lines_of_page(row)] == ["abcd", "xy"]
    spaced = [glyph(c, 10 + 6 * i, n=i) for i, c in enumerate("abcd")] + [glyph("e", 42, n=9)]
    assert [l["text"] for l in layout.lines_of_page(spaced)] == ["abcd e"]


def test_a_glyph_follows_the_last_glyph_of_a_line():
    # Overlap with the line as a whole, not with its last glyph: a line apart.
    row = [glyph("A", 10, y=0.0, size=30.0), glyph(".", 16, y=25.0, size=4.0), glyph("b", 22, y=1.0, size=20.0)]
    for g in row:
        g["baseline"] = 27.0
    assert [l["text"] for l in layout.lines_of_page(row)] == ["A.", "b"]
    turned = [glyph("a", 10), glyph("b", 16, angle=0.5)]
    assert len(layout.lines_of_page(turned)) == 2


def test_gutters():
    left, right = [(50.0, 60.0 + 14 * i, 220.0, 11.0) for i in range(6)], [(350.0, 60.0 + 14 * i, 220.0, 11.0) for i in range(6)]
    title = [(40.0, 20.0, 520.0, 14.0)]
    (gap,) = layout.gutters_of_page(left + right + title, 600.0)
    assert 265 <= gap[0] <= 280 and 345 <= gap[1] <= 352
    assert layout.gutters_of_page(left[:2] + right[:1], 600.0) == []  # too few lines
    below = [(x, y + 400, w, h) for x, y, w, h in right]
    assert layout.gutters_of_page(left + below, 600.0) == []  # never side by side
    crossed = left + right + [(200.0, 30.0, 200.0, 11.0)]
    assert len(layout.gutters_of_page(crossed, 600.0)) == 1
    assert layout.gutters_of_page(crossed + [(200.0, 45.0, 200.0, 11.0)], 600.0) == []


def test_columns_and_order(spark):
    lines = [(1, 40.0, 20.0, 520.0), (2, 50.0, 60.0, 220.0), (3, 350.0, 60.0, 220.0), (4, 50.0, 80.0, 220.0), (5, 350.0, 80.0, 220.0), (6, 50.0, 100.0, 220.0), (7, 350.0, 100.0, 220.0)]
    df = spark.createDataFrame([("d", 0, n, "t", x, y, w, 11.0) for n, x, y, w in lines], "doc string, page int, line int, text string, x double, y double, width double, height double")
    got = {r.line: r.column for r in layout.columns_of(df, layout.gutters(df, 600.0), 600.0).collect()}
    assert got == {1: None, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0, 7: 1}
    rows = [glyph(c, x + 6 * i, y, n=n * 100 + i) for n, (x, y, t) in enumerate([(50, 60, "aaaa"), (350, 60, "cccc"), (50, 80, "bbbb"), (350, 80, "dddd")]) for i, c in enumerate(t)]
    g = spark.createDataFrame([{"doc": "d", "page": 0, **r, "x": float(r["x"]), "y": float(r["y"])} for r in rows])
    found = layout.glyph_lines(g)
    assert [r.text for r in reading.in_order(found, reading.regions(found, 600.0, 800.0)).orderBy("position").collect()] == ["aaaa", "bbbb", "cccc", "dddd"]


PROSE = "\n".join(["The river runs past the old town and then on to the sea in a slow curve."] * 7)


TIMED = "You should spend about 20 minutes on Questions 14–26, which are based on Reading Passage 2\n"
BOOKLETS = {
    "headed": ["Cover", "READING PASSAGE 1\n" + PROSE, "Questions 1-13\n1 What?", "READING\nPASSAGE 2\n" + PROSE, "Questions 14-26\n14 Who?", "ANSWER KEY\n" + "\n".join(f"{n} TRUE" for n in range(1, 27))],
    "bare": [PROSE, "Questions 1-13", PROSE, "Questions 14-26"],
    "one": [PROSE, "Questions 1-5", PROSE, "Questions 6-13"],
    "clash": ["PASSAGE 2\n" + PROSE, "Questions 1-13"],
    "timed": [TIMED + PROSE],
    "first": ["Questions 1-13\n1 What?", PROSE, "Questions 14-26\n14 Who?", PROSE],
    "bands": ["Questions 1-13\n1 a", "Questions 14-26\n14 b", "Questions 27-40\n27 c"],
    "tests": ["Test 1\nREADING PASSAGE 1\n" + PROSE, "Questions 1-13", "Test 2\nREADING PASSAGE 1\n" + PROSE, "Questions 1-13", "Answer key Test 1\n1 A\n2 B\n3 C", "4 D\n5 A\n6 B"],
    "shared": ["READING PASSAGE 1\n" + PROSE, "Questions 1-13\n1 a", "9 b\n10 c\n11 d\n12 e\n13 f\nREADING PASSAGE 2\n" + PROSE, "Questions 14-26"],
    "spaced": ["R E A D I N G  P A S S A G E  1\n" + PROSE, "Questions 1to13", "Passage 2\n" + PROSE, "Questionnaire 1"],
    "blank": ["", None],
    "neither": ["Test your vocabulary\nQuestions on Reading Passage 1"],
}


def test_page_split(spark):
    df = spark.createDataFrame([(d, n, t) for d, pages in BOOKLETS.items() for n, t in enumerate(pages, 1)], "doc string, page int, text string")
    found, answers = {d: [] for d in BOOKLETS}, {}
    for r in split.split_documents(df).orderBy("doc", "segment").collect():
        found[r.doc].append(r)
    for r in split.with_answer_pages(split.page_signals(df)).filter("is_answers").orderBy("page").collect():
        answers.setdefault(r.doc, []).append(r.page)
    assert [(s.passage, s.pages, s["first"], s["last"], s.confidence) for s in found["headed"]] == [(1, [2, 3], 1, 13, "high"), (2, [4, 5], 14, 26, "high")]
    assert answers == {"headed": [6], "tests": [5, 6]} and found["headed"][0].default_split
    # By layout alone: borne out by the numbers, or taken back.
    assert [s.passage for s in found["bare"]] == [1, 2] and "layout" in found["bare"][0].signals
    assert [s.pages for s in found["one"]] == [[1, 2, 3, 4]]
    assert found["clash"][0].confidence == "low" and not found["clash"][0].default_split
    (timed,) = found["timed"]
    assert timed.passage == 2 and (timed["first"], timed["last"]) == (14, 26) and "instruction" in timed.signals
    assert [(s.passage, s.pages) for s in found["first"]] == [(1, [1, 2]), (2, [3, 4])]  # questions come first
    assert [(s.passage, s.pages, s["first"]) for s in found["bands"]] == [(1, [1], 1), (2, [2], 14), (3, [3], 27)]  # no prose at all
    assert [(s.test, s.passage, s.pages, s.confidence) for s in found["tests"]] == [(1, 1, [1, 2], "high"), (2, 1, [3, 4], "high")]
    assert [(s.pages, s.shares_start) for s in found["shared"]] == [([1, 2, 3], False), ([3, 4], True)]
    assert [(s.passage, s.confidence) for s in found["spaced"]] == [(1, "high"), (2, "high")]
    assert found["blank"] == found["neither"] == []


def test_split_documents(spark):
    rows = [("a", 2, "Questions 1-13"), ("a", 1, "READING PASSAGE 1\n" + PROSE), ("b", 1, None), ("a", 3, "PASSAGE 2\n" + PROSE), ("a", 4, "Questions 14-26")]
    got = split.split_documents(spark.createDataFrame(rows, "doc string, page int, text string")).collect()
    assert sorted((r.doc, r.segment, r.default_split) for r in got) == [("a", 0, True), ("a", 1, True)]


def test_import_is_a_whole(spark):
    names = "attempt_id long, terminal_id string, install_id string, paper_id string, exported_at string"
    stored = spark.createDataFrame([(1, "T1", "I1", "P1", "2024-01-01T00:00:00Z"), (2, "T1", None, "", "2024-01-01T00:00:00Z"), (3, "T1", None, "P1", "2025-01-01T00:00:00Z")], names)
    children = spark.createDataFrame([(1, "q1", "old"), (1, "q2", "old"), (2, "q1", "old"), (3, "q1", "old")], "attempt_id long, question_id string, answer string")
    new = [("f1", 1, True, "T1", "I1", "P2", "2024-02-01T00:00:00Z"), ("f1", 2, False, "T9", None, "P1", "2024-02-01T00:00:00Z"), ("f2", 2, True, "T9", None, "P1", "2024-02-01T00:00:00Z"), ("f2", 3, False, "T1", None, "P1", "2026-01-01T00:00:00Z"), ("f3", 3, True, "T1", None, "P1", "2024-06-01T00:00:00Z"), ("f4", 1, True, "T1", None, "P1", "2024-03-01T00:00:00+00:00")]
    incoming = spark.createDataFrame(new, "file string, attempt_id long, main boolean, " + names.split(", ", 1)[1])
    rows = spark.createDataFrame([("f4", 1, "q3", "new"), ("f1", 1, "q1", "stale"), ("f2", 3, "q1", "never")], "file string, attempt_id long, question_id string, answer string")
    out, outcomes = imports.import_snapshots({"attempts": stored, "answers": children}, {"attempts": incoming, "answers": rows})
    assert {(r.file, r.attempt_id): r.outcome for r in outcomes.collect()} == {("f1", 1): "imported", ("f1", 2): "conflict", ("f2", 2): "failed", ("f2", 3): "failed", ("f3", 3): "skipped", ("f4", 1): "imported"}
    assert sorted((r.attempt_id, r.question_id, r.answer) for r in out["answers"].collect()) == [(1, "q3", "new"), (2, "q1", "old"), (3, "q1", "old")]
    first = out["attempts"].filter("attempt_id = 1").first()
    assert (first.paper_id, first.install_id, first.exported_at) == ("P1", "I1", "2024-03-01T00:00:00+00:00")


def test_rejudge_rules():
    for rule in ({"scope": "paper"}, {"scope": "exam", "exam": "E", "accepted": ["a"]}, {"scope": "all", "accepted": ["a"]}, {"scope": "paper", "paper": "P", "accepted": [" "]}):
        with pytest.raises(ValueError):
            imports.rejudge(None, None, None, None, rule)


def test_words_as_characters(spark):
    rnd = random.Random(1)
    pairs = [(" ".join(rnd.choice("ab cd ef gh".split()) for _ in range(rnd.randint(0, 8))), " ".join(rnd.choice("ab cd ef xy".split()) for _ in range(rnd.randint(0, 8)))) for _ in range(60)]
    for r in metrics.error_rates(spark.createDataFrame(pairs, "r string, p string"), "r", "p").collect():
        a, b = r.r.split(), r.p.split()
        assert (r.wer is None) == (not a)
        if a:
            assert abs(r.wer - similarity.levenshtein(a, b) / len(a)) < 1e-12 and abs(r.cer - similarity.levenshtein(r.r, r.p) / len(r.r)) < 1e-12


def test_group_fallback_by_numbers(spark):
    schema = "doc int, task_id string, numbers array<int>, task_type string, prompt string, response_prompt string, bank map<string,string>"
    local = spark.createDataFrame([(1, "a", [1, 2], "cloze", "Choose  ONE", None, {"A": "x"}), (1, "b", [3], "cloze", "p", None, None), (1, "c", [9], "cloze", "p", None, None)], schema)
    cloud = spark.createDataFrame([(1, "a", [1, 2], "matching", "choose one", None, {"A": "y"}), (1, "z", [3, 3], "cloze", "q", None, {"A": "x"})], schema)
    got = sorted((r.task_id, r.code) for r in quality.compare_groups(local, cloud, "doc").collect())
    assert got == [("a", "option bank conflict"), ("a", "task type conflict"), ("b", "option bank missing locally"), ("b", "prompt conflict")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Small tables for the queries below."""
    d = str(tmp_path_factory.mktemp("sf"))
    rnd = random.Random(4)
    spark.createDataFrame([(i, f"name {rnd.choice('aäzß')}{i}", i % 50, "t", "b") for i in range(300)], "p_partkey long, p_name string, p_size int, p_type string, p_brand string").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(i, i % 5, rnd.random() * 40) for i in range(200)], "event_id long, user_id long, value double").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(i // 6, i % 6, "same start " + rnd.choice(["ö", "o", "ä"]) * (i % 4) + "tail", "user") for i in range(60)], "conv_id long, turn int, text string, role string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(i, " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(900)}" for _ in range(20))) for i in range(6)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_lcp_by_brute_force(spark, small):
    rows = {(r.conv_id, r.turn): r.text.encode() for r in spark.read.parquet(f"{small}/conversations.parquet").collect()}
    for r in plans.QUERIES["win_lcp_prev"](spark, small).collect():
        a, b = rows[r.conv_id, r.turn], rows.get((r.conv_id, r.turn - 1), b"")
        assert r.lcp == len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b))))


def test_spatial_pairs_by_brute_force(spark, small):
    boxes = [(i % 21, i, i // 40 % 25 * 20.0, i % 7 * 3.0) for i in range(300)]
    want = []
    for doc in range(21):
        taken = set()
        odd = [b for b in boxes if b[0] == doc and b[1] % 2]
        for _, i, x, y in sorted(b for b in boxes if b[0] == doc and b[1] % 2 == 0):
            near = sorted((-layout.iou((x, y, 18.0, 12.0), (u, v, 18.0, 12.0)), j) for _, j, u, v in odd if j not in taken)
            if near and -near[0][0] >= 0.55:
                taken.add(near[0][1])
                want.append((str(doc), i, near[0][1]))
    got = [(r.doc, r.ocr, r.native) for r in plans.QUERIES["jn_spatial_iou"](spark, small).collect()]
    assert sorted(got) == sorted(want) and got


@pytest.mark.parametrize("name,tolerance,first", [("win_running_cluster", 2.0, False), ("win_first_anchor_cluster", 8.0, True)])
def test_clusters_by_brute_force(spark, small, name, tolerance, first):
    rows = spark.read.parquet(f"{small}/events.parquet").collect()
    want = {}
    for user in range(5):
        members, cluster = [], -1
        for value, event in sorted((r.value, r.event_id) for r in rows if r.user_id == user):
            if not members or abs(value - (members[0] if first else sum(members) / len(members))) > tolerance:
                members, cluster = [], cluster + 1
            members.append(value)
            want[event] = cluster
    assert {r.event_id: r.cluster for r in plans.QUERIES[name](spark, small).collect()} == want


def test_samples_and_shuffles(spark, small):
    got = {r.item_id: r["sample"] for r in plans.QUERIES["num_fnv_sample"](spark, small).collect()}
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        h = 14695981039346656037
        for b in r.text.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        pool, want = list(range(40)), []
        for _ in range(5):
            h ^= h << 13 & 2**64 - 1
            h ^= h >> 7
            h ^= h << 17 & 2**64 - 1
            want.append(pool.pop(h % len(pool)))
        assert got[r.item_id] == sorted(want)
    drawn = [r.drawn for r in plans.QUERIES["num_seeded_shuffle"](spark, small).collect()]
    assert all(len(set(x)) == 6 and set(x) <= set(range(30)) for x in drawn) and len({tuple(x) for x in drawn}) > 1
    assert questions.shuffled([1, 2, 3], "s", 9) == questions.shuffled([1, 2, 3], "s", 9)


def test_orderings(spark, small):
    names = [r.p_name for r in plans.QUERIES["srt_locale"](spark, small).collect()]
    plain = [r.p_name for r in spark.read.parquet(f"{small}/part.parquet").orderBy(F.collate("p_name", "zh"), "p_partkey").collect()]
    assert names == plain and len(names) == 300
    assert [r.p_partkey for r in plans.QUERIES["srt_natural"](spark, small).collect()] == list(range(300))
    ranks = [(r.group_rank, r.p_name, r.p_partkey) for r in plans.QUERIES["srt_group_rank"](spark, small).collect()]
    assert ranks == sorted(ranks, key=lambda x: (x[0], x[1].encode(), x[2])) and len(ranks) == 300


def test_fuzzy_window(spark, small):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    for r in plans.QUERIES["str_fuzzy_window"](spark, small).collect():
        t = texts[r.item_id]
        piece = t[19:39] + "##" + t[41:61]
        assert r.at == 19 and abs(r.score - similarity.ratio(piece, t[19 : 19 + len(piece)])) < 1e-9


def test_page_queries_give_whole_pages(spark, small):
    gaps = plans.QUERIES["num_gutters"](spark, small).collect()
    assert len(gaps) == 8 and all(g.left < 350 and g.right > 270 for g in gaps)
    columns = plans.QUERIES["num_column_assign"](spark, small).collect()
    assert len(columns) == 300 and {r.column for r in columns} == {None, 0, 1}
    tables = plans.QUERIES["num_table_ruled"](spark, small).collect()
    assert {(t.how, t["columns"], t["rows"]) for t in tables} == {("ruling_lines", 4, 5), ("text_alignment", 4, 4)} and len(tables) == 15
    pages = plans.QUERIES["seg_enrich_page"](spark, small).collect()
    assert {p.doc for p in pages} == {str(i) for i in range(6)}
    segments = plans.QUERIES["seg_pdf_split"](spark, small).collect()
    form = {d: sorted((s.test, s.passage, tuple(s.pages)) for s in segments if s.doc == d) for d in {s.doc for s in segments}}
    assert form["0"] == [(None, 1, (1, 2)), (None, 2, (3, 4)), (None, 3, (5, 6))]
    assert form["1"] == [(None, 1, (1, 2)), (None, 2, (3, 4))]
    assert form["2"] == [(None, 1, (1, 2, 3)), (None, 2, (3, 4))]
    assert form["3"] == [(1, 1, (1, 2)), (2, 1, (3, 4))]
    assert form["4"] == [(None, 1, (1,)), (None, 2, (2,)), (None, 3, (3,))]
