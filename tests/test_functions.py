from pyspark.sql import functions as F

from tallyloom.functions import documents, similarity, text
from tallyloom.operators import events, layout, library, reconcile


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("v")).first().v


def test_text(spark):
    assert one(spark, " A  b\tC ", text.squeeze_lower) == "a b c"
    assert one(spark, "“Don’t” — x… ", text.readable) == "\"don't\" - x..."
    assert one(spark, "Questions 1-6 The ﬁrst － one", text.review_text) == "the first-one"
    assert one(spark, "t r u e s", text.spaced_out) is True and one(spark, "a b c d", text.spaced_out) is False
    assert one(spark, '["a", " ", "b"]', text.display_answer) == "a / b" and one(spark, "null", text.display_answer) == "—"
    assert one(spark, "One. Two! Three", text.sentences) == ["One.", "Two!", "Three"] and one(spark, "", text.sentences) == [""]
    r = one(spark, "Questions 3–6", text.range_numbers)
    assert (r.first, r.last) == (3, 6) and one(spark, "9-3", text.range_numbers) is None
    assert one(spark, "1 and 22, 1999 300", text.digit_tokens) == [1, 22]
    rows = one(spark, "1. TRUE\n2) a b\n1. FALSE\n1234 x\n3 http://x.y", text.answer_rows)
    assert [(x.number, x.answer) for x in rows] == [(1, "TRUE"), (2, "a b"), (123, "4 x")]
    assert one(spark, "(ii) the way", text.option_label).label == "ii"
    assert one(spark, "READING PASSAGE 2", text.heading) == "passage" and one(spark, "Answer Key", text.heading) == "answers"
    assert one(spark, "ab é", text.token_estimate) == 2


def test_natural_order(spark):
    df = spark.createDataFrame([("t10.mp3",), ("t2.mp3",), ("T1.mp3",)], "n string")
    assert [r.n for r in df.orderBy(text.natural_key(F.col("n"))).collect()] == ["T1.mp3", "t2.mp3", "t10.mp3"]


def test_part_precedence(spark):
    df = spark.createDataFrame([(None, None, [14, 15], "x p3.pdf"), (None, None, [1, 9], "part 3.pdf"), (2, 1, [1], ""), (None, None, None, "p31.pdf")], "m int, h int, n array<int>, f string")
    assert [r.p for r in df.select(text.part_detect(*map(F.col, "mhnf")).alias("p")).collect()] == [2, 3, 2, None]


def test_similarity():
    assert similarity.dice("night", "nacht") == 0.25 and similarity.dice("", "") == 1.0
    assert similarity.ratio("abc", "abd") == 1 - 1 / 3 and similarity.lis_length([1, 3, 2, 2, 5]) == 4
    at, score = similarity.fuzzy_find("hello brave world", "xx hello brqve world yy")
    assert at == 3 and score > 0.9
    got = similarity.match_sentences(["one two three", "four five six", "absent words"], "zero one two three and four fixe six end")
    assert [h for h, _ in got] == ["exact", "fuzzy", "missing"]
    assert similarity.seeded_sample("s", 10, 3) == similarity.seeded_sample("s", 10, 3) and similarity.utf16_slice("a😀b", 1, 3) == "😀"


def test_documents():
    a, b = {"x": [1, 2], "y": None, "z": {"k": 1}}, {"x": [1, 3], "z": {"k": 1, "n": None}}
    d = documents.diff(a, b)
    assert [p for p, _, _ in d] == ["/x/1", "/y", "/z/n"]
    assert documents.patch(a, d) == b and documents.patch(b, d, undo=True) == a
    assert documents.gather_text({"text": "a", "id": "no", "items": [{"content": "b"}]}) == "a b"


def test_intervals(spark):
    rows = [(1, 1, "enter", 0, 1.0, "c"), (1, 2, "leave", 0, 4.0, "c"), (2, 1, "enter", 0, 1.0, "c"), (2, 2, "leave", 0, 2.0, "d")]
    df = spark.createDataFrame(rows, "attempt_id long, seq int, event_type string, passage_index int, clock double, clock_id string")
    assert [tuple(r) for r in events.intervals(df).collect()] == [(1, 0, 3.0, True)]
    assert events.replay([]) == ([], False)


def test_layout(spark):
    g = [("d", 0, i, c, 10.0 * i + (15 if i > 1 else 0), 5.0 + 0.1 * i, 9.0, 10.0, 14.0, 10.0, 0.0, i) for i, c in enumerate("abcd")]
    g.append(("d", 0, 9, "z", 0.0, 40.0, 9.0, 10.0, 49.0, 10.0, 0.0, 9))
    lines = layout.glyph_lines(spark.createDataFrame(g, "doc string, page int, id int, text string, x double, y double, width double, height double, baseline double, font_size double, angle double, source_order int"))
    assert [r.text for r in lines.orderBy("line").collect()] == ["ab cd", "z"]
    v = spark.createDataFrame([("d", x) for x in (1.0, 2.0, 3.0, 9.0)], "doc string, v double")
    assert [r.cluster for r in layout.running_clusters(v, ["doc"], "v", 1.6).orderBy("v").collect()] == [0, 0, 0, 1]
    regions = spark.createDataFrame([("d", 0, 1, 0), ("d", 0, 2, 1), ("d", 0, 3, 2)], "doc string, page int, id int, base_rank int")
    edges = spark.createDataFrame([("d", 0, 3, 1)], "doc string, page int, before int, after int")
    assert [r.id for r in layout.reading_order(regions, edges).orderBy("position").collect()] == [2, 3, 1]
    boxes = spark.createDataFrame([("d", 0, 1, 0.0, 0.0, 10.0, 10.0), ("d", 0, 2, 0.5, 0.0, 10.0, 10.0), ("d", 0, 3, 90.0, 0.0, 10.0, 10.0)], "doc string, page int, id int, x double, y double, width double, height double")
    assert round(layout.duplicate_ratio(boxes).first().ratio, 6) == round(2 / 3, 6)
    assert (layout.roman(14), layout.alpha(28)) == ("xiv", "ab")


def test_library(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, t string, v int")
    new = spark.createDataFrame([(1, "x", 2), (2, "y", 4), (3, "z", 1)], "id int, t string, v int")
    assert {tuple(r) for r in library.upsert(old, new, ["id"], newer="v").collect()} == {(1, "x", 2), (2, "b", 5), (3, "z", 1)}
    assert {r.id for r in library.insert_ignore(old, new, ["id"]).filter("t in ('a','b','z')").collect()} == {1, 2, 3}
    r = spark.createDataFrame([("k", n) for n in (1, 2, 3, 4, 6)], "key string, n int")
    assert library.page_ranges(r, "key", "n").first().ranges == "1–4、6"


def test_reconcile(spark):
    s = "n int, answer string"
    local = spark.createDataFrame([(1, "a"), (2, ""), (3, "x"), (4, "")], s)
    cloud = spark.createDataFrame([(1, "A"), (2, "b"), (3, "y"), (4, "q")], s)
    source = spark.createDataFrame([(2, "B"), (3, "x"), (4, "w")], s)
    got = {r.n: (r.state, r.auto_apply) for r in reconcile.slot_decisions(local, cloud, source, ["n"]).collect()}
    assert got == {1: ("agree", False), 2: ("missing local", True), 3: ("conflict", False), 4: ("missing local", False)}
