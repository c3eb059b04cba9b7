"""Each rule on references broken by one written case."""

from pyspark.sql import functions as F

from tallyloom.operators import quality


def test_each_rule(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tasks = frame([("d", "t1", "matching", ["A", "B"]), ("d", "t2", "matching_headings", None), ("d", "t3", "cloze", None), ("d", "t3", "cloze", None), ("e", "t1", "cloze", None)], "doc string, task_id string, task_type string, alphabet array<string>")
    responses = frame([("d", "r1", "t1"), ("d", "r2", "t2"), ("d", "r3", "t3"), ("d", "r3", "t3"), ("d", "r9", "none"), ("e", "r1", "t1")], "doc string, response_id string, task_id string")
    slots = frame([("d", "s1", "r1", 1, None), ("d", "s2", "r2", 2, None), ("d", "s3", "r3", 3, 2), ("d", "s4", "r3", 3, 9), ("d", "s5", "gone", 5, None), ("e", "s1", "r1", 1, 3)], "doc string, slot_id string, response_id string, number int, word_limit int")
    answers = frame([("d", "s1", " c "), ("d", "s2", "i"), ("d", "s3", "one two  three"), ("d", "s4", " "), ("d", "s5", "x"), ("d", "lost", "x"), ("e", "s1", "one two three")], "doc string, slot_id string, answer string")
    options = frame([("d", "t1", "A", "red"), ("d", "t1", "C", ""), ("d", "t1", None, "blue"), ("d", "t2", "i", "First")], "doc string, task_id string, label string, text string")
    assets = frame([("d", "a1", "x/../y.png", "t1", True), ("d", "a2", "ok/y.png", None, False), ("d", "a3", "ok.png", "nowhere", True), ("d", "a4", "a.png", None, True), ("d", "a4", "b.png", None, True), ("d", "a5", "/etc/x", None, True), ("d", "a6", "a..b/c.png", None, True)], "doc string, asset_id string, path string, task_id string, stored boolean")
    got = {tuple(r) for r in quality.reference_issues(tasks, responses, slots, answers, options, assets).collect()}
    assert got == {
        ("d", "t3", "task id twice"), ("d", "r3", "response id twice"), ("d", "3", "question number twice"), ("d", "r9", "response without task"), ("d", "s5", "slot without response"),
        ("d", "lost", "answer without slot"), ("d", "s4", "slot without answer"), ("d", "s3", "answer over the word limit"), ("d", "t1", "option without label"), ("d", "t1", "option without text"),
        ("d", "t1", "options differ from instruction"), ("d", "t2", "too few headings"), ("d", "a4", "asset id twice"), ("d", "a1", "asset path unsafe"), ("d", "a5", "asset path unsafe"), ("d", "a2", "asset missing"), ("d", "a3", "asset of no task"),
    }


def test_inputs_are_read_once(spark):
    """Rules read written tables, and no source is computed for each rule."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        calls.add(1)
        return x

    t = spark.createDataFrame([("d", "t", "cloze", None)], "doc string, task_id string, task_type string, alphabet array<string>").withColumn("task_id", seen("task_id"))
    r = spark.createDataFrame([("d", "r", "t")], "doc string, response_id string, task_id string")
    s = spark.createDataFrame([("d", "s", "r", 1, 1)], "doc string, slot_id string, response_id string, number int, word_limit int")
    a = spark.createDataFrame([("d", "s", "two words")], "doc string, slot_id string, answer string")
    none = lambda c: spark.createDataFrame([], c)
    got = quality.reference_issues(t, r, s, a, none("doc string, task_id string, label string, text string"), none("doc string, asset_id string, path string, task_id string, stored boolean"))
    assert [tuple(x) for x in got.collect()] == [("d", "s", "answer over the word limit")]
    assert calls.value == 1


def test_no_table_goes_through_the_driver(spark):
    """Joins are broadcast by no estimate, however small the tables look."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    t = frame([("d", "t", "cloze", None)], "doc string, task_id string, task_type string, alphabet array<string>")
    r, s = frame([("d", "r", "t")], "doc string, response_id string, task_id string"), frame([("d", "s", "r", 1, 1)], "doc string, slot_id string, response_id string, number int, word_limit int")
    a, o = frame([("d", "s", "two words")], "doc string, slot_id string, answer string"), frame([("d", "t", "A", "x")], "doc string, task_id string, label string, text string")
    assets = frame([("d", "a", "a.png", "t", True)], "doc string, asset_id string, path string, task_id string, stored boolean")
    found = quality.reference_issues(t, r, s, a, o, assets)
    assert [tuple(x) for x in found.collect()] == [("d", "s", "answer over the word limit")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
