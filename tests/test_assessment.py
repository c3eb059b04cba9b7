"""The hand-computed example of four attempts, and the rules around it."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import facts, roster, statistics

MARKS = {"A1": ("TTFT", "TTTT", "FFTF"), "A2": ("TFFF", "TTFF", "TTTT"), "A3": ("TTTT", "TTTT", "TTTT"), "A4": ("FFFF", "TFFF", "FFFF")}
WHO = {"A1": ("C-001", "张三"), "A2": ("C-002", "李四"), "A3": ("C-002", "李四四"), "A4": ("C-004", "张三")}
KINDS = ("true_false_not_given", "matching_headings", "sentence_completion")


@pytest.fixture(scope="module")
def tables(spark):
    attempts = spark.createDataFrame(
        [(a, *WHO[a], "B", "paper-A", "submitted", True, None) for a in MARKS], "attempt_id string, candidate_id string, candidate_name string, batch_id string, paper_id string, status string, counted boolean, exclude_reason string"
    )
    answers = spark.createDataFrame(
        [(a, p, f"p{p}q{q + 1}", f"p{p}q{q + 1}", KINDS[p], "x", int(c == "T"), 1.0, None) for a, rows in MARKS.items() for p, row in enumerate(rows) for q, c in enumerate(row)],
        "attempt_id string, passage_index int, question_id string, label string, kind string, answer string, is_correct int, weight double, score double",
    )
    passages = spark.createDataFrame(
        [(a, p, float(row.count("T")), 4.0, True, None) for a, rows in MARKS.items() for p, row in enumerate(rows)], "attempt_id string, passage_index int, correct double, total double, gradable boolean, category string"
    )
    suites = spark.createDataFrame([(a, 3) for a in MARKS], "attempt_id string, total_passages int")
    overrides = spark.createDataFrame(
        [("o1", "A1", 0, "p0q3", "x", 0, None, 1.0, False), ("o2", "A1", 2, "p2q1", "other", 0, None, 1.0, False), ("o3", "A4", 0, "p0q1", "x", 0, None, 1.0, True), ("o4", "A9", 0, "p0q1", "x", 0, None, 1.0, False)],
        "override_id string, attempt_id string, passage_index int, question_id string, original_answer string, original_correct int, original_score double, new_score double, revoked boolean",
    )
    return attempts, answers, passages, suites, overrides


def valid_of(tables, overrides=None):
    attempts, answers, passages, suites, _ = tables
    good = facts.validity(attempts, suites, passages).filter("reason IS NULL")
    scores = facts.attempt_scores(passages, facts.effective_answers(answers, overrides))
    return attempts.join(good.select("attempt_id"), "attempt_id").join(scores, "attempt_id")


def test_summary(tables):
    r = statistics.summary(valid_of(tables), ["batch_id"]).first()
    assert (r.n, r["mean"], r["median"], r["max"], r["min"], r.accuracy) == (4, 7.0, 7.5, 12.0, 1.0, round(28 / 48, 6))


def test_parts_items_kinds(tables):
    v = valid_of(tables)
    assert [(r.correct, r.total) for r in statistics.parts(v, tables[2]).orderBy("passage_index").collect()] == [(8.0, 16.0), (11.0, 16.0), (9.0, 16.0)]
    item = statistics.items(v, tables[1]).filter("question_id = 'p0q1'").first()
    assert (item.n, item.n_correct, item.accuracy, item.enough) == (4, 3, 0.75, False)
    kind = statistics.kinds(v, facts.effective_answers(tables[1], None)).filter("kind = 'true_false_not_given'").first()
    assert (kind.attempts, kind.points, kind.score) == (4, 16.0, 8.0)


def test_histograms_keep_empty_bins(tables):
    unit = {r.bin: r.n for r in statistics.unit_histogram(valid_of(tables), ["batch_id"]).collect()}
    assert len(unit) == 12 and unit[1] == unit[7] == unit[8] == 1 and unit[11] == 1 and unit[0] == 0
    decile = {r.bin: r.n for r in statistics.decile_histogram(valid_of(tables), ["batch_id"]).collect()}
    assert sorted(decile) == list(range(0, 100, 10)) and decile[90] == 1


def test_overrides_need_their_evidence(tables):
    v = {r.attempt_id: (r.raw_score, r.effective_score) for r in valid_of(tables, tables[4]).collect()}
    assert v["A1"] == (8.0, 9.0) and v["A4"] == (1.0, 1.0)
    assert {r.override_id: r.conflict for r in facts.override_conflicts(tables[1], tables[4]).collect()} == {"o2": "evidence changed", "o4": "answer gone"}


def test_partial_attempt_is_excluded_and_teacher_wins(tables, spark):
    attempts, _, passages, suites, _ = tables
    less = passages.filter("NOT (attempt_id = 'A2' AND passage_index > 0)")
    out = attempts.withColumn("counted", F.col("attempt_id") != "A2").withColumn("exclude_reason", F.lit("absent"))
    assert {r.attempt_id: r.reason for r in facts.validity(attempts, suites, less).collect()}["A2"] == "missing passages"
    assert {r.attempt_id: r.reason for r in facts.validity(out, suites, less).collect()}["A2"] == "absent"


def test_identity_and_matrix(tables):
    found = {(r.issue, r.key) for r in roster.identity_issues(tables[0]).collect()}
    assert found == {("id has names", "C-002"), ("name has ids", "张三")}
    row = statistics.matrix(valid_of(tables), tables[1], ["p0q1", "p2q4"]).filter("attempt_id = 'A1'").first()
    assert (row.p0q1, row.p2q4) == (1, 0)


def test_rejudge(tables):
    attempts, answers, _, _, overrides = tables
    p = roster.rejudge_preview(attempts, answers, overrides, [" X "], question="p0q3")
    assert {r.attempt_id for r in p.collect()} == {"A2", "A4"}
    assert roster.rejudge_apply(p, answers, "run").count() == 2
