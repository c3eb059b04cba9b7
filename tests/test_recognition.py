"""Roles, numbers, chains and blocks of questions from written pages."""

import itertools
import random

from pyspark.sql import functions as F

from tallyloom.operators import recognition as rec

REGIONS = "doc string, page int, region int, kind string, y double, height double, page_height double, texts array<string>"
LINES = "doc string, page int, line int, text string, x double, y double, width double, height double, region int, font_size double"


def test_roles(spark):
    long = "The river runs past the old town and then on to the sea in a slow curve."
    cases = {
        "question_instruction": (["Questions 1-5", "Choose the correct letter"], 0.95),
        "question_prompt": (["1 What is it?", "2 Where is it?"], 0.75),
        "option_run": (["A red", "B blue", "C green"], 0.75),
        "option_bank": (["List of Headings", "i The first"], 0.9),
        "answer_key": (["ANSWER KEY", "1 TRUE"], 0.9),
        "passage": ([long, long], 0.4),
        "unknown": (["A short line"], 0.0),
    }
    rows = [("d", 0, n, "text", 300.0, 50.0, 800.0, texts) for n, (texts, _) in enumerate(cases.values())]
    rows += [("d", 0, 50, "page_number", 790.0, 8.0, 800.0, ["12"]), ("d", 0, 51, "text", 5.0, 8.0, 800.0, ["Test 3"]), ("d", 0, 52, "figure", 300.0, 80.0, 800.0, ["map"]), ("d", 0, 53, "text", 300.0, 50.0, 800.0, [])]
    got = {r.region: (r.role, r.role_confidence) for r in rec.region_roles(spark.createDataFrame(rows, REGIONS)).collect()}
    for n, (role, (_, sure)) in enumerate(cases.items()):
        assert got[n] == (role, sure), role
    assert (got[50], got[51], got[52], got[53]) == (("header_footer", 1.0), ("header_footer", 0.55), ("stimulus", 0.6), ("unknown", 0.0))


def test_labels_and_numbers(spark):
    rows = [("A. red", 0, None), ("b) blue", 1, None), ("ii the second", 1, None), ("iv) fourth", 3, None), ("A", None, None), ("An apple", None, None), ("14 What", None, 14), ("14. What", None, 14), ("1995 was", None, None), ("3rd", None, None), ("0 none", None, None), ("", None, None), ("x: ten", 23, None)]
    df = spark.createDataFrame(rows, "t string, rank int, number int").select("t", "rank", "number", rec.option_rank(F.col("t")).alias("r"), rec.leading_number(F.col("t")).alias("n"))
    assert [tuple(r) for r in df.filter("NOT (r <=> rank) OR NOT (n <=> number)").collect()] == []


def page(spark):
    text = ["Questions 1-3 Choose the correct letter", "1 What is the first thing", "that they saw?", "A red", "B blue", "C green", "2. Where?", "30 % of them", "3 Why was it so late", "far below"]
    ys = [100.0, 120.0, 132.0, 144.0, 156.0, 168.0, 190.0, 202.0, 214.0, 300.0]
    lines = [("d", 0, n, t, 60.0, y, 200.0, 10.0, 0 if n == 0 else 1, 11.0 if n != 7 else 20.0) for n, (t, y) in enumerate(zip(text, ys, strict=True))]
    df = spark.createDataFrame(lines, LINES)
    regions = spark.createDataFrame([("d", 0, 0, "text", 100.0, 10.0, 800.0, text[:1]), ("d", 0, 1, "text", 120.0, 190.0, 800.0, text[1:])], REGIONS)
    return df, rec.region_roles(regions)


def test_number_evidence_and_blocks(spark):
    lines, roles = page(spark)
    scored = rec.number_scores(lines, roles)
    got = {r.value: (r.score, set(r.evidence)) for r in scored.collect()}
    assert got[1] == (0.65, {"expected", "question_area", "text_adjacent", "font"})
    assert got[2] == (0.85, {"expected", "question_area", "text_adjacent", "font", "rising"})
    assert got[30] == (0.0, {"question_area", "text_adjacent", "measure"}) and got[3][0] == 0.65
    blocks = {r.number: (r.stem, r.options) for r in rec.question_blocks(lines, scored).collect()}
    assert blocks == {1: ("What is the first thing that they saw?", ["A red", "B blue", "C green"]), 2: ("Where? 30 % of them", []), 3: ("Why was it so late", [])}
    assert rec.rising_chain(scored).first().numbers == [1, 2, 3]


def test_chain_by_all_subsets(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for d in range(25):
        cs = [(rnd.randint(1, 8), round(rnd.choice([0.55, 0.65, 0.85, 0.4]), 6)) for _ in range(rnd.randint(1, 9))]
        rows += [(f"d{d}", 0, n, 1.0, float(n), v, s) for n, (v, s) in enumerate(cs)]
        good = [c for c in cs if c[1] >= 0.55]
        best = max(((round(sum(s for _, s in pick), 6), len(pick), [v for v, _ in pick]) for k in range(1, len(good) + 1) for pick in itertools.combinations(good, k) if all(a[0] < b[0] for a, b in itertools.pairwise(pick))), default=None)
        if best:
            want[f"d{d}"] = best
    got = {r.doc: (r.total, len(r.numbers), r.numbers) for r in rec.rising_chain(spark.createDataFrame(rows, "doc string, page int, line int, x double, y double, value int, score double")).collect()}
    assert got == want
