"""Tables with shifted and missing keys: what only larger or odder inputs show."""

import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom import plans
from tallyloom.operators import layout, recognition
from tallyloom.plans import questions
from tallyloom.sources import workbook

SMALL = "/root/testdata/sf0.01"
BOX = "doc string, page int, id int, x double, y double, width double, height double"


def same_as_sql(spark, name, folder):
    """Whether a query gives the rows of its statement over a folder's tables."""
    out = f"{folder}/out-{name}"
    plans.QUERIES[name](spark, str(folder)).write.parquet(out)
    c = duckdb.connect()
    for f in folder.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    c.sql(f"CREATE TABLE want AS {plans.SQL[name]}")
    c.sql(f"CREATE TABLE got AS FROM '{out}/*.parquet'")
    n = c.sql("SELECT count(*) FROM ((FROM got EXCEPT ALL FROM want) UNION ALL (FROM want EXCEPT ALL FROM got))").fetchall()[0][0]
    return n == 0 and c.sql("SELECT count(*) FROM want").fetchall()[0][0] > 0


def test_boxes_on_each_other_are_not_paired(spark):
    rows = [("d", 0, i, float(i % 2), 0.0, 10.0, 10.0) for i in range(60_000)]
    boxes = spark.createDataFrame(rows, BOX)
    began = time.time()
    assert layout.duplicate_ratio(boxes, 0.9).first().ratio == 1.0  # 0.9e9 pairs
    few = spark.createDataFrame([*rows[:3], ("d", 0, 9, 50.0, 0.0, 10.0, 10.0), ("e", 0, 1, 0.0, 0.0, 0.0, 0.0), ("e", 0, 2, 0.0, 0.0, 0.0, 0.0)], BOX)
    assert {(r.doc, r.ratio) for r in layout.duplicate_ratio(few, 0.9).collect()} == {("d", 0.5), ("e", 0.0)}
    assert time.time() - began < 60


def test_tokens_on_each_other_are_claimed_in_order(spark):
    at = lambda ids, x: [("d", 0, i, x, 0.0, 10.0, 10.0) for i in ids]
    ocr = spark.createDataFrame(at(range(0, 40_000, 2), 0.0) + at([50_000, 50_002], 1.0), BOX)
    native = spark.createDataFrame(at(range(1, 30_000, 2), 0.0) + at(range(30_001, 39_999, 2), 2.0) + at([60_001, 60_003], 1.0), BOX)
    got = {r.ocr: (r.native, round(r.iou, 6)) for r in layout.claim_tokens(ocr, native).collect()}
    # Those in the same place first, then the next best one, then the last ones.
    assert got[0] == (1, 1.0) and got[29_998] == (29_999, 1.0) and got[30_000] == (60_001, round(9 / 11, 6)) and got[30_004] == (30_001, round(8 / 12, 6))
    assert len({n for n, _ in got.values()}) == len(got) == 20_001 and got[50_000][0] == 39_997 and 50_002 not in got


@pytest.fixture
def folder(tmp_path):
    return tmp_path


@pytest.mark.parametrize("name", ["num_table_ruled", "num_table_cells"])
def test_pages_cut_short_have_no_table(spark, folder, name):
    spark.read.parquet(f"{SMALL}/part.parquet").filter("p_partkey < 295 AND p_partkey <> 119").write.parquet(f"{folder}/part.parquet")
    assert same_as_sql(spark, name, folder)


@pytest.mark.parametrize("name", ["num_table_ruled", "num_table_cells"])
def test_pages_with_few_inner_rules_are_ruled_tables(spark, folder, name):
    size = F.when(F.floor(F.col("p_partkey") / 20) % 3 == 0, 3).otherwise(F.col("p_size"))
    spark.read.parquet(f"{SMALL}/part.parquet").withColumn("p_size", size.cast("int")).write.parquet(f"{folder}/part.parquet")
    assert same_as_sql(spark, name, folder)


def test_a_gap_just_over_the_least_is_a_space(spark, folder):
    # 0.28 * 24 is 6.720000000000001 as a float.
    rows = [(1, 19, 0.0), (2, 19, 6.720000000000001), (3, 19, 13.0), (4, 19, 21.5)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{folder}/events.parquet")
    assert same_as_sql(spark, "num_word_gap", folder)


def test_a_document_of_many_candidates_has_one_chain(spark):
    rows = [("d", 0, i, 1.0, float(i), i % 40 + 1, 0.6) for i in range(4000)]
    began = time.time()
    found = recognition.rising_chain(spark.createDataFrame(rows, "doc string, page int, line int, x double, y double, value int, score double")).first()
    assert found.numbers == list(range(1, 41)) and found.total == 24.0
    assert time.time() - began < 20


def test_more_rows_than_a_sheet_holds(spark, tmp_path):
    tables = {"many": spark.range(0, 1000, 1, 3).selectExpr("id", "'t' || id AS t"), "none": spark.createDataFrame([], "only string"), "one": spark.createDataFrame([(True,)], "f boolean")}
    workbook.write_workbooks(tables, str(tmp_path / "out"), most=101)
    back = workbook.read_workbooks(spark, str(tmp_path / "out")).collect()
    assert sorted((tuple(r.cells) for r in back if r.sheet == "many" and r.row), key=lambda c: int(c[0])) == [(str(i), f"t{i}") for i in range(1000)]
    assert {r.sheet: r.cells for r in back if r.row == 0} == {"many": ["id", "t"], "none": ["only"], "one": ["f"]} and max(r.row for r in back) == 100
    assert [r.cells for r in back if r.sheet == "one" and r.row] == [["1"]] and not [r for r in back if r.sheet == "none" and r.row]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_pages_of_questions_are_dealt_once(spark):
    """Lines are made where their page's orders lie; no step deals them again."""
    lines = questions._lines(spark, SMALL)
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(key, "false")  # as in the queries
    try:
        found = recognition.question_blocks(lines, recognition.number_scores(lines, questions._roles(lines)))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(key)
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    assert dealt and all(re.fullmatch(r"doc#\d+", keys) for keys in dealt) and "SortMergeJoin" in plan
