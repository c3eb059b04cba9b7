"""What is broadcast in the writing steps is bounded by rows, not by files."""

from tallyloom.llm import line_dedup
from tallyloom.llm._shared import materialise, tidy_shuffles


def test_many_rows_are_dealt_by_key(spark):
    lines, rows = spark.range(2000), materialise(spark.range(1000), "rows")
    plan = lambda most: lines.join(line_dedup._few(rows, most), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(1000)
    assert "BroadcastHashJoin" not in plan(999)


def test_compressed_files_are_no_measure(spark):
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with tidy_shuffles(spark):
        # A file of 2 MB may hold 30 MB of rows.
        a, b = spark.range(10_000_000), spark.range(250_000)
        assert "BroadcastHashJoin" not in a.join(b, "id")._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(key) == before
