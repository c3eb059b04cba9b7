"""Orderings return every row."""

from tallyloom import plans


def test_srt_locale_keeps_all_rows(spark, tmp_path):
    names = ["name %d" % (k * 7 % 301) for k in range(301)]
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = [r.p_partkey for r in plans.QUERIES["srt_locale"](spark, str(tmp_path)).collect()]
    assert sorted(got) == list(range(301))
