"""Word error rates where there are many distinct words."""

from tallyloom.operators import metrics


def test_many_distinct_words(spark):
    n = 56_000  # past the surrogates and past four hexadecimal digits
    ref = [f"w{k}" for k in range(n)]
    every = spark.createDataFrame([(ref,)], "every array<string>")
    probe = [0, 1, 41_983, 41_984, 41_985, 43_000, 52_223, 52_224, n - 1]
    got = every.select(*(metrics._as_characters(metrics.F.array(metrics.F.lit(ref[k])), metrics.F.col("every")).alias(f"c{k}") for k in probe)).first()
    assert len(set(got)) == len(probe) and all(len(c) == 1 and not 0xD800 <= ord(c) < 0xE000 for c in got)


def test_rates(spark):
    rows = [("the cat sat on the mat", "the cat on a mat", 2 / 6), ("a b", "", 1.0), ("", "x", None), (None, None, None), ("one two three", "one two three", 0.0)]
    got = metrics.error_rates(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, r string, p string, want double"), "r", "p").orderBy("k").collect()
    assert [g.wer for g in got] == [r[2] for r in rows]
