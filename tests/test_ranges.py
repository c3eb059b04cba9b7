"""Numbers to the first range that holds them, against all pairs."""

import random

from tallyloom.operators import library


def test_range_assign_by_all_pairs(spark):
    rnd = random.Random(4)
    segments = [(rnd.choice("ab"), k, (lo := rnd.randint(-20, 300)), lo + rnd.choice([-1, 0, 0, 3, 17, 250, 10**12])) for k in range(60)]
    numbers = sorted({(rnd.choice("abc"), rnd.randint(-30, 400)) for _ in range(300)})
    n = spark.createDataFrame(numbers, "key string, number long")
    s = spark.createDataFrame(segments, "key string, segment long, low long, high long")
    got = {(r.key, r.number): r.segment for r in library.range_assign(n, s, "key").collect()}
    want = {(k, v): min((g for c, g, lo, hi in segments if c == k and lo <= v <= hi), default=None) for k, v in numbers}
    assert got == want and len(got) == len(numbers)
    assert library.range_assign(n.limit(0), s, "key").count() == 0
    assert library.range_assign(n, s.limit(0), "key").filter("segment IS NOT NULL").count() == 0
