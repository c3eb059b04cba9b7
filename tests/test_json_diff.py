"""Differences of JSON values against a recursive walk."""

import json
import random

from pyspark.sql import functions as F

from tallyloom.functions import documents
from tallyloom.operators import json_diff


def value(rnd, depth=0):
    kind = rnd.randrange(8 if depth < 4 else 5)
    if kind < 5:
        return [None, rnd.randrange(4), rnd.choice(["a", "b", "é\n"]), rnd.random() < 0.5, ""][kind]
    if kind == 5:
        return [value(rnd, depth + 1) for _ in range(rnd.randrange(3))]
    return {rnd.choice(["a", "b/c", "d~e", "f"]): value(rnd, depth + 1) for _ in range(rnd.randrange(4))}


def text(v):
    return None if v is documents.MISSING else json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_by_recursive_walk(spark):
    rnd = random.Random(1)
    rows = [(k, value(rnd), value(rnd)) for k in range(300)]
    rows += [(400, {"x": {"y": [1, {"z": 1}]}}, {"x": {"y": [1, {"z": 2}]}}), (401, [1, 2], [1]), (402, {"a": None}, {}), (403, 1, 1)]
    df = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, a, b in rows], "id long, a string, b string")
    got = sorted(map(str, (tuple(r) for r in json_diff.differences(df, "id", "a", "b").collect())))
    want = [(k, p, text(x), text(y)) for k, a, b in rows for p, x, y in documents.diff(a, b)]
    norm = lambda r: str((r[0], r[1], r[2] and text(json.loads(r[2])), r[3] and text(json.loads(r[3]))))
    assert sorted(norm(r) for r in json_diff.differences(df, "id", "a", "b").collect()) == sorted(map(str, want)) and got


def test_same_value_and_empty(spark):
    rows = [('{"b": 1, "a": [1, 2]}', '{ "a":[1,2], "b":1 }', True), ('{"a": 1}', '{"a": 2}', False), ("[1, 2]", "[2, 1]", False), (None, None, True), ('{"a": null}', "{}", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.filter(json_diff.same_value(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    empty = spark.createDataFrame([], "id string, a string, b string")
    assert json_diff.differences(empty, "id", "a", "b").collect() == []
    missing = spark.createDataFrame([("k", None, "1")], "id string, a string, b string")
    assert [tuple(r) for r in json_diff.differences(missing, "id", "a", "b").collect()] == [("k", "", None, "1")]
