"""Differences of JSON values by path, level by level over variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.sources.durable import durable


def _exploded(rows: DataFrame, side: str) -> DataFrame:
    """Members of the containers of one side: key by name, or by place."""
    name = f"_rows_{side}"
    rows.createOrReplaceTempView(name)
    out = rows.sparkSession.sql(f"SELECT r._id, r._path, r._array, coalesce(e.key, cast(e.pos AS string)) AS _key, e.value AS {side} FROM {name} r, LATERAL variant_explode(r.{side}) e")
    rows.sparkSession.catalog.dropTempView(name)
    return out


def canonical(value: Column) -> Column:
    """A JSON text with its keys in order and its white space gone; null where
    the text is no JSON."""
    return F.to_json(F.try_parse_json(value))


def same_value(a: Column, b: Column) -> Column:
    """Whether two JSON texts are one value, whatever the order of keys."""
    return canonical(a).eqNullSafe(canonical(b))


def differences(docs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, path, before, after (JSON texts) of what differs in two columns.

    Objects are compared by key, arrays by place if they have one length and
    as a whole if not. A member that is missing has a null text, one that is
    null the text ``null``. Keys in a path have ~ as ~0 and / as ~1. A column
    that is null is missing as a whole; text that is no JSON raises an error.
    Each level of the documents is one join of what still differs there.
    """
    level = docs.select(F.col(key).alias("_id"), F.lit("").alias("_path"), F.parse_json(before).alias("a"), F.parse_json(after).alias("b"))
    text = lambda c: F.to_json(F.col(c))
    found: DataFrame | None = None
    while True:
        differs = ~text("a").eqNullSafe(text("b"))
        shape = lambda c: F.substring(text(c), 1, 1)
        size = lambda c: F.size(F.variant_get(F.col(c), "$", "array<variant>"))
        level = level.filter(differs).withColumn("_ka", shape("a")).withColumn("_kb", shape("b"))
        objects = (F.col("_ka") == "{") & (F.col("_kb") == "{")
        arrays = (F.col("_ka") == "[") & (F.col("_kb") == "[")
        deeper = F.coalesce(objects | F.when(arrays, size("a") == size("b")), F.lit(False))
        level = durable(level.withColumn("_array", F.coalesce(arrays, F.lit(False))).withColumn("_deeper", deeper))
        own = level.filter("NOT _deeper").select("_id", F.col("_path").alias("path"), text("a").alias("before"), text("b").alias("after"))
        found = own if found is None else found.unionByName(own)
        rest = level.filter("_deeper")
        if rest.isEmpty():
            return found.select(F.col("_id").alias(key), "path", "before", "after")
        keys = ["_id", "_path", "_array", "_key"]
        both = _exploded(rest, "a").join(_exploded(rest, "b"), keys, "full")
        step = F.when(F.col("_array"), F.col("_key")).otherwise(F.replace(F.replace("_key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        level = both.select("_id", F.concat("_path", F.lit("/"), step).alias("_path"), "a", "b")


def consecutive(rows: DataFrame, by: str, order: str, document: Column, key: str) -> DataFrame:
    """Differences of each row's document to the one before it in its group."""
    d = rows.select(key, document.alias("after"), F.lag(document).over(W.partitionBy(by).orderBy(order)).alias("before"))
    return differences(d.filter("before IS NOT NULL"), key, "before", "after")
