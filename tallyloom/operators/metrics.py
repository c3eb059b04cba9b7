"""Recognition metrics: error rates, set and class scores, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import tokens


def _as_characters(words: Column, every: Column) -> Column:
    """A word sequence as a string with one character for each distinct word,
    so that the built-in edit distance counts words. Surrogates are no
    characters: the numbering leaves them out."""

    def code(w: Column) -> Column:
        n = F.array_position(every, w) + 0x3400 - 1
        return F.decode(F.unhex(F.lpad(F.hex(F.when(n < 0xD800, n).otherwise(n + 0x800)), 8, "0")), "UTF-32")

    return F.array_join(F.transform(words, code), "")


def error_rates(rows: DataFrame, reference: str, prediction: str) -> DataFrame:
    """``rows`` with the character and word error rate: edit distance over the
    size of the reference, null where that is empty."""
    a, b = F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(prediction), F.lit(""))
    x, y = tokens(a), tokens(b)
    every = F.array_distinct(F.concat(x, y))
    ratio = lambda d, n: F.when(n > 0, d / n)
    return rows.withColumns(
        {"cer": ratio(F.levenshtein(a, b), F.length(a)), "wer": ratio(F.levenshtein(_as_characters(x, every), _as_characters(y, every)), F.size(x))}
    )


def set_scores(reference: DataFrame, prediction: DataFrame, key: list[str], item: str) -> DataFrame:
    """Recall, precision and F1 of the distinct items of each key."""
    r = reference.select(*key, item).distinct().withColumn("_r", F.lit(1))
    p = prediction.select(*key, item).distinct().withColumn("_p", F.lit(1))
    g = r.join(p, [*key, item], "full_outer").groupBy(*key).agg(F.count("_r").alias("reference"), F.count("_p").alias("predicted"), F.count(F.col("_r") + F.col("_p")).alias("both"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return g.select(*key, "reference", "predicted", "both", ratio(F.col("both"), F.col("reference")).alias("recall"), ratio(F.col("both"), F.col("predicted")).alias("precision"), (2 * F.col("both") / (F.col("reference") + F.col("predicted"))).alias("f1"))


def class_scores(rows: DataFrame, reference: str, prediction: str) -> DataFrame:
    """(class, f1) over all rows, of the classes of either side; their mean is
    the macro F1."""
    sides = rows.select(F.col(reference).alias("class"), F.lit(1).alias("r"), F.lit(0).alias("p"), (F.col(reference) == F.col(prediction)).cast("int").alias("b"))
    other = rows.select(F.col(prediction).alias("class"), F.lit(0).alias("r"), F.lit(1).alias("p"), F.lit(0).alias("b"))
    g = sides.unionByName(other).groupBy("class").agg(F.sum("r").alias("r"), F.sum("p").alias("p"), F.sum("b").alias("b"))
    return g.select("class", (2 * F.col("b") / (F.col("r") + F.col("p"))).alias("f1"))


def gates(values: DataFrame, targets: list[tuple[str, str, float]]) -> DataFrame:
    """``values`` (metric, value) with the verdict of each target (metric,
    operator, value): pass, fail, or missing for a null."""
    verdict = F.lit("no target")
    for metric, sign, limit in targets:
        good = {">=": F.col("value") >= limit, "<=": F.col("value") <= limit, "=": F.col("value") == limit}[sign]
        verdict = F.when(F.col("metric") == metric, F.when(F.col("value").isNull(), "missing").when(good, "pass").otherwise("fail")).otherwise(verdict)
    return values.withColumn("verdict", verdict)
