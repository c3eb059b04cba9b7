"""Evaluation metrics and usage accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flag_metrics(rows: DataFrame, truth: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """Counts, recall, precision, F1 and accuracy of a 0/1 prediction."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    g = rows.groupBy(*by).agg(F.count(F.when(t & p, 1)).alias("tp"), F.count(F.when(~t & p, 1)).alias("fp"), F.count(F.when(t & ~p, 1)).alias("fn"), F.count(F.when(~t & ~p, 1)).alias("tn"))
    div = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return g.withColumns({"recall": div(tp, tp + fn), "precision": div(tp, tp + fp), "f1": div(2 * tp, 2 * tp + fp + fn), "accuracy": div(tp + tn, tp + fp + fn + tn)})


def order_accuracy(rows: DataFrame, key: str, truth: str, predicted: str) -> DataFrame:
    """Share of the pairs of a key that stand in the true order."""
    a, b = rows.alias("a"), rows.alias("b")
    j = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{truth}") < F.col(f"b.{truth}")))
    return j.groupBy(F.col(f"a.{key}").alias(key)).agg(F.count("*").alias("pairs"), F.round(F.avg((F.col(f"a.{predicted}") < F.col(f"b.{predicted}")).cast("double")), 6).alias("accuracy"))


def acceptance(measured: DataFrame, enough: int = 5) -> DataFrame:
    """Violations over checks of each metric; too few samples is no result."""
    g = measured.groupBy("metric").agg(F.count("*").alias("samples"), F.sum("violations").alias("violations"), F.sum("checked").alias("checked"))
    rate = F.round(F.when(F.col("checked") > 0, F.col("violations") / F.col("checked")), 6)
    return g.select("metric", "samples", rate.alias("rate"), F.when(F.col("samples") < enough, "insufficient_evidence").otherwise("measured").alias("status"))


def usage_totals(calls: DataFrame, metrics: list[str]) -> DataFrame:
    """Sum of each metric and how many calls report it."""
    return calls.agg(*[x for m in metrics for x in (F.sum(m).alias(m), F.count(m).alias(f"{m}_known"))])


def cost(calls: DataFrame, hit: float, miss: float, output: float) -> DataFrame:
    """Price of each call, per million tokens of each kind."""
    c = (F.coalesce("hit", F.lit(0)) * hit + F.coalesce("miss", F.lit(0)) * miss + F.coalesce("output", F.lit(0)) * output) / 1e6
    return calls.withColumn("cost", F.round(c, 9))


def previous(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.lag(value).over(W.partitionBy(key).orderBy(order)))
