"""Reconciliation of locally and remotely recognised answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import squeeze_lower


def slot_coverage(local: DataFrame, cloud: DataFrame, key: list[str]) -> DataFrame:
    from tallyloom.operators.library import both_sides

    return both_sides(local, cloud, key)


def slot_decisions(local: DataFrame, cloud: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Each slot's answer on both sides and in the source text: agreement,
    conflict, one side missing; what the source says; whether to apply.

    Columns answer on every side; local may carry user_edited.
    """
    l = local.select(*key, squeeze_lower(F.col("answer")).alias("local"), (F.col("user_edited") if "user_edited" in local.columns else F.lit(False)).alias("edited"))
    c = cloud.select(*key, squeeze_lower(F.col("answer")).alias("cloud"))
    s = source.select(*key, squeeze_lower(F.col("answer")).alias("source"))
    j = l.join(c, key, "full_outer").join(s, key, "left")
    blank = lambda x: F.col(x).isNull() | (F.col(x) == "")
    state = F.when(blank("local") & blank("cloud"), "both missing").when(blank("local"), "missing local").when(blank("cloud"), "missing cloud").when(F.col("local") == F.col("cloud"), "agree").otherwise("conflict")
    check = F.when(blank("source"), "not verifiable").when(F.col("source") == F.coalesce("cloud", "local"), "agrees").otherwise("contradicts")
    apply = ~F.coalesce("edited", F.lit(False)) & blank("local") & ~blank("cloud") & (F.col("cloud") == F.col("source"))
    return j.select(*key, "local", "cloud", "source", state.alias("state"), check.alias("source_check"), F.coalesce(apply, F.lit(False)).alias("auto_apply"))


def decision_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("state").agg(F.count("*").alias("n"), F.count(F.when(F.col("auto_apply"), 1)).alias("applied"))


def missing_assets(references: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    return references.join(assets, key, "left_anti")


def coverage_ledger(nodes: DataFrame, assigned: DataFrame, ignored: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(disposition of each source node, share explained of each document)."""
    a, i = assigned.select(*key).distinct().withColumn("_a", F.lit(True)), ignored.select(*key, "reason").dropDuplicates(key)
    j = nodes.join(a, key, "left").join(i, key, "left")
    d = F.when(F.col("_a"), "assigned").when(F.col("reason").isNotNull(), "ignored_with_reason").otherwise("unassigned")
    ledger = j.select(*key, d.alias("disposition"), "reason")
    return ledger, ledger.groupBy(key[0]).agg(F.avg((F.col("disposition") != "unassigned").cast("double")).alias("explained"))


def score_slots(answers: DataFrame) -> DataFrame:
    """Slots given as (accepted array, given, fold_case) to earned points."""
    g = F.trim("given")
    hit = F.when(F.col("fold_case"), F.exists("accepted", lambda a: F.lower(a) == F.lower(g))).otherwise(F.array_contains("accepted", g))
    return answers.withColumn("correct", F.coalesce(hit, F.lit(False)))


def options_match(given: Column, right: Column, ordered: bool) -> Column:
    """Whether chosen options are the right ones: one by one, or as sets."""
    if ordered:
        return F.coalesce(given == right, F.lit(False))
    return (F.size(F.array_except(given, right)) == 0) & (F.size(F.array_except(right, given)) == 0)


def score_groups(slots: DataFrame, key: list[str]) -> DataFrame:
    """Groups by rule: "each" sums slots, "all_or_nothing" needs all of them,
    "unordered" counts the distinct given that are accepted anywhere,
    "exact_set" needs the two sets to be equal."""
    g = slots.groupBy(*key, "rule").agg(F.count("*").alias("possible"), F.count(F.when(F.col("correct"), 1)).alias("right"), F.array_distinct(F.flatten(F.collect_list("accepted"))).alias("all"), F.collect_set(F.trim("given")).alias("got"))
    both = F.size(F.array_intersect("got", "all"))
    earned = F.when(F.col("rule") == "each", F.col("right")).when(F.col("rule") == "all_or_nothing", F.when(F.col("right") == F.col("possible"), F.col("possible")).otherwise(0)).when(F.col("rule") == "unordered", F.least(both, F.col("possible")))
    earned = earned.otherwise(F.when((both == F.size("all")) & (both == F.size("got")), F.col("possible")).otherwise(0))
    return g.select(*key, "rule", "possible", earned.alias("earned"))
