"""Review mutations as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def create_overrides(answers: DataFrame, requests: DataFrame, key: list[str]) -> DataFrame:
    """Requests (key, new_score, version) with their outcome and evidence: the
    score must be finite and within the weight, the version the current one."""
    j = requests.join(answers.select(*key, "answer", "is_correct", "score", "weight", "review_version"), key, "left")
    bad = (
        F.when(F.col("weight").isNull(), "no such answer")
        .when(F.isnan("new_score") | ~F.col("new_score").between(0, F.col("weight")), "score out of bounds")
        .when(F.col("version") != F.col("review_version"), "stale version")
    )
    return j.select(*key, "new_score", F.col("answer").alias("original_answer"), F.col("is_correct").alias("original_correct"), F.col("score").alias("original_score"), F.coalesce(bad, F.lit("ok")).alias("outcome"))


def revoke(overrides: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    gone = ids.select("override_id").distinct().withColumn("_g", F.lit(True))
    return overrides.join(gone, "override_id", "left").withColumn("revoked_at", F.when(F.col("_g") & F.col("revoked_at").isNull(), at).otherwise(F.col("revoked_at"))).drop("_g")


def set_counted(attempts: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest change (attempt_id, counted, reason) of each attempt; a reason
    is kept only while the attempt is out."""
    c = changes.select("attempt_id", F.col("counted").alias("_c"), F.col("reason").alias("_r"))
    j = attempts.join(c, "attempt_id", "left")
    counted = F.coalesce("_c", "counted")
    return j.withColumn("exclude_reason", F.when(~counted, F.coalesce("_r", "exclude_reason"))).withColumn("counted", counted).drop("_c", "_r")


def grade_lifecycle(grades: DataFrame) -> DataFrame:
    """The state each step of an essay's grade leads to: versions count up by
    one, only a reviewed grade is published, a publication supersedes the
    published one before it."""
    w = W.partitionBy("essay").orderBy("version")
    step = F.when(F.col("version") != F.row_number().over(w), "rejected").when((F.col("action") == "publish") & (F.lag("action").over(w) != "review"), "rejected").otherwise(F.col("action"))
    later = F.max(F.when(F.col("step") == "publish", F.col("version"))).over(W.partitionBy("essay"))
    state = F.when(F.col("step") == "rejected", "rejected").when(F.col("step") == "publish", F.when(F.col("version") == later, "published").otherwise("superseded")).when(F.col("step") == "review", "reviewed").otherwise("draft")
    return grades.withColumn("step", step).withColumn("state", state).drop("step")


def audit(before: DataFrame, after: DataFrame, key: str, columns: list[str], operator: str) -> DataFrame:
    """One audit row for each key whose row changed, with both as JSON."""
    b = before.select(key, F.to_json(F.struct(*columns)).alias("before"))
    a = after.select(key, F.to_json(F.struct(*columns)).alias("after"))
    return b.join(a, key, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after"))).withColumn("operator", F.lit(operator))
