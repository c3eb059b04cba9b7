"""Effective scores, evidence-checked overrides and attempt validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["attempt_id", "passage_index", "question_id"]
EVIDENCE = (("original_answer", "answer"), ("original_correct", "is_correct"), ("original_score", "score"))


def original_points():
    """Stored score, else the weight if correct, else 0 if graded."""
    return F.coalesce("score", F.when(F.col("is_correct") == 1, F.col("weight")).when(F.col("is_correct") == 0, F.lit(0.0)))


def _matched(answers: DataFrame, overrides: DataFrame, kind: str) -> DataFrame:
    a, o = answers.alias("a"), overrides.alias("o")
    on = [F.col(f"a.{k}") == F.col(f"o.{k}") for k in KEYS]
    return a.join(o, on + [~F.col("o.revoked")] + ([F.col(f"o.{x}").eqNullSafe(F.col(f"a.{y}")) for x, y in EVIDENCE] if kind == "evidence" else []), "left")


def effective_answers(answers: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Answers with original and effective points.

    An override counts only if it is active and its three pieces of evidence
    still equal the answer, null-safe. ``None`` leaves every answer as it is.
    """
    if overrides is None:
        return answers.withColumns({"overridden": F.lit(False), "original": original_points(), "effective": original_points()})
    joined = _matched(answers, overrides, "evidence")
    return joined.select("a.*", F.col("o.override_id").isNotNull().alias("overridden"), F.col("o.new_score").alias("_new")).withColumns(
        {"original": original_points(), "effective": F.coalesce("_new", original_points())}
    ).drop("_new")


def override_conflicts(answers: DataFrame, overrides: DataFrame) -> DataFrame:
    """Active overrides whose answer is gone or whose evidence differs."""
    o = overrides.filter(~F.col("revoked")).alias("o")
    joined = o.join(answers.alias("a"), [F.col(f"a.{k}") == F.col(f"o.{k}") for k in KEYS], "left")
    gone = F.col("a.attempt_id").isNull()
    differs = ~(F.lit(True) & F.col("o.original_answer").eqNullSafe(F.col("a.answer")) & F.col("o.original_correct").eqNullSafe(F.col("a.is_correct")) & F.col("o.original_score").eqNullSafe(F.col("a.score")))
    return joined.filter(gone | differs).select("o.override_id", F.when(gone, "answer gone").otherwise("evidence changed").alias("conflict"))


def with_delta(passages: DataFrame, effective: DataFrame) -> DataFrame:
    """Stored passages with ``delta``, what overrides add to their points."""
    delta = effective.groupBy("attempt_id", "passage_index").agg(F.sum(F.coalesce("effective", F.lit(0.0)) - F.coalesce("original", F.lit(0.0))).alias("delta"))
    return passages.join(delta, ["attempt_id", "passage_index"], "left")


def graded_passages(effective: DataFrame) -> DataFrame:
    """Passages that are nothing but their answers, with ``delta``: points,
    total and whether any answer is graded, all from one grouping."""
    graded = F.col("is_correct").isNotNull()
    return effective.groupBy("attempt_id", "passage_index").agg(
        F.sum(F.when(F.col("is_correct") == 1, F.col("weight")).otherwise(0.0)).alias("correct"),
        F.sum(F.when(graded, F.col("weight")).otherwise(0.0)).alias("total"),
        F.max(graded).alias("gradable"),
        F.sum(F.coalesce("effective", F.lit(0.0)) - F.coalesce("original", F.lit(0.0))).alias("delta"),
    )


def attempt_scores(passages: DataFrame, effective: DataFrame) -> DataFrame:
    """Raw, effective and total points of each attempt; deltas are summed for
    each passage first."""
    return with_delta(passages, effective).groupBy("attempt_id").agg(
        F.sum("correct").alias("raw_score"), F.sum(F.col("correct") + F.coalesce("delta", F.lit(0.0))).alias("effective_score"), F.sum("total").alias("total")
    )


def validity(attempts: DataFrame, suites: DataFrame, passages: DataFrame) -> DataFrame:
    """(attempt_id, reason) of submitted attempts; a null reason is valid.

    A teacher's exclusion replaces the first failing rule.
    """
    p = passages.groupBy("attempt_id").agg(F.count("*").alias("n"), F.bool_and(F.col("gradable") & (F.col("total") > 0)).alias("all_graded"))
    j = attempts.filter(F.col("status") == "submitted").join(suites, "attempt_id", "left").join(p, "attempt_id", "left")
    reason = (
        F.when(~F.col("counted"), F.col("exclude_reason"))
        .when(F.col("total_passages").isNull(), "no suite")
        .when(F.coalesce("n", F.lit(0)) < F.greatest("total_passages", F.lit(1)), "missing passages")
        .when(~F.col("all_graded"), "ungraded passage")
    )
    return j.select("attempt_id", reason.alias("reason"))


def valid_attempts(attempts: DataFrame, suites: DataFrame, passages: DataFrame) -> DataFrame:
    """Submitted attempts that no rule of ``validity`` excludes, with their raw,
    effective and total points. passages: attempt_id, correct, total, gradable
    and delta, read and grouped once for both."""
    p = passages.groupBy("attempt_id").agg(
        F.count("*").alias("_n"), F.bool_and(F.col("gradable") & (F.col("total") > 0)).alias("_graded"),
        F.sum("correct").alias("raw_score"), F.sum(F.col("correct") + F.coalesce("delta", F.lit(0.0))).alias("effective_score"), F.sum("total").alias("total"),
    )
    a = attempts.filter((F.col("status") == "submitted") & (F.col("counted") | F.col("exclude_reason").isNull()))
    j = a.join(suites.select("attempt_id", F.col("total_passages").alias("_asked")), "attempt_id").join(p, "attempt_id")
    good = (F.col("_n") >= F.greatest("_asked", F.lit(1))) & F.coalesce("_graded", F.lit(True))
    return j.filter(F.col("_asked").isNotNull() & (~F.col("counted") | good)).drop("_asked", "_n", "_graded")


def ratio(part, whole):
    """part / whole, null unless whole is positive."""
    return F.when(whole > 0, part / whole)
