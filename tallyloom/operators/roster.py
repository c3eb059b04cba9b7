"""Identity checks, batch overview, overlaps, wrong answers, re-scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def identity_issues(attempts: DataFrame) -> DataFrame:
    """Ids with several names and names with several ids, submitted only."""
    a = attempts.filter(F.col("status") == "submitted").select(F.col("candidate_id").cast("string").alias("id"), F.col("candidate_name").alias("name"))

    def several(key: str, other: str, issue: str) -> DataFrame:
        g = a.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set(other)).alias("m"))
        return g.filter(F.size("m") > 1).select(F.lit(issue).alias("issue"), "key", F.size("m").alias("n_members"), F.array_join("m", "|").alias("members"))

    return several("id", "name", "id has names").unionByName(several("name", "id", "name has ids"))


def latest_beacon(beacons: DataFrame) -> DataFrame:
    """The newest beacon of each attempt by string time; ties: least file."""
    w = W.partitionBy("attempt_id").orderBy(F.desc("updated_at"), "file")
    return beacons.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def live_counts(beacons: DataFrame) -> DataFrame:
    return latest_beacon(beacons).groupBy("batch_id", "status").agg(F.count("*").alias("n"))


def batch_overview(attempts: DataFrame, validity: DataFrame, beacons: DataFrame) -> DataFrame:
    """Beacon counts by status, imported, valid, last submission (the largest
    string) and exceptions of each batch. Exceptions make no group."""
    b = latest_beacon(beacons).groupBy("batch_id").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(f"live_{s}") for s in ("checked_in", "in_progress", "submitted", "failed")])
    i = attempts.filter(F.col("status").isin("submitted", "failed")).groupBy("batch_id").agg(F.count("*").alias("imported"), F.max(F.when(F.col("status") == "submitted", F.col("submitted_at"))).alias("last_submitted"))
    v = attempts.join(validity, "attempt_id").groupBy("batch_id").agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("valid"), F.count("reason").alias("exceptions"))
    j = b.join(i, "batch_id", "full_outer").join(v.select("batch_id", "valid"), "batch_id", "full_outer").join(v.select("batch_id", "exceptions"), "batch_id", "left")
    return j.select("batch_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in j.columns if c not in ("batch_id", "last_submitted")], "last_submitted")


def interval_overlaps(passages: DataFrame) -> DataFrame:
    """Pairs of passages of an attempt whose times overlap, strictly."""
    a, b = passages.alias("a"), passages.alias("b")
    on = (F.col("a.attempt_id") == F.col("b.attempt_id")) & (F.col("a.passage_index") < F.col("b.passage_index")) & (F.col("a.started_at") < F.col("b.ended_at")) & (F.col("b.started_at") < F.col("a.ended_at"))
    return a.join(b, on).select("a.attempt_id", F.col("a.passage_index").alias("first"), F.col("b.passage_index").alias("second"))


def wrong_answers(answers: DataFrame) -> DataFrame:
    return answers.filter(F.col("is_correct") == 0)


def rejudge_preview(attempts: DataFrame, answers: DataFrame, overrides: DataFrame, accepted: list[str], paper: str | None = None, question: str | None = None) -> DataFrame:
    """Wrong answers without an active override that a rule would accept.

    ``token`` identifies the affected set; applying asks for the same token.
    """
    active = overrides.filter(~F.col("revoked")).select("attempt_id", "passage_index", "question_id")
    a = attempts.filter(F.col("status") == "submitted")
    if paper is not None:
        a = a.filter(F.col("paper_id") == paper)
    w = wrong_answers(answers) if question is None else wrong_answers(answers).filter(F.col("question_id") == question)
    normal = F.lower(F.trim(F.regexp_replace("answer", r"\s+", " ")))
    w = w.filter(normal.isin([" ".join(x.split()).lower() for x in accepted]))
    j = w.join(a.select("attempt_id"), "attempt_id").join(active, ["attempt_id", "passage_index", "question_id"], "left_anti")
    key = F.concat_ws("/", F.col("attempt_id").cast("string"), F.col("passage_index").cast("string"), "question_id")
    return j.select("attempt_id", "passage_index", "question_id", "answer", "weight", F.sha2(key, 256).alias("token"))


def rejudge_apply(preview: DataFrame, answers: DataFrame, run_id: str) -> DataFrame:
    """Override rows of a previewed rule, with the evidence of this moment."""
    keys = ["attempt_id", "passage_index", "question_id"]
    j = preview.select(*keys).join(answers, keys)
    return j.select(
        F.concat_ws("-", F.lit(run_id), F.col("attempt_id").cast("string"), "question_id").alias("override_id"), *keys,
        F.col("answer").alias("original_answer"), F.col("is_correct").alias("original_correct"), F.col("score").alias("original_score"), F.col("weight").alias("new_score"), F.lit(False).alias("revoked"),
    )


def latest_child(parents: DataFrame, children: DataFrame, key: str, order: list) -> DataFrame:
    """Parents with their first child in ``order``; none gives nulls."""
    w = W.partitionBy(key).orderBy(*order)
    return parents.join(children.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n"), key, "left")


def retention(rows: DataFrame, key: str, order: str, keep: int, special) -> DataFrame:
    """The last ``keep`` rows of each key, and its latest special row."""
    w = W.partitionBy(key)
    r = rows.withColumn("_n", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("_s", F.max(F.when(special, F.col(order))).over(w))
    return r.filter((F.col("_n") <= keep) | (F.col(order) == F.col("_s"))).drop("_n", "_s")


def version_gate(events: DataFrame, key: str, order: str, version: str) -> DataFrame:
    """Events whose version is above every earlier one of their key."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("_m", F.max(version).over(before)).filter(F.col("_m").isNull() | (F.col(version) > F.col("_m"))).drop("_m")
