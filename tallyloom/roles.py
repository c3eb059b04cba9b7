"""Column roles: the star-schema tables seen as assessment tables.

Operators take DataFrames with role columns; these functions give them from
the driver's tables, and ``ROLES`` gives DuckDB the same views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        key.alias("attempt_id"),
        cust.alias("candidate_id"),
        F.concat(F.lit("Candidate "), (cust % 997).cast("string"), F.when(key % 50 == 0, " B").otherwise("")).alias("candidate_name"),
        F.col("o_orderpriority").alias("batch_id"),
        F.when(key % 13 == 0, "").otherwise(F.year("o_orderdate").cast("string")).alias("paper_id"),
        F.when(F.col("o_orderstatus") == "F", "submitted").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("failed").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("submitted_at"),
        F.concat(F.lit("T"), (key % 4).cast("string")).alias("terminal_id"),
        (key % 17 != 0).alias("counted"),
        F.when(key % 17 == 0, "excluded by teacher").alias("exclude_reason"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (attempt, question): the least line of those given."""
    names = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    # Dealt by attempt once: groups and joins on the attempt need no other exchange.
    one = read(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*names)).alias("r"))
    part, supp, qty = F.col("r.l_partkey"), F.col("r.l_suppkey"), F.col("r.l_quantity")
    correct = F.when(F.col("r.l_returnflag") == "R", 0).when(F.col("r.l_returnflag") == "N", 1)
    return one.select(
        F.col("l_orderkey").alias("attempt_id"),
        F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("passage_index"),
        F.concat(F.lit("q"), F.col("l_linenumber").cast("string")).alias("question_id"),
        F.when(part % 31 != 0, F.concat(F.lit("Item "), F.col("l_linenumber").cast("string"))).alias("label"),
        F.when(part % 29 != 0, F.when(F.col("r.l_linestatus") == "O", "matching").otherwise("cloze")).alias("kind"),
        F.concat(F.lit("A"), (part % 6).cast("string")).alias("answer"),
        correct.alias("is_correct"),
        F.when(supp % 23 == 0, 0.0).otherwise(qty).alias("weight"),
        F.when((part % 5 == 0) & correct.isNotNull(), qty / 2).alias("score"),
        F.col("r.l_extendedprice").alias("elapsed"),
        (supp % 4).cast("int").alias("changes"),
        F.col("r.l_discount").alias("discount"),
        part.alias("part"),
        F.col("r.l_shipdate").alias("answered_at"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages_of(answers(spark, sf_dir))


def passages_of(a: DataFrame) -> DataFrame:
    graded = F.col("is_correct").isNotNull()
    return a.groupBy("attempt_id", "passage_index").agg(
        F.sum(F.when(F.col("is_correct") == 1, F.col("weight")).otherwise(0.0)).alias("correct"),
        F.sum(F.when(graded, F.col("weight")).otherwise(0.0)).alias("total"),
        F.max(graded).alias("gradable"),
        F.min("answered_at").alias("started_at"),
        F.max("answered_at").alias("ended_at"),
        F.sum(F.when(F.col("part") % 3 != 0, F.col("changes"))).alias("duration_sec"),
        F.min(F.when(F.col("part") % 2 == 0, F.col("kind"))).alias("category"),
    )


def suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").filter(key % 11 != 0).select(key.alias("attempt_id"), F.when(key % 5 == 0, 3).otherwise(1).alias("total_passages"))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overrides_of(answers(spark, sf_dir))


def overrides_of(a: DataFrame) -> DataFrame:
    """Teacher overrides of a tenth of the answers; a quarter of them carry
    evidence that no longer holds, a seventh are revoked."""
    return a.filter(F.round("discount", 2) == 0.1).select(
        F.concat_ws("-", F.col("attempt_id").cast("string"), "question_id").alias("override_id"),
        "attempt_id",
        "passage_index",
        "question_id",
        F.when(F.col("part") % 4 == 0, "Z").otherwise(F.col("answer")).alias("original_answer"),
        F.col("is_correct").alias("original_correct"),
        F.col("score").alias("original_score"),
        F.col("weight").alias("new_score"),
        (F.col("part") % 7 == 0).alias("revoked"),
        F.col("answered_at").alias("created_at"),
    )


def beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("attempt_id"),
        F.element_at(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM")), (F.col("user_id") % 3 + 1).cast("int")).alias("batch_id"),
        F.element_at(F.array(F.lit("checked_in"), F.lit("in_progress"), F.lit("submitted"), F.lit("failed")), (F.col("event_id") % 4 + 1).cast("int")).alias("status"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("updated_at"),
        F.col("event_id").alias("file"),
    )


ROLES = """
attempts AS (
  SELECT o_orderkey AS attempt_id, o_custkey AS candidate_id,
         'Candidate ' || (o_custkey % 997) || CASE WHEN o_orderkey % 50 = 0 THEN ' B' ELSE '' END AS candidate_name,
         o_orderpriority AS batch_id, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS paper_id,
         CASE o_orderstatus WHEN 'F' THEN 'submitted' WHEN 'O' THEN 'in_progress' ELSE 'failed' END AS status,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS submitted_at, 'T' || (o_orderkey % 4) AS terminal_id,
         o_orderkey % 17 <> 0 AS counted, CASE WHEN o_orderkey % 17 = 0 THEN 'excluded by teacher' END AS exclude_reason
  FROM orders
), answers AS (
  SELECT l_orderkey AS attempt_id, CAST((l_linenumber - 1) // 3 AS INTEGER) AS passage_index, 'q' || l_linenumber AS question_id,
         CASE WHEN l_partkey % 31 <> 0 THEN 'Item ' || l_linenumber END AS label,
         CASE WHEN l_partkey % 29 <> 0 THEN CASE WHEN l_linestatus = 'O' THEN 'matching' ELSE 'cloze' END END AS kind,
         'A' || (l_partkey % 6) AS answer, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 END AS is_correct,
         CASE WHEN l_suppkey % 23 = 0 THEN 0.0 ELSE l_quantity END AS weight,
         CASE WHEN l_partkey % 5 = 0 AND l_returnflag IN ('R', 'N') THEN l_quantity / 2 END AS score,
         l_extendedprice AS elapsed, CAST(l_suppkey % 4 AS INTEGER) AS changes, l_discount AS discount, l_partkey AS part, l_shipdate AS answered_at
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem)
  WHERE rn = 1
), passages AS (
  SELECT attempt_id, passage_index, sum(CASE WHEN is_correct = 1 THEN weight ELSE 0.0 END) AS correct,
         sum(CASE WHEN is_correct IS NOT NULL THEN weight ELSE 0.0 END) AS total, bool_or(is_correct IS NOT NULL) AS gradable,
         min(answered_at) AS started_at, max(answered_at) AS ended_at, sum(changes) FILTER (part % 3 <> 0) AS duration_sec, min(kind) FILTER (part % 2 = 0) AS category
  FROM answers GROUP BY 1, 2
), suites AS (
  SELECT o_orderkey AS attempt_id, CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 1 END AS total_passages FROM orders WHERE o_orderkey % 11 <> 0
), overrides AS (
  SELECT attempt_id || '-' || question_id AS override_id, attempt_id, passage_index, question_id,
         CASE WHEN part % 4 = 0 THEN 'Z' ELSE answer END AS original_answer, is_correct AS original_correct, score AS original_score,
         weight AS new_score, part % 7 = 0 AS revoked, answered_at AS created_at
  FROM answers WHERE round(discount, 2) = 0.1
), beacons AS (
  SELECT user_id AS attempt_id, ['1-URGENT', '2-HIGH', '3-MEDIUM'][user_id % 3 + 1] AS batch_id,
         ['checked_in', 'in_progress', 'submitted', 'failed'][event_id % 4 + 1] AS status,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS updated_at, event_id AS file
  FROM events
)"""

#: Facts that several statements share, after ROLES.
FACTS = """
, effective AS (
  SELECT a.*, o.override_id IS NOT NULL AS overridden,
         coalesce(a.score, CASE a.is_correct WHEN 1 THEN a.weight WHEN 0 THEN 0.0 END) AS original,
         coalesce(o.new_score, a.score, CASE a.is_correct WHEN 1 THEN a.weight WHEN 0 THEN 0.0 END) AS effective
  FROM answers a LEFT JOIN overrides o ON o.attempt_id = a.attempt_id AND o.passage_index = a.passage_index AND o.question_id = a.question_id
    AND NOT o.revoked AND o.original_answer IS NOT DISTINCT FROM a.answer AND o.original_correct IS NOT DISTINCT FROM a.is_correct
    AND o.original_score IS NOT DISTINCT FROM a.score
), delta AS (
  SELECT attempt_id, passage_index, sum(coalesce(effective, 0) - coalesce(original, 0)) AS delta FROM effective GROUP BY 1, 2
), scores AS (
  SELECT p.attempt_id, sum(correct) AS raw_score, sum(correct + coalesce(delta, 0)) AS effective_score, sum(total) AS total
  FROM passages p LEFT JOIN delta d ON d.attempt_id = p.attempt_id AND d.passage_index = p.passage_index GROUP BY 1
), validity AS (
  SELECT t.attempt_id, CASE WHEN NOT counted THEN exclude_reason WHEN s.total_passages IS NULL THEN 'no suite'
           WHEN coalesce(n, 0) < greatest(s.total_passages, 1) THEN 'missing passages' WHEN NOT all_graded THEN 'ungraded passage' END AS reason
  FROM attempts t LEFT JOIN suites s ON s.attempt_id = t.attempt_id
  LEFT JOIN (SELECT attempt_id, count(*) AS n, bool_and(gradable AND total > 0) AS all_graded FROM passages GROUP BY 1) p ON p.attempt_id = t.attempt_id
  WHERE status = 'submitted'
), valid AS (
  SELECT t.*, raw_score, effective_score, total FROM attempts t JOIN validity v ON v.attempt_id = t.attempt_id AND reason IS NULL
  JOIN scores s ON s.attempt_id = t.attempt_id
), submitted AS (SELECT * FROM attempts WHERE status = 'submitted')
"""
