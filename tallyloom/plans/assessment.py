"""Assessment queries over the role tables, each with its statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom import roles as R
from tallyloom.operators import facts, roster, statistics
from tallyloom.plans.registry import query
from tallyloom.roles import FACTS, ROLES

S = SparkSession
BASE = f"WITH {ROLES}"
ALL = f"WITH {ROLES}{FACTS}"
GROUP = ["batch_id", "paper_id"]


def effective(spark: S, d: str) -> DataFrame:
    return facts.effective_answers(R.answers(spark, d), R.overrides(spark, d))


def valid(spark: S, d: str, original: bool = False) -> DataFrame:
    """Valid attempts with their points, from effective or original answers."""
    e = facts.effective_answers(R.answers(spark, d), None if original else R.overrides(spark, d))
    return facts.valid_attempts(R.attempts(spark, d), R.suites(spark, d), facts.graded_passages(e))


@query("agg_summary", ALL + """
SELECT batch_id, paper_id, count(*) AS n, round(avg(effective_score), 6) AS mean, round(median(effective_score), 6) AS median,
       min(effective_score) AS min, max(effective_score) AS max, round(CASE WHEN sum(total) > 0 THEN sum(effective_score) / sum(total) END, 6) AS accuracy,
       max(total) AS max_total FROM valid GROUP BY 1, 2""")
def agg_summary(spark: S, d: str) -> DataFrame:
    return statistics.summary(valid(spark, d), GROUP)


@query("agg_summary_original", ALL + """
SELECT batch_id, paper_id, count(*) AS n, round(avg(raw_score), 6) AS mean, round(median(raw_score), 6) AS median, min(raw_score) AS min, max(raw_score) AS max,
       round(CASE WHEN sum(total) > 0 THEN sum(raw_score) / sum(total) END, 6) AS accuracy, max(total) AS max_total FROM valid GROUP BY 1, 2""")
def agg_summary_original(spark: S, d: str) -> DataFrame:
    return statistics.summary(valid(spark, d, original=True), GROUP, "raw_score")


@query("agg_attempt_score", ALL + "SELECT attempt_id, raw_score, effective_score, total FROM scores")
def agg_attempt_score(spark: S, d: str) -> DataFrame:
    return facts.attempt_scores(R.passages(spark, d), effective(spark, d))


@query("agg_validity", ALL + "SELECT attempt_id, reason FROM validity")
def agg_validity(spark: S, d: str) -> DataFrame:
    return facts.validity(R.attempts(spark, d), R.suites(spark, d), R.passages(spark, d))


@query("agg_suite_total", BASE + "SELECT attempt_id, max(total_passages) AS total_passages FROM suites GROUP BY 1")
def agg_suite_total(spark: S, d: str) -> DataFrame:
    return R.suites(spark, d).groupBy("attempt_id").agg(F.max("total_passages").alias("total_passages"))


@query("jn_override_reading", ALL + "SELECT attempt_id, passage_index, question_id, overridden, original, effective FROM effective")
def jn_override_reading(spark: S, d: str) -> DataFrame:
    return effective(spark, d).select(*facts.KEYS, "overridden", "original", "effective")


@query("jn_outer_detect", BASE + """
SELECT o.override_id, CASE WHEN a.attempt_id IS NULL THEN 'answer gone' ELSE 'evidence changed' END AS conflict
FROM overrides o LEFT JOIN answers a ON a.attempt_id = o.attempt_id AND a.passage_index = o.passage_index AND a.question_id = o.question_id
WHERE NOT o.revoked AND (a.attempt_id IS NULL OR o.original_answer IS DISTINCT FROM a.answer OR o.original_correct IS DISTINCT FROM a.is_correct OR o.original_score IS DISTINCT FROM a.score)""")
def jn_outer_detect(spark: S, d: str) -> DataFrame:
    return facts.override_conflicts(R.answers(spark, d), R.overrides(spark, d))


@query("agg_histogram_unit", ALL + """
, tops AS (SELECT batch_id, greatest(CAST(ceil(max(total) / 10.0) AS INTEGER) - 1, 0) AS top FROM valid GROUP BY 1)
, bins AS (SELECT batch_id, CAST(unnest(range(0, top + 1)) AS INTEGER) AS bin FROM tops)
, c AS (SELECT v.batch_id, CAST(least(greatest(floor(effective_score / 10.0), 0), top) AS INTEGER) AS bin, count(*) AS n FROM valid v JOIN tops t ON t.batch_id = v.batch_id GROUP BY 1, 2)
SELECT b.batch_id, b.bin, coalesce(n, 0) AS n FROM bins b LEFT JOIN c ON c.batch_id = b.batch_id AND c.bin = b.bin""")
def agg_histogram_unit(spark: S, d: str) -> DataFrame:
    return statistics.unit_histogram(valid(spark, d), ["batch_id"], width=10.0)


@query("agg_histogram_decile", ALL + """
, c AS (SELECT batch_id, CAST(least(greatest(floor(coalesce(CASE WHEN total > 0 THEN effective_score * 100 / total END, 0) / 10), 0) * 10, 90) AS INTEGER) AS bin, count(*) AS n FROM valid GROUP BY 1, 2)
, b AS (SELECT DISTINCT batch_id, CAST(unnest(range(0, 100, 10)) AS INTEGER) AS bin FROM valid)
SELECT b.batch_id, b.bin, coalesce(n, 0) AS n FROM b LEFT JOIN c ON c.batch_id = b.batch_id AND c.bin = b.bin""")
def agg_histogram_decile(spark: S, d: str) -> DataFrame:
    return statistics.decile_histogram(valid(spark, d), ["batch_id"])


@query("agg_part", ALL + """
, j AS (SELECT p.*, v.candidate_id FROM passages p JOIN valid v ON v.attempt_id = p.attempt_id)
SELECT passage_index, count(*) AS n, sum(correct) AS correct, sum(total) AS total, round(CASE WHEN sum(total) > 0 THEN sum(correct) / sum(total) END, 6) AS accuracy,
       arg_min(coalesce(nullif(trim(category), ''), 'P' || (passage_index + 1)), {'c': candidate_id, 'a': attempt_id}) AS label FROM j GROUP BY 1""")
def agg_part(spark: S, d: str) -> DataFrame:
    return statistics.parts(valid(spark, d), R.passages(spark, d))


ITEMS = """
, j AS (SELECT a.*, v.candidate_id FROM answers a JOIN valid v ON v.attempt_id = a.attempt_id WHERE is_correct IS NOT NULL AND weight > 0)
, items AS (SELECT passage_index, question_id, count(*) AS n, count(*) FILTER (is_correct = 1) AS n_correct, round(avg(CASE WHEN is_correct = 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  count(*) >= 30 AS enough, arg_min(label, {'c': candidate_id, 'a': attempt_id}) FILTER (label IS NOT NULL) AS label, arg_min(kind, {'c': candidate_id, 'a': attempt_id}) FILTER (kind IS NOT NULL) AS kind
  FROM j GROUP BY 1, 2)
"""


@query("agg_question", ALL + ITEMS + "SELECT * FROM items")
def agg_question(spark: S, d: str) -> DataFrame:
    return statistics.items(valid(spark, d), R.answers(spark, d))


@query("topk_hard", ALL + ITEMS + "SELECT passage_index, question_id, n, accuracy FROM items ORDER BY coalesce(accuracy, 1.0), n DESC, passage_index, strlen(question_id), question_id LIMIT 5")
def topk_hard(spark: S, d: str) -> DataFrame:
    return statistics.hardest(agg_question(spark, d), 5).select("passage_index", "question_id", "n", "accuracy")


@query("num_verdict", ALL + ITEMS + "SELECT passage_index, question_id, CASE WHEN n < 30 THEN 'insufficient' WHEN accuracy < 0.5 THEN 'hard' ELSE 'normal' END AS verdict FROM items")
def num_verdict(spark: S, d: str) -> DataFrame:
    return agg_question(spark, d).select("passage_index", "question_id", statistics.verdict(F.col("n"), F.col("accuracy")).alias("verdict"))


@query("srt_multi", ALL + ITEMS + "SELECT passage_index, question_id, row_number() OVER (ORDER BY passage_index, strlen(question_id), question_id) AS rank FROM items")
def srt_multi(spark: S, d: str) -> DataFrame:
    order = W.orderBy("passage_index", *statistics.natural())  # one row an item
    return agg_question(spark, d).select("passage_index", "question_id", F.row_number().over(order).alias("rank"))


@query("agg_kind", ALL + """
SELECT coalesce(kind, '') AS kind, count(DISTINCT e.attempt_id) AS attempts, sum(weight) AS points, sum(effective) AS score, round(CASE WHEN sum(weight) > 0 THEN sum(effective) / sum(weight) END, 6) AS accuracy
FROM effective e JOIN valid v ON v.attempt_id = e.attempt_id WHERE is_correct IS NOT NULL AND weight > 0 GROUP BY 1""")
def agg_kind(spark: S, d: str) -> DataFrame:
    return statistics.kinds(valid(spark, d), effective(spark, d))


POINTS = "count(*) AS n, sum(coalesce(effective, 0)) AS score, sum(weight) AS points, round(CASE WHEN sum(weight) > 0 THEN sum(coalesce(effective, 0)) / sum(weight) END, 6) AS accuracy FROM effective WHERE weight > 0"


@query("agg_listening_question", ALL + f"SELECT passage_index, question_id, {POINTS} GROUP BY 1, 2")
def agg_listening_question(spark: S, d: str) -> DataFrame:
    return statistics.item_points(effective(spark, d), ["passage_index", "question_id"])


@query("topk_hard_points", ALL + f"SELECT passage_index, question_id, accuracy FROM (SELECT passage_index, question_id, {POINTS} GROUP BY 1, 2) ORDER BY accuracy, passage_index, question_id LIMIT 5")
def topk_hard_points(spark: S, d: str) -> DataFrame:
    return agg_listening_question(spark, d).orderBy("accuracy", "passage_index", "question_id").limit(5).select("passage_index", "question_id", "accuracy")


@query("agg_listening_kind", ALL + "SELECT coalesce(kind, 'unknown') AS kind, count(DISTINCT attempt_id) AS attempts, sum(coalesce(effective, 0)) AS score, sum(weight) AS points FROM effective GROUP BY 1")
def agg_listening_kind(spark: S, d: str) -> DataFrame:
    return effective(spark, d).groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count_distinct("attempt_id").alias("attempts"), F.sum(F.coalesce("effective", F.lit(0.0))).alias("score"), F.sum("weight").alias("points"))


@query("agg_listening_student", ALL + "SELECT attempt_id, sum(coalesce(effective, 0)) AS score, sum(weight) AS points, count(*) AS n_slots FROM effective GROUP BY 1")
def agg_listening_student(spark: S, d: str) -> DataFrame:
    return statistics.student_slots(effective(spark, d)).select("attempt_id", "score", "points", F.size("slots").cast("long").alias("n_slots"))


@query("piv_map_cells", ALL + "SELECT attempt_id, string_agg(question_id || ':' || CAST(coalesce(effective, 0) AS INTEGER), ',' ORDER BY question_id) AS cells FROM effective GROUP BY 1")
def piv_map_cells(spark: S, d: str) -> DataFrame:
    cells = F.transform(F.map_entries("slots"), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"], 0).cast("int").cast("string")))
    e = effective(spark, d).withColumn("effective", F.bround("effective", 0))
    return statistics.student_slots(e).select("attempt_id", F.array_join(cells, ",").alias("cells"))


@query("agg_distribution", ALL + """
, j AS (SELECT a.*, v.candidate_id, lower(trim(regexp_replace(answer, '\\s+', ' ', 'g'))) AS text FROM answers a JOIN valid v ON v.attempt_id = a.attempt_id)
SELECT e.passage_index, e.question_id, text, n, round(n / n_all, 6) AS share, last_correct
FROM (SELECT passage_index, question_id, text, count(*) AS n, arg_max_null(is_correct, {'c': candidate_id, 'a': attempt_id}) AS last_correct FROM j GROUP BY 1, 2, 3) e
JOIN (SELECT passage_index, question_id, count(*) AS n_all FROM j GROUP BY 1, 2) w ON w.passage_index = e.passage_index AND w.question_id = e.question_id""")
def agg_distribution(spark: S, d: str) -> DataFrame:
    return statistics.distribution(valid(spark, d), R.answers(spark, d))


@query("agg_question_avgs", ALL + """
SELECT passage_index, question_id, round(avg(elapsed), 4) AS mean_elapsed, round(avg(changes), 6) AS mean_changes
FROM answers a JOIN valid v ON v.attempt_id = a.attempt_id WHERE is_correct IS NOT NULL AND weight > 0 GROUP BY 1, 2""")
def agg_question_avgs(spark: S, d: str) -> DataFrame:
    return statistics.question_effort(valid(spark, d), R.answers(spark, d)).withColumn("mean_elapsed", F.round("mean_elapsed", 4))


@query("piv_matrix", ALL + """
SELECT v.candidate_id, a.attempt_id, """ + ", ".join(f"max(is_correct) FILTER (question_id = 'q{k}') AS q{k}" for k in range(1, 8)) + """
FROM answers a JOIN valid v ON v.attempt_id = a.attempt_id GROUP BY 1, 2""")
def piv_matrix(spark: S, d: str) -> DataFrame:
    return statistics.matrix(valid(spark, d), R.answers(spark, d), [f"q{k}" for k in range(1, 8)])


@query("piv_parts", ALL + "SELECT p.attempt_id, max(correct) FILTER (passage_index = 0) AS part_0, max(correct) FILTER (passage_index = 1) AS part_1, max(correct) FILTER (passage_index = 2) AS part_2 FROM passages p JOIN valid v ON v.attempt_id = p.attempt_id GROUP BY 1")
def piv_parts(spark: S, d: str) -> DataFrame:
    return statistics.part_vector(valid(spark, d), R.passages(spark, d), 3)


@query("agg_duration", BASE + "SELECT attempt_id, CAST(sum(duration_sec) AS BIGINT) AS duration_sec FROM passages GROUP BY 1")
def agg_duration(spark: S, d: str) -> DataFrame:
    return statistics.durations(R.passages(spark, d))


@query("agg_median_upper", BASE + "SELECT passage_index, sort_list[len(sort_list) // 2 + 1] AS median_upper FROM (SELECT passage_index, list_sort(list(total)) AS sort_list FROM passages GROUP BY 1)".replace("sort_list", "s"))
def agg_median_upper(spark: S, d: str) -> DataFrame:
    return statistics.median_upper(R.passages(spark, d), ["passage_index"], "total")


@query("agg_median_exact", BASE + "SELECT passage_index, median(total) AS median FROM passages GROUP BY 1")
def agg_median_exact(spark: S, d: str) -> DataFrame:
    return R.passages(spark, d).groupBy("passage_index").agg(F.median("total").alias("median"))


@query("agg_identity", BASE + """
, a AS (SELECT DISTINCT CAST(candidate_id AS VARCHAR) AS id, candidate_name AS name FROM attempts WHERE status = 'submitted')
SELECT 'id has names' AS issue, id AS key, CAST(count(*) AS INTEGER) AS n_members, string_agg(name, '|' ORDER BY name) AS members FROM a GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'name has ids', name, CAST(count(*) AS INTEGER), string_agg(id, '|' ORDER BY id) FROM a GROUP BY name HAVING count(*) > 1""")
def agg_identity(spark: S, d: str) -> DataFrame:
    return roster.identity_issues(R.attempts(spark, d))


LATEST = ", latest AS (SELECT * FROM beacons QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY updated_at DESC, file) = 1)"


@query("win_latest_per_key", BASE + LATEST + "SELECT attempt_id, batch_id, status, updated_at, file FROM latest")
def win_latest_per_key(spark: S, d: str) -> DataFrame:
    return roster.latest_beacon(R.beacons(spark, d))


@query("stm_live_counts", BASE + LATEST + "SELECT batch_id, status, count(*) AS n FROM latest GROUP BY 1, 2")
def stm_live_counts(spark: S, d: str) -> DataFrame:
    return roster.live_counts(R.beacons(spark, d))


@query("agg_batch_overview", ALL + LATEST + """
, b AS (SELECT batch_id, count(*) FILTER (status = 'checked_in') AS live_checked_in, count(*) FILTER (status = 'in_progress') AS live_in_progress,
        count(*) FILTER (status = 'submitted') AS live_submitted, count(*) FILTER (status = 'failed') AS live_failed FROM latest GROUP BY 1)
, i AS (SELECT batch_id, count(*) AS imported, max(submitted_at) FILTER (status = 'submitted') AS last_submitted FROM attempts WHERE status IN ('submitted', 'failed') GROUP BY 1)
, x AS (SELECT batch_id, count(*) FILTER (reason IS NULL) AS valid, count(reason) AS exceptions FROM attempts a JOIN validity v ON v.attempt_id = a.attempt_id GROUP BY 1)
SELECT coalesce(b.batch_id, i.batch_id) AS batch_id, coalesce(live_checked_in, 0) AS live_checked_in, coalesce(live_in_progress, 0) AS live_in_progress, coalesce(live_submitted, 0) AS live_submitted,
       coalesce(live_failed, 0) AS live_failed, coalesce(imported, 0) AS imported, coalesce(valid, 0) AS valid, coalesce(exceptions, 0) AS exceptions, last_submitted
FROM b FULL OUTER JOIN i ON i.batch_id = b.batch_id LEFT JOIN x ON x.batch_id = coalesce(b.batch_id, i.batch_id)""")
def agg_batch_overview(spark: S, d: str) -> DataFrame:
    a, p = R.attempts(spark, d), R.passages(spark, d)
    return roster.batch_overview(a, facts.validity(a, R.suites(spark, d), p), R.beacons(spark, d))


@query("jn_theta_interval", BASE + "SELECT a.attempt_id, a.passage_index AS first, b.passage_index AS second FROM passages a JOIN passages b ON a.attempt_id = b.attempt_id AND a.passage_index < b.passage_index AND a.started_at < b.ended_at AND b.started_at < a.ended_at")
def jn_theta_interval(spark: S, d: str) -> DataFrame:
    return roster.interval_overlaps(R.passages(spark, d))


REJUDGE = """
SELECT a.attempt_id, passage_index, question_id, answer, weight, sha256(a.attempt_id || '/' || passage_index || '/' || question_id) AS token
FROM answers a JOIN attempts t ON t.attempt_id = a.attempt_id AND status = 'submitted'
WHERE is_correct = 0 AND lower(answer) IN ('a1', 'a4') AND NOT EXISTS (SELECT 1 FROM overrides o WHERE o.attempt_id = a.attempt_id AND o.passage_index = a.passage_index AND o.question_id = a.question_id AND NOT revoked)"""


@query("mut_rejudge_preview", BASE + REJUDGE)
def mut_rejudge_preview(spark: S, d: str) -> DataFrame:
    return roster.rejudge_preview(R.attempts(spark, d), R.answers(spark, d), R.overrides(spark, d), [" a1 ", "A4"])


@query("mut_rejudge_apply", BASE + f"""
SELECT 'run1-' || r.attempt_id || '-' || r.question_id AS override_id, r.attempt_id, r.passage_index, r.question_id, a.answer AS original_answer, a.is_correct AS original_correct,
       a.score AS original_score, a.weight AS new_score, false AS revoked
FROM ({REJUDGE}) r JOIN answers a ON a.attempt_id = r.attempt_id AND a.passage_index = r.passage_index AND a.question_id = r.question_id""")
def mut_rejudge_apply(spark: S, d: str) -> DataFrame:
    return roster.rejudge_apply(mut_rejudge_preview(spark, d), R.answers(spark, d), "run1")


@query("jn_anti", BASE + "SELECT a.attempt_id, a.question_id FROM answers a WHERE is_correct = 0 AND NOT EXISTS (SELECT 1 FROM overrides o WHERE o.attempt_id = a.attempt_id AND o.question_id = a.question_id AND NOT revoked)")
def jn_anti(spark: S, d: str) -> DataFrame:
    active = R.overrides(spark, d).filter(~F.col("revoked"))
    return roster.wrong_answers(R.answers(spark, d)).join(active, ["attempt_id", "question_id"], "left_anti").select("attempt_id", "question_id")


@query("jn_semi", BASE + "SELECT attempt_id, status FROM attempts t WHERE EXISTS (SELECT 1 FROM overrides o WHERE o.attempt_id = t.attempt_id)")
def jn_semi(spark: S, d: str) -> DataFrame:
    return R.attempts(spark, d).join(R.overrides(spark, d), "attempt_id", "left_semi").select("attempt_id", "status")


@query("jn_children", BASE + "SELECT t.attempt_id, batch_id, passage_index, correct, total, total_passages FROM attempts t JOIN passages p ON p.attempt_id = t.attempt_id LEFT JOIN suites s ON s.attempt_id = t.attempt_id")
def jn_children(spark: S, d: str) -> DataFrame:
    t, p, s = R.attempts(spark, d), R.passages(spark, d), R.suites(spark, d)
    return t.join(p, "attempt_id").join(s, "attempt_id", "left").select("attempt_id", "batch_id", "passage_index", "correct", "total", "total_passages")


@query("jn_inner_using", BASE + "SELECT attempt_id, passage_index, question_id, batch_id, total FROM answers JOIN passages USING (attempt_id, passage_index) JOIN attempts USING (attempt_id)")
def jn_inner_using(spark: S, d: str) -> DataFrame:
    j = R.answers(spark, d).join(R.passages(spark, d), ["attempt_id", "passage_index"]).join(R.attempts(spark, d), "attempt_id")
    return j.select("attempt_id", "passage_index", "question_id", "batch_id", "total")


@query("jn_latest_child", BASE + """
, n AS (SELECT * FROM overrides QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY created_at DESC, override_id DESC) = 1)
SELECT t.attempt_id, t.status, n.override_id, n.new_score FROM attempts t LEFT JOIN n ON n.attempt_id = t.attempt_id""")
def jn_latest_child(spark: S, d: str) -> DataFrame:
    o = R.overrides(spark, d).select("attempt_id", "override_id", "new_score", "created_at")
    return roster.latest_child(R.attempts(spark, d), o, "attempt_id", [F.desc("created_at"), F.desc("override_id")]).select("attempt_id", "status", "override_id", "new_score")


@query("agg_correlated_sum", ALL + "SELECT t.attempt_id, coalesce((SELECT sum(effective) FROM effective e WHERE e.attempt_id = t.attempt_id), 0) AS score FROM attempts t")
def agg_correlated_sum(spark: S, d: str) -> DataFrame:
    s = effective(spark, d).groupBy("attempt_id").agg(F.sum("effective").alias("s"))
    return R.attempts(spark, d).join(s, "attempt_id", "left").select("attempt_id", F.coalesce("s", F.lit(0.0)).alias("score"))


@query("agg_correlated_min", BASE + "SELECT attempt_id, coalesce((SELECT min(started_at) FROM passages p WHERE p.attempt_id = t.attempt_id), TIMESTAMP '2000-01-01') AS first_at FROM attempts t")
def agg_correlated_min(spark: S, d: str) -> DataFrame:
    m = R.passages(spark, d).groupBy("attempt_id").agg(F.min("started_at").alias("m"))
    return R.attempts(spark, d).join(m, "attempt_id", "left").select("attempt_id", F.coalesce("m", F.lit("2000-01-01").cast(m.schema["m"].dataType)).alias("first_at"))


@query("agg_export_listening", ALL + "SELECT t.attempt_id, candidate_name, batch_id, sum(coalesce(effective, 0)) AS score, sum(weight) AS points FROM effective e JOIN attempts t ON t.attempt_id = e.attempt_id WHERE counted GROUP BY 1, 2, 3")
def agg_export_listening(spark: S, d: str) -> DataFrame:
    j = effective(spark, d).join(R.attempts(spark, d).filter("counted"), "attempt_id")
    return j.groupBy("attempt_id", "candidate_name", "batch_id").agg(F.sum(F.coalesce("effective", F.lit(0.0))).alias("score"), F.sum("weight").alias("points"))


@query("agg_bool_any_all", BASE + "SELECT attempt_id, bool_or(NOT gradable) AS any_ungraded, bool_and(gradable) AS all_graded FROM passages GROUP BY 1")
def agg_bool_any_all(spark: S, d: str) -> DataFrame:
    return R.passages(spark, d).groupBy("attempt_id").agg(F.bool_or(~F.col("gradable")).alias("any_ungraded"), F.bool_and("gradable").alias("all_graded"))


@query("win_retention", BASE + """
, r AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY file DESC) AS rn, max(CASE WHEN status = 'submitted' THEN file END) OVER (PARTITION BY attempt_id) AS s FROM beacons)
SELECT attempt_id, file FROM r WHERE rn <= 20 OR file = s""")
def win_retention(spark: S, d: str) -> DataFrame:
    return roster.retention(R.beacons(spark, d), "attempt_id", "file", 20, F.col("status") == "submitted").select("attempt_id", "file")


@query("stm_version_gate", """
SELECT event_id, user_id, v FROM (SELECT event_id, user_id, CAST(value AS BIGINT) AS v,
  max(CAST(value AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR v > m""")
def stm_version_gate(spark: S, d: str) -> DataFrame:
    e = R.read(spark, d, "events").select("event_id", "user_id", F.bround("value", 0).cast("long").alias("v"))
    return roster.version_gate(e, "user_id", "event_id", "v")


@query("win_first_value", BASE + "SELECT DISTINCT passage_index, first_value(kind IGNORE NULLS) OVER (PARTITION BY passage_index ORDER BY attempt_id, question_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kind FROM answers")
def win_first_value(spark: S, d: str) -> DataFrame:
    order = F.struct("attempt_id", "question_id")
    return R.answers(spark, d).groupBy("passage_index").agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), order)).alias("kind"))


@query("flt_scope", ALL + "SELECT attempt_id, effective_score FROM valid WHERE batch_id = '2-HIGH' AND paper_id = '1996'")
def flt_scope(spark: S, d: str) -> DataFrame:
    return valid(spark, d).filter((F.col("batch_id") == "2-HIGH") & (F.col("paper_id") == "1996")).select("attempt_id", "effective_score")


@query("flt_in_list_param", BASE + "SELECT attempt_id FROM attempts WHERE status IN ('submitted', 'failed') AND coalesce(paper_id, '') IN ('1996', '')")
def flt_in_list_param(spark: S, d: str) -> DataFrame:
    a = R.attempts(spark, d).filter(F.col("status").isin("submitted", "failed"))
    return a.filter(F.coalesce("paper_id", F.lit("")).isin("1996", "")).select("attempt_id")


@query("nest_labels", ALL + """
SELECT v.attempt_id, v.candidate_name, a.passage_index, coalesce(label, question_id) AS label, answer, CASE is_correct WHEN 1 THEN 'right' ELSE 'wrong' END AS result, original
FROM effective a JOIN valid v ON v.attempt_id = a.attempt_id WHERE is_correct IS NOT NULL""")
def nest_labels(spark: S, d: str) -> DataFrame:
    j = effective(spark, d).filter(F.col("is_correct").isNotNull()).join(valid(spark, d).select("attempt_id", "candidate_name"), "attempt_id")
    return j.select("attempt_id", "candidate_name", "passage_index", F.coalesce("label", "question_id").alias("label"), "answer", F.when(F.col("is_correct") == 1, "right").otherwise("wrong").alias("result"), "original")


@query("nest_detail", BASE + """
SELECT t.attempt_id, p.n_passages, coalesce(o.n_overrides, 0) AS n_overrides, p.points FROM attempts t
JOIN (SELECT attempt_id, count(*) AS n_passages, sum(correct) AS points FROM passages GROUP BY 1) p ON p.attempt_id = t.attempt_id
LEFT JOIN (SELECT attempt_id, count(*) AS n_overrides FROM overrides GROUP BY 1) o ON o.attempt_id = t.attempt_id""")
def nest_detail(spark: S, d: str) -> DataFrame:
    p = R.passages(spark, d).groupBy("attempt_id").agg(F.array_sort(F.collect_list(F.struct("passage_index", "correct", "total"))).alias("passages"))
    o = R.overrides(spark, d).groupBy("attempt_id").agg(F.array_sort(F.collect_list(F.struct("override_id", "new_score", "revoked"))).alias("overrides"))
    j = R.attempts(spark, d).join(p, "attempt_id").join(o, "attempt_id", "left")
    points = F.aggregate("passages", F.lit(0.0), lambda acc, x: acc + x["correct"])
    return j.select("attempt_id", F.size("passages").cast("long").alias("n_passages"), F.coalesce(F.size("overrides"), F.lit(0)).cast("long").alias("n_overrides"), points.alias("points")).withColumn("n_overrides", F.greatest("n_overrides", F.lit(0)))
