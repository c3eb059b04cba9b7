"""Further rows of the operator inventory, each with its statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom import roles as R
from tallyloom.functions import text
from tallyloom.operators import library, reconcile, review
from tallyloom.plans.assessment import ALL, BASE, effective, valid
from tallyloom.plans.library import MERGE, _merge_sources
from tallyloom.plans.registry import query

S = SparkSession
read = R.read


@query("flt_part", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11'")
def flt_part(spark: S, d: str) -> DataFrame:
    return read(spark, d, "part").filter(library.optional("p_brand", "Brand#11")).select("p_partkey")


@query("prj_coalesce_score", BASE + "SELECT attempt_id, question_id, coalesce(score, CASE is_correct WHEN 1 THEN weight WHEN 0 THEN 0.0 END) AS points FROM answers")
def prj_coalesce_score(spark: S, d: str) -> DataFrame:
    return R.answers(spark, d).select("attempt_id", "question_id", F.coalesce("score", F.when(F.col("is_correct") == 1, F.col("weight")).when(F.col("is_correct") == 0, 0.0)).alias("points"))


@query("prj_json_len", "SELECT event_id, length(props) AS n, length(trim(props)) > 0 AS filled FROM events")
def prj_json_len(spark: S, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.length("props").cast("long").alias("n"), (F.length(F.trim("props")) > 0).alias("filled"))


@query("jn_override_listening", BASE + """
SELECT a.attempt_id, a.question_id, coalesce(o.new_score, a.is_correct * a.weight) AS points FROM answers a
LEFT JOIN overrides o ON o.attempt_id = a.attempt_id AND o.question_id = a.question_id AND NOT o.revoked AND o.original_correct IS NOT DISTINCT FROM a.is_correct""")
def jn_override_listening(spark: S, d: str) -> DataFrame:
    a, o = R.answers(spark, d).alias("a"), R.overrides(spark, d).filter(~F.col("revoked")).alias("o")
    on = (F.col("a.attempt_id") == F.col("o.attempt_id")) & (F.col("a.question_id") == F.col("o.question_id")) & F.col("o.original_correct").eqNullSafe(F.col("a.is_correct"))
    return a.join(o, on, "left").select("a.attempt_id", "a.question_id", F.coalesce("o.new_score", F.col("a.is_correct") * F.col("a.weight")).alias("points"))


@query("jn_fuzzy_key", """
WITH a AS (SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS k FROM customer), b AS (SELECT s_suppkey, lower(regexp_replace('customer-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), '[^A-Za-z0-9]', '', 'g')) AS k FROM supplier)
SELECT a.c_custkey, b.s_suppkey FROM a LEFT JOIN b ON b.k = a.k""")
def jn_fuzzy_key(spark: S, d: str) -> DataFrame:
    key = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    a = read(spark, d, "customer").select("c_custkey", key(F.col("c_name")).alias("k"))
    b = read(spark, d, "supplier").select("s_suppkey", key(F.concat(F.lit("customer-"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))).alias("k"))
    return a.join(b, "k", "left").select("c_custkey", "s_suppkey")


@query("jn_unmapped_lookup", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25")
def jn_unmapped_lookup(spark: S, d: str) -> DataFrame:
    p = read(spark, d, "part").filter("p_size > 25").select("p_partkey", "p_name")
    return read(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "p_name")


@query("agg_listening_part", ALL + "SELECT coalesce(CASE WHEN passage_index < 2 THEN CAST(passage_index AS VARCHAR) END, 'unknown') AS part, sum(coalesce(effective, 0)) AS score, sum(weight) AS points FROM effective GROUP BY 1")
def agg_listening_part(spark: S, d: str) -> DataFrame:
    part = F.coalesce(F.when(F.col("passage_index") < 2, F.col("passage_index").cast("string")), F.lit("unknown"))
    return effective(spark, d).groupBy(part.alias("part")).agg(F.sum(F.coalesce("effective", F.lit(0.0))).alias("score"), F.sum("weight").alias("points"))


@query("agg_decision_summary", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def agg_decision_summary(spark: S, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).count().na.fill(0)


@query("agg_document_score", BASE + "SELECT t.attempt_id, coalesce(round(avg(correct), 6), 0) AS score FROM attempts t LEFT JOIN passages p ON p.attempt_id = t.attempt_id GROUP BY 1")
def agg_document_score(spark: S, d: str) -> DataFrame:
    return R.attempts(spark, d).join(R.passages(spark, d), "attempt_id", "left").groupBy("attempt_id").agg(F.coalesce(F.round(F.avg("correct"), 6), F.lit(0.0)).alias("score"))


@query("agg_multiset_common", """
WITH t AS (SELECT conv_id, turn % 2 AS side, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS w FROM conversations), c AS (SELECT conv_id, w, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM t GROUP BY 1, 2)
SELECT conv_id, sum(least(a, b))::BIGINT AS common FROM c GROUP BY 1""")
def agg_multiset_common(spark: S, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", "turn", F.explode(text.tokens(F.col("text"))).alias("w"))
    return library.multiset_common(c.filter("turn % 2 = 0"), c.filter("turn % 2 = 1"), ["conv_id"], "w").select("conv_id", "common")


@query("rec_doc_compare", """
WITH t AS (SELECT conv_id AS doc, turn // 2 AS page, turn % 2 AS side, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS w FROM conversations), c AS (SELECT doc, page, w, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM t GROUP BY 1, 2, 3)
SELECT doc, page, sum(least(a, b))::BIGINT AS common, sum(greatest(b - a, 0))::BIGINT AS added, sum(greatest(a - b, 0))::BIGINT AS removed, sum(abs(a - b)) = 0 AS equal FROM c GROUP BY 1, 2""")
def rec_doc_compare(spark: S, d: str) -> DataFrame:
    page = F.floor(F.col("turn") / 2)
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), page.alias("page"), "turn", F.explode(text.tokens(F.col("text"))).alias("w"))
    m = library.multiset_common(c.filter("turn % 2 = 0"), c.filter("turn % 2 = 1"), ["doc", "page"], "w")
    return m.select("doc", "page", "common", "added", "removed", (F.col("symdiff") == 0).alias("equal"))


@query("win_last_value", BASE + "SELECT passage_index, answer, arg_max_null(is_correct, {'a': attempt_id, 'q': question_id}) AS last FROM answers GROUP BY 1, 2")
def win_last_value(spark: S, d: str) -> DataFrame:
    return R.answers(spark, d).groupBy("passage_index", "answer").agg(F.max_by("is_correct", F.struct("attempt_id", "question_id")).alias("last"))


@query("win_rank_in_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rank FROM part")
def win_rank_in_order(spark: S, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")).alias("rank"))


@query("srt_students", ALL + "SELECT candidate_id, attempt_id, effective_score FROM valid ORDER BY 1, 2")
def srt_students(spark: S, d: str) -> DataFrame:
    return valid(spark, d).select("candidate_id", "attempt_id", "effective_score").orderBy("candidate_id", "attempt_id")


@query("srt_desc_stable", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type")
def srt_desc_stable(spark: S, d: str) -> DataFrame:
    return read(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type")


@query("srt_null_order", BASE + "SELECT attempt_id, question_id, kind FROM answers ORDER BY kind NULLS FIRST, attempt_id, question_id")
def srt_null_order(spark: S, d: str) -> DataFrame:
    return R.answers(spark, d).select("attempt_id", "question_id", "kind").orderBy("kind", "attempt_id", "question_id")


@query("srt_locale")
def srt_locale(spark: S, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", "p_name").orderBy(F.collate("p_name", "zh"), "p_partkey")


@query("set_intersection", BASE + MERGE + "SELECT id FROM a INTERSECT SELECT id FROM b")
def set_intersection(spark: S, d: str) -> DataFrame:
    a, b, *_ = (x.select("id") for x in _merge_sources(spark, d))
    return a.intersect(b)


@query("set_union_array", "SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_orderkey % 3, o_orderkey % 5, o_orderkey % 7])), ',') AS u FROM orders")
def set_union_array(spark: S, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    u = F.array_sort(F.array_union(F.array(k % 3), F.array(k % 5, k % 7)))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(u, lambda x: x.cast("string")), ",").alias("u"))


@query("str_readable", "SELECT doc_id, md5(rtrim(lower(regexp_replace(text, '\\s+', ' ', 'g')))) AS h FROM documents")
def str_readable(spark: S, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(text.readable(F.col("text"))).alias("h"))


@query("str_compact", "SELECT conv_id, turn, md5(regexp_replace(text, '\\s+', '', 'g')) AS h FROM conversations")
def str_compact(spark: S, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(text.compact(F.col("text"))).alias("h"))


@query("str_char_spacing", "SELECT doc_id, regexp_matches(text, '(?:^|\\s)(?:[A-Za-z]\\s+){4}[A-Za-z](?:\\s|$)') AS spaced FROM documents")
def str_char_spacing(spark: S, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.spaced_out(F.col("text")).alias("spaced"))


@query("str_compare_key", "SELECT p_partkey, array_to_string(list_sort([lower(p_brand), lower(p_type), lower(p_name)]), '|') AS k FROM part")
def str_compare_key(spark: S, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", text.compare_key(F.array("p_brand", "p_type", "p_name")).alias("k"))


@query("str_label", BASE + "SELECT attempt_id, passage_index, coalesce(nullif(trim(category), ''), 'P' || (passage_index + 1)) AS label FROM passages")
def str_label(spark: S, d: str) -> DataFrame:
    return R.passages(spark, d).select("attempt_id", "passage_index", text.label(F.col("category"), F.col("passage_index")).alias("label"))


@query("str_range_parse", "SELECT p_partkey, CASE WHEN p_size % 20 + 1 <= p_size THEN p_size % 20 + 1 END AS first FROM part")
def str_range_parse(spark: S, d: str) -> DataFrame:
    c = F.concat(F.lit("Questions "), (F.col("p_size") % 20 + 1).cast("string"), F.lit("–"), F.col("p_size").cast("string"))
    return read(spark, d, "part").select("p_partkey", text.range_numbers(c)["first"].alias("first"))


@query("str_display_answer", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '—' WHEN 1 THEN c_name ELSE c_name || ' / ' || c_mktsegment END AS shown FROM customer")
def str_display_answer(spark: S, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    doc = F.when(k == 0, "null").when(k == 1, F.concat(F.lit('"'), "c_name", F.lit('"'))).otherwise(F.to_json(F.array("c_name", F.lit(" "), "c_mktsegment")))
    return read(spark, d, "customer").select("c_custkey", text.display_answer(doc).alias("shown"))


@query("dt_parse_rfc3339", BASE + "SELECT attempt_id, CASE WHEN attempt_id % 10 <> 0 THEN CAST(replace(submitted_at, 'Z', '') AS TIMESTAMP) END AS at FROM attempts")
def dt_parse_rfc3339(spark: S, d: str) -> DataFrame:
    t = F.when(F.col("attempt_id") % 10 == 0, "not a time").otherwise(F.col("submitted_at"))
    return R.attempts(spark, d).select("attempt_id", F.try_to_timestamp(t).cast("timestamp_ntz").alias("at"))


@query("dt_lease", "SELECT event_id, ts + INTERVAL 600 SECOND AS until, ts + INTERVAL 600 SECOND < (SELECT max(ts) FROM events) AS expired FROM events")
def dt_lease(spark: S, d: str) -> DataFrame:
    e = read(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    until = F.col("ts") + F.expr("INTERVAL 600 SECONDS")
    return e.crossJoin(now).select("event_id", until.alias("until"), (until < F.col("now")).alias("expired"))


@query("dt_monotonic_delta", "SELECT event_id, event_id - p AS delta FROM (SELECT event_id, event_id // 500 AS c, lag(event_id) OVER w AS p, lag(event_id // 500) OVER w AS pc FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE c = pc AND event_id >= p")
def dt_monotonic_delta(spark: S, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("event_id")
    e = read(spark, d, "events").withColumn("c", F.floor(F.col("event_id") / 500))
    e = e.withColumns({"p": F.lag("event_id").over(w), "pc": F.lag("c").over(w)}).filter("c = pc AND event_id >= p")
    return e.select("event_id", (F.col("event_id") - F.col("p")).alias("delta"))


@query("num_finite_range", BASE + "SELECT attempt_id, question_id, score BETWEEN 0 AND weight AS ok FROM answers")
def num_finite_range(spark: S, d: str) -> DataFrame:
    s = F.col("score")
    return R.answers(spark, d).select("attempt_id", "question_id", (~F.isnan(s) & s.between(0, F.col("weight"))).alias("ok"))


@query("num_floor_ceil_clamp", "SELECT l_orderkey, l_linenumber, CAST(least(greatest(floor(l_extendedprice / 1000), 0), 40) AS BIGINT) AS bin, CAST(ceil(l_tax * 100) AS BIGINT) AS up FROM lineitem")
def num_floor_ceil_clamp(spark: S, d: str) -> DataFrame:
    bin_ = F.least(F.greatest(F.floor(F.col("l_extendedprice") / 1000), F.lit(0)), F.lit(40))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bin_.alias("bin"), F.ceil(F.col("l_tax") * 100).alias("up"))


@query("num_round", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS v FROM lineitem")
def num_round(spark: S, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5) / 100).alias("v"))


@query("num_score_attempt", BASE + "SELECT attempt_id, count(*) AS possible, count(*) FILTER (answer IN ('A1', 'A3')) AS earned FROM answers GROUP BY 1")
def num_score_attempt(spark: S, d: str) -> DataFrame:
    s = R.answers(spark, d).select("attempt_id", F.array(F.lit("A1"), F.lit("A3")).alias("accepted"), F.col("answer").alias("given"), F.lit(False).alias("fold_case"))
    return reconcile.score_slots(s).groupBy("attempt_id").agg(F.count("*").alias("possible"), F.count(F.when(F.col("correct"), 1)).alias("earned"))


@query("js_set", "SELECT event_id, '{\"k\":\"' || event_type || '\",\"v\":' || event_id || '}' AS doc FROM events")
def js_set(spark: S, d: str) -> DataFrame:
    doc = F.from_json(F.to_json(F.struct(F.lit("old").alias("k"), F.col("event_id").alias("v"))), "k string, v long")
    return read(spark, d, "events").select("event_id", F.to_json(doc.withField("k", F.col("event_type"))).alias("doc"))


@query("js_type", "SELECT event_id, json_type(props) = 'OBJECT' AS is_object FROM events")
def js_type(spark: S, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT").alias("is_object"))


@query("js_normalised_equal", "SELECT event_id, CAST(json(props) AS VARCHAR) IS NOT DISTINCT FROM CAST(json(CASE WHEN event_id % 3 = 0 THEN replace(props, '1', '2') ELSE replace(props, ':', ' : ') END) AS VARCHAR) AS same FROM events")
def js_normalised_equal(spark: S, d: str) -> DataFrame:
    norm = lambda c: F.to_json(F.try_parse_json(c))
    other = F.when(F.col("event_id") % 3 == 0, F.replace("props", F.lit("1"), F.lit("2"))).otherwise(F.replace("props", F.lit(":"), F.lit(" : ")))
    return read(spark, d, "events").select("event_id", norm(F.col("props")).eqNullSafe(norm(other)).alias("same"))


@query("js_score_info", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.total') AS BIGINT), CAST(json_extract_string(props, '$.totalQuestions') AS BIGINT), 0) AS total FROM events")
def js_score_info(spark: S, d: str) -> DataFrame:
    n = lambda k: F.get_json_object("props", f"$.{k}").cast("long")
    return read(spark, d, "events").select("event_id", F.coalesce(n("total"), n("totalQuestions"), F.lit(0)).alias("total"))


@query("mut_override_create", BASE + """
SELECT attempt_id, question_id, CASE WHEN part % 8 = 0 THEN 'score out of bounds' WHEN part % 9 = 0 THEN 'stale version' ELSE 'ok' END AS outcome FROM answers WHERE discount > 0.05""")
def mut_override_create(spark: S, d: str) -> DataFrame:
    a = R.answers(spark, d).withColumn("review_version", F.lit(3))
    p = F.col("part")
    r = a.filter("discount > 0.05").select("attempt_id", "question_id", F.when(p % 8 == 0, F.col("weight") + 1).otherwise(F.col("weight")).alias("new_score"), F.when(p % 9 == 0, 2).otherwise(3).alias("version"))
    return review.create_overrides(a, r, ["attempt_id", "question_id"]).select("attempt_id", "question_id", "outcome")


@query("mut_set_counted", BASE + "SELECT attempt_id, CASE WHEN attempt_id % 23 = 0 THEN false ELSE counted END AS counted, CASE WHEN attempt_id % 23 = 0 THEN 'late' WHEN NOT counted THEN exclude_reason END AS exclude_reason FROM attempts")
def mut_set_counted(spark: S, d: str) -> DataFrame:
    a = R.attempts(spark, d)
    c = a.filter("attempt_id % 23 = 0").select("attempt_id", F.lit(False).alias("counted"), F.lit("late").alias("reason"))
    return review.set_counted(a, c).select("attempt_id", "counted", "exclude_reason")


@query("mut_grade_lifecycle", """
WITH g AS (SELECT user_id AS essay, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, ['draft', 'review', 'publish'][event_id % 3 + 1] AS action FROM events)
, s AS (SELECT *, CASE WHEN action = 'publish' AND lag(action) OVER (PARTITION BY essay ORDER BY version) <> 'review' THEN 'rejected' ELSE action END AS step FROM g)
SELECT essay, version, CASE step WHEN 'rejected' THEN 'rejected' WHEN 'publish' THEN CASE WHEN version = max(CASE WHEN step = 'publish' THEN version END) OVER (PARTITION BY essay) THEN 'published' ELSE 'superseded' END
  WHEN 'review' THEN 'reviewed' ELSE 'draft' END AS state FROM s""")
def mut_grade_lifecycle(spark: S, d: str) -> DataFrame:
    e = read(spark, d, "events")
    action = F.element_at(F.array(F.lit("draft"), F.lit("review"), F.lit("publish")), (F.col("event_id") % 3 + 1).cast("int"))
    g = e.select(F.col("user_id").alias("essay"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("version"), action.alias("action"))
    return review.grade_lifecycle(g).select("essay", "version", "state")


@query("mut_audit", BASE + "SELECT attempt_id, 'anna' AS operator FROM attempts WHERE attempt_id % 23 = 0 AND (counted OR exclude_reason <> 'late')")
def mut_audit(spark: S, d: str) -> DataFrame:
    return review.audit(R.attempts(spark, d), mut_set_counted(spark, d), "attempt_id", ["counted", "exclude_reason"], "anna").select("attempt_id", "operator")


@query("mut_patch_retention", "SELECT user_id, max(event_id) AS keep FROM events WHERE event_type <> 'view' GROUP BY 1")
def mut_patch_retention(spark: S, d: str) -> DataFrame:
    return read(spark, d, "events").filter("event_type <> 'view'").groupBy("user_id").agg(F.max("event_id").alias("keep"))


@query("rec_assets", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)")
def rec_assets(spark: S, d: str) -> DataFrame:
    have = read(spark, d, "part").filter("p_size > 3").select(F.col("p_partkey").alias("l_partkey"))
    return reconcile.missing_assets(read(spark, d, "lineitem").select("l_orderkey", "l_partkey"), have, "l_partkey")


@query("rec_slot_coverage", BASE + MERGE + "SELECT CASE WHEN b.id IS NULL THEN 'left only' WHEN a.id IS NULL THEN 'right only' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON b.id = a.id GROUP BY 1")
def rec_slot_coverage(spark: S, d: str) -> DataFrame:
    a, b, *_ = _merge_sources(spark, d)
    return reconcile.slot_coverage(a, b, ["id"]).groupBy("side").agg(F.count("*").alias("n"))


@query("stm_late", BASE + "SELECT attempt_id, max(updated_at) AS updated_at FROM beacons GROUP BY 1")
def stm_late(spark: S, d: str) -> DataFrame:
    b = R.beacons(spark, d)
    old = b.filter("file % 2 = 0").groupBy("attempt_id").agg(F.max("updated_at").alias("updated_at"))
    new = b.filter("file % 2 = 1").groupBy("attempt_id").agg(F.max("updated_at").alias("updated_at"))
    return library.upsert(old, new, ["attempt_id"], newer="updated_at")


@query("agg_usage_by_command", "SELECT role, count(*) AS calls, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def agg_usage_by_command(spark: S, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("calls"), F.sum(F.length("text")).alias("chars"))


@query("seg_answer_assign", """
WITH s AS (SELECT s_nationkey AS k, s_suppkey AS segment, s_suppkey AS low, s_suppkey * 12 AS high FROM supplier), n AS (SELECT DISTINCT c_nationkey AS k, c_custkey AS number FROM customer)
, p AS (SELECT n.k, n.number, min(segment) AS segment FROM n LEFT JOIN s ON s.k = n.k AND n.number BETWEEN low AND high GROUP BY 1, 2)
SELECT k AS key, number, CASE WHEN count(segment) OVER (PARTITION BY k) >= 0.8 * count(*) OVER (PARTITION BY k) THEN segment END AS segment FROM p""")
def seg_answer_assign(spark: S, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), k.alias("segment"), k.alias("low"), (k * 12).alias("high"))
    n = read(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("number")).distinct()
    return library.assign_answers(n, s, "key")


@query("str_role", """
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\b(choose|complete|write|answer) (the|no more|one|your)\\b') THEN 'instruction' WHEN regexp_matches(text, '^\\s*\\d{1,2}[.)]\\s') THEN 'question'
  WHEN regexp_matches(text, '^\\s*[A-H][.)]\\s') THEN 'option' WHEN regexp_matches(text, '^[^a-z.!?]{3,60}$') THEN 'heading' ELSE 'text' END AS role FROM conversations""")
def str_role(spark: S, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", text.block_role(F.col("text")).alias("role"))
