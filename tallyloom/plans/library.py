"""Catalogue, merge, text, reshape and usage queries, each with its statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom import roles as R
from tallyloom.functions import similarity, text
from tallyloom.operators import library, usage
from tallyloom.plans.registry import query
from tallyloom.roles import ROLES

S = SparkSession
BASE = f"WITH {ROLES}"
read = R.read
MONTH = {"R": "returned"}


@query("flt_like_ci", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a_t%' OR lower(p_type) LIKE '%a_t%' ORDER BY p_partkey LIMIT 200")
def flt_like_ci(spark: S, d: str) -> DataFrame:
    return library.search(read(spark, d, "part"), "A_t", ["p_name", "p_type"], 200, ["p_partkey"]).select("p_partkey", "p_name")


@query("flt_contains_ci", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ar') OR contains(lower(p_brand), 'ar')")
def flt_contains_ci(spark: S, d: str) -> DataFrame:
    return library.contains(read(spark, d, "part"), "AR", ["p_name", "p_brand"]).select("p_partkey")


@query("flt_status", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def flt_status(spark: S, d: str) -> DataFrame:
    return read(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey")


@query("flt_nullsafe_eq", BASE + "SELECT a.attempt_id, a.question_id FROM answers a JOIN answers b ON a.attempt_id = b.attempt_id AND a.question_id < b.question_id AND a.is_correct IS NOT DISTINCT FROM b.is_correct AND a.kind IS DISTINCT FROM b.kind")
def flt_nullsafe_eq(spark: S, d: str) -> DataFrame:
    a = R.answers(spark, d).select("attempt_id", "question_id", "is_correct", "kind")
    x, y = a.alias("a"), a.alias("b")
    on = (F.col("a.attempt_id") == F.col("b.attempt_id")) & (F.col("a.question_id") < F.col("b.question_id")) & F.col("a.is_correct").eqNullSafe(F.col("b.is_correct")) & ~F.col("a.kind").eqNullSafe(F.col("b.kind"))
    return x.join(y, on).select("a.attempt_id", "a.question_id")


@query("flt_optional_param", "SELECT o_orderkey FROM orders WHERE (NULL IS NULL OR o_orderstatus = NULL) AND ('1-URGENT' IS NULL OR o_orderpriority = '1-URGENT')")
def flt_optional_param(spark: S, d: str) -> DataFrame:
    return read(spark, d, "orders").filter(library.optional("o_orderstatus", None) & library.optional("o_orderpriority", "1-URGENT")).select("o_orderkey")


@query("flt_tab", "SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'trash' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'processing' WHEN o_orderkey % 3 = 0 THEN 'action' ELSE 'ready' END AS tab FROM orders")
def flt_tab(spark: S, d: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    tab = F.when(k % 19 == 0, "trash").when(s == "P", "failed").when(s == "O", "processing").when(k % 3 == 0, "action").otherwise("ready")
    return read(spark, d, "orders").select("o_orderkey", tab.alias("tab"))


@query("agg_queue_groups", "SELECT count(*) FILTER (o_orderstatus = 'O') AS working, count(*) FILTER (o_orderstatus = 'F') AS review, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS badge FROM orders")
def agg_queue_groups(spark: S, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    n = lambda c, a: F.count(F.when(c, 1)).alias(a)
    return read(spark, d, "orders").agg(n(s == "O", "working"), n(s == "F", "review"), n(s == "P", "failed"), n(s.isin("O", "P"), "badge"))


@query("prj_case", "SELECT event_id, CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'seen' ELSE event_type END AS state, greatest(ts, TIMESTAMP '2024-01-02') AS latest FROM events")
def prj_case(spark: S, d: str) -> DataFrame:
    e = read(spark, d, "events")
    state = F.when(F.col("event_type") == "click", "open").when(F.col("event_type") == "view", "seen").otherwise(F.col("event_type"))
    return e.select("event_id", state.alias("state"), F.greatest("ts", F.lit("2024-01-02").cast(e.schema["ts"].dataType)).alias("latest"))


@query("prj_ratio", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_custkey / c_acctbal END AS ratio FROM customer")
def prj_ratio(spark: S, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_custkey") / F.col("c_acctbal")).alias("ratio"))


@query("prj_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS ok, length(trim(props)) > 0 AS filled FROM events")
def prj_json_path(spark: S, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("ok"), (F.length(F.trim("props")) > 0).alias("filled"))


@query("prj_is_null_flag", BASE + "SELECT t.attempt_id, s.total_passages IS NOT NULL AS has_suite FROM attempts t LEFT JOIN suites s ON s.attempt_id = t.attempt_id")
def prj_is_null_flag(spark: S, d: str) -> DataFrame:
    return R.attempts(spark, d).join(R.suites(spark, d), "attempt_id", "left").select("attempt_id", F.col("total_passages").isNotNull().alias("has_suite"))


@query("agg_facets", """
SELECT 'total' AS facet, '' AS value, count(*) AS n FROM documents
UNION ALL SELECT 'lang', coalesce(lang, '(none)'), count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, '(none)'), count(*) FROM documents GROUP BY 2""")
def agg_facets(spark: S, d: str) -> DataFrame:
    return library.facets(read(spark, d, "documents").select("lang", "source"), ["lang", "source"])


@query("lim_clamped", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000 OFFSET 20")
def lim_clamped(spark: S, d: str) -> DataFrame:
    return library.page(read(spark, d, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 5000, 20).select("o_orderkey")


@query("lim_audit", "SELECT event_id, (SELECT count(*) FROM events) AS total FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 5)")
def lim_audit(spark: S, d: str) -> DataFrame:
    e = read(spark, d, "events")
    total = e.agg(F.count("*").alias("total"))  # one row
    return library.page(e, [F.desc("ts"), F.desc("event_id")], None, 5, 500, 100).select("event_id").crossJoin(total)


@query("lim_latest", "SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY 1")
def lim_latest(spark: S, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("srt_queue", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def srt_queue(spark: S, d: str) -> DataFrame:
    return read(spark, d, "orders").filter("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("srt_group_rank", "SELECT p_partkey, p_name, CASE p_size % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 9 END AS group_rank FROM part ORDER BY group_rank, p_name, p_partkey")
def srt_group_rank(spark: S, d: str) -> DataFrame:
    m = (F.col("p_size") % 4).cast("int")
    ranked = read(spark, d, "part").select("p_partkey", "p_name", F.when(m == 0, 9).otherwise(m).alias("group_rank"))
    return ranked.orderBy("group_rank", "p_name", "p_partkey")


@query("srt_natural", "SELECT p_partkey, 'Track ' || p_partkey || '.mp3' AS name FROM part ORDER BY p_partkey")
def srt_natural(spark: S, d: str) -> DataFrame:
    name = F.concat(F.lit("Track "), F.col("p_partkey").cast("string"), F.lit(".mp3"))
    return read(spark, d, "part").select("p_partkey", name.alias("name")).orderBy(text.natural_key(F.col("name")))


@query("agg_count_group", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_count_group(spark: S, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("agg_max_scalar", "SELECT max(o_orderdate) AS newest, coalesce(max(o_orderkey), 0) AS last_key, coalesce(sum(length(o_orderpriority)), 0)::BIGINT AS chars FROM orders")
def agg_max_scalar(spark: S, d: str) -> DataFrame:
    return read(spark, d, "orders").agg(F.max("o_orderdate").alias("newest"), F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("last_key"), F.coalesce(F.sum(F.length("o_orderpriority")), F.lit(0)).alias("chars"))


@query("agg_group_max_order", "SELECT user_id, max(event_id) AS last FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 20")
def agg_group_max_order(spark: S, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("last")).orderBy(F.desc("last")).limit(20)


@query("agg_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_count_distinct(spark: S, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("agg_json_array", "SELECT user_id, to_json(list_sort(list(DISTINCT event_type)))::VARCHAR AS types FROM events GROUP BY 1")
def agg_json_array(spark: S, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_set("event_type"))).alias("types"))


@query("jn_indirect_key", "SELECT l.l_orderkey, count(*) AS n FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING' GROUP BY 1")
def jn_indirect_key(spark: S, d: str) -> DataFrame:
    c = read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    o = read(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("o_orderkey")
    return read(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(F.count("*").alias("n"))


MERGE = """
, a AS (SELECT o_orderkey AS id, o_orderpriority AS title FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS id, 'b' || o_orderstatus AS title FROM orders WHERE o_orderkey % 3 = 0)
, c AS (SELECT o_orderkey AS id, 'c' AS title FROM orders WHERE o_orderkey % 5 = 0), t AS (SELECT o_orderkey AS id, 'trash' AS title FROM orders WHERE o_orderkey % 7 = 0)
"""


def _merge_sources(spark: S, d: str) -> list[DataFrame]:
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    parts = ((2, F.col("o_orderpriority")), (3, F.concat(F.lit("b"), "o_orderstatus")), (5, F.lit("c")), (7, F.lit("trash")))
    return [o.filter(k % m == 0).select(k.alias("id"), title.alias("title")) for m, title in parts]


@query("jn_full_merge", BASE + MERGE + """
SELECT coalesce(a.id, b.id, c.id) AS id, coalesce(a.title, b.title, c.title) AS title, false AS trashed FROM a FULL JOIN b ON b.id = a.id FULL JOIN c ON c.id = coalesce(a.id, b.id)
WHERE coalesce(a.id, b.id, c.id) NOT IN (SELECT id FROM t) UNION ALL SELECT id, title, true FROM t""")
def jn_full_merge(spark: S, d: str) -> DataFrame:
    *live, trash = _merge_sources(spark, d)
    return library.full_merge(live, "id", ["title"], trash)


@query("jn_full_slots", BASE + MERGE + "SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'left only' WHEN a.id IS NULL THEN 'right only' ELSE 'both' END AS side FROM a FULL JOIN b ON b.id = a.id")
def jn_full_slots(spark: S, d: str) -> DataFrame:
    a, b, *_ = _merge_sources(spark, d)
    return library.both_sides(a, b, ["id"])


@query("set_union_distinct", BASE + MERGE + "SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM c")
def set_union_distinct(spark: S, d: str) -> DataFrame:
    a, b, c, _ = (x.select("id") for x in _merge_sources(spark, d))
    return a.union(b).union(c).distinct()


@query("set_difference", BASE + MERGE + "SELECT id FROM a EXCEPT SELECT id FROM t")
def set_difference(spark: S, d: str) -> DataFrame:
    a, _, _, t = (x.select("id") for x in _merge_sources(spark, d))
    return a.subtract(t)


@query("set_concat", BASE + MERGE + "SELECT id, title FROM a UNION ALL SELECT id, title FROM b")
def set_concat(spark: S, d: str) -> DataFrame:
    a, b, *_ = _merge_sources(spark, d)
    return a.unionByName(b)


@query("set_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def set_distinct(spark: S, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("set_coverage", BASE + """
, s AS (SELECT attempt_id, list_sort(list(DISTINCT CAST(substr(question_id, 2) AS INTEGER))) AS have FROM answers GROUP BY 1)
SELECT attempt_id, CASE WHEN len(want) = 0 THEN 'undetermined' WHEN have = want THEN 'complete' ELSE 'missing' END AS status
FROM (SELECT *, CASE WHEN attempt_id % 6 = 0 THEN [] ELSE range(1, CAST(attempt_id % 6 AS BIGINT) + 1) END AS want FROM s)""")
def set_coverage(spark: S, d: str) -> DataFrame:
    have = R.answers(spark, d).groupBy("attempt_id").agg(F.collect_set(F.substring("question_id", 2, 9).cast("int")).alias("have"))
    n = (F.col("attempt_id") % 6).cast("int")
    want = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    return have.select("attempt_id", library.set_coverage(want, F.col("have")).alias("status"))


@query("snk_upsert", BASE + MERGE + "SELECT coalesce(a.id, b.id) AS id, coalesce(b.title, a.title) AS title FROM a FULL JOIN b ON b.id = a.id")
def snk_upsert(spark: S, d: str) -> DataFrame:
    a, b, *_ = _merge_sources(spark, d)
    return library.upsert(a, b, ["id"])


@query("snk_ignore", BASE + MERGE + "SELECT id, title FROM a UNION ALL SELECT id, title FROM b WHERE id NOT IN (SELECT id FROM a)")
def snk_ignore(spark: S, d: str) -> DataFrame:
    a, b, *_ = _merge_sources(spark, d)
    return library.insert_ignore(a, b, ["id"])


@query("snk_replace_children", BASE + "SELECT attempt_id, question_id, answer FROM answers WHERE attempt_id % 4 <> 0 UNION ALL SELECT attempt_id, 'new', 'N' FROM attempts WHERE attempt_id % 4 = 0")
def snk_replace_children(spark: S, d: str) -> DataFrame:
    new = R.attempts(spark, d).filter("attempt_id % 4 = 0").select("attempt_id", F.lit("new").alias("question_id"), F.lit("N").alias("answer"))
    return library.replace_children(R.answers(spark, d).select("attempt_id", "question_id", "answer"), new, "attempt_id")


@query("mut_immutable_check", BASE + "SELECT attempt_id, question_id FROM answers WHERE part % 37 = 0 OR (part % 10 = 0 AND score IS NOT NULL)")
def mut_immutable_check(spark: S, d: str) -> DataFrame:
    a = R.answers(spark, d)
    new = a.withColumn("answer", F.when(F.col("part") % 37 == 0, "changed").otherwise(F.col("answer"))).withColumn("score", F.when(F.col("part") % 10 == 0, F.coalesce("score", F.lit(0.0)) + 1).otherwise(F.col("score")))
    return library.immutable_violations(a, new, ["attempt_id", "question_id"], ["answer"], ["score"]).select("attempt_id", "question_id")


@query("mut_revision", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision_no, event_id = last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current FROM events")
def mut_revision(spark: S, d: str) -> DataFrame:
    return library.revisions(read(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "revision_no", "current")


@query("mut_paper_supersede", "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'published' ELSE 'superseded' END AS state FROM orders")
def mut_paper_supersede(spark: S, d: str) -> DataFrame:
    return library.supersede(read(spark, d, "orders"), ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey", "state")


@query("mut_part_exclusive", "SELECT o_custkey, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def mut_part_exclusive(spark: S, d: str) -> DataFrame:
    return library.exclusive(read(spark, d, "orders"), ["o_custkey", "o_orderpriority"])


@query("mut_soft_delete", "SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN o_orderdate END AS deleted_at FROM orders WHERE o_orderkey % 38 <> 0")
def mut_soft_delete(spark: S, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").filter(k % 38 != 0).select("o_orderkey", F.when(k % 19 == 0, F.col("o_orderdate")).alias("deleted_at"))


@query("mut_decision_merge", BASE + """
, x AS (SELECT user_id AS decision_id, event_id AS seq, ['info', 'warning', 'blocking'][event_id % 3 + 1] AS severity, ['open', 'auto', 'teacher'][event_id % 5 % 3 + 1] AS resolution,
        CASE WHEN event_id % 4 = 0 THEN 'L' || event_id END AS local_value, CASE WHEN event_id % 6 = 0 THEN 'C' || event_id END AS cloud_value, event_type AS evidence FROM events)
SELECT decision_id, ['info', 'warning', 'blocking'][max(list_position(['info', 'warning', 'blocking'], severity))] AS severity, ['open', 'auto', 'teacher'][max(list_position(['open', 'auto', 'teacher'], resolution))] AS resolution,
  arg_min(local_value, seq) AS local_value, arg_min(cloud_value, seq) AS cloud_value, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence FROM x GROUP BY 1""")
def mut_decision_merge(spark: S, d: str) -> DataFrame:
    e = read(spark, d, "events")
    k = F.col("event_id")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    sev, res = ["info", "warning", "blocking"], ["open", "auto", "teacher"]
    x = e.select(F.col("user_id").alias("decision_id"), k.alias("seq"), pick(sev, k % 3).alias("severity"), pick(res, k % 5 % 3).alias("resolution"), F.when(k % 4 == 0, F.concat(F.lit("L"), k.cast("string"))).alias("local_value"), F.when(k % 6 == 0, F.concat(F.lit("C"), k.cast("string"))).alias("cloud_value"), F.col("event_type").alias("evidence"))
    return library.decision_merge(x, sev, res)


@query("win_contiguous_runs", "SELECT p_size, min(p_partkey) AS first, max(p_partkey) AS last FROM (SELECT p_size, p_partkey, p_partkey - row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS g FROM part) GROUP BY p_size, g")
def win_contiguous_runs(spark: S, d: str) -> DataFrame:
    return library.islands(read(spark, d, "part"), "p_size", "p_partkey")


@query("win_page_ranges", """
SELECT attempt_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, '、' ORDER BY a) AS ranges
FROM (SELECT attempt_id, min(n) AS a, max(n) AS b FROM (SELECT attempt_id, n, n - row_number() OVER (PARTITION BY attempt_id ORDER BY n) AS g FROM (SELECT DISTINCT l_orderkey AS attempt_id, l_linenumber AS n FROM lineitem)) GROUP BY attempt_id, g) GROUP BY 1""")
def win_page_ranges(spark: S, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.col("l_linenumber").alias("n"))
    return library.page_ranges(l, "attempt_id", "n")


@query("win_lag_gap", "SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS island FROM (SELECT *, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 100 THEN 1 ELSE 0 END AS new FROM events)")
def win_lag_gap(spark: S, d: str) -> DataFrame:
    return library.gap_islands(read(spark, d, "events"), "user_id", "event_id", 100).select("event_id", "island")


@query("win_adjacent_pairs", "SELECT user_id, count(*) FILTER (n + 10 < value) AS regressions FROM (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) GROUP BY 1")
def win_adjacent_pairs(spark: S, d: str) -> DataFrame:
    n = F.lead("value").over(W.partitionBy("user_id").orderBy("event_id"))
    return read(spark, d, "events").withColumn("n", n).groupBy("user_id").agg(F.count(F.when(F.col("n") + 10 < F.col("value"), 1)).alias("regressions"))


@query("win_session_band", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS band FROM events")
def win_session_band(spark: S, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return library.carry_forward(e, "user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")), "band").select("event_id", "band")


@query("win_lcp_prev", None)
def win_lcp_prev(spark: S, d: str) -> DataFrame:
    c = usage.previous(read(spark, d, "conversations"), "conv_id", "turn", "text", "before")
    return c.select("conv_id", "turn", similarity.lcp_udf("text", "before").alias("lcp"))


@query("agg_multiset_symdiff", """
, x AS (SELECT 1)""".replace(", x AS (SELECT 1)", "") + """
WITH t AS (SELECT conv_id, role, lower(unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))) AS w FROM conversations WHERE role IN ('user', 'assistant'))
, c AS (SELECT conv_id, w, count(*) FILTER (role = 'user') AS a, count(*) FILTER (role = 'assistant') AS b FROM t GROUP BY 1, 2)
SELECT conv_id, sum(least(a, b))::BIGINT AS common, sum(greatest(b - a, 0))::BIGINT AS added, sum(greatest(a - b, 0))::BIGINT AS removed, sum(abs(a - b))::BIGINT AS symdiff FROM c GROUP BY 1""")
def agg_multiset_symdiff(spark: S, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", "role", F.explode(text.tokens(F.lower("text"))).alias("w"))
    return library.multiset_common(c.filter("role = 'user'"), c.filter("role = 'assistant'"), ["conv_id"], "w")


@query("jn_theta_contains", """
WITH s AS (SELECT s_nationkey AS k, s_suppkey AS segment, s_suppkey AS low, s_suppkey + 400 AS high FROM supplier), n AS (SELECT DISTINCT c_nationkey AS k, c_custkey AS number FROM customer)
SELECT n.k AS key, n.number, min(segment) AS segment FROM n LEFT JOIN s ON s.k = n.k AND n.number BETWEEN low AND high GROUP BY 1, 2""")
def jn_theta_contains(spark: S, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), k.alias("segment"), k.alias("low"), (k + 400).alias("high"))
    n = read(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("number")).distinct()
    return library.range_assign(n, s, "key")


@query("exp_json_each", "SELECT event_id, unnest([event_type, json_extract_string(props, '$.k')]) AS item FROM events")
def exp_json_each(spark: S, d: str) -> DataFrame:
    doc = F.to_json(F.array("event_type", F.get_json_object("props", "$.k")))
    return read(spark, d, "events").select("event_id", F.explode(F.from_json(doc, "array<string>")).alias("item"))


@query("exp_range", "SELECT o_orderkey, unnest(list_sort(list_distinct(list_concat(range(o_orderkey % 5, o_orderkey % 5 + 3), [o_orderkey % 7, 9::BIGINT])))) AS number FROM orders")
def exp_range(spark: S, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    numbers = F.array_sort(F.array_distinct(F.flatten(F.array(F.sequence(k % 5, k % 5 + 2), F.array(k % 7, F.lit(9).cast("long"))))))
    return read(spark, d, "orders").select("o_orderkey", F.explode(numbers).alias("number"))


@query("str_squeeze_lower", "SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS h FROM documents")
def str_squeeze_lower(spark: S, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(text.squeeze_lower(F.col("text"))).alias("h"))


@query("str_alnum_key", "SELECT doc_id, md5(lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))) AS h FROM documents")
def str_alnum_key(spark: S, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(text.alnum_key(F.col("text"))).alias("h"))


@query("str_loose", "SELECT doc_id, md5(replace(regexp_replace(text, '\\s+', '', 'g'), '-', '')) AS h FROM documents")
def str_loose(spark: S, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(text.loose(F.col("text"))).alias("h"))


@query("str_tokens", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))::INTEGER AS n FROM documents")
def str_tokens(spark: S, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n"))


@query("str_html_strip", "SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS h FROM pages")
def str_html_strip(spark: S, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.md5(text.html_strip(F.col("html"))).alias("h"))


@query("str_levenshtein_ratio", "SELECT a.c_custkey, CASE WHEN greatest(length(a.c_name), length(b.c_name)) = 0 THEN 1.0 ELSE 1 - levenshtein(a.c_name, b.c_name)::DOUBLE / greatest(length(a.c_name), length(b.c_name)) END AS ratio FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1")
def str_levenshtein_ratio(spark: S, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    n = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("next"))
    return c.join(n, "c_custkey").select("c_custkey", text.levenshtein_ratio(F.col("c_name"), F.col("next")).alias("ratio"))


@query("str_sentences", """
SELECT doc_id, greatest(len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '')), 1) AS n FROM documents""")
def str_sentences(spark: S, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n"))


@query("str_find_all", "SELECT doc_id, instr(text, 'the') AS first, (length(text) - length(replace(text, 'the', ''))) // 3 >= 2 AS twice FROM documents")
def str_find_all(spark: S, d: str) -> DataFrame:
    t = F.col("text")
    first = F.instr(t, "the")
    again = F.instr(t.substr(first + 3, F.length(t)), "the")
    return read(spark, d, "documents").select("doc_id", first.cast("long").alias("first"), ((first > 0) & (again > 0)).alias("twice"))


@query("str_truncate", "SELECT doc_id, left(text, 160) AS t FROM documents")
def str_truncate(spark: S, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.substring("text", 1, 160).alias("t"))


@query("str_id_valid", "SELECT page_id, regexp_matches(replace(url, '/', '_'), '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') AND NOT contains(url, '..') AS ok FROM pages")
def str_id_valid(spark: S, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.safe_id(F.replace(F.col("url"), F.lit("/"), F.lit("_"))).alias("ok"))


@query("str_task_label", BASE + "SELECT attempt_id, question_id, CASE kind WHEN 'matching' THEN 'Matching headings' ELSE kind END AS label FROM answers")
def str_task_label(spark: S, d: str) -> DataFrame:
    return R.answers(spark, d).select("attempt_id", "question_id", text.task_label(F.col("kind"), {"matching": "Matching headings"}).alias("label"))


@query("dt_is_newer", BASE + "SELECT attempt_id, CAST(replace(submitted_at, 'Z', '') AS TIMESTAMP) > TIMESTAMP '1998-06-01' AS newer FROM attempts")
def dt_is_newer(spark: S, d: str) -> DataFrame:
    a, b = F.col("submitted_at"), F.lit("1998-06-01T00:00:00+00:00")
    x, y = F.try_to_timestamp(a), F.try_to_timestamp(b)
    return R.attempts(spark, d).select("attempt_id", F.when(x.isNotNull() & y.isNotNull(), x > y).otherwise(a > b).alias("newer"))


@query("dt_string_max", BASE + "SELECT batch_id, max(submitted_at) AS last FROM attempts GROUP BY 1")
def dt_string_max(spark: S, d: str) -> DataFrame:
    return R.attempts(spark, d).groupBy("batch_id").agg(F.max("submitted_at").alias("last"))


@query("num_half_step", "SELECT l_orderkey, l_linenumber, l_quantity, l_quantity BETWEEN 0 AND 9 AND l_quantity * 2 % 1 = 0 AS ok FROM lineitem")
def num_half_step(spark: S, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (q.between(0, 9) & (F.pmod(q * 2, F.lit(1.0)) == 0)).alias("ok"))


@query("num_mean4", "SELECT l_orderkey, l_linenumber, (l_quantity + l_discount + l_tax + l_suppkey) / 4 AS band FROM lineitem")
def num_mean4(spark: S, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") + F.col("l_discount") + F.col("l_tax") + F.col("l_suppkey")) / 4).alias("band"))


@query("num_band", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 1 AND 13 THEN 1 WHEN l_quantity BETWEEN 14 AND 26 THEN 2 WHEN l_quantity BETWEEN 27 AND 40 THEN 3 END AS part FROM lineitem")
def num_band(spark: S, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(q.between(1, 13), 1).when(q.between(14, 26), 2).when(q.between(27, 40), 3).alias("part"))


@query("num_readiness", "SELECT l_orderkey, l_linenumber, CASE WHEN 1 - l_discount < 0.92 THEN 'blocked' WHEN 1 - l_discount < 0.95 OR 1 - l_tax < 0.995 THEN 'review' ELSE 'ready' END AS state FROM lineitem")
def num_readiness(spark: S, d: str) -> DataFrame:
    a, b = 1 - F.col("l_discount"), 1 - F.col("l_tax")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(a < 0.92, "blocked").when((a < 0.95) | (b < 0.995), "review").otherwise("ready").alias("state"))


@query("num_token_estimate", "SELECT conv_id, turn, CAST(ceil((3 * (length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) + 6 * length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / 10.0) AS BIGINT) AS tokens FROM conversations")
def num_token_estimate(spark: S, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("hash_sha256", "SELECT c_custkey, sha256('{\"balance\":' || CAST(floor(c_acctbal) AS BIGINT) || ',\"name\":\"' || c_name || '\"}') AS h FROM customer")
def hash_sha256(spark: S, d: str) -> DataFrame:
    doc = F.to_json(F.struct(F.floor("c_acctbal").alias("balance"), F.col("c_name").alias("name")))
    return read(spark, d, "customer").select("c_custkey", F.sha2(doc, 256).alias("h"))


@query("evl_metrics", """
SELECT count(*) FILTER (quality = 1 AND p) AS tp, count(*) FILTER (quality <> 1 AND p) AS fp, count(*) FILTER (quality = 1 AND NOT p) AS fn, count(*) FILTER (quality <> 1 AND NOT p) AS tn,
  round(count(*) FILTER (quality = 1 AND p) / count(*) FILTER (quality = 1), 6) AS recall, round(count(*) FILTER (quality = 1 AND p) / count(*) FILTER (p), 6) AS precision,
  round(2 * count(*) FILTER (quality = 1 AND p) / (count(*) FILTER (quality = 1) + count(*) FILTER (p)), 6) AS f1, round(count(*) FILTER ((quality = 1) = p) / count(*), 6) AS accuracy
FROM (SELECT quality, n_chars > 500 AS p FROM labels JOIN documents USING (doc_id))""")
def evl_metrics(spark: S, d: str) -> DataFrame:
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return usage.flag_metrics(j.withColumn("p", (F.col("n_chars") > 500).cast("int")), "quality", "p")


@query("evl_order_accuracy", BASE + """
SELECT a.attempt_id, count(*) AS pairs, round(avg(CASE WHEN a.elapsed < b.elapsed THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM answers a JOIN answers b ON a.attempt_id = b.attempt_id AND a.question_id < b.question_id GROUP BY 1""")
def evl_order_accuracy(spark: S, d: str) -> DataFrame:
    return usage.order_accuracy(R.answers(spark, d).select("attempt_id", "question_id", "elapsed"), "attempt_id", "question_id", "elapsed")


@query("evl_acceptance", """
SELECT metric, count(*) AS samples, round(sum(v) / sum(c), 6) AS rate, CASE WHEN count(*) < 5 THEN 'insufficient_evidence' ELSE 'measured' END AS status
FROM (SELECT p_brand AS metric, p_size % 3 AS v, p_size AS c FROM part) GROUP BY 1""")
def evl_acceptance(spark: S, d: str) -> DataFrame:
    return usage.acceptance(read(spark, d, "part").select(F.col("p_brand").alias("metric"), (F.col("p_size") % 3).alias("violations"), F.col("p_size").alias("checked")))


CALLS = "WITH c AS (SELECT conv_id, turn, length(text) AS prompt, CASE WHEN turn % 3 <> 0 THEN length(text) // 2 END AS hit, length(text) - length(text) // 2 AS miss, turn * 10 AS output FROM conversations) "


def _calls(spark: S, d: str) -> DataFrame:
    n = F.length("text").cast("long")
    half = F.floor(n / 2)
    return read(spark, d, "conversations").select("conv_id", "turn", n.alias("prompt"), F.when(F.col("turn") % 3 != 0, half).alias("hit"), (n - half).alias("miss"), (F.col("turn") * 10).alias("output"))


@query("agg_usage_totals", CALLS + "SELECT sum(prompt)::BIGINT AS prompt, count(prompt) AS prompt_known, sum(hit)::BIGINT AS hit, count(hit) AS hit_known FROM c")
def agg_usage_totals(spark: S, d: str) -> DataFrame:
    return usage.usage_totals(_calls(spark, d), ["prompt", "hit"])


@query("agg_cost", CALLS + "SELECT conv_id, turn, round((coalesce(hit, 0) * 0.5::DOUBLE + miss * 2.0::DOUBLE + output * 8.0::DOUBLE) / 1e6, 9) AS cost FROM c")
def agg_cost(spark: S, d: str) -> DataFrame:
    return usage.cost(_calls(spark, d), 0.5, 2.0, 8.0).select("conv_id", "turn", "cost")


@query("js_valid", "SELECT event_id, json_valid(CASE WHEN event_id % 7 = 0 THEN '{bad' ELSE props END) AS ok FROM events")
def js_valid(spark: S, d: str) -> DataFrame:
    doc = F.when(F.col("event_id") % 7 == 0, "{bad").otherwise(F.col("props"))
    return read(spark, d, "events").select("event_id", F.try_parse_json(doc).isNotNull().alias("ok"))
