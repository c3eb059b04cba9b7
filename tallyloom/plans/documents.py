"""Document, layout, event and reconciliation queries. Those that SQL can't
express are tested against plain Python and return rows only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom import roles as R
from tallyloom.functions import documents, similarity, text
from tallyloom.operators import events, json_diff, layout, reconcile
from tallyloom.plans.registry import query
from tallyloom.sources import files

S = SparkSession
read = R.read


@query("win_event_intervals", """
WITH e AS (SELECT user_id AS attempt_id, event_id AS seq, event_id % 2 = 0 AS opens, event_id % 3 AS passage_index, event_id::DOUBLE AS clock, event_id // 5000 AS clock_id FROM events)
, b AS (SELECT *, lag(opens) OVER w AS before, lag(clock) OVER w AS began, lag(clock_id) OVER w AS began_id, lead(seq) OVER w IS NULL AS last FROM e WINDOW w AS (PARTITION BY attempt_id, passage_index ORDER BY seq))
, p AS (SELECT *, NOT opens AND coalesce(before, false) AND began_id = clock_id AND clock >= began AS pair FROM b)
, j AS (SELECT *, bool_or(CASE WHEN opens THEN coalesce(before, false) OR last ELSE NOT pair END) OVER (PARTITION BY attempt_id) AS wrong FROM p)
SELECT attempt_id, CAST(passage_index AS INTEGER) AS passage_index, clock - began AS seconds, NOT wrong AS complete FROM j WHERE pair""")
def win_event_intervals(spark: S, d: str) -> DataFrame:
    e = read(spark, d, "events")
    kind = F.element_at(F.array(F.lit("enter"), F.lit("leave"), F.lit("focus"), F.lit("blur")), (F.col("event_id") % 4 + 1).cast("int"))
    clock = F.concat(F.lit("c"), F.floor(F.col("event_id") / 5000).cast("string"))
    return events.intervals(e.select(F.col("user_id").alias("attempt_id"), F.col("event_id").alias("seq"), kind.alias("event_type"), (F.col("event_id") % 3).cast("int").alias("passage_index"), F.col("event_id").cast("double").alias("clock"), clock.alias("clock_id")))


@query("str_bigram_dice", """
WITH c AS (SELECT a.c_custkey, a.c_name AS a, b.c_name AS b FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1)
, x AS (SELECT c_custkey, g, count(*) AS n FROM (SELECT c_custkey, unnest(list_transform(range(1, length(a)), lambda i: substring(a, i, 2))) AS g FROM c) GROUP BY 1, 2), y AS (SELECT c_custkey, g, count(*) AS n FROM (SELECT c_custkey, unnest(list_transform(range(1, length(b)), lambda i: substring(b, i, 2))) AS g FROM c) GROUP BY 1, 2)
, s AS (SELECT x.c_custkey, sum(least(x.n, y.n)) AS n FROM x JOIN y ON y.c_custkey = x.c_custkey AND y.g = x.g GROUP BY 1)
SELECT c.c_custkey, round(2 * coalesce(s.n, 0) / (length(a) + length(b) - 2), 6) AS dice FROM c LEFT JOIN s ON s.c_custkey = c.c_custkey""")
def str_bigram_dice(spark: S, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    n = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("next"))
    return c.join(n, "c_custkey").select("c_custkey", F.round(similarity.dice_udf("c_name", "next"), 6).alias("dice"))


@query("win_lis")
def win_lis(spark: S, d: str) -> DataFrame:
    v = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.floor("value").cast("int").alias("v")))), lambda x: x["v"])
    return read(spark, d, "events").groupBy("user_id").agg(v.alias("v")).select("user_id", F.round(similarity.lis_share_udf("v"), 6).alias("share"))


@query("str_match_sentence")
def str_match_sentence(spark: S, d: str) -> DataFrame:
    """How each benchmark sentence stands in the text of the next item."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        parts = [p for p in r["text"].replace("\n", " ").split(". ") if p]
        return pd.DataFrame([{"item_id": r["item_id"], "n": k, "how": how, "place": at} for k, (how, at) in enumerate(similarity.match_sentences(parts, r["source"].replace("\n", " ")))])

    b = read(spark, d, "benchmark")
    own = b.withColumn("source", F.concat(F.lit("Start. "), "text"))
    return own.groupBy("item_id").applyInPandas(run, "item_id long, n int, how string, place int")


@query("str_answer_rows", """
WITH t AS (SELECT doc_id, '1. ' || left(text, 30) || chr(10) || '2) TRUE' || chr(10) || '2. FALSE' || chr(10) || text AS t FROM documents)
, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM t)
, r AS (SELECT doc_id, i, TRY_CAST(regexp_extract(l, '^\\s*(\\d{1,3})[.)\\]:-]*\\s*(.+)$', 1) AS INTEGER) AS number, trim(regexp_extract(l, '^\\s*(\\d{1,3})[.)\\]:-]*\\s*(.+)$', 2)) AS answer FROM l)
SELECT doc_id, number, arg_min(answer, i) AS answer FROM r WHERE number BETWEEN 1 AND 200 AND length(answer) <= 40 AND answer <> '' AND len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda x: x <> '')) <= 6 AND NOT regexp_matches(answer, '(?i)https?://|www\\.') GROUP BY 1, 2""")
def str_answer_rows(spark: S, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", F.concat(F.lit("1. "), F.substring("text", 1, 30), F.lit("\n2) TRUE\n2. FALSE\n"), "text").alias("t"))
    return t.select("doc_id", F.explode(text.answer_rows(F.col("t"))).alias("r")).select("doc_id", "r.number", "r.answer")


@query("str_digit_tokens", "SELECT page_id, array_to_string(list_filter(regexp_extract_all(html, '\\d+'), lambda x: length(x) <= 3 AND CAST(x AS BIGINT) BETWEEN 1 AND 200).list_transform(lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS numbers FROM pages")
def str_digit_tokens(spark: S, d: str) -> DataFrame:
    found = F.transform(text.digit_tokens(F.col("html")), lambda x: x.cast("string"))
    return read(spark, d, "pages").select("page_id", F.array_join(found, ",").alias("numbers"))


@query("str_part_detect")
def str_part_detect(spark: S, d: str) -> DataFrame:
    p = read(spark, d, "part")
    k = F.col("p_partkey").cast("int")
    return p.select("p_partkey", text.part_detect(F.when(k % 9 == 0, 1), F.when(k % 7 == 0, 2), F.when(k % 5 == 0, F.sequence(k % 40 + 1, k % 40 + 3)), F.concat(F.lit("paper p"), (k % 5).cast("string"), F.lit(".pdf"))).alias("part"))


@query("str_review")
def str_review(spark: S, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", text.review_text(F.concat(F.lit("Questions 1–4 "), "text")).alias("t"))


@query("seg_paragraph", """
WITH t AS (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS t FROM documents)
, p AS (SELECT doc_id, t, len(list_filter(regexp_split_to_array(t, '\\n\\s*\\n'), lambda x: trim(x, ' ') <> '')) AS n FROM t)
SELECT doc_id, CASE WHEN n > 1 THEN n ELSE len(list_filter(string_split(regexp_replace(t, '(?m)^\\s*(Questions? \\d|READING PASSAGE|Answers?\\b)', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x, ' ') <> '')) END AS n FROM p""")
def seg_paragraph(spark: S, d: str) -> DataFrame:
    t = F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n\n"))
    return read(spark, d, "documents").select("doc_id", F.size(files.paragraphs(t)).alias("n"))


@query("jn_bidirectional_contains", """
WITH k AS (SELECT conv_id, turn, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS k FROM conversations)
SELECT a.conv_id, a.turn AS first, b.turn AS second FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE length(a.k) >= 12 AND length(b.k) >= 12 AND (contains(a.k, b.k) OR contains(b.k, a.k))""")
def jn_bidirectional_contains(spark: S, d: str) -> DataFrame:
    """Pairs of turns of a conversation of which one holds the other."""
    k = read(spark, d, "conversations").select("conv_id", "turn", text.alnum_key(F.col("text")).alias("k")).filter(F.length("k") >= 12)
    a, b = k.alias("a"), k.alias("b")
    j = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") < F.col("b.turn")))
    return j.filter(F.contains("a.k", "b.k") | F.contains("b.k", "a.k")).select("a.conv_id", F.col("a.turn").alias("first"), F.col("b.turn").alias("second"))


@query("num_baseline_cluster")
def num_baseline_cluster(spark: S, d: str) -> DataFrame:
    """Lines of glyphs laid out from the items' characters, 40 in a row."""
    g = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("doc"), F.posexplode(F.split("text", "")).alias("i", "text")).filter("text <> '' AND text <> '\n'")
    row = F.floor(F.col("i") / 40)
    glyphs = g.filter("text <> ' '").select("doc", F.lit(0).alias("page"), F.col("i").alias("id"), "text", (F.col("i") % 40 * 6.0).alias("x"), (row * 14.0).alias("y"), F.lit(5.5).alias("width"), F.lit(10.0).alias("height"), (row * 14.0 + 9 + (F.col("i") % 3) * 0.2).alias("baseline"), F.lit(10.0).alias("font_size"), F.lit(0.0).alias("angle"), F.col("i").alias("source_order"))
    return layout.glyph_lines(glyphs)


def _boxes(spark: S, d: str) -> DataFrame:
    p, k = read(spark, d, "part"), F.col("p_partkey")
    return p.select((k % 21).cast("string").alias("doc"), F.lit(0).alias("page"), k.cast("int").alias("id"), (F.floor(k / 40) % 25 * 20.0).alias("x"), (k % 7 * 3.0).alias("y"), F.lit(18.0).alias("width"), F.lit(12.0).alias("height"))


@query("jn_spatial_dup", """
WITH b AS (SELECT CAST(p_partkey % 21 AS VARCHAR) AS doc, 0 AS page, p_partkey AS id, p_partkey // 40 % 25 * 20.0::DOUBLE AS x, p_partkey % 7 * 3.0::DOUBLE AS y FROM part)
, j AS (SELECT a.doc, greatest(least(a.x, b.x) + 18 - greatest(a.x, b.x), 0) * greatest(least(a.y, b.y) + 12 - greatest(a.y, b.y), 0) AS inner_ FROM b a JOIN b b ON a.doc = b.doc AND a.id < b.id AND abs(a.x - b.x) < 18 AND abs(a.y - b.y) < 12)
, p AS (SELECT doc, count(*) AS pairs FROM j WHERE inner_ / (2 * 18 * 12 - inner_) >= 0.82 GROUP BY 1)
SELECT b.doc, b.page, round(least(1.0, 2 * coalesce(any_value(pairs), 0) / count(*)), 6) AS ratio FROM b LEFT JOIN p ON p.doc = b.doc GROUP BY 1, 2""")
def jn_spatial_dup(spark: S, d: str) -> DataFrame:
    return layout.duplicate_ratio(_boxes(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query("jn_spatial_iou")
def jn_spatial_iou(spark: S, d: str) -> DataFrame:
    b = _boxes(spark, d)
    return layout.claim_tokens(b.filter("id % 2 = 0"), b.filter("id % 2 = 1"))


@query("win_running_cluster")
def win_running_cluster(spark: S, d: str) -> DataFrame:
    return layout.running_clusters(read(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "value", 2.0).select("event_id", "cluster")


@query("srt_topological")
def srt_topological(spark: S, d: str) -> DataFrame:
    p, k = read(spark, d, "part"), F.col("p_partkey").cast("int")
    page = [(k % 50).cast("string").alias("doc"), F.lit(0).alias("page")]
    regions = p.select(*page, k.alias("id"), F.col("p_size").alias("base_rank"))
    edges = p.filter("p_partkey % 3 = 0").select(*page, k.alias("before"), (k - 50).alias("after"))
    return layout.reading_order(regions, edges)


@query("win_renumber", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS doc, event_id AS seq, event_id % 3 AS level FROM events)
, a AS (SELECT *, count(*) FILTER (level = 0) OVER (PARTITION BY doc ORDER BY seq) AS c0, count(*) FILTER (level <= 1) OVER (PARTITION BY doc ORDER BY seq) AS g1 FROM e)
, b AS (SELECT *, count(*) FILTER (level = 1) OVER (PARTITION BY doc, c0 ORDER BY seq) AS c1, count(*) FILTER (level = 2) OVER (PARTITION BY doc, g1 ORDER BY seq) AS c2 FROM a)
SELECT doc, CAST(seq AS INTEGER) AS seq, c0 || CASE WHEN level > 0 THEN '.' || c1 ELSE '' END || CASE WHEN level > 1 THEN '.' || c2 ELSE '' END AS number FROM b""")
def win_renumber(spark: S, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return layout.numbering(e.select(F.col("user_id").cast("string").alias("doc"), F.col("event_id").cast("int").alias("seq"), (F.col("event_id") % 3).cast("int").alias("level")))


@query("rec_slots", """
WITH a AS (SELECT l_orderkey AS n, l_linenumber AS q, min('A' || (l_partkey % 4)) AS answer FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2)
, b AS (SELECT l_orderkey AS n, l_linenumber AS q, min('a' || (l_partkey % 3)) AS answer FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1, 2)
, s AS (SELECT l_orderkey AS n, l_linenumber AS q, min('a' || (l_partkey % 2)) AS answer FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1, 2)
, j AS (SELECT coalesce(a.n, b.n) AS n, coalesce(a.q, b.q) AS q, lower(a.answer) AS l, b.answer AS c FROM a FULL JOIN b ON a.n = b.n AND a.q = b.q)
SELECT state, count(*) AS n, count(*) FILTER (apply) AS applied FROM (
  SELECT CASE WHEN l IS NULL THEN 'missing local' WHEN c IS NULL THEN 'missing cloud' WHEN l = c THEN 'agree' ELSE 'conflict' END AS state, coalesce(l IS NULL AND c = s.answer, false) AS apply
  FROM j LEFT JOIN s ON s.n = j.n AND s.q = j.q) GROUP BY 1""")
def rec_slots(spark: S, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("n"), F.col("l_linenumber").alias("q"), "l_suppkey", "l_partkey")

    def side(test: str, mark: str, m: int) -> DataFrame:
        return l.filter(test).groupBy("n", "q").agg(F.min(F.concat(F.lit(mark), (F.col("l_partkey") % m).cast("string"))).alias("answer"))

    return reconcile.decision_summary(reconcile.slot_decisions(side("l_suppkey % 5 <> 0", "A", 4), side("l_suppkey % 7 <> 0", "a", 3), side("l_suppkey % 2 = 0", "a", 2), ["n", "q"]))


@query("num_score_group", f"""
WITH {R.ROLES}
, s AS (SELECT attempt_id, passage_index, ['each', 'all_or_nothing', 'unordered', 'exact_set'][attempt_id % 4 + 1] AS rule, answer, lower(answer) IN ('a1', 'a3') AS correct FROM answers)
, g AS (SELECT attempt_id, passage_index, rule, count(*) AS possible, count(*) FILTER (correct) AS hits, list(DISTINCT answer) AS got, len(list_intersect(list(DISTINCT answer), ['A1', 'A3'])) AS common FROM s GROUP BY 1, 2, 3)
SELECT attempt_id, passage_index, rule, possible, CASE rule WHEN 'each' THEN hits WHEN 'all_or_nothing' THEN CASE WHEN hits = possible THEN possible ELSE 0 END WHEN 'unordered' THEN least(common, possible) ELSE CASE WHEN common = 2 AND len(got) = 2 THEN possible ELSE 0 END END AS earned FROM g""")
def num_score_group(spark: S, d: str) -> DataFrame:
    a = R.answers(spark, d)
    rules = F.element_at(F.array(*[F.lit(r) for r in ("each", "all_or_nothing", "unordered", "exact_set")]), (F.col("attempt_id") % 4 + 1).cast("int"))
    s = a.select("attempt_id", "passage_index", "question_id", F.array(F.lit("A1"), F.lit("A3")).alias("accepted"), F.col("answer").alias("given"), F.lit(True).alias("fold_case"), rules.alias("rule"))
    return reconcile.score_groups(reconcile.score_slots(s), ["attempt_id", "passage_index"])


@query("num_coverage_ledger", """
SELECT o_custkey AS doc, avg(CASE WHEN o_orderkey % 3 <> 2 THEN 1.0 ELSE 0.0 END) AS explained FROM orders GROUP BY 1""")
def num_coverage_ledger(spark: S, d: str) -> DataFrame:
    n = read(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("node"))
    return reconcile.coverage_ledger(n, n.filter("node % 3 = 0"), n.filter("node % 3 = 1").withColumn("reason", F.lit("decoration")), ["doc", "node"])[1]


@query("diff_json", """
WITH e AS (SELECT user_id, event_id, event_type AS t, value, props, lag(event_type) OVER w AS t0, lag(value) OVER w AS value0, lag(props) OVER w AS props0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
, f AS (SELECT * FROM e WHERE t0 IS NOT NULL)
, letters AS (SELECT event_id, t, t0, unnest(range(length(t))) AS i FROM f WHERE length(t) = length(t0))
SELECT event_id, '/type' AS path, '"' || t0 || '"' AS before, '"' || t || '"' AS after FROM f WHERE t <> t0
UNION ALL SELECT event_id, '/props/k', CAST(props0->'$.k' AS VARCHAR), CAST(props->'$.k' AS VARCHAR) FROM f WHERE props0->>'$.k' IS DISTINCT FROM props->>'$.k'
UNION ALL SELECT event_id, '/letters/' || i, '"' || t0[i + 1] || '"', '"' || t[i + 1] || '"' FROM letters WHERE t[i + 1] <> t0[i + 1]
UNION ALL SELECT event_id, '/letters', '["' || array_to_string(string_split(t0, ''), '","') || '"]', '["' || array_to_string(string_split(t, ''), '","') || '"]' FROM f WHERE length(t) <> length(t0)
UNION ALL SELECT event_id, '/high', CASE WHEN value0 > 50 THEN 'true' END, CASE WHEN value > 50 THEN 'true' END FROM f WHERE (value > 50) <> (value0 > 50)""")
def diff_json(spark: S, d: str) -> DataFrame:
    """What changed from each event to the next of its user, as documents."""
    t = F.col("event_type")
    letters = F.concat(F.lit('["'), F.array_join(F.split(t, "(?<=.)(?=.)"), '","'), F.lit('"]'))
    high = F.when(F.col("value") > 50, ',"high":true').otherwise("")
    doc = F.concat(F.lit('{"props":'), F.col("props"), F.lit(',"letters":'), letters, high, F.lit(',"type":"'), t, F.lit('"}'))
    return json_diff.consecutive(read(spark, d, "events"), "user_id", "event_id", doc, "event_id")


@query("num_fnv_sample")
def num_fnv_sample(spark: S, d: str) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def sample(a: pd.Series) -> pd.Series:
        return a.map(lambda t: similarity.seeded_sample(t, 40, 5))

    return read(spark, d, "benchmark").select("item_id", sample("text").alias("sample"))
