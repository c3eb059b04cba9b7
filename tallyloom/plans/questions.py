"""Queries of question structure. Each order is a page: an instruction that
names its lines, and for each line an item that begins with the line's number,
options if it was returned or accepted so, and a line that begins with a measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom import roles as R
from tallyloom.operators import recognition
from tallyloom.plans.registry import query
from tallyloom.sources.durable import kept

S = SparkSession
read = R.read

ITEMS = """
WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS value, l_returnflag AS mode, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem)
, last AS (SELECT doc, max(rn) AS n FROM l GROUP BY 1)
, c AS (SELECT doc, 10 * rn AS line, value, false AS measure FROM l UNION ALL SELECT doc, 10 * rn + 5, q, true FROM l WHERE q BETWEEN 1 AND 999)
, s AS (SELECT c.doc, line, value, value <= n AS expected, measure, coalesce(lag(value) OVER (PARTITION BY c.doc ORDER BY line) + 1 = value, false) AS rising FROM c JOIN last ON last.doc = c.doc)
, scored AS (SELECT doc, line, value, round(0.25 + CASE WHEN expected THEN 0.3 ELSE 0 END + CASE WHEN rising THEN 0.2 ELSE 0 END - CASE WHEN measure THEN 0.25 ELSE 0 END, 6)::DOUBLE AS score FROM s)
"""


#: Lines of orders in a task's share of them, so that sorting needs no disk.
_SHARE = 100_000


def _lines(spark: S, d: str) -> DataFrame:
    """Lines of pages. Orders are dealt by page before lines are made of them:
    all that groups, sorts or joins by page needs no other exchange."""
    order = W.partitionBy("doc").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    i = read(spark, d, "lineitem").withColumn("doc", F.col("l_orderkey").cast("string"))
    shares = i.count() // _SHARE
    i = i.repartition(shares, "doc") if shares > spark.sparkContext.defaultParallelism else i.repartition("doc")
    i = i.withColumns({"rn": F.row_number().over(order), "n": F.count("*").over(W.partitionBy("doc"))})
    number, q = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")
    three = F.col("l_returnflag") != "N"
    texts = [
        (F.lit(0), F.concat(number, F.lit(". How was it sent, part "), F.col("l_partkey").cast("string"))),
        (F.lit(1), F.when(three, F.concat(F.lit("A under flag "), F.lower("l_returnflag")))),
        (F.lit(2), F.when(three, "B by another way")),
        (F.lit(3), F.when(three, "C not at all")),
        (F.lit(5), F.concat(q, F.lit(" % of the whole"))),
    ]
    head = F.when(F.col("rn") == 1, F.concat(F.lit("Questions 1-"), F.col("n").cast("string"), F.lit(" Choose the correct letter")))
    rows = [F.struct((10 * F.col("rn") + k).cast("int").alias("line"), t.alias("text"), F.lit(1).alias("region")) for k, t in texts]
    rows.append(F.struct(F.lit(1).alias("line"), head.alias("text"), F.lit(0).alias("region")))
    every = i.select("doc", F.explode(F.array(*rows)).alias("r")).select("doc", "r.*").filter("text IS NOT NULL")
    return every.select("doc", F.lit(0).alias("page"), "line", "text", F.lit(60.0).alias("x"), (F.lit(90.0) + F.col("line") * 12).alias("y"), F.lit(200.0).alias("width"), F.lit(10.0).alias("height"), "region")


def _roles(lines: DataFrame) -> DataFrame:
    r = lines.groupBy("doc", "page", "region").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda v: v["text"]).alias("texts"), F.min("y").alias("y"), F.max(F.col("y") + F.col("height")).alias("_b"))
    return recognition.region_roles(r.withColumn("height", F.col("_b") - F.col("y")).withColumn("kind", F.lit("text")).withColumn("page_height", F.lit(2000.0)).drop("_b"))


@query("seg_role", """
WITH l AS (SELECT l_orderkey AS doc, l_returnflag <> 'N' AS three FROM lineitem)
, b AS (SELECT doc, count(*) AS n, count(*) FILTER (three) AS t FROM l GROUP BY 1)
SELECT CAST(doc AS VARCHAR) AS doc, 0 AS region, 'question_instruction' AS role, 0.95::DOUBLE AS confidence FROM b
UNION ALL SELECT CAST(doc AS VARCHAR), 1, CASE WHEN t > 0 AND round(0.35 + least(2.0 * n / (2 * n + 3 * t), 0.4), 6) < 0.75 THEN 'option_run' ELSE 'question_prompt' END,
  CASE WHEN t > 0 THEN greatest(0.75::DOUBLE, round(0.35 + least(2.0::DOUBLE * n / (2 * n + 3 * t), 0.4), 6)) ELSE round(0.35 + least(2.0::DOUBLE * n / (2 * n), 0.4), 6) END FROM b""")
def seg_role(spark: S, d: str) -> DataFrame:
    """Roles of regions by the evidence in their lines."""
    return _roles(_lines(spark, d)).select("doc", "region", "role", F.col("role_confidence").alias("confidence"))


@query("num_number_score", ITEMS + "SELECT CAST(doc AS VARCHAR) AS doc, CAST(line AS INTEGER) AS line, CAST(value AS INTEGER) AS value, score FROM scored")
def num_number_score(spark: S, d: str) -> DataFrame:
    """How much speaks for each leading number to be a question's."""
    lines = _lines(spark, d)
    return kept(recognition.number_scores(lines, _roles(lines)).select("doc", "line", "value", "score"))


@query("num_rising_chain")
def num_rising_chain(spark: S, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return kept(recognition.rising_chain(recognition.number_scores(lines, _roles(lines))))


@query("seg_blocks", ITEMS + """
, good AS (SELECT * FROM scored WHERE score >= 0.55)
, texts AS (SELECT doc, 10 * rn AS line, 'How was it sent, part ' || p AS t, mode FROM (SELECT l.*, x.l_partkey AS p FROM l JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) x ON x.l_orderkey = l.doc AND x.rn = l.rn))
SELECT CAST(g.doc AS VARCHAR) AS doc, CAST(g.value AS INTEGER) AS number, t.t AS stem, CASE WHEN mode <> 'N' THEN 3 ELSE 0 END AS options FROM good g JOIN texts t ON t.doc = g.doc AND t.line = g.line WHERE mode <> 'N'""")
def seg_blocks(spark: S, d: str) -> DataFrame:
    """Stem and options of the accepted numbers that have options."""
    lines = _lines(spark, d)
    found = recognition.question_blocks(lines, recognition.number_scores(lines, _roles(lines)))
    return kept(found.filter("size(options) > 0").select("doc", "number", "stem", F.size("options").alias("options")))
