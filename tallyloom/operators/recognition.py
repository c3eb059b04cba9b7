"""Question structure of pages from the evidence in their text.

Regions get the role that most speaks for, numbers at the beginning of lines a
score of what speaks for a question, and of the numbers that pass one rising
chain is chosen. All are expressions and windows over a page's lines; only the
chain folds over the candidates of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.text import let, range_numbers

PAGE = ["doc", "page"]

# Markers of instructions, units after a measure, the weights of
# evidence and the limits that belong to them.
MARKERS = ("write ", "choose ", "complete ", "do the following", "select ", "match ", "label the", "answer the", "from the list", "according to", "in boxes", "true", "false", "not given", "yes", "no")
MEASURE = r"^\s*(?:[%£$]|per |kg|km|cm|mm)"
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
WEIGHTS = {"expected": 0.30, "question_area": 0.15, "text_adjacent": 0.10, "font": 0.10, "rising": 0.20, "passage": -0.20, "year": -0.25, "measure": -0.25}
LEAST_SCORE = 0.55
ROW_TOLERANCE, LARGEST_GAP = 5, 34.0
CHROME, VISUAL = ("header", "footer", "page_number"), ("figure", "image", "table", "diagram")

_NUMBER = r"^\s*(\d{1,3})(?:[.)]?(?=\s|$))"
_LABEL = r"^\s*(?:([A-Za-z])|((?i:viii|vii|iii|ii|iv|vi|ix|x|v|i)))(?:\s+|(?=[.):\]-]))[.):\]-]*\s*(.*)$"
_MAY_LABEL = r"^\s*[A-Za-z]{1,4}[\s.):\]-]"  # of every text that _LABEL matches


def leading_number(text: Column) -> Column:
    """A number of one to three digits that a line begins with."""
    return F.nullif(F.nullif(F.regexp_extract(text, _NUMBER, 1), F.lit("")).cast("int"), F.lit(0))


def option_rank(text: Column) -> Column:
    """The place of the label that a line with a body begins with: A, B, ...
    count from 0, and so do Roman numbers of more than one letter."""
    found = F.struct(F.upper(F.regexp_extract(text, _LABEL, 1)).alias("letter"), F.lower(F.regexp_extract(text, _LABEL, 2)).alias("roman"), F.trim(F.regexp_extract(text, _LABEL, 3)).alias("body"))

    def rank(v: Column) -> Column:
        place = F.when(v["letter"] != "", F.ascii(v["letter"]) - ord("A")).otherwise(F.array_position(F.lit(list(ROMAN)), v["roman"]).cast("int") - 1)
        return F.when((v["body"] != "") & ((v["letter"] != "") | (v["roman"] != "")), place)

    # Most lines begin otherwise, which is told at less cost.
    return F.when(text.rlike(_MAY_LABEL), let(found, rank))


def has_option_run(texts: Column, least: int = 3) -> Column:
    """Whether labels that follow each other stand in that many lines in a row."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("best"), F.lit(None).cast("int").alias("last"))

    def step(s: Column, t: Column) -> Column:
        def judged(r: Column) -> Column:
            n = F.when(r.isNull(), 0).when(r == s["last"] + 1, s["n"] + 1).otherwise(1)
            return F.struct(n.alias("n"), F.greatest(s["best"], n).alias("best"), r.alias("last"))

        return F.transform(F.array(option_rank(t)), judged)[0]

    return F.aggregate(texts, start, step, lambda s: s["best"]) >= least


def _evidence(v: Column) -> Column:
    """(score, place, role) of all that speaks for a role of a region."""
    text, low, n, run = v["text"], v["low"], F.greatest(F.size("texts"), F.lit(1)), v["run"]
    marker = F.lit(False)
    for m in MARKERS:
        marker = marker | low.contains(m)
    edge = (F.col("y") <= F.col("page_height") * 0.08) | (F.col("y") + F.col("height") >= F.col("page_height") * 0.92)
    chrome, visual = F.col("kind").isin(*CHROME), F.col("kind").isin(*VISUAL)
    asks = low.contains("question")
    scores = (
        ("header_footer", F.when(chrome, 1.0).when(edge & (F.length(text) < 80), 0.55)),
        ("answer_key", F.when(low.contains("answer key") | low.startswith("answers"), 0.9)),
        ("question_instruction", F.when(asks, 0.5 + F.when(marker, 0.25).otherwise(0.0) + F.when(range_numbers(text, high=999).isNotNull(), 0.2).otherwise(0.0))),
        ("option_bank", F.when(low.contains("list of headings"), 0.9)),
        ("option_run", F.when(run, 0.75)),
        ("question_prompt", F.when(v["numbered"] >= 0.25, 0.35 + F.least(v["numbered"], F.lit(0.4)))),
        ("stimulus", F.when(visual, 0.6)),
        ("passage", F.when((F.length(text) / n >= 45) & ~run & ~asks & ~visual, 0.4)),
    )
    return F.array_compact(F.array(*(F.when(s.isNotNull(), F.struct(F.round(s, 6).alias("score"), F.lit(k).alias("place"), F.lit(role).alias("role"))) for k, (role, s) in enumerate(scores))))


def region_roles(regions: DataFrame) -> DataFrame:
    """``regions`` with role, role_confidence and evidence (role, score).

    Columns kind, y, height, page_height and texts (its lines). Of equal scores
    the later in the list of evidence wins; without any the role is unknown.
    """
    # What several kinds of evidence ask for is bound once for a region.
    text = F.array_join("texts", " ")
    numbered = F.size(F.filter("texts", lambda t: leading_number(t).isNotNull())) / F.greatest(F.size("texts"), F.lit(1))
    first = F.struct(text.alias("text"), F.lower(text).alias("low"), numbered.alias("numbered"), has_option_run(F.col("texts")).alias("run"))
    out = regions.withColumn("_e", let(first, _evidence)).withColumn("_best", F.array_max("_e"))
    told = F.transform("_e", lambda e: F.struct(e["role"].alias("role"), e["score"].alias("score")))
    return out.withColumn("role", F.coalesce("_best.role", F.lit("unknown"))).withColumn("role_confidence", F.least(F.coalesce("_best.score", F.lit(0.0)), F.lit(1.0))).withColumn("evidence", told).drop("_e", "_best")


def number_scores(lines: DataFrame, roles: DataFrame) -> DataFrame:
    """doc, page, line, value, score, evidence of every line that begins with a
    number.

    lines: doc, page, line, text, x, y, width, height, region and, if known,
    font_size. roles: those of ``region_roles``. The numbers that a page's
    instructions name are expected on it. Lines of headers and footers don't
    count.
    """
    # One row for each page: its roles are judged once.
    named = F.when(F.col("role") == "question_instruction", range_numbers(F.array_join("texts", " "), high=999))
    page = roles.groupBy(*PAGE).agg(F.collect_list(F.struct("region", "role")).alias("_roles"), F.collect_list(named).alias("_expected"))
    d = lines.join(page, PAGE, "left").withColumn("role", F.get(F.filter("_roles", lambda r: r["region"] == F.col("region")), F.lit(0))["role"]).drop("_roles")
    middle = (1000 * (F.col("y") + F.col("height") / 2)).cast("long")  # ranges are of whole numbers
    row = W.partitionBy(*PAGE).orderBy("_middle").rangeBetween(-1000 * ROW_TOLERANCE, 1000 * ROW_TOLERANCE)
    d = d.withColumn("_middle", middle).withColumn("_beside", F.max(F.when(F.trim("text") != "", F.col("x"))).over(row))
    d = d.withColumn("value", leading_number(F.col("text"))).filter("value IS NOT NULL AND coalesce(role, '') <> 'header_footer'")
    font = F.lit(False)
    if "font_size" in lines.columns:
        sizes = F.sort_array(F.collect_list("font_size").over(W.partitionBy(*PAGE)))
        d = d.withColumn("_usual", F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")))
        font = F.coalesce(F.abs(F.col("font_size") - F.col("_usual")) <= 0.75, F.lit(False))
    order = W.partitionBy(*PAGE).orderBy("y", "x", "line")
    after = F.regexp_replace("text", r"^\s*\d{1,3}[.)]?", "")
    holds = {
        "expected": F.coalesce(F.exists("_expected", lambda r: F.col("value").between(r["first"], r["last"])), F.lit(False)),
        "question_area": F.col("role").isin("question_prompt", "option_run"),
        "text_adjacent": (F.length(F.trim("text")) > 3) | (F.col("_beside") > F.col("x") + F.col("width")),
        "font": font,
        "rising": F.lag("value").over(order) + 1 == F.col("value"),
        "passage": F.col("role") == "passage",
        "year": F.col("value").between(1900, 2100),
        "measure": after.rlike(MEASURE),
    }
    told = F.array_compact(F.array(*(F.when(c, n) for n, c in holds.items())))
    score = F.lit(0.0)
    for n, c in holds.items():
        score = score + F.when(c, WEIGHTS[n]).otherwise(0.0)
    score = F.round(score, 6)
    return d.select(*PAGE, "line", "x", "y", "value", score.alias("score"), told.alias("evidence"))


def rising_chain(scored: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc, numbers, total: of the candidates with ``least`` or more, in reading
    order, the chain of rising numbers with the greatest sum of scores (ties:
    the longer, then the greater numbers)."""
    one = F.struct("page", "y", "x", "line", "value", "score")
    docs = scored.filter(F.col("score") >= least).groupBy("doc").agg(F.sort_array(F.collect_list(one)).alias("cs"))
    none = F.array().cast("array<struct<total:double,n:int,chain:array<int>,value:int>>")

    def step(best: Column, c: Column) -> Column:
        def longer(before: Column) -> Column:
            chain = F.concat(F.coalesce(before["chain"], F.array().cast("array<int>")), F.array(c["value"]))
            return F.struct(F.round(F.coalesce(before["total"], F.lit(0.0)) + c["score"], 6).alias("total"), (F.coalesce(before["n"], F.lit(0)) + 1).alias("n"), chain.alias("chain"), c["value"].alias("value"))

        new = let(F.array_max(F.filter(best, lambda b: b["value"] < c["value"])), longer)
        # Of chains that end with one number only the best can go on: there
        # are no more than numbers, whatever the candidates.
        same = F.filter(best, lambda b: b["value"] == c["value"])
        return F.concat(F.filter(best, lambda b: b["value"] != c["value"]), F.array(F.array_max(F.concat(same, F.array(new)))))

    found = docs.select("doc", F.array_max(F.aggregate("cs", none, step)).alias("b"))
    return found.select("doc", F.col("b.chain").alias("numbers"), F.col("b.total").alias("total"))


def question_blocks(lines: DataFrame, scored: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc, page, number, stem, options, lines of each accepted number.

    A block reaches to the next number of its page. Its stem ends at the first
    option or where a gap is too wide; options are the labelled lines after
    that, if three or more follow each other.
    """
    marks = scored.filter(F.col("score") >= least).select(*PAGE, "line", F.col("value").alias("_number"))
    order = W.partitionBy(*PAGE).orderBy("y", "x", "line")
    d = lines.join(marks, [*PAGE, "line"], "left")
    d = d.withColumn("_block", F.count("_number").over(order.rowsBetween(W.unboundedPreceding, 0))).filter("_block > 0")
    own = W.partitionBy(*PAGE, "_block").orderBy("y", "x", "line")
    gap = F.col("y") - F.lag(F.col("y") + F.col("height")).over(own) > LARGEST_GAP
    labelled = F.col("_number").isNull() & option_rank(F.col("text")).isNotNull()
    d = d.withColumn("_gap", gap).withColumn("_label", labelled)
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_ended", F.max(F.coalesce("_gap", F.lit(False)) | F.col("_label")).over(upto)).withColumn("_cut", F.max(F.coalesce("_gap", F.lit(False))).over(upto))
    text = F.when(F.col("_number").isNotNull(), F.regexp_replace("text", r"^\s*\d{1,3}[.)]?\s*", "")).otherwise(F.trim("text"))
    part = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("y", "x", "line", text.alias("t"))))), lambda v: v["t"])
    g = d.groupBy(*PAGE, "_block").agg(
        F.max("_number").alias("number"), part(~F.col("_ended")).alias("stem"), part(F.col("_label") & ~F.col("_cut")).alias("options"), F.sort_array(F.collect_list("line")).alias("lines")
    )
    stem = F.trim(F.regexp_replace(F.array_join("stem", " "), r"\s+", " "))
    none = F.array().cast("array<string>")
    return g.select(*PAGE, "number", stem.alias("stem"), F.when(has_option_run(F.col("options")), F.col("options")).otherwise(none).alias("options"), "lines")
