"""Summary statistics, histograms, item analysis, matrices, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.facts import ratio


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def natural(question: str = "question_id") -> tuple[Column, Column]:
    """Order of question ids: byte length, then bytes, so q2 < q10."""
    return F.octet_length(question), F.col(question)


def summary(valid: DataFrame, by: list[str], score: str = "effective_score") -> DataFrame:
    s = F.col(score)
    return valid.groupBy(*by).agg(
        F.count("*").alias("n"), r6(F.avg(s)).alias("mean"), r6(F.median(s)).alias("median"), F.min(s).alias("min"), F.max(s).alias("max"),
        r6(ratio(F.sum(s), F.sum("total"))).alias("accuracy"), F.max("total").alias("max_total"),
    )


def unit_histogram(valid: DataFrame, by: list[str], score: str = "effective_score", width: float = 1.0) -> DataFrame:
    """Counts in bins [k, k + 1) of ``width`` up to the largest total, empty
    bins kept; scores outside fall in the first or last bin."""
    # One pass: counts by raw bin with the largest total, then a few numbers
    # of each group, whose outer bins are added to its first and last.
    raw = valid.groupBy(*by, F.floor(F.col(score) / width).alias("_raw")).agg(F.count("*").alias("_n"), F.max("total").alias("_total"))
    group = raw.groupBy(*by).agg(F.greatest(F.ceil(F.max("_total") / width) - 1, F.lit(0)).cast("int").alias("_top"), F.collect_list(F.struct("_raw", "_n")).alias("_bins"))
    placed = F.filter("_bins", lambda b: F.least(F.greatest(b["_raw"], F.lit(0)), F.col("_top")) == F.col("bin"))
    n = F.aggregate(placed, F.lit(0).cast("long"), lambda acc, b: acc + b["_n"])
    return group.withColumn("bin", F.explode(F.sequence(F.lit(0), "_top"))).select(*by, "bin", n.alias("n"))


def decile_histogram(valid: DataFrame, by: list[str], score: str = "effective_score") -> DataFrame:
    """Ten bins of accuracy in percent, always; 100 % joins the last."""
    percent = F.coalesce(ratio(F.col(score) * 100, F.col("total")), F.lit(0.0))
    decile = F.least(F.greatest(F.floor(percent / 10), F.lit(0)) * 10, F.lit(90)).cast("int")
    counts = valid.withColumn("bin", decile).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    groups = valid.select(*by).distinct().withColumn("bin", F.explode(F.array(*[F.lit(10 * k) for k in range(10)])))
    return groups.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def parts(valid: DataFrame, passages: DataFrame) -> DataFrame:
    """Each passage index: rows, points, ratio, and the label seen first in
    the order of candidate and attempt."""
    j = passages.join(valid.select("attempt_id", "candidate_id"), "attempt_id")
    name = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.concat(F.lit("P"), (F.col("passage_index") + 1).cast("string")))
    return j.groupBy("passage_index").agg(
        F.count("*").alias("n"), F.sum("correct").alias("correct"), F.sum("total").alias("total"),
        r6(ratio(F.sum("correct"), F.sum("total"))).alias("accuracy"), F.min_by(name, F.struct("candidate_id", "attempt_id")).alias("label"),
    )


def graded(answers: DataFrame) -> DataFrame:
    return answers.filter(F.col("is_correct").isNotNull() & (F.col("weight") > 0))


def items(valid: DataFrame, answers: DataFrame, enough: int = 30) -> DataFrame:
    """Each question: graded rows, correct rows, ratio by rows, whether there
    are enough, and the first label and kind that isn't null."""
    j = graded(answers).join(valid.select("attempt_id", "candidate_id"), "attempt_id")
    first = F.struct("candidate_id", "attempt_id")
    return j.groupBy("passage_index", "question_id").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("is_correct") == 1, 1).otherwise(0)).alias("n_correct"), r6(F.avg(F.when(F.col("is_correct") == 1, 1.0).otherwise(0.0))).alias("accuracy"),
        (F.count("*") >= enough).alias("enough"), F.min_by("label", F.when(F.col("label").isNotNull(), first)).alias("label"), F.min_by("kind", F.when(F.col("kind").isNotNull(), first)).alias("kind"),
    )


def hardest(items_: DataFrame, n: int = 10) -> DataFrame:
    """The items of lowest accuracy; ties: more rows, then natural order."""
    size, name = natural()
    return items_.orderBy(F.coalesce("accuracy", F.lit(1.0)), F.desc("n"), "passage_index", size, name).limit(n)


def verdict(n: Column, accuracy: Column) -> Column:
    return F.when(n < 30, "insufficient").when(accuracy < 0.5, "hard").otherwise("normal")


def kinds(valid: DataFrame, effective: DataFrame) -> DataFrame:
    """Each kind: distinct attempts, points and ratio by points; no kind is ''."""
    j = graded(effective).join(valid.select("attempt_id"), "attempt_id").withColumn("kind", F.coalesce("kind", F.lit("")))
    return j.groupBy("kind").agg(
        F.count_distinct("attempt_id").alias("attempts"), F.sum("weight").alias("points"), F.sum("effective").alias("score"), r6(ratio(F.sum("effective"), F.sum("weight"))).alias("accuracy")
    )


def item_points(effective: DataFrame, by: list[str]) -> DataFrame:
    """Item statistics by points, as listening papers count them."""
    j = effective.filter(F.col("weight") > 0)
    s = F.coalesce("effective", F.lit(0.0))
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.sum(s).alias("score"), F.sum("weight").alias("points"), r6(ratio(F.sum(s), F.sum("weight"))).alias("accuracy"))


def student_slots(effective: DataFrame) -> DataFrame:
    """Points and a map of question to points for each attempt."""
    s = F.coalesce("effective", F.lit(0.0))
    return effective.groupBy("attempt_id").agg(F.sum(s).alias("score"), F.sum("weight").alias("points"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("question_id", s.alias("s"))))).alias("slots"))


def distribution(valid: DataFrame, answers: DataFrame) -> DataFrame:
    """Each answer text of each question: count, share, and whether the last
    row, in the order of candidate and attempt, was correct."""
    j = answers.join(valid.select("attempt_id", "candidate_id"), "attempt_id")
    text = F.lower(F.trim(F.regexp_replace("answer", r"\s+", " ")))
    last = F.max_by("is_correct", F.struct("candidate_id", "attempt_id"))
    each = j.groupBy("passage_index", "question_id", text.alias("text")).agg(F.count("*").alias("n"), last.alias("last_correct"))
    whole = F.sum("n").over(W.partitionBy("passage_index", "question_id"))
    return each.select("passage_index", "question_id", "text", "n", r6(F.col("n") / whole).alias("share"), "last_correct")


def question_effort(valid: DataFrame, answers: DataFrame) -> DataFrame:
    j = graded(answers).join(valid.select("attempt_id"), "attempt_id")
    return j.groupBy("passage_index", "question_id").agg(r6(F.avg("elapsed")).alias("mean_elapsed"), r6(F.avg("changes")).alias("mean_changes"))


def matrix(valid: DataFrame, answers: DataFrame, columns: list[str]) -> DataFrame:
    """Students by questions: 1, 0 or null. Naming the columns keeps Spark
    from a pass over the data to find them."""
    j = answers.join(valid.select("attempt_id", "candidate_id"), "attempt_id")
    return j.groupBy("candidate_id", "attempt_id").pivot("question_id", columns).agg(F.max("is_correct"))


def part_vector(valid: DataFrame, passages: DataFrame, n_parts: int) -> DataFrame:
    j = passages.join(valid.select("attempt_id"), "attempt_id")
    return j.groupBy("attempt_id").pivot("passage_index", list(range(n_parts))).agg(F.first("correct")).toDF("attempt_id", *[f"part_{k}" for k in range(n_parts)])


def durations(passages: DataFrame) -> DataFrame:
    return passages.groupBy("attempt_id").agg(F.sum("duration_sec").alias("duration_sec"))


def median_upper(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The upper median: the element at half the length of the sorted list."""
    each = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by)
    ranked = each.withColumns({"_upto": F.sum("_n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_n").over(w)})
    return ranked.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min(value).alias("median_upper"))
