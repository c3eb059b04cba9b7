"""The queries of the training-data operators: each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, html_text, line_dedup, mixing, passages, periodic, pii, ppm, quality_rules, simhash, suffix_dedup, token_counts, turns
from tallyloom.llm._shared import let, table, words


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.with_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.size("lines.removed").cast("long")
    return found.select("doc_id", "lines.n_lines", n.alias("n_removed"), "lines.n_near", F.sha2(F.coalesce("lines.text", F.lit("")), 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.transform("leaks", lambda x: x["item"])
    return found.select("doc_id", F.size("leaks").alias("n_items"), items.alias("item_ids"), F.array_max(F.transform("leaks", lambda x: x["coverage"])).alias("coverage"), (F.size("leaks") > 0).alias("contaminated"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_classes(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.quality_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines")
    return d.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in names))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    at = mixing.position(F.col("mix.start"), F.col("mix.target"), F.col("mix.slope"))
    out = m.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", F.round(at, 9).alias("position"))
    return out.orderBy("position", "doc_id")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """A tenth of the texts, by a hash of their id, turned periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(ws: Column) -> Column:
        n, g = F.size(ws), F.floor(h / 10)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.array_join(let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.transform(ws, lambda w, i: F.when(i >= x["a"], ws[x["a"] + (i - x["a"]) % x["p"]]).otherwise(w))), " ")

    text = let(words(F.col("text")), lambda ws: F.when(F.size(ws) > 0, planted(ws)).otherwise(F.col("text")))
    return docs.withColumn("text", F.when(h % 10 == 0, text).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.with_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    runs = F.col("periodic.runs")
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "").alias("lines"), F.col("periodic.collapsed").alias("collapsed"))
    return out.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        (-F.col("best.length")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    k = F.crc32(name.cast("binary")) % 20
    damaged = c.select(
        "conv_id",
        "turn",
        F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"),
    )
    found = turns.repair(damaged, copies=F.col("copies"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda ss: F.array_join(F.transform(ss, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(k) for k in pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
