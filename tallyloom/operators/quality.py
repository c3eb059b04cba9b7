"""Issue lists of task groups, and the comparison of two recognitions.

Groups, responses and slots are tables; every rule is a column condition over
one row for each group, so a document's size doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import review_text
from tallyloom.sources.durable import kept

#: Task types by what their answers are chosen from (fixed values).
TRUTH = ("true_false", "yes_no")
CHOICE = ("multiple_choice", "single_choice")
BANK = ("matching", "matching_headings")
COMPLETION = ("cloze", "summary", "table_completion")
#: Severity of each issue that isn't blocking (fixed values).
WARNINGS = ("instruction unresolved",)


def _listed(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules]))


def group_issues(groups: DataFrame, responses: DataFrame, slots: DataFrame, key: list[str]) -> DataFrame:
    """(key, issue, severity) of each rule that a task group breaks.

    groups: key, task_type, expected and display (arrays of question numbers),
    prompt, ambiguous, type_conflict, confidence, word_limit, alphabet, bank
    (array of option texts, null without one), choose (null unless the
    instruction says how many). responses: key, response_id, exact, least,
    most, assignment, reuse, options (array). slots: key, response_id, slot_id,
    number.
    """
    held = slots.groupBy(*key, "response_id").agg(F.count_distinct("slot_id").alias("n_slots"))
    r = responses.join(held, [*key, "response_id"], "left").withColumn("n_slots", F.coalesce("n_slots", F.lit(0)))
    r = r.join(groups.select(*key, "task_type", "choose", "bank"), key)
    c, n = F.col("choose"), F.col("n_slots")
    same = lambda x: (F.col("exact") == x) & (F.col("least") == x) & (F.col("most") == x)
    options = F.coalesce("options", F.array().cast("array<string>"))
    usable = lambda o: (F.size(o) >= 2) & ~F.exists(o, lambda x: x.isNull() | (F.trim(x) == ""))
    shared = (F.col("task_type") == "multiple_choice") & (c > 1)
    fits = F.when(shared, (n == c) & same(c) & (F.col("assignment") == "unordered_set") & ~F.col("reuse") & (F.size(options) > c)).otherwise(
        (n > 0) & (((F.col("assignment") == "per_slot") & same(c)) | (F.col("assignment").isin("unordered_set", "ordered_slots") & same(n)))
    )
    bank = F.coalesce("bank", F.array().cast("array<string>"))
    lacks = F.when(F.col("task_type").isin(*CHOICE), ~usable(options)).when(F.col("task_type").isin(*BANK), ~usable(bank)).when(F.col("task_type").isin(*TRUTH), (F.size(options) > 0) & (F.size(options) < 2)).otherwise(False)
    per_group = r.groupBy(*key).agg(F.bool_or(c.isNotNull() & ~F.coalesce(fits, F.lit(False))).alias("policy"), F.bool_or(lacks).alias("options_lack"), F.sum(n).alias("response_slots"))
    numbers = slots.groupBy(*key).agg(F.collect_set("number").alias("numbers"), F.count_distinct("slot_id").alias("slots"))
    g = groups.join(per_group, key, "left").join(numbers, key, "left")
    none = F.array().cast("array<int>")
    expected, display, have = (F.coalesce(x, none) for x in ("expected", "display", "numbers"))
    count = F.coalesce("slots", F.lit(0))
    apart = lambda a, b: (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)
    policy = F.coalesce("policy", F.lit(False))
    rules = [
        ("task type conflict", F.col("type_conflict")),
        ("slots differ from instruction", (F.size(F.array_distinct(expected)) != count) | ((F.size(display) > 0) & apart(display, expected))),
        ("question number missing", (F.size(expected) == 0) | (F.size(F.array_except(expected, have)) > 0)),
        ("prompt empty", (F.trim(F.coalesce("prompt", F.lit(""))) == "") & (count > 0)),
        ("prompt boundary ambiguous", F.col("ambiguous") & (count > 0)),
        ("instruction unresolved", F.coalesce("confidence", F.lit(0.0)) < 0.7),
        ("option bank missing", F.col("options_lack") & F.col("task_type").isin(*BANK)),
        ("options incomplete", F.col("options_lack") & ~F.col("task_type").isin(*BANK)),
        ("response policy differs", policy),
        ("choice differs from slots", ~policy & (F.col("task_type") == "multiple_choice") & c.isNotNull() & ((F.col("response_slots") != F.size(expected)) | (c > F.col("response_slots")))),
        ("word limit unknown", F.col("task_type").isin(*COMPLETION) & F.col("alphabet").isNull() & F.col("word_limit").isNull()),
    ]
    found = g.select(*key, F.explode(_listed(rules)).alias("issue"))
    return found.withColumn("severity", F.when(F.col("issue").isin(*WARNINGS), "warning").otherwise("blocking"))


def reference_issues(tasks: DataFrame, responses: DataFrame, slots: DataFrame, answers: DataFrame, options: DataFrame, assets: DataFrame) -> DataFrame:
    """(doc, target, issue) of references that don't close, in whole documents.

    tasks: doc, task_id, task_type, alphabet (labels that the instruction
    names, or null). responses: doc, response_id, task_id. slots: doc, slot_id,
    response_id, number, word_limit (or null). answers: doc, slot_id, answer.
    options: doc, task_id, label, text. assets: doc, asset_id, path, task_id
    (that shows it, or null) and stored (whether the file is there).

    Every rule is a grouping or a join of the tables, so a document's size
    doesn't matter. An id that stands twice is an issue once; a null or empty
    answer counts as none; a slot takes any of its answers. No side of a join
    goes through the driver: a written table's compressed size says little of
    its rows, and a dozen joins run at a time.
    """

    def told(rows: DataFrame, target: str, issue: str) -> DataFrame:
        return rows.select("doc", F.col(target).cast("string").alias("target"), F.lit(issue).alias("issue"))

    def met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        return left.join(right.hint("merge"), on, how)

    tasks, responses = kept(tasks), kept(responses)
    twice = lambda rows, c: rows.groupBy("doc", c).count().filter("count > 1")
    said = answers.filter(F.trim(F.coalesce("answer", F.lit(""))) != "").select("doc", "slot_id", "answer")
    # Several rules read these; each is grouped once.
    known = kept(slots.select("doc", "slot_id", "response_id", "word_limit").dropDuplicates(["doc", "slot_id"]))
    asked = met(known, responses.select("doc", "response_id", "task_id").dropDuplicates(["doc", "response_id"]), ["doc", "response_id"])
    asked = met(asked, tasks.select("doc", "task_id", "task_type", "alphabet").dropDuplicates(["doc", "task_id"]), ["doc", "task_id"])
    given = met(said, asked, ["doc", "slot_id"])
    labels = options.filter(F.trim(F.coalesce("label", F.lit(""))) != "").groupBy("doc", "task_id").agg(F.collect_set(F.upper(F.trim("label"))).alias("labels"), F.count("*").alias("n_options"))
    n_slots = asked.groupBy("doc", "task_id", "task_type").agg(F.count("*").alias("n_slots"))
    words = F.size(F.filter(F.split("answer", r"\s+"), lambda x: x != ""))
    chosen = met(given.filter(F.col("task_type").isin(*CHOICE, *BANK)), labels, ["doc", "task_id"])
    alphabets = met(tasks.filter("alphabet IS NOT NULL"), labels, ["doc", "task_id"])
    apart = (F.size(F.array_except("alphabet", "labels")) > 0) | (F.size(F.array_except("labels", "alphabet")) > 0)
    unsafe = F.col("path").rlike(r"^(?:[A-Za-z]:|[/\\])|(?:^|[/\\])\.\.(?:[/\\]|$)|[\x00-\x1f]") | (F.trim(F.coalesce("path", F.lit(""))) == "")
    parts = [
        told(twice(tasks, "task_id"), "task_id", "task id twice"),
        told(twice(responses, "response_id"), "response_id", "response id twice"),
        told(twice(slots, "number").filter("number IS NOT NULL"), "number", "question number twice"),
        told(met(responses, tasks.select("doc", "task_id"), ["doc", "task_id"], "left_anti"), "response_id", "response without task"),
        told(met(known, responses.select("doc", "response_id"), ["doc", "response_id"], "left_anti"), "slot_id", "slot without response"),
        told(met(said, known, ["doc", "slot_id"], "left_anti").select("doc", "slot_id").distinct(), "slot_id", "answer without slot"),
        told(met(known, said, ["doc", "slot_id"], "left_anti"), "slot_id", "slot without answer"),
        told(given.filter(words > F.col("word_limit")).select("doc", "slot_id").distinct(), "slot_id", "answer over the word limit"),
        told(chosen.filter(~F.array_contains("labels", F.upper(F.trim("answer")))).select("doc", "slot_id").distinct(), "slot_id", "answer not among the options"),
        told(options.filter(F.trim(F.coalesce("label", F.lit(""))) == "").select("doc", "task_id").distinct(), "task_id", "option without label"),
        told(options.filter(F.trim(F.coalesce("text", F.lit(""))) == "").select("doc", "task_id").distinct(), "task_id", "option without text"),
        told(alphabets.filter(apart), "task_id", "options differ from instruction"),
        told(met(n_slots.filter("task_type = 'matching_headings'"), labels, ["doc", "task_id"], "left").filter(F.coalesce("n_options", F.lit(0)) <= F.col("n_slots")), "task_id", "too few headings"),
        told(twice(assets, "asset_id"), "asset_id", "asset id twice"),
        told(assets.filter(unsafe).select("doc", "asset_id").distinct(), "asset_id", "asset path unsafe"),
        told(assets.filter("NOT coalesce(stored, false)").select("doc", "asset_id").distinct(), "asset_id", "asset missing"),
        told(met(assets.filter("task_id IS NOT NULL"), tasks.select("doc", "task_id"), ["doc", "task_id"], "left_anti").select("doc", "asset_id").distinct(), "asset_id", "asset of no task"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def group_readiness(groups: DataFrame, issues: DataFrame, key: list[str]) -> DataFrame:
    """ready, review or blocked by the worst issue of each group."""
    worst = issues.groupBy(*key).agg(F.bool_or(F.col("severity") == "blocking").alias("_b"), F.count("*").alias("n_issues"))
    state = F.when(F.col("_b"), "blocked").when(F.col("_b").isNotNull(), "review").otherwise("ready")
    return groups.join(worst, key, "left").select(*key, F.coalesce("n_issues", F.lit(0)).alias("n_issues"), state.alias("state"))


def compare_groups(local: DataFrame, cloud: DataFrame, doc: str) -> DataFrame:
    """(doc, task_id, code) of what two recognitions of a task group disagree
    on. A group is found by its id, else by its set of question numbers.

    Columns on both sides: doc, task_id, numbers (array), task_type, prompt,
    response_prompt, bank (map of label to text, null without one).
    """
    fields = ["task_type", "prompt", "response_prompt", "bank"]
    numbers = lambda c: F.array_join(F.transform(F.array_sort(F.array_distinct(c)), lambda x: x.cast("string")), ",")
    l = local.withColumn("_n", numbers(F.col("numbers")))
    c = cloud.select(doc, F.col("task_id").alias("_id"), numbers(F.col("numbers")).alias("_n"), *[F.col(f).alias(f"c_{f}") for f in fields])
    by_id = l.drop("_n").join(c.drop("_n").withColumnRenamed("_id", "task_id"), [doc, "task_id"])
    rest = l.join(cloud.select(doc, "task_id"), [doc, "task_id"], "left_anti").filter("_n <> ''")
    first = c.groupBy(doc, "_n").agg(F.min_by(F.struct(*[f"c_{f}" for f in fields]), "_id").alias("o"))
    by_numbers = rest.join(first, [doc, "_n"]).select(*l.drop("_n").columns, "o.*")
    j = by_id.unionByName(by_numbers)
    differ = lambda f: (F.trim(F.coalesce(f, F.lit(""))) != "") & (F.trim(F.coalesce(f"c_{f}", F.lit(""))) != "") & (review_text(F.col(f)) != review_text(F.col(f"c_{f}")))
    entries = lambda f: F.array_sort(F.map_entries(f))
    rules = [
        ("task type conflict", ~F.col("task_type").eqNullSafe(F.col("c_task_type"))),
        ("prompt conflict", differ("prompt")),
        ("response prompt conflict", differ("response_prompt")),
        ("option bank conflict", F.col("bank").isNotNull() & F.col("c_bank").isNotNull() & (entries("bank") != entries("c_bank"))),
        ("option bank missing locally", F.col("bank").isNull() & (F.size("c_bank") > 0)),
    ]
    return j.select(doc, "task_id", F.explode(_listed(rules)).alias("code"))


def slot_interactions(slots: DataFrame) -> DataFrame:
    """Slots (interaction, answer_kind) whose answer can't come from their
    interaction: text needs a text, choosing an option; an open one may be."""
    needs = F.when(F.col("interaction") == "text", F.lit("text")).otherwise("option")
    known = (F.trim(F.coalesce("interaction", F.lit(""))) != "") & ~F.coalesce("answer_kind", F.lit("unresolved")).isin("unresolved", "")
    return slots.filter(known & (F.col("answer_kind") != needs))


def significant_uncovered(regions: DataFrame, assigned: DataFrame, key: list[str], least_area: float = 0.01) -> DataFrame:
    """Regions of text, tables or figures of a share of the page that no task
    has: key, kind, area."""
    r = regions.filter(F.col("kind").isin("text", "table", "figure") & (F.col("area") >= least_area))
    return r.join(assigned.select(*key).distinct(), key, "left_anti")


def verify_source(slots: DataFrame, pages: DataFrame, doc: str) -> DataFrame:
    """Slots (doc, number, answer) against the source text: whether their
    number stands in it, and whether an answer row agrees.

    pages: doc, numbers (array of the numbers in the text), rows (array of
    number and answer).
    """
    from tallyloom.functions.text import squeeze_lower

    row = F.element_at(F.filter("rows", lambda r: r["number"] == F.col("number")), 1)["answer"]
    seen = slots.join(pages, doc, "left").withColumn("_row", F.when(F.exists("rows", lambda r: r["number"] == F.col("number")), row))
    check = F.when(F.col("_row").isNull() | (F.trim(F.coalesce("answer", F.lit(""))) == ""), "not verifiable").when(squeeze_lower(F.col("_row")) == squeeze_lower(F.col("answer")), "agrees").otherwise("contradicts")
    return seen.select(doc, "number", "answer", F.coalesce(F.array_contains("numbers", F.col("number")), F.lit(False)).alias("number_in_source"), check.alias("source_check"))


def adjudicate(decisions: DataFrame, batch: str) -> DataFrame:
    """Which proposals of a batch are applied: all, if every one of them is a
    canonical-empty answer that wasn't edited and that the source confirms;
    else none. Columns needs_review, edited, field, canonical, local,
    proposal, source."""
    from tallyloom.functions.text import squeeze_lower

    key = lambda c: F.coalesce(squeeze_lower(F.col(c)), F.lit(""))
    good = F.col("needs_review") & ~F.col("edited") & (F.col("field") == "answer") & (key("canonical") == "") & (key("local") == key("canonical")) & (key("proposal") != "") & (key("proposal") == key("source"))
    judged = decisions.withColumn("valid", F.coalesce(good, F.lit(False)))
    whole = judged.groupBy(batch).agg(F.bool_and("valid").alias("applied"))
    return judged.join(whole, batch)
