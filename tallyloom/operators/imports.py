"""Import of exported snapshots with all their child tables, and re-scoring
under a token: batch functions from stored tables to stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.sources.durable import kept


def _newer(e: Column, s: Column) -> Column:
    """Whether ``e`` was exported later; by text where either isn't a time. Any
    time is later than none."""
    a, b = e["exported"], s["exported"]
    return F.when(e["at"].isNotNull() & s["at"].isNotNull(), e["at"] > s["at"]).otherwise(F.coalesce(a > b, a.isNotNull() & b.isNull()))


#: A list of files of so many rows goes to every task; a longer one is dealt.
_MOST_SENT = 1 << 18


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that grow with the attempts: neither side goes through
    the driver, however small its compressed files look."""
    return left.join(right.hint("merge"), on, how)


_STATE = ("known", "terminal", "install", "paper", "exported", "at", "facts")
_OUT = "array<struct<file:{file},seq:int,main:boolean,clash:boolean,changed:boolean,outcome:string,note:string,paper:string,install:string>>"


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _step(s: Column, e: Column) -> Column:
    """One attempt of one file meets what is stored of it by then."""
    clash = s["known"] & (~e["terminal"].eqNullSafe(s["terminal"]) | F.coalesce(e["install"] != s["install"], F.lit(False)))
    old = s["known"] & ~_newer(e, s)

    def judged(v: Column) -> Column:
        changed = s["known"] & ~v["clash"] & ~v["old"] & F.coalesce(e["facts"] != s["facts"], F.lit(False))
        outcome = F.when(e["failed"], "failed").when(v["clash"], "conflict").when(v["old"], "skipped").otherwise("imported")
        other = s["known"] & (F.coalesce(e["paper"], F.lit("")) != "") & (F.coalesce(s["paper"], F.lit("")) != "") & (e["paper"] != s["paper"])
        note = F.when(v["clash"], "another terminal or install").when(~e["failed"] & other, "another paper; the stored one is kept")
        take = ~e["failed"] & ~v["clash"] & ~v["old"]
        paper = F.when(take, F.coalesce(F.nullif(s["paper"], F.lit("")), e["paper"])).otherwise(s["paper"])
        install = F.when(take, F.coalesce(s["install"], e["install"])).otherwise(s["install"])
        row = F.struct(*(e[c].alias(c) for c in ("file", "seq", "main")), v["clash"].alias("clash"), changed.alias("changed"), outcome.alias("outcome"), note.alias("note"), paper.alias("paper"), install.alias("install"))
        return F.struct(
            (s["known"] | take).alias("known"),
            F.when(take, e["terminal"]).otherwise(s["terminal"]).alias("terminal"),
            install.alias("install"),
            paper.alias("paper"),
            F.when(take, e["exported"]).otherwise(s["exported"]).alias("exported"),
            F.when(take, e["at"]).otherwise(s["at"]).alias("at"),
            F.when(take, F.coalesce(s["facts"], e["facts"])).otherwise(s["facts"]).alias("facts"),
            F.concat(s["out"], F.array(row)).alias("out"),
        )

    return _bound(F.struct(clash.alias("clash"), old.alias("old")), judged)


def _folded(events: DataFrame, failed: DataFrame | None, n_failed: int = 0) -> DataFrame:
    """Outcome of every event, each attempt's files taken in order."""
    if failed is None:
        e = events.withColumn("failed", F.lit(False))
    else:
        names = failed.select("file", F.lit(True).alias("failed")).hint("broadcast" if n_failed <= _MOST_SENT else "merge")
        e = events.join(names, "file", "left").fillna(False, ["failed"])
    rows = F.sort_array(F.collect_list(F.struct("file", "seq", "main", "failed", "terminal", "install", "paper", "exported", "at", "facts")))
    start = [F.first(f"s_{c}").alias(f"s_{c}") for c in _STATE]
    per = e.groupBy("attempt_id").agg(rows.alias("rows"), *start)
    kind = _OUT.format(file=events.schema["file"].dataType.simpleString())
    state = F.struct(*(F.col(f"s_{c}").alias(c) for c in _STATE), F.array().cast(kind).alias("out"))
    out = per.select("attempt_id", F.aggregate("rows", state, _step, lambda s: s["out"]).alias("out"))
    last = F.array_max(F.transform(F.filter("out", lambda x: x["outcome"] == "imported"), lambda x: F.struct(x["file"], x["seq"])))
    each = out.select("attempt_id", last.alias("_last"), F.explode("out").alias("o")).select("attempt_id", "_last", "o.*")
    return each.withColumn("last", F.coalesce((F.struct("file", "seq") == F.col("_last")) & (F.col("outcome") == "imported"), F.lit(False))).drop("_last")


def judge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """What becomes of every attempt in every file, files taken by name, each
    seeing what the files before it left.

    stored: attempt_id, terminal_id, install_id, paper_id, exported_at and, if
    facts must not change, ``facts`` (a digest). incoming: file, attempt_id,
    main (the attempt that the file is for) and the same columns.

    An identity that differs (terminal, or both installs known and unequal) is
    a conflict. A file fails as a whole, and leaves no trace, if its main
    attempt is missing or in conflict, or if a newer attempt changes facts.
    What isn't newer is skipped; so is an attempt that stands in a file again.
    Another paper is noted and the stored one kept. Columns: file, attempt_id,
    seq, outcome, note, last (it is what stays stored), paper, install.

    Whether a file fails depends on files before it that share an attempt. All
    files are judged side by side, first as if none failed, then again without
    those that did, until no verdict changes: as each depends on earlier files
    only, that is the verdict of taking them one by one. One attempt's history
    is the largest group. What a round finds is written once and read by all
    that ask for it.
    """
    facts = "facts" if "facts" in incoming.columns and "facts" in stored.columns else None
    value = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    names = {"terminal": "terminal_id", "install": "install_id", "paper": "paper_id", "exported": "exported_at", "facts": facts}
    own = stored.select("attempt_id", F.lit(True).alias("s_known"), *(value(c).alias(f"s_{n}") for n, c in names.items()))
    again = W.partitionBy("file", "attempt_id").orderBy(*(value(c) for c in names.values()))
    events = incoming.select("file", "attempt_id", F.coalesce("main", F.lit(False)).alias("main"), F.row_number().over(again).alias("seq"), *(value(c).alias(n) for n, c in names.items()))
    events = _met(events, own, "attempt_id", "left").fillna(False, ["s_known"])
    events = kept(events.withColumns({"at": F.try_to_timestamp("exported"), "s_at": F.try_to_timestamp("s_exported")}))
    failed: DataFrame | None = None
    n_failed = 0
    while True:
        found = kept(_folded(events, failed, n_failed))
        fails = (F.bool_or(F.col("main") & F.col("clash")) | F.bool_or("changed") | ~F.bool_or("main")).alias("f")
        now = kept(found.groupBy("file").agg(fails).filter("f").select("file"))
        n = now.count()
        if n == n_failed and (n == 0 or _met(now, failed, "file", "left_anti").isEmpty()):
            return found.select("file", "attempt_id", "seq", "outcome", "note", "last", "paper", "install")
        failed, n_failed = now, n


def import_snapshots(stored: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(stored tables after the import, outcomes). Both have ``attempts`` and
    any child tables with attempt_id; incoming ones carry ``file`` too. An
    imported attempt keeps a known paper and install, takes all else, and its
    child rows are replaced whole, in every child table."""
    outcomes = judge(stored["attempts"], incoming["attempts"])
    taken = kept(outcomes.filter("last").select("file", "attempt_id", "seq", "paper", "install"))
    names = stored["attempts"].columns
    order = [F.col(c).cast("string") for c in ("terminal_id", "install_id", "paper_id", "exported_at", *(["facts"] if "facts" in names else []))]
    rows = incoming["attempts"].withColumn("seq", F.row_number().over(W.partitionBy("file", "attempt_id").orderBy(*order)))
    new = _met(rows, taken, ["file", "attempt_id", "seq"]).withColumn("paper_id", F.col("paper")).withColumn("install_id", F.col("install")).select(*names)
    out = {"attempts": _met(stored["attempts"], taken, "attempt_id", "left_anti").unionByName(new)}
    for name, old in stored.items():
        if name != "attempts":
            rows = _met(incoming[name], taken, ["file", "attempt_id"], "left_semi").select(*old.columns)
            # Old rows go even where the new snapshot has none.
            out[name] = _met(old, taken, "attempt_id", "left_anti").unionByName(rows)
    return out, outcomes


def file_outcomes(outcomes: DataFrame) -> DataFrame:
    """file, status (ok, skipped, failed), imported, conflicts of each file."""
    count = lambda x: F.count(F.when(F.col("outcome") == x, 1))
    status = F.when(count("failed") > 0, "failed").when(count("imported") > 0, "ok").otherwise("skipped")
    return outcomes.groupBy("file").agg(status.alias("status"), count("imported").alias("imported"), count("conflict").alias("conflicts"))


def rejudge(attempts: DataFrame, answers: DataFrame, passages: DataFrame, overrides: DataFrame, rule: dict) -> DataFrame:
    """Wrong answers that a rule would accept: attempt_id, passage_index,
    question_id, answer, weight, review_version.

    rule: scope (paper, exam or slot), accepted (answers), and paper; exam and
    hash; or exam, hash and slot; modality (reading if not said). Only
    submitted attempts and answers without an active override of the modality
    count. For listening ``answers`` and ``passages`` have no passage_index,
    one row of ``passages`` says the exam of an attempt, and the index that is
    returned is -1. An answer that is a JSON list counts as its only member.
    """
    scope = rule.get("scope")
    needs = {"paper": ("paper",), "exam": ("exam", "hash"), "slot": ("exam", "hash", "slot")}
    if scope not in needs or any(rule.get(k) is None for k in needs[scope]):
        raise ValueError("the rule doesn't say what it is for")
    accepted = [" ".join(x.split()).lower() for x in rule.get("accepted", ())]
    if not accepted or not all(accepted):
        raise ValueError("the rule accepts nothing")
    a = attempts.filter(F.col("status") == "submitted")
    if rule.get("paper") is not None:
        a = a.filter(F.col("paper_id") == rule["paper"])
    modality = rule.get("modality", "reading")
    if modality not in ("reading", "listening"):
        raise ValueError(f"no modality {modality}")
    place = ["attempt_id"] if modality == "listening" else ["attempt_id", "passage_index"]
    p = passages.select(*place, "exam_id", "content_hash")
    if rule.get("exam") is not None:
        p = p.filter(F.col("exam_id") == rule["exam"])
    if rule.get("hash") is not None:
        p = p.filter(F.col("content_hash") == rule["hash"])
    members = F.when(F.col("answer").startswith("["), F.from_json("answer", "array<string>"))
    one = F.when(members.isNull(), F.col("answer")).when(F.size(members) == 1, F.get(members, F.lit(0)))
    w = answers.filter((F.col("is_correct") == 0) & F.lower(F.trim(F.regexp_replace(one, r"\s+", " "))).isin(accepted))
    if rule.get("slot") is not None:
        w = w.filter(F.col("question_id") == rule["slot"])
    own = F.coalesce("modality", F.lit("reading")) == modality if "modality" in overrides.columns else F.lit(modality == "reading")
    active = overrides.filter(~F.col("revoked") & own).select(*place, "question_id")
    j = w.join(a.select("attempt_id", "review_version"), "attempt_id").join(p, place).join(active, [*place, "question_id"], "left_anti")
    index = F.lit(-1) if modality == "listening" else F.col("passage_index")
    return j.select("attempt_id", index.alias("passage_index"), "question_id", "answer", "weight", "review_version")


def rejudge_token(affected: DataFrame, rule_text: str) -> DataFrame:
    """One row (n, token): a hash of the rule and of every affected row with
    its review version, whatever their order."""
    row = F.concat_ws("/", *[F.col(c).cast("string") for c in ("attempt_id", "passage_index", "question_id", "answer", "review_version")])
    number = F.conv(F.substring(F.sha2(row, 256), 1, 12), 16, 10).cast("decimal(30,0)")
    total = affected.agg(F.count("*").alias("n"), F.coalesce(F.sum(number), F.lit(0)).alias("s"))
    return total.select("n", F.sha2(F.concat_ws("|", F.lit(rule_text), F.col("n").cast("string"), F.col("s").cast("decimal(38,0)").cast("string")), 256).alias("token"))


def rejudge_apply(affected: DataFrame, answers: DataFrame, rule_text: str, expected: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(overrides, run): the overrides of a rule whose token, computed again
    over the present rows, is the ``expected`` one (one row, ``token``); none
    otherwise. The run row says which it was, and how many."""
    now = rejudge_token(affected, rule_text)
    same = now.join(F.broadcast(expected.select("token").withColumn("_same", F.lit(True))), "token", "left")  # one row
    run = same.select(F.lit(run_id).alias("run_id"), F.when(F.col("_same"), "applied").otherwise("conflict").alias("outcome"), F.when(F.col("_same"), F.col("n")).otherwise(0).alias("n"))
    keys = ["attempt_id", "passage_index", "question_id"]
    rows = affected.select(*keys).join(answers, keys).withColumn("run_id", F.lit(run_id)).join(F.broadcast(run.filter("outcome = 'applied'").select("run_id")), "run_id", "left_semi")
    made = rows.select(
        F.concat_ws("-", "run_id", *(F.col(c).cast("string") for c in keys)).alias("override_id"), *keys,
        F.col("answer").alias("original_answer"), F.col("is_correct").alias("original_correct"), F.col("score").alias("original_score"), F.col("weight").alias("new_score"), F.lit(False).alias("revoked"), "run_id",
    )
    return made, run


def rejudge_audit(affected: DataFrame, attempts: DataFrame, run: DataFrame, rule_text: str, operator: str) -> tuple[DataFrame, DataFrame]:
    """(attempts, audit) after a run: each attempt that an applied run touches
    is a review version later, and the run has one audit row with how many
    attempts and answers it touched; a run in conflict has neither."""
    applied = F.broadcast(run.filter("outcome = 'applied'").select("run_id"))  # one row
    touched = affected.groupBy("attempt_id").agg(F.count("*").alias("_n")).join(applied)
    new = attempts.join(touched.select("attempt_id", "_n"), "attempt_id", "left").withColumn("review_version", F.col("review_version") + F.when(F.col("_n").isNotNull(), 1).otherwise(0)).drop("_n")
    audit = touched.groupBy("run_id").agg(F.count("*").alias("attempts"), F.sum("_n").alias("answers"))
    return new, audit.select("run_id", F.lit("apply_rejudge").alias("action"), F.lit(operator).alias("operator"), F.lit(rule_text).alias("rule"), "attempts", "answers")


def revoke_checked(overrides: DataFrame, requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """Requests (override_id, version) with their outcome: only an active
    override of an attempt at that review version is revoked."""
    o = overrides.select("override_id", "attempt_id", "revoked")
    j = requests.join(o, "override_id", "left").join(attempts.select("attempt_id", "review_version"), "attempt_id", "left")
    outcome = F.when(F.col("revoked").isNull(), "no such override").when(F.col("revoked"), "already revoked").when(F.col("version") != F.col("review_version"), "stale version").otherwise("revoked")
    return j.select("override_id", outcome.alias("outcome"))
