"""Queries of the remaining inventory: imports, re-scoring, quality, page
structure, metrics and text functions, each with its statement where SQL can
say the same; the others are tested against plain Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom import roles as R
from tallyloom.functions import documents, questions, similarity, text
from tallyloom.operators import imports, json_diff, layout, metrics, quality, reconcile, split
from tallyloom.plans.registry import query
from tallyloom.roles import FACTS, ROLES
from tallyloom.sources import workbook
from tallyloom.sources.durable import kept, kept_folder

S = SparkSession
BASE = f"WITH {ROLES}"
ALL = f"WITH {ROLES}{FACTS}"
read = R.read

# --- imports and re-scoring -------------------------------------------------

_CLASH = "s.known AND (e.terminal IS DISTINCT FROM s.terminal OR coalesce(e.install <> s.install, false))"
_OLD = "s.known AND NOT CASE WHEN e.at IS NOT NULL AND s.at IS NOT NULL THEN e.at > s.at ELSE coalesce(e.exported > s.exported, s.exported IS NULL AND e.exported IS NOT NULL) END"
_TAKE = f"(NOT e.failed AND NOT ({_CLASH}) AND NOT ({_OLD}))"
_EVENT = "'file': file, 'main': main, 'failed': failed, 'known': false, 'terminal': terminal_id, 'install': install_id, 'paper': paper_id, 'exported': exported_at, 'at': TRY_CAST(exported_at AS TIMESTAMPTZ), 'facts': facts, 'out': []::STRUCT(file BIGINT, main BOOLEAN, clash BOOLEAN, changed BOOLEAN, outcome VARCHAR, note VARCHAR, paper VARCHAR, install VARCHAR)[]"
_FIRST = "'file': 0::BIGINT, 'main': false, 'failed': false, 'known': known, 'terminal': s_terminal, 'install': s_install, 'paper': s_paper, 'exported': s_exported, 'at': TRY_CAST(s_exported AS TIMESTAMPTZ), 'facts': s_facts, 'out': []::STRUCT(file BIGINT, main BOOLEAN, clash BOOLEAN, changed BOOLEAN, outcome VARCHAR, note VARCHAR, paper VARCHAR, install VARCHAR)[]"
_PAPER = f"CASE WHEN {_TAKE} THEN coalesce(nullif(s.paper, ''), e.paper) ELSE s.paper END"
_INSTALL = f"CASE WHEN {_TAKE} THEN coalesce(s.install, e.install) ELSE s.install END"
_FOLD = f"""{{'file': e.file, 'main': e.main, 'failed': e.failed, 'known': s.known OR {_TAKE}, 'terminal': CASE WHEN {_TAKE} THEN e.terminal ELSE s.terminal END, 'install': {_INSTALL}, 'paper': {_PAPER},
  'exported': CASE WHEN {_TAKE} THEN e.exported ELSE s.exported END, 'at': CASE WHEN {_TAKE} THEN e.at ELSE s.at END, 'facts': CASE WHEN {_TAKE} THEN coalesce(s.facts, e.facts) ELSE s.facts END,
  'out': list_append(s.out, {{'file': e.file, 'main': e.main, 'clash': {_CLASH}, 'changed': NOT ({_CLASH}) AND NOT ({_OLD}) AND s.known AND coalesce(e.facts <> s.facts, false),
    'outcome': CASE WHEN e.failed THEN 'failed' WHEN {_CLASH} THEN 'conflict' WHEN {_OLD} THEN 'skipped' ELSE 'imported' END,
    'note': CASE WHEN {_CLASH} THEN 'another terminal or install' WHEN NOT e.failed AND s.known AND e.paper <> '' AND s.paper <> '' AND e.paper <> s.paper THEN 'another paper; the stored one is kept' END, 'paper': {_PAPER}, 'install': {_INSTALL}}})}}"""


def _judged(rounds: int = 5) -> str:
    """Files judged side by side without those that failed the round before;
    as many rounds as chains of failures in the data are long, and more."""
    out = ", none_failed AS (SELECT 0::BIGINT AS file WHERE false)"
    for n in range(rounds):
        out += f"""
, folded{n} AS (SELECT attempt_id, unnest(list_reduce(list_prepend({{{_FIRST}}}, evs), lambda s, e: {_FOLD}).out) AS o FROM (
    SELECT attempt_id, known, s_terminal, s_install, s_paper, s_exported, s_facts, list({{{_EVENT}}} ORDER BY file) AS evs
    FROM (SELECT j.*, j.file IN (SELECT file FROM {f"failed{n - 1}" if n else "none_failed"}) AS failed FROM joined j) GROUP BY ALL))
, failed{n} AS (SELECT o.file AS file FROM folded{n} GROUP BY 1 HAVING bool_or(o.main AND o.clash) OR bool_or(o.changed) OR NOT bool_or(o.main))"""
    return out + f", judged AS (SELECT attempt_id, o.file AS file, o.outcome AS outcome, o.note AS note, o.paper AS paper, o.install AS install, o.outcome = 'imported' AND o.file = max(CASE WHEN o.outcome = 'imported' THEN o.file END) OVER (PARTITION BY attempt_id) AS last FROM folded{rounds - 1})"


#: A first file of many attempts, a later one of one terminal's, and one each of some.
STORED = """
, stored AS (SELECT attempt_id, terminal_id, CASE WHEN attempt_id % 5 <> 0 THEN 'I' || (attempt_id % 2) END AS install_id, paper_id, CASE WHEN attempt_id % 11 <> 0 THEN submitted_at END AS exported_at, CAST(attempt_id % 9 AS VARCHAR) AS facts FROM attempts WHERE attempt_id % 3 <> 0)
, incoming AS (
  SELECT attempt_id % 700 AS file, attempt_id, attempt_id % 4 = 0 AS main, CASE WHEN attempt_id % 41 = 0 THEN 'TX' ELSE terminal_id END AS terminal_id,
    CASE WHEN attempt_id % 29 = 0 THEN 'I9' ELSE 'I' || (attempt_id % 2) END AS install_id, CASE WHEN attempt_id % 19 = 0 THEN 'other' ELSE paper_id END AS paper_id,
    CASE WHEN attempt_id % 2 = 0 THEN '2998-12-31T23:30:00-01:00' ELSE submitted_at END AS exported_at, CAST(attempt_id % 9 + CASE WHEN attempt_id % 601 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS facts FROM attempts
  UNION ALL
  SELECT attempt_id % 300 + 1000, attempt_id, attempt_id % 7 = 0, CASE WHEN attempt_id % 53 = 0 THEN 'TY' ELSE terminal_id END, NULL, paper_id, '2999-01-01T00:15:00Z', NULL FROM attempts WHERE attempt_id % 8 < 3
  UNION ALL
  SELECT attempt_id % 900 + 2000, attempt_id, true, terminal_id, 'I' || (attempt_id % 2), paper_id, '2999-01-01T09:00:00+09:00', NULL FROM attempts WHERE attempt_id % 8 = 0)
, joined AS (SELECT i.*, s.attempt_id IS NOT NULL AS known, s.terminal_id AS s_terminal, s.install_id AS s_install, s.paper_id AS s_paper, s.exported_at AS s_exported, s.facts AS s_facts FROM incoming i LEFT JOIN stored s ON s.attempt_id = i.attempt_id)
""" + _judged()


def _snapshots(spark: S, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    a, k = R.attempts(spark, d), F.col("attempt_id")
    install = F.concat(F.lit("I"), (k % 2).cast("string"))
    none, facts = F.lit(None).cast("string"), (k % 9).cast("string")
    stored = a.filter(k % 3 != 0).select("attempt_id", "terminal_id", F.when(k % 5 != 0, install).alias("install_id"), "paper_id", F.when(k % 11 != 0, F.col("submitted_at")).alias("exported_at"), facts.alias("facts"))

    def files(where, file, main, terminal, install, paper, exported, facts):
        named = {"file": file, "attempt_id": k, "main": main, "terminal_id": terminal, "install_id": install, "paper_id": paper, "exported_at": exported, "facts": facts}
        return a.filter(where).select(*(c.alias(n) for n, c in named.items()))

    t, p = F.col("terminal_id"), F.col("paper_id")
    many = files(F.lit(True), k % 700, k % 4 == 0, F.when(k % 41 == 0, "TX").otherwise(t), F.when(k % 29 == 0, "I9").otherwise(install), F.when(k % 19 == 0, "other").otherwise(p), F.when(k % 2 == 0, "2998-12-31T23:30:00-01:00").otherwise(F.col("submitted_at")), (k % 9 + F.when(k % 601 == 0, 1).otherwise(0)).cast("string"))
    later = files(k % 8 < 3, k % 300 + 1000, k % 7 == 0, F.when(k % 53 == 0, "TY").otherwise(t), none, p, F.lit("2999-01-01T00:15:00Z"), none)
    single = files(k % 8 == 0, k % 900 + 2000, F.lit(True), t, install, p, F.lit("2999-01-01T09:00:00+09:00"), none)
    new = many.unionByName(later).unionByName(single)
    return {"attempts": stored}, {"attempts": new}


def _with_children(spark: S, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    stored, new = _snapshots(spark, d)
    answers = kept(R.answers(spark, d))  # of which passages are made too
    children = {"answers": answers.select("attempt_id", "question_id", "answer"), "passages": R.passages_of(answers).select("attempt_id", "passage_index", "correct"), "suites": R.suites(spark, d)}
    # Ids and files grow with the attempts: they are not for the driver.
    ids, files = stored["attempts"].select("attempt_id").hint("merge"), new["attempts"].select("file", "attempt_id").hint("merge")
    inside = {n: c.join(ids, "attempt_id", "left_semi") for n, c in children.items()}
    # A new snapshot has no first question and doubled passage points.
    changed = {"answers": children["answers"].filter("question_id <> 'q1'").withColumn("answer", F.concat(F.lit("n"), "answer")), "passages": children["passages"].withColumn("correct", F.col("correct") * 2), "suites": children["suites"].filter("total_passages > 1")}
    return stored | inside, new | {n: c.join(files, "attempt_id") for n, c in changed.items()}


@query("mut_import_outcomes", BASE + STORED + "SELECT file, attempt_id, outcome, note FROM judged")
def mut_import_outcomes(spark: S, d: str) -> DataFrame:
    stored, new = _snapshots(spark, d)
    return imports.judge(stored["attempts"], new["attempts"]).select("file", "attempt_id", "outcome", "note")


@query("mut_import_merge", BASE + STORED + """SELECT file, CASE WHEN bool_or(outcome = 'failed') THEN 'failed' WHEN bool_or(outcome = 'imported') THEN 'ok' ELSE 'skipped' END AS status,
  count(*) FILTER (outcome = 'imported') AS imported, count(*) FILTER (outcome = 'conflict') AS conflicts FROM judged GROUP BY 1""")
def mut_import_merge(spark: S, d: str) -> DataFrame:
    """Files imported one by one, each failing as a whole or not at all."""
    stored, new = _snapshots(spark, d)
    return imports.file_outcomes(imports.judge(stored["attempts"], new["attempts"]))


@query("mut_import_attempts", BASE + STORED + """
, t AS (SELECT * FROM judged WHERE last)
SELECT attempt_id, terminal_id, install_id, paper_id, exported_at FROM stored WHERE attempt_id NOT IN (SELECT attempt_id FROM t)
UNION ALL SELECT i.attempt_id, i.terminal_id, t.install, t.paper, i.exported_at FROM t JOIN incoming i ON i.file = t.file AND i.attempt_id = t.attempt_id""")
def mut_import_attempts(spark: S, d: str) -> DataFrame:
    return imports.import_snapshots(*_snapshots(spark, d))[0]["attempts"].select("attempt_id", "terminal_id", "install_id", "paper_id", "exported_at")


@query("mut_import_children", BASE + STORED + """
, t AS (SELECT attempt_id FROM judged WHERE last), s AS (SELECT attempt_id FROM stored)
SELECT 'answers' AS child, attempt_id, question_id AS key, answer AS value FROM answers WHERE attempt_id IN (SELECT * FROM s) AND attempt_id NOT IN (SELECT * FROM t)
UNION ALL SELECT 'answers', attempt_id, question_id, 'n' || answer FROM answers WHERE attempt_id IN (SELECT * FROM t) AND question_id <> 'q1'
UNION ALL SELECT 'passages', attempt_id, CAST(passage_index AS VARCHAR), CAST(CAST(correct AS BIGINT) AS VARCHAR) FROM passages WHERE attempt_id IN (SELECT * FROM s) AND attempt_id NOT IN (SELECT * FROM t)
UNION ALL SELECT 'passages', attempt_id, CAST(passage_index AS VARCHAR), CAST(CAST(correct * 2 AS BIGINT) AS VARCHAR) FROM passages WHERE attempt_id IN (SELECT * FROM t)
UNION ALL SELECT 'suites', attempt_id, 'total', CAST(total_passages AS VARCHAR) FROM suites WHERE attempt_id IN (SELECT * FROM s) AND attempt_id NOT IN (SELECT * FROM t)
UNION ALL SELECT 'suites', attempt_id, 'total', CAST(total_passages AS VARCHAR) FROM suites WHERE attempt_id IN (SELECT * FROM t) AND total_passages > 1""")
def mut_import_children(spark: S, d: str) -> DataFrame:
    out, _ = imports.import_snapshots(*_with_children(spark, d))
    row = lambda name, key, value: out[name].select(F.lit(name).alias("child"), "attempt_id", key.cast("string").alias("key"), value.cast("string").alias("value"))
    parts = [row("answers", F.col("question_id"), F.col("answer")), row("passages", F.col("passage_index"), F.col("correct").cast("long")), row("suites", F.lit("total"), F.col("total_passages"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


RULES = {
    "paper": {"scope": "paper", "paper": "1995", "accepted": [" a1 ", "A4"]},
    "exam": {"scope": "exam", "exam": "E1", "hash": "h0", "accepted": ["A2"]},
    "slot": {"scope": "slot", "exam": "E2", "hash": "h1", "slot": "q4", "accepted": ["a0", "A5"]},
}
AFFECTED = """
, versions AS (SELECT *, attempt_id % 3 + 1 AS review_version FROM attempts), exams AS (SELECT attempt_id, passage_index, 'E' || (attempt_id % 3) AS exam_id, 'h' || (attempt_id % 2) AS content_hash FROM passages)
, affected AS (
  SELECT r.scope, w.attempt_id, w.passage_index, w.question_id, w.answer, w.weight, v.review_version FROM answers w JOIN versions v ON v.attempt_id = w.attempt_id AND v.status = 'submitted'
  JOIN exams e ON e.attempt_id = w.attempt_id AND e.passage_index = w.passage_index
  JOIN (VALUES ('paper', '1995', NULL, NULL, NULL, ['a1', 'a4']), ('exam', NULL, 'E1', 'h0', NULL, ['a2']), ('slot', NULL, 'E2', 'h1', 'q4', ['a0', 'a5'])) r(scope, paper, exam, hash, slot, accepted)
    ON (r.paper IS NULL OR v.paper_id = r.paper) AND (r.exam IS NULL OR e.exam_id = r.exam) AND (r.hash IS NULL OR e.content_hash = r.hash) AND (r.slot IS NULL OR w.question_id = r.slot) AND list_contains(r.accepted, lower(w.answer))
  WHERE w.is_correct = 0 AND NOT EXISTS (SELECT 1 FROM overrides o WHERE o.attempt_id = w.attempt_id AND o.passage_index = w.passage_index AND o.question_id = w.question_id AND NOT revoked))
"""
TOKENS = AFFECTED + """
, tokens AS (SELECT s.scope, count(a.attempt_id) AS n, sha256(s.scope || '|' || count(a.attempt_id) || '|' || CAST(coalesce(sum(CAST(('0x' || left(sha256(concat_ws('/', attempt_id, passage_index, question_id, answer, review_version)), 12)) AS BIGINT)), 0) AS VARCHAR)) AS token
  FROM (VALUES ('paper'), ('exam'), ('slot')) s(scope) LEFT JOIN affected a ON a.scope = s.scope GROUP BY 1)
"""


def _rejudged(spark: S, d: str, rule: dict) -> DataFrame:
    k = F.col("attempt_id")
    a = R.attempts(spark, d).withColumn("review_version", k % 3 + 1)
    p = R.passages(spark, d).select("attempt_id", "passage_index", F.concat(F.lit("E"), (k % 3).cast("string")).alias("exam_id"), F.concat(F.lit("h"), (k % 2).cast("string")).alias("content_hash"))
    return imports.rejudge(a, R.answers(spark, d), p, R.overrides(spark, d), rule)


@query("mut_rejudge_scopes", BASE + AFFECTED + "SELECT scope, attempt_id, passage_index, question_id, review_version FROM affected")
def mut_rejudge_scopes(spark: S, d: str) -> DataFrame:
    parts = [_rejudged(spark, d, r).select(F.lit(s).alias("scope"), "attempt_id", "passage_index", "question_id", "review_version") for s, r in RULES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LISTENING = {"scope": "slot", "modality": "listening", "exam": "E1", "hash": "h1", "slot": "q3", "accepted": ["A1", " a4"]}


def _listened(spark: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Each attempt's first passage as a listening paper: attempts, answers as
    JSON lists, exams and overrides of both kinds."""
    k = F.col("attempt_id")
    a = R.attempts(spark, d).withColumn("review_version", k % 3 + 1)
    own = R.answers(spark, d).filter("passage_index = 0").drop("passage_index").withColumn("answer", F.to_json(F.array("answer")))
    exams = a.select("attempt_id", F.concat(F.lit("E"), (k % 3).cast("string")).alias("exam_id"), F.concat(F.lit("h"), (k % 2).cast("string")).alias("content_hash"))
    return a, own, exams, R.overrides(spark, d).withColumn("modality", F.when(F.col("original_answer") == "Z", "listening").otherwise("reading"))


@query("mut_rejudge_listening", BASE + """
SELECT w.attempt_id, w.question_id, w.attempt_id % 3 + 1 AS review_version FROM answers w JOIN attempts t ON t.attempt_id = w.attempt_id AND t.status = 'submitted'
WHERE w.passage_index = 0 AND w.is_correct = 0 AND w.attempt_id % 3 = 1 AND w.attempt_id % 2 = 1 AND w.question_id = 'q3' AND w.answer IN ('A1', 'A4')
  AND NOT EXISTS (SELECT 1 FROM overrides o WHERE o.attempt_id = w.attempt_id AND o.question_id = w.question_id AND NOT o.revoked AND o.original_answer = 'Z')""")
def mut_rejudge_listening(spark: S, d: str) -> DataFrame:
    return imports.rejudge(*_listened(spark, d), LISTENING).select("attempt_id", "question_id", "review_version")


@query("mut_rejudge_audit", BASE + AFFECTED + """
, hit AS (SELECT attempt_id, count(*) AS n FROM affected WHERE scope = 'paper' GROUP BY 1)
SELECT 'versions' AS part, CAST(sum(t.attempt_id % 3 + 1 + CASE WHEN h.n IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n FROM attempts t LEFT JOIN hit h ON h.attempt_id = t.attempt_id
UNION ALL SELECT 'attempts', count(*) FROM hit UNION ALL SELECT 'answers', CAST(sum(n) AS BIGINT) FROM hit""")
def mut_rejudge_audit(spark: S, d: str) -> DataFrame:
    """Review versions and the audit row after a run over a paper."""
    affected = _rejudged(spark, d, RULES["paper"])
    seen = imports.rejudge_token(affected, "paper")
    _, run = imports.rejudge_apply(affected, R.answers(spark, d), "paper", seen, "run-1")
    a = R.attempts(spark, d).withColumn("review_version", F.col("attempt_id") % 3 + 1)
    new, audit = imports.rejudge_audit(affected, a, run, "paper", "teacher")
    versions = new.agg(F.sum("review_version").alias("n")).select(F.lit("versions").alias("part"), "n")
    return versions.unionByName(audit.select(F.explode(F.array(*(F.struct(F.lit(c).alias("part"), F.col(c).alias("n")) for c in ("attempts", "answers")))).alias("x")).select("x.*"))


@query("mut_rejudge_token", BASE + TOKENS + "SELECT scope, n, token FROM tokens")
def mut_rejudge_token(spark: S, d: str) -> DataFrame:
    parts = [imports.rejudge_token(_rejudged(spark, d, r), s).select(F.lit(s).alias("scope"), "n", "token") for s, r in RULES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("mut_rejudge_checked", BASE + TOKENS + "SELECT scope AS run_id, CASE WHEN scope = 'slot' THEN 'conflict' ELSE 'applied' END AS outcome, CASE WHEN scope = 'slot' THEN 0 ELSE n END AS n FROM tokens")
def mut_rejudge_checked(spark: S, d: str) -> DataFrame:
    """Runs under the token of their preview; the last preview is older than
    a change of the review versions."""
    runs = []
    for s, r in RULES.items():
        now = _rejudged(spark, d, r)
        seen = now if s != "slot" else now.withColumn("review_version", F.col("review_version") - 1)
        token = imports.rejudge_token(seen, s if s != "slot" else "slot before")
        runs.append(imports.rejudge_apply(now, R.answers(spark, d), s, token, s)[1])
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("mut_override_revoke", BASE + "SELECT override_id, CASE WHEN revoked THEN 'already revoked' WHEN part % 4 + 1 <> attempt_id % 3 + 1 THEN 'stale version' ELSE 'revoked' END AS outcome FROM (SELECT o.*, a.part FROM overrides o JOIN answers a ON a.attempt_id = o.attempt_id AND a.question_id = o.question_id)")
def mut_override_revoke(spark: S, d: str) -> DataFrame:
    o, k = R.overrides(spark, d), F.col("attempt_id")
    asked = o.select("override_id", "attempt_id", "question_id").join(R.answers(spark, d).select("attempt_id", "question_id", "part"), ["attempt_id", "question_id"]).select("override_id", (F.col("part") % 4 + 1).alias("version"))
    return imports.revoke_checked(o, asked, R.attempts(spark, d).withColumn("review_version", k % 3 + 1))


# --- quality and comparison of recognitions ---------------------------------

GROUPS = """
WITH slots AS (SELECT DISTINCT l_orderkey AS task_id, 'r' || (l_linenumber % 2) AS response_id, 's' || l_linenumber AS slot_id, CAST(l_linenumber AS INTEGER) AS number FROM lineitem WHERE l_linenumber % 5 <> 3)
, groups AS (
  SELECT o_orderkey AS task_id, ['cloze', 'multiple_choice', 'matching', 'true_false'][o_orderkey % 4 + 1] AS task_type, CAST(range(1, o_orderkey % 7 + 2) AS INTEGER[]) AS expected,
    CASE WHEN o_orderkey % 9 = 0 THEN [1, 2] ELSE CAST([] AS INTEGER[]) END AS display, CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE o_orderpriority END AS prompt, o_orderkey % 11 = 0 AS ambiguous, o_orderkey % 13 = 0 AS type_conflict,
    o_orderkey % 10 / 10.0 AS confidence, CASE WHEN o_orderkey % 8 = 0 THEN 3 END AS word_limit, CASE WHEN o_orderkey % 12 = 0 THEN 'A-C' END AS alphabet,
    CASE WHEN o_orderkey % 3 = 0 THEN ['one', 'two'] WHEN o_orderkey % 3 = 1 THEN ['one', ' '] END AS bank, CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey % 5 + 1 END AS choose FROM orders)
, responses AS (
  SELECT task_id, response_id, CAST(CASE WHEN task_id % 2 = 0 THEN count(*) ELSE 1 END AS INTEGER) AS n, CASE WHEN task_id % 2 = 0 THEN 'unordered_set' ELSE 'per_slot' END AS assignment, task_id % 7 = 0 AS reuse,
    CASE WHEN task_id % 3 = 0 THEN ['a', 'b', 'c'] WHEN task_id % 3 = 1 THEN ['a'] ELSE CAST([] AS VARCHAR[]) END AS options FROM slots GROUP BY 1, 2)
, held AS (SELECT task_id, response_id, count(*) AS n_slots FROM slots GROUP BY 1, 2)
, r AS (SELECT r.*, n_slots, task_type, choose, bank FROM responses r JOIN held h ON h.task_id = r.task_id AND h.response_id = r.response_id JOIN groups g ON g.task_id = r.task_id)
, per AS (SELECT task_id, sum(n_slots) AS response_slots,
    bool_or(choose IS NOT NULL AND NOT CASE WHEN task_type = 'multiple_choice' AND choose > 1 THEN n_slots = choose AND n = choose AND assignment = 'unordered_set' AND NOT reuse AND len(options) > choose
      ELSE n_slots > 0 AND ((assignment = 'per_slot' AND n = choose) OR (assignment = 'unordered_set' AND n = n_slots)) END) AS policy,
    bool_or(CASE task_type WHEN 'multiple_choice' THEN len(options) < 2 WHEN 'matching' THEN len(coalesce(bank, [])) < 2 OR len(list_filter(bank, lambda x: trim(x) = '')) > 0 WHEN 'true_false' THEN len(options) = 1 ELSE false END) AS options_lack
  FROM r GROUP BY 1)
, nums AS (SELECT task_id, list(DISTINCT number) AS numbers, count(*) AS slots FROM slots GROUP BY 1)
, g AS (SELECT g.*, coalesce(policy, false) AS policy, coalesce(options_lack, false) AS options_lack, response_slots, coalesce(numbers, CAST([] AS INTEGER[])) AS numbers, coalesce(slots, 0) AS slots FROM groups g LEFT JOIN per p ON p.task_id = g.task_id LEFT JOIN nums n ON n.task_id = g.task_id)
, issues AS (
  SELECT task_id, unnest(list_filter([
    CASE WHEN type_conflict THEN 'task type conflict' END,
    CASE WHEN len(expected) <> slots OR (len(display) > 0 AND list_sort(display) <> list_sort(expected)) THEN 'slots differ from instruction' END,
    CASE WHEN len(list_filter(expected, lambda x: NOT list_contains(numbers, x))) > 0 THEN 'question number missing' END,
    CASE WHEN trim(prompt) = '' AND slots > 0 THEN 'prompt empty' END,
    CASE WHEN ambiguous AND slots > 0 THEN 'prompt boundary ambiguous' END,
    CASE WHEN confidence < 0.7 THEN 'instruction unresolved' END,
    CASE WHEN options_lack AND task_type = 'matching' THEN 'option bank missing' END,
    CASE WHEN options_lack AND task_type <> 'matching' THEN 'options incomplete' END,
    CASE WHEN policy THEN 'response policy differs' END,
    CASE WHEN NOT policy AND task_type = 'multiple_choice' AND choose IS NOT NULL AND (response_slots <> len(expected) OR choose > response_slots) THEN 'choice differs from slots' END,
    CASE WHEN task_type = 'cloze' AND alphabet IS NULL AND word_limit IS NULL THEN 'word limit unknown' END], lambda x: x IS NOT NULL)) AS issue FROM g)
"""


def _task_groups(spark: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    none = F.array().cast("array<int>")
    groups = o.select(
        k.alias("task_id"), pick("cloze", "multiple_choice", "matching", "true_false").alias("task_type"), F.sequence(F.lit(1), (k % 7 + 1).cast("int")).alias("expected"), F.when(k % 9 == 0, F.array(F.lit(1), F.lit(2))).otherwise(none).alias("display"),
        F.when(k % 6 == 0, " ").otherwise(F.col("o_orderpriority")).alias("prompt"), (k % 11 == 0).alias("ambiguous"), (k % 13 == 0).alias("type_conflict"), (k % 10 / 10).alias("confidence"), F.when(k % 8 == 0, 3).alias("word_limit"), F.when(k % 12 == 0, "A-C").alias("alphabet"),
        F.when(k % 3 == 0, F.array(F.lit("one"), F.lit("two"))).when(k % 3 == 1, F.array(F.lit("one"), F.lit(" "))).alias("bank"), F.when(k % 5 < 3, k % 5 + 1).alias("choose"),
    )
    n = F.col("l_linenumber")
    slots = read(spark, d, "lineitem").filter("l_linenumber % 5 <> 3").select(F.col("l_orderkey").alias("task_id"), F.concat(F.lit("r"), (n % 2).cast("string")).alias("response_id"), F.concat(F.lit("s"), n.cast("string")).alias("slot_id"), n.cast("int").alias("number")).distinct()
    t = F.col("task_id")
    r = slots.groupBy("task_id", "response_id").agg(F.count("*").alias("c"))
    size = F.when(t % 2 == 0, F.col("c")).otherwise(1).cast("int")
    responses = r.select("task_id", "response_id", size.alias("exact"), size.alias("least"), size.alias("most"), F.when(t % 2 == 0, "unordered_set").otherwise("per_slot").alias("assignment"), (t % 7 == 0).alias("reuse"), F.when(t % 3 == 0, F.array(*map(F.lit, "abc"))).when(t % 3 == 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("options"))
    return groups, responses, slots


@query("rec_quality", GROUPS + "SELECT task_id, issue, CASE WHEN issue = 'instruction unresolved' THEN 'warning' ELSE 'blocking' END AS severity FROM issues")
def rec_quality(spark: S, d: str) -> DataFrame:
    return quality.group_issues(*_task_groups(spark, d), ["task_id"])


@query("rec_quality_state", GROUPS + """
SELECT g.task_id, count(issue) AS n_issues, CASE WHEN count(issue) = 0 THEN 'ready' WHEN bool_or(issue <> 'instruction unresolved') THEN 'blocked' ELSE 'review' END AS state FROM groups g LEFT JOIN issues i ON i.task_id = g.task_id GROUP BY 1""")
def rec_quality_state(spark: S, d: str) -> DataFrame:
    g, r, s = _task_groups(spark, d)
    return quality.group_readiness(g, quality.group_issues(g, r, s, ["task_id"]), ["task_id"])


@query("rec_references", """
WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS number, 's' || l_linenumber AS slot_id, 'r' || (l_suppkey % 4) AS response_id, 't' || (l_suppkey % 4) AS task_id, l_returnflag AS f, l_linestatus AS st, CAST(round(l_tax * 100) AS INTEGER) AS tax, CAST(l_quantity AS INTEGER) AS q, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
, tasks AS (SELECT DISTINCT doc, task_id FROM l WHERE f <> 'R'), responses AS (SELECT DISTINCT doc, response_id, task_id FROM l WHERE st = 'F')
, slots AS (SELECT doc, slot_id, number, response_id, CASE WHEN q > 25 THEN 1 ELSE 9 END AS word_limit FROM l), known AS (SELECT DISTINCT doc, slot_id, response_id, word_limit FROM slots)
, answers AS (SELECT doc, CASE WHEN tax > 6 THEN 's' || (number + 50) ELSE slot_id END AS slot_id, p_name AS answer FROM l WHERE f <> 'N')
, one AS (SELECT doc, slot_id, min(response_id || '/' || word_limit) AS x FROM slots GROUP BY 1, 2)
SELECT doc, CAST(number AS VARCHAR) AS target, 'question number twice' AS issue FROM slots GROUP BY doc, number HAVING count(*) > 1
UNION ALL SELECT doc, response_id, 'response without task' FROM responses r WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.doc = r.doc AND t.task_id = r.task_id)
UNION ALL SELECT doc, slot_id, 'slot without response' FROM one o WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.doc = o.doc AND r.response_id = string_split(o.x, '/')[1])
UNION ALL SELECT DISTINCT doc, slot_id, 'answer without slot' FROM answers a WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.doc = a.doc AND o.slot_id = a.slot_id)
UNION ALL SELECT doc, slot_id, 'slot without answer' FROM one o WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.doc = o.doc AND a.slot_id = o.slot_id)
UNION ALL SELECT DISTINCT o.doc, o.slot_id, 'answer over the word limit' FROM one o JOIN answers a ON a.doc = o.doc AND a.slot_id = o.slot_id JOIN responses r ON r.doc = o.doc AND r.response_id = string_split(o.x, '/')[1] JOIN tasks t ON t.doc = r.doc AND t.task_id = r.task_id
  WHERE len(string_split(trim(a.answer), ' ')) > CAST(string_split(o.x, '/')[2] AS INTEGER)""")
def rec_references(spark: S, d: str) -> DataFrame:
    """References of orders seen as documents: lines as slots, answers by part."""
    l = read(spark, d, "lineitem").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    side = (F.col("l_suppkey") % 4).cast("string")
    l = l.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("number"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("slot_id"), F.concat(F.lit("r"), side).alias("response_id"), F.concat(F.lit("t"), side).alias("task_id"),
        F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("st"), F.round(F.col("l_tax") * 100).cast("int").alias("tax"), F.when(F.col("l_quantity") > 25, 1).otherwise(9).alias("word_limit"), F.col("p_name").alias("answer"),
    )
    l = kept(l)  # every table of the documents is made of it
    none = lambda *cs: [F.lit(None).cast(k).alias(c) for c, k in cs]
    tasks = l.filter("f <> 'R'").select("doc", "task_id").distinct().select("*", F.lit("cloze").alias("task_type"), *none(("alphabet", "array<string>")))
    first = l.groupBy("doc", "slot_id", "number").agg(F.min(F.struct("response_id", "word_limit")).alias("x"), F.count("*").alias("n"))
    slots = first.select("doc", "slot_id", "number", "x.*", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("_")).drop("_")
    answers = l.filter("f <> 'N'").select("doc", F.when(F.col("tax") > 6, F.concat(F.lit("s"), (F.col("number") + 50).cast("string"))).otherwise(F.col("slot_id")).alias("slot_id"), "answer")
    nothing = tasks.filter("false")
    options = nothing.select("doc", "task_id", *none(("label", "string"), ("text", "string")))
    assets = nothing.select("doc", "task_id", *none(("asset_id", "string"), ("path", "string"), ("stored", "boolean")))
    return quality.reference_issues(tasks, l.filter("st = 'F'").select("doc", "response_id", "task_id").distinct(), slots, answers, options, assets)


@query("rec_groups", """
WITH l AS (SELECT p_size AS doc, 't' || p_partkey AS task_id, 'n' || p_partkey AS n, p_type AS task_type, p_name AS prompt, p_brand AS response_prompt, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 3 END AS bank, p_partkey AS k FROM part)
, c AS (SELECT doc, CASE WHEN k % 5 = 0 THEN 'c' || k ELSE task_id END AS task_id, n, CASE WHEN k % 7 = 0 THEN 'OTHER' ELSE task_type END AS task_type, CASE k % 6 WHEN 0 THEN prompt || ' more' WHEN 1 THEN upper(prompt) WHEN 2 THEN '' ELSE prompt END AS prompt,
         CASE WHEN k % 10 = 3 THEN 'Brand' ELSE response_prompt END AS response_prompt, CASE WHEN k % 8 <> 1 THEN k % 3 + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END END AS bank, k FROM l WHERE k % 11 <> 0)
, j AS (SELECT l.doc, l.task_id, l.task_type AS a, c.task_type AS b, l.prompt AS p, c.prompt AS q, l.response_prompt AS rp, c.response_prompt AS rq, l.bank AS x, c.bank AS y FROM l JOIN c ON c.doc = l.doc AND (c.task_id = l.task_id OR (c.n = l.n AND l.k % 5 = 0)))
SELECT doc, task_id, unnest(list_filter([CASE WHEN a <> b THEN 'task type conflict' END, CASE WHEN trim(q) <> '' AND lower(p) <> lower(q) THEN 'prompt conflict' END, CASE WHEN lower(rp) <> lower(rq) THEN 'response prompt conflict' END,
  CASE WHEN x <> y THEN 'option bank conflict' END, CASE WHEN x IS NULL AND y IS NOT NULL THEN 'option bank missing locally' END], lambda v: v IS NOT NULL)) AS code FROM j""")
def rec_groups(spark: S, d: str) -> DataFrame:
    p, k = read(spark, d, "part"), F.col("p_partkey")
    name = lambda a: F.concat(F.lit(a), k.cast("string"))
    bank = lambda v: F.when(v.isNotNull(), F.create_map(F.lit("A"), v.cast("string"), F.lit("B"), F.lit("same")))
    numbers = F.array((k % 100000).cast("int"), (k + 1).cast("int")).alias("numbers")
    local = p.select(F.col("p_size").alias("doc"), name("t").alias("task_id"), numbers, F.col("p_type").alias("task_type"), F.col("p_name").alias("prompt"), F.col("p_brand").alias("response_prompt"), bank(F.when(k % 4 != 0, k % 3)).alias("bank"))
    prompt = F.when(k % 6 == 0, F.concat("p_name", F.lit(" more"))).when(k % 6 == 1, F.upper("p_name")).when(k % 6 == 2, "").otherwise(F.col("p_name"))
    cloud = p.filter(k % 11 != 0).select(
        F.col("p_size").alias("doc"), F.when(k % 5 == 0, name("c")).otherwise(name("t")).alias("task_id"), numbers, F.when(k % 7 == 0, "OTHER").otherwise(F.col("p_type")).alias("task_type"), prompt.alias("prompt"),
        F.when(k % 10 == 3, "Brand").otherwise(F.col("p_brand")).alias("response_prompt"), bank(F.when(k % 8 != 1, k % 3 + F.when(k % 9 == 0, 1).otherwise(0))).alias("bank"),
    )
    return quality.compare_groups(local, cloud, "doc")


@query("rec_slot_interaction", BASE + "SELECT attempt_id, question_id FROM answers WHERE part % 3 < 2 AND part % 4 < 2 AND (part % 3 = 0) <> (part % 4 = 0)")
def rec_slot_interaction(spark: S, d: str) -> DataFrame:
    p = F.col("part")
    a = R.answers(spark, d).select("attempt_id", "question_id", F.when(p % 3 == 0, "text").when(p % 3 == 1, "choice").otherwise("").alias("interaction"), F.when(p % 4 == 0, "text").when(p % 4 == 1, "option").otherwise("unresolved").alias("answer_kind"))
    return quality.slot_interactions(a).select("attempt_id", "question_id")


@query("rec_source", "SELECT p_size AS doc, p_partkey AS region, p_partkey % 50 / 1000.0 AS area FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 50 / 1000.0 >= 0.01 AND p_partkey % 3 <> 0")
def rec_source(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    r = read(spark, d, "part").select(F.col("p_size").alias("doc"), k.alias("region"), F.element_at(F.array(*map(F.lit, ("text", "table", "figure", "decoration"))), (k % 4 + 1).cast("int")).alias("kind"), (k % 50 / 1000).alias("area"))
    return quality.significant_uncovered(r, r.filter("region % 3 = 0"), ["doc", "region"]).select("doc", "region", "area")


@query("rec_source_verify", BASE + """
, p AS (SELECT attempt_id, min(part % 6) AS low FROM answers WHERE part % 5 <> 0 GROUP BY 1)
SELECT a.attempt_id, question_id, p.low IS NOT NULL AND a.part % 6 IN (p.low, p.low + 1) AS number_in_source,
  CASE WHEN p.low IS NULL OR a.part % 6 <> p.low THEN 'not verifiable' WHEN a.answer = 'A1' THEN 'agrees' ELSE 'contradicts' END AS source_check FROM answers a LEFT JOIN p ON p.attempt_id = a.attempt_id""")
def rec_source_verify(spark: S, d: str) -> DataFrame:
    a = R.answers(spark, d).withColumn("number", (F.col("part") % 6).cast("int"))
    low = F.min("number")
    pages = a.filter("part % 5 <> 0").groupBy("attempt_id").agg(F.array(low, low + 1).alias("numbers"), F.array(F.struct(low.alias("number"), F.lit(" a1 ").alias("answer"))).alias("rows"))
    slots = a.select(F.struct("attempt_id", "question_id").alias("slot"), "attempt_id", "number", "answer")
    # One document for each attempt; a slot keeps its own name beside it.
    found = quality.verify_source(slots.select("attempt_id", "number", "answer").distinct(), pages, "attempt_id")
    on = [slots["attempt_id"] == found["attempt_id"], slots["number"] == found["number"], slots["answer"] == found["answer"]]
    return slots.join(found, on).select("slot.attempt_id", "slot.question_id", "number_in_source", "source_check")


@query("rec_adjudicate", BASE + """
, v AS (SELECT attempt_id, question_id, part % 7 <> 0 AND part % 11 <> 0 AND part % 2 = 0 AS valid FROM answers)
SELECT attempt_id, question_id, valid, bool_and(valid) OVER (PARTITION BY attempt_id) AS applied FROM v""")
def rec_adjudicate(spark: S, d: str) -> DataFrame:
    p = F.col("part")
    a = R.answers(spark, d).select("attempt_id", "question_id", (p % 7 != 0).alias("needs_review"), (p % 11 == 0).alias("edited"), F.lit("answer").alias("field"), F.lit(None).cast("string").alias("canonical"), F.lit("").alias("local"), F.lower("answer").alias("proposal"), F.when(p % 2 == 0, F.col("answer")).otherwise("other").alias("source"))
    return quality.adjudicate(a, "attempt_id").select("attempt_id", "question_id", "valid", "applied")


@query("rec_dependency", BASE + "SELECT attempt_id, question_id, 'response ' || passage_index AS dependency FROM answers WHERE passage_index % 2 = 1")
def rec_dependency(spark: S, d: str) -> DataFrame:
    """Slots whose response isn't judged slot by slot, with their group."""
    a = R.answers(spark, d).select("attempt_id", "question_id", "passage_index", F.when(F.col("passage_index") % 2 == 1, "unordered_set").otherwise("per_slot").alias("assignment"))
    return a.filter(F.coalesce("assignment", F.lit("per_slot")) != "per_slot").select("attempt_id", "question_id", F.concat(F.lit("response "), F.col("passage_index").cast("string")).alias("dependency"))


@query("num_score_slot", BASE + """
, s AS (SELECT attempt_id, passage_index, list(answer ORDER BY question_id) AS given FROM answers GROUP BY 1, 2)
SELECT attempt_id, passage_index, given = ['A1', 'A2', 'A3'] AS ordered, list_sort(list_distinct(given)) = ['A1', 'A2', 'A3'] AS as_set FROM s""")
def num_score_slot(spark: S, d: str) -> DataFrame:
    """Option answers in order, or as a set."""
    given = F.transform(F.array_sort(F.collect_list(F.struct("question_id", "answer"))), lambda x: x["answer"])
    g = R.answers(spark, d).groupBy("attempt_id", "passage_index").agg(given.alias("given"))
    right = F.array(F.lit("A1"), F.lit("A2"), F.lit("A3"))
    return g.select("attempt_id", "passage_index", reconcile.options_match(F.col("given"), right, True).alias("ordered"), reconcile.options_match(F.col("given"), right, False).alias("as_set"))


# --- pages, zones and layout ------------------------------------------------

@query("seg_zones", """
WITH l AS (SELECT conv_id AS doc, turn AS seq, CASE turn % 6 WHEN 0 THEN 'Questions ' || (turn + 1) || '–' || (turn + 4) WHEN 5 THEN 'A. ' || text WHEN 3 THEN text ELSE (turn - turn % 6 + turn % 6) || '. ' || text END AS text FROM conversations)
, z AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^(?i)questions? \\d') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS zone FROM l)
, g AS (SELECT doc, CAST(zone AS BIGINT) AS zone, min(CASE WHEN seq % 6 = 0 THEN seq + 1 END) AS first, min(CASE WHEN seq % 6 = 0 THEN seq + 4 END) AS last,
    list(DISTINCT TRY_CAST(regexp_extract(text, '^\\s*(\\d{1,2})[.)]\\s', 1) AS INTEGER)) FILTER (seq % 6 <> 0 AND regexp_matches(text, '^\\s*\\d{1,2}[.)]\\s')) AS stems, count(*) FILTER (seq % 6 <> 0 AND regexp_matches(text, '^\\s*[A-H][.)]\\s')) AS options
  FROM z WHERE zone > 0 GROUP BY 1, 2)
SELECT doc, zone, first, last, len(coalesce(stems, [])) AS stems, options, len(list_filter(range(first, last + 1), lambda x: NOT list_contains(coalesce(stems, []), x))) = 0 AS closed FROM g""")
def seg_zones(spark: S, d: str) -> DataFrame:
    t, x = F.col("turn"), F.col("text")
    number = lambda v: F.concat(v.cast("string"), F.lit(". "), x)
    line = F.when(t % 6 == 0, F.concat(F.lit("Questions "), (t + 1).cast("string"), F.lit("–"), (t + 4).cast("string"))).when(t % 6 == 5, F.concat(F.lit("A. "), x)).when(t % 6 == 3, x).otherwise(number(t))
    return layout.task_zones(read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), t.alias("seq"), line.alias("text")))


@query("seg_pdf_split")
def seg_pdf_split(spark: S, d: str) -> DataFrame:
    """Segments of booklets made of the benchmark's texts, laid out in five
    ways: headings, layout alone, a page shared by two passages, two tests
    with their answers, and questions alone."""
    b, k = read(spark, d, "benchmark"), F.col("item_id")
    prose = F.concat_ws("\n", *[F.concat(F.translate("text", "\n", " "), F.lit(" and so on until the end of this long line"))] * 7)
    asked = lambda a, z: F.concat(F.lit(f"Questions {a}-{z}\n{a} "), F.substring("text", 1, 30))
    titled = lambda n: F.concat(F.lit(f"READING PASSAGE {n}\n"), prose)
    key = F.lit("ANSWER KEY\n" + "\n".join(f"{n} B" for n in range(1, 14)))
    few = "\n".join(f"{n} item" for n in range(9, 14)) + "\n"
    forms = [
        [titled(1), asked(1, 13), titled(2), asked(14, 26), titled(3), asked(27, 40), key],
        [prose, asked(1, 13), prose, asked(14, 26)],
        [titled(1), asked(1, 13), F.concat(F.lit(few), titled(2)), asked(14, 26)],
        [F.concat(F.lit("Test 1\n"), titled(1)), asked(1, 13), F.concat(F.lit("Test 2\n"), titled(1)), asked(1, 13), key],
        [asked(1, 13), asked(14, 26), asked(27, 40)],
    ]
    page = F.lit(None).cast("array<string>")
    for n, form in enumerate(forms):
        page = F.when(k % 5 == n, F.array(*form)).otherwise(page)
    pages = b.select(k.cast("string").alias("doc"), F.posexplode(page).alias("p", "text"))
    return split.split_documents(pages.select("doc", (F.col("p") + 1).alias("page"), "text"))


@query("num_region_kind", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 OR p_size > 44 THEN 'title' WHEN p_partkey % 9 = 1 AND p_partkey % 100 > 86 THEN 'page_number' ELSE 'text' END AS kind FROM part""")
def num_region_kind(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.when(k % 4 == 0, F.concat(F.lit("PART "), k.cast("string"))).when(k % 9 == 1, k.cast("string")).otherwise(F.concat(F.lit("a "), "p_name"))
    return read(spark, d, "part").select("p_partkey", layout.region_kind(t, k % 100, F.col("p_size") - 30, 100.0).alias("kind"))


@query("win_first_anchor_cluster")
def win_first_anchor_cluster(spark: S, d: str) -> DataFrame:
    return layout.running_clusters(read(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "value", 8.0, "first").select("event_id", "cluster")


@query("num_bbox", """
SELECT p_partkey, least(x, u) AS x, least(y, v) AS y, greatest(x + 18, u + 10) - least(x, u) AS width, greatest(y + 12, v + 20) - least(y, v) AS height
FROM (SELECT p_partkey, p_partkey % 50 * 1.0 AS x, p_size * 1.0 AS y, p_partkey % 37 * 2.0 AS u, p_partkey % 11 * 3.0 AS v FROM part)""")
def num_bbox(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    box = lambda x, y, w, h: F.struct((x * 1.0).alias("x"), (y * 1.0).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"))
    p = read(spark, d, "part").select("p_partkey", box(k % 50, F.col("p_size"), 18.0, 12.0).alias("a"), box(k % 37 * 2, k % 11 * 3, 10.0, 20.0).alias("b"))
    return p.select("p_partkey", layout.box_union("a", "b").alias("u")).select("p_partkey", "u.*")


@query("num_overlap_1d", """
SELECT p_partkey, round(greatest(0, least(a1, b1) - greatest(a0, b0)) / greatest(0.01, least(a1 - a0, b1 - b0)), 6) AS share
FROM (SELECT p_partkey % 40 * 1.0::DOUBLE AS a0, p_partkey % 40 + p_size * 1.0::DOUBLE AS a1, p_partkey % 23 * 2.0::DOUBLE AS b0, p_partkey % 23 * 2.0::DOUBLE + p_partkey % 9 AS b1, p_partkey FROM part)""")
def num_overlap_1d(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    a0, b0 = k % 40 * 1.0, k % 23 * 2.0
    return read(spark, d, "part").select("p_partkey", F.round(layout.overlap_column(a0, a0 + F.col("p_size"), b0, b0 + k % 9), 6).alias("share"))


@query("num_word_gap", "SELECT event_id, coalesce(value - lag(value) OVER w > greatest(0.28 * (user_id % 20 + 5), 1.0), false) AS space FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)")
def num_word_gap(spark: S, d: str) -> DataFrame:
    """Whether a gap between neighbours is a space, for pieces without a
    usual gap of their own."""
    w = W.partitionBy("user_id").orderBy("value", "event_id")
    gap = F.col("value") - F.lag("value").over(w)
    return read(spark, d, "events").select("event_id", F.coalesce(gap > F.greatest(28 * (F.col("user_id") % 20 + 5) / 100, F.lit(1.0)), F.lit(False)).alias("space"))


# --- metrics ----------------------------------------------------------------

@query("evl_error_rates", """
WITH c AS (SELECT a.c_custkey, a.c_name || ' ' || a.c_mktsegment || ' of ' || (a.c_custkey % 7) AS r, b.c_name || ' ' || b.c_mktsegment || ' ' || (b.c_custkey % 5) AS p FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1)
, w AS (SELECT *, string_split(r, ' ') AS rw, string_split(p, ' ') AS pw, list_concat(string_split(r, ' '), string_split(p, ' ')) AS e FROM c)
SELECT c_custkey, round(levenshtein(r, p)::DOUBLE / length(r), 6) AS cer,
  round(levenshtein(list_aggregate(list_transform(rw, lambda x: chr(64 + list_position(e, x)::INTEGER)), 'string_agg', ''), list_aggregate(list_transform(pw, lambda x: chr(64 + list_position(e, x)::INTEGER)), 'string_agg', ''))::DOUBLE / len(rw), 6) AS wer FROM w""")
def evl_error_rates(spark: S, d: str) -> DataFrame:
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    a = c.select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment", F.lit("of"), (k % 7).cast("string")).alias("r"))
    b = c.select((k - 1).alias("c_custkey"), F.concat_ws(" ", "c_name", "c_mktsegment", (k % 5).cast("string")).alias("p"))
    return metrics.error_rates(a.join(b, "c_custkey"), "r", "p").select("c_custkey", F.round("cer", 6).alias("cer"), F.round("wer", 6).alias("wer"))


@query("evl_set_scores", BASE + """
, r AS (SELECT DISTINCT attempt_id, question_id FROM answers WHERE part % 3 <> 0), p AS (SELECT DISTINCT attempt_id, question_id FROM answers WHERE part % 4 <> 0)
, j AS (SELECT coalesce(r.attempt_id, p.attempt_id) AS attempt_id, r.question_id AS a, p.question_id AS b FROM r FULL JOIN p ON r.attempt_id = p.attempt_id AND r.question_id = p.question_id)
SELECT attempt_id, count(a) AS reference, count(b) AS predicted, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both, round(CASE WHEN count(a) > 0 THEN count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(a) END, 6) AS recall,
  round(CASE WHEN count(b) > 0 THEN count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(b) END, 6) AS precision, round(2 * count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / (count(a) + count(b)), 6) AS f1 FROM j GROUP BY 1""")
def evl_set_scores(spark: S, d: str) -> DataFrame:
    a = R.answers(spark, d)
    out = metrics.set_scores(a.filter("part % 3 <> 0"), a.filter("part % 4 <> 0"), ["attempt_id"], "question_id")
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "f1")})


@query("evl_macro_f1", """
WITH x AS (SELECT p_brand AS r, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#11' ELSE p_brand END AS p FROM part)
, c AS (SELECT r AS class, 1 AS r, 0 AS p, CASE WHEN r = p THEN 1 ELSE 0 END AS b FROM x UNION ALL SELECT p, 0, 1, 0 FROM x)
SELECT class, round(2 * sum(b) / (sum(r) + sum(p)), 6) AS f1 FROM c GROUP BY 1""")
def evl_macro_f1(spark: S, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_brand").alias("r"), F.when(F.col("p_partkey") % 3 == 0, "Brand#11").otherwise(F.col("p_brand")).alias("p"))
    return metrics.class_scores(p, "r", "p").withColumn("f1", F.round("f1", 6))


@query("evl_gates", """
SELECT p_brand AS metric, round(avg(p_size / 50.0::DOUBLE), 6) AS value, CASE p_brand WHEN 'Brand#11' THEN CASE WHEN avg(p_size / 50.0::DOUBLE) >= 0.5 THEN 'pass' ELSE 'fail' END WHEN 'Brand#12' THEN CASE WHEN avg(p_size / 50.0::DOUBLE) <= 0.5 THEN 'pass' ELSE 'fail' END ELSE 'no target' END AS verdict FROM part GROUP BY 1""")
def evl_gates(spark: S, d: str) -> DataFrame:
    v = read(spark, d, "part").groupBy(F.col("p_brand").alias("metric")).agg(F.avg(F.col("p_size") / 50).alias("value"))
    return metrics.gates(v, [("Brand#11", ">=", 0.5), ("Brand#12", "<=", 0.5)]).withColumn("value", F.round("value", 6))


# --- text, numbers, JSON ----------------------------------------------------

@query("str_answer_norm", BASE + "SELECT attempt_id, question_id, CASE WHEN kind = 'matching' THEN 'q-' || attempt_id ELSE replace('q-' || attempt_id, '-', '') END AS norm FROM answers WHERE kind IS NOT NULL")
def str_answer_norm(spark: S, d: str) -> DataFrame:
    a = R.answers(spark, d).filter("kind IS NOT NULL")
    t = F.concat(F.lit("  Q-"), F.col("attempt_id").cast("string"), F.lit(" "))
    return a.select("attempt_id", "question_id", text.answer_norm(F.when(F.col("kind") == "matching", "matching").otherwise("true_false"), t).alias("norm"))


@query("str_heading", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'passage' WHEN 1 THEN 'test' WHEN 2 THEN 'answers' END AS heading FROM part")
def str_heading(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.when(k % 4 == 0, F.concat(F.lit("READING  Passage "), (k % 3 + 1).cast("string"))).when(k % 4 == 1, F.concat(F.lit("Test "), (k % 9 + 1).cast("string"))).when(k % 4 == 2, "Answer Key").otherwise(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", text.heading(t).alias("heading"))


@query("str_option_label", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN chr(CAST(65 + p_partkey % 8 AS INTEGER)) WHEN 1 THEN 'iv' END AS label, p_name AS text FROM part")
def str_option_label(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.when(k % 3 == 0, F.concat(F.char(65 + k % 8), F.lit(". "), "p_name")).when(k % 3 == 1, F.concat(F.lit("(iv) "), "p_name")).otherwise(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", text.option_label(t).alias("o")).select("p_partkey", "o.label", "o.text")


@query("str_alpha", "SELECT p_partkey, CASE WHEN n > 26 THEN chr(CAST(96 + (n - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(97 + (n - 1) % 26 AS INTEGER)) AS alpha FROM (SELECT p_partkey, p_partkey % 600 + 1 AS n FROM part)")
def str_alpha(spark: S, d: str) -> DataFrame:
    @F.udf(T.StringType(), useArrow=True)
    def named(n: int) -> str:
        return layout.alpha(n)

    return read(spark, d, "part").select("p_partkey", named((F.col("p_partkey") % 600 + 1).cast("int")).alias("alpha"))


@query("str_roman", """
SELECT p_partkey, ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] AS roman
FROM (SELECT p_partkey, p_partkey % 999 + 1 AS n FROM part)""")
def str_roman(spark: S, d: str) -> DataFrame:
    @F.udf(T.StringType(), useArrow=True)
    def named(n: int) -> str:
        return layout.roman(n)

    return read(spark, d, "part").select("p_partkey", named((F.col("p_partkey") % 999 + 1).cast("int")).alias("roman"))


@query("str_utf16_slice", "SELECT doc_id, md5(substring(text, 6, 20)) AS h FROM documents")
def str_utf16_slice(spark: S, d: str) -> DataFrame:
    """Slices by UTF-16 units; the same as by characters inside one plane."""
    return read(spark, d, "documents").select("doc_id", F.md5(similarity.utf16_slice_udf("text", F.lit(5), F.lit(25))).alias("h"))


@query("str_fuzzy_window")
def str_fuzzy_window(spark: S, d: str) -> DataFrame:
    """Where a changed piece of each benchmark text stands in the text."""
    piece = F.concat(F.substring("text", 20, 20), F.lit("##"), F.substring("text", 42, 20))
    return read(spark, d, "benchmark").select("item_id", similarity.fuzzy_udf(piece, F.col("text")).alias("found")).select("item_id", "found.*")


@query("str_qnum_expr", """
SELECT p_partkey, CASE WHEN p_size < 3 THEN NULL ELSE CASE WHEN p_partkey % 2 = 0 THEN 'mixed' ELSE 'set' END END AS kind,
  CASE WHEN p_size < 3 THEN NULL WHEN p_partkey % 2 = 0 THEN array_to_string(list_concat(range(1, p_size + 1), [p_size + 2]), ',') ELSE '1,' || p_size || ',' || (p_size + 2) END AS numbers FROM part""")
def str_qnum_expr(spark: S, d: str) -> DataFrame:
    n = F.col("p_size")
    bad = F.concat(F.lit("Questions 5, "), n.cast("string"))
    mixed = F.concat(F.lit("Questions 1–"), n.cast("string"), F.lit(" and "), (n + 2).cast("string"))
    plain = F.concat(F.lit("Questions 1, "), n.cast("string"), F.lit(" and "), (n + 2).cast("string"), F.lit(" below"))
    t = F.when(n < 3, bad).when(F.col("p_partkey") % 2 == 0, mixed).otherwise(plain)

    @F.pandas_udf("kind string, numbers string")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        found = [questions.question_numbers(x) for x in texts]
        return pd.DataFrame({"kind": [x and x[0] for x in found], "numbers": [x and ",".join(map(str, x[1])) for x in found]})

    return read(spark, d, "part").select("p_partkey", parsed(t).alias("q")).select("p_partkey", "q.*")


@query("str_answer_pairs", "SELECT p_partkey, '1=TRUE|14=' || p_brand || '|27=' || (p_size % 40 + 1) AS pairs FROM part")
def str_answer_pairs(spark: S, d: str) -> DataFrame:
    line = F.concat(F.lit("1 TRUE   14) "), "p_brand", F.lit("  27. "), (F.col("p_size") % 40 + 1).cast("string"))

    @F.pandas_udf(T.StringType())
    def parsed(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: "|".join(f"{n}={a}" for n, a in questions.answer_pairs(x)))

    return read(spark, d, "part").select("p_partkey", parsed(line).alias("pairs"))


@query("num_alignment_report", """
SELECT conv_id, count(*) AS sentences, count(*) FILTER (turn % 3 <> 0) / count(*) >= 0.8 AS matched_ok FROM conversations GROUP BY 1""")
def num_alignment_report(spark: S, d: str) -> DataFrame:
    """Verdict over the turns of a conversation, every third of them unmatched."""
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("the turn number "), F.col("turn").cast("string"), F.lit(" of it")).alias("t"))))

    @F.pandas_udf("sentences long, matched_ok boolean")
    def judged(turns: pd.Series) -> pd.DataFrame:
        out = []
        for v in turns:
            r = questions.alignment_report([(x["t"], 0.0 if x["turn"] % 3 == 0 else 1.0, x["turn"]) for x in v], 100, 100, 1.0)
            out.append((len(v), bool(r["matched_ok"])))
        return pd.DataFrame(out, columns=["sentences", "matched_ok"])

    return read(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("v")).select("conv_id", judged("v").alias("r")).select("conv_id", "r.*")


@query("num_seeded_shuffle")
def num_seeded_shuffle(spark: S, d: str) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def drawn(seeds: pd.Series) -> pd.Series:
        return seeds.map(lambda s: questions.shuffled(list(range(30)), s, 6))

    return read(spark, d, "benchmark").select("item_id", drawn(F.col("item_id").cast("string")).alias("drawn"))


@query("seg_answer_page", """
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
, p AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, coalesce(n, 0) AS n, o_orderstatus = 'F' AS headed, left(o_orderpriority, 1) = '1' AS asks FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
, q AS (SELECT *, NOT asks AND ((headed AND n >= 3) OR (n >= 8)) AS starts, NOT asks AND n >= 3 AND 2 * n >= greatest(n + CASE WHEN headed THEN 1 ELSE 0 END + CASE WHEN asks THEN 1 ELSE 0 END, 1) AS goes_on FROM p)
, i AS (SELECT *, sum(CASE WHEN starts OR goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page) AS island FROM q)
SELECT CAST(doc AS VARCHAR) AS doc, CAST(page AS INTEGER) AS page, (starts OR goes_on) AND bool_or(starts) OVER (PARTITION BY doc, island ORDER BY page) AS answers FROM i""")
def seg_answer_page(spark: S, d: str) -> DataFrame:
    """Answer pages of customers seen as booklets, an order a page: a dense page
    or one under a heading begins them, a thinner one goes on."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(" "), x["l_returnflag"])), "\n").alias("t"))
    o = read(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.concat_ws("\n", F.when(F.col("o_orderstatus") == "F", "ANSWER KEY"), F.when(F.col("o_orderpriority").startswith("1"), "Questions 1-5"), "t")
    pages = o.select(F.col("o_custkey").cast("string").alias("doc"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"), text.alias("text"))
    return split.with_answer_pages(split.page_signals(pages)).select("doc", "page", F.col("is_answers").alias("answers"))


@query("js_text_concat", "SELECT c_custkey, c_name || ' ' || c_mktsegment AS t FROM customer")
def js_text_concat(spark: S, d: str) -> DataFrame:
    import json

    doc = F.to_json(F.struct(F.struct(F.col("c_name").alias("text"), F.lit("x").alias("id")).alias("head"), F.array(F.struct(F.lit("p").alias("kind"), F.struct(F.col("c_mktsegment").alias("text")).alias("content"))).alias("body")))

    @F.pandas_udf(T.StringType())
    def gathered(docs: pd.Series) -> pd.Series:
        return docs.map(lambda x: documents.gather_text(json.loads(x)))

    return read(spark, d, "customer").select("c_custkey", gathered(doc).alias("t"))


@query("js_structural_equal", """
WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, lag(o_orderstatus) OVER w AS s0, lag(o_orderpriority) OVER w AS p0 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey, s = s0 AND p = p0 AS same FROM o WHERE s0 IS NOT NULL""")
def js_structural_equal(spark: S, d: str) -> DataFrame:
    """Whether an order's document equals that of the customer's order before
    it, whatever the order of its keys and its white space."""
    one = F.concat(F.lit('{"status":"'), F.col("o_orderstatus"), F.lit('","more":{"p":["'), F.col("o_orderpriority"), F.lit('"]}}'))
    other = F.concat(F.lit('{ "more" : {"p": [ "'), F.col("o_orderpriority"), F.lit('"] }, "status": "'), F.col("o_orderstatus"), F.lit('" }'))
    o = read(spark, d, "orders").select("o_orderkey", one.alias("a"), F.lag(other).over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("b"))
    return o.filter("b IS NOT NULL").select("o_orderkey", json_diff.same_value(F.col("a"), F.col("b")).alias("same"))


@query("dt_format", BASE + """
SELECT attempt_id, CASE WHEN d IS NULL THEN '—' ELSE (d // 60) || 'm ' || (d % 60) || 's' END AS duration, strftime(CAST(replace(submitted_at, 'Z', '') AS TIMESTAMP), '%Y-%m-%d %H:%M') AS at
FROM (SELECT t.attempt_id, submitted_at, CAST(p.d AS BIGINT) AS d FROM attempts t LEFT JOIN (SELECT attempt_id, sum(duration_sec) AS d FROM passages GROUP BY 1) p ON p.attempt_id = t.attempt_id)""")
def dt_format(spark: S, d: str) -> DataFrame:
    p = R.passages(spark, d).groupBy("attempt_id").agg(F.sum("duration_sec").cast("long").alias("d"))
    n = F.col("d")
    span = F.when(n.isNull(), "—").otherwise(F.concat(F.floor(n / 60).cast("string"), F.lit("m "), (n % 60).cast("string"), F.lit("s")))
    return R.attempts(spark, d).join(p, "attempt_id", "left").select("attempt_id", span.alias("duration"), F.date_format(F.to_timestamp("submitted_at"), "yyyy-MM-dd HH:mm").alias("at"))


# --- exports ----------------------------------------------------------------

@query("snk_export", ALL + """
SELECT 'scores' AS sheet, count(*) AS n FROM valid UNION ALL SELECT 'details', count(*) FROM effective e JOIN valid v ON v.attempt_id = e.attempt_id
UNION ALL SELECT 'items', count(*) FROM (SELECT DISTINCT passage_index, question_id FROM effective e JOIN valid v ON v.attempt_id = e.attempt_id) UNION ALL SELECT 'kinds', count(*) FROM (SELECT DISTINCT coalesce(kind, '') FROM effective e JOIN valid v ON v.attempt_id = e.attempt_id)
UNION ALL SELECT 'exceptions', count(*) FROM validity WHERE reason IS NOT NULL UNION ALL SELECT 'adjusted', count(*) FROM effective e JOIN valid v ON v.attempt_id = e.attempt_id WHERE overridden
UNION ALL SELECT 'writing', count(*) FROM conversations WHERE role = 'user' UNION ALL SELECT 'listening', count(*) FROM submitted""")
def snk_export(spark: S, d: str) -> DataFrame:
    """The eight tables of an export, with the rows of each."""
    from tallyloom.plans import sheets

    out = None
    for name, df in sheets.export_tables(spark, d).items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("sheet"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("snk_xlsx", ALL + """
, d AS (SELECT e.* FROM effective e JOIN valid v ON v.attempt_id = e.attempt_id)
SELECT 'items' AS sheet, count(*) AS n, 4 AS columns FROM (SELECT DISTINCT passage_index, question_id FROM d) UNION ALL SELECT 'kinds', count(*), 3 FROM (SELECT DISTINCT coalesce(kind, '') FROM d)
UNION ALL SELECT 'scores', count(*), 8 FROM valid UNION ALL SELECT 'details', count(*), 20 FROM d UNION ALL SELECT 'adjusted', count(*), 20 FROM d WHERE overridden
UNION ALL SELECT 'exceptions', count(*), 2 FROM validity WHERE reason IS NOT NULL UNION ALL SELECT 'writing', count(*), 3 FROM conversations WHERE role = 'user' UNION ALL SELECT 'listening', count(*), 3 FROM submitted""")
def snk_xlsx(spark: S, d: str) -> DataFrame:
    """Rows and columns of the eight sheets of an export that were written to
    workbooks, as they are read back from them. A sheet holds 2^20 rows at
    most, by its format; more go to sheets of its name in further workbooks."""
    from tallyloom.plans import sheets

    path = kept_folder(spark, "export")
    workbook.write_workbooks(sheets.export_tables(spark, d), path)
    rows = F.count(F.when(F.col("row") > 0, 1))
    return workbook.read_workbooks(spark, path).groupBy("sheet").agg(rows.alias("n"), F.max(F.size("cells")).alias("columns"))
