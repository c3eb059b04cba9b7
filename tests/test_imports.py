"""Import of several files against taking them one by one."""

import random
from datetime import datetime

from tallyloom.operators import imports

STORED = "attempt_id long, terminal_id string, install_id string, paper_id string, exported_at string, facts string"
INCOMING = "file string, attempt_id long, main boolean, terminal_id string, install_id string, paper_id string, exported_at string, facts string"


def later(a, b):
    try:
        return datetime.fromisoformat(a) > datetime.fromisoformat(b)
    except (TypeError, ValueError):
        return b is None and a is not None if a is None or b is None else a > b


def one_by_one(stored, incoming):
    """(stored after, {(file, attempt): outcomes}) of whole files in order."""
    now, out = {r[0]: list(r[1:]) for r in stored}, {}
    for f in sorted({r[0] for r in incoming}):
        rows = sorted((r for r in incoming if r[0] == f), key=lambda r: (r[1], tuple((x is not None, x or "") for x in r[3:])))
        trial, said, failed = {k: list(v) for k, v in now.items()}, [], not any(r[2] for r in rows)
        for _, a, main, t, i, p, e, facts in rows:
            had = trial.get(a)
            if had and (t != had[0] or (i and had[1] and i != had[1])):
                failed |= bool(main)
                said.append((a, "conflict"))
            elif had and not later(e, had[3]):
                said.append((a, "skipped"))
            else:
                failed |= bool(had and facts and had[4] and facts != had[4])
                trial[a] = [t, (had[1] if had else None) or i, (had[2] if had else None) or p, e, (had[4] if had else None) or facts]
                said.append((a, "imported"))
        for a, outcome in said:
            out.setdefault((f, a), []).append("failed" if failed else outcome)
        now = now if failed else trial
    return now, out


def result(spark, stored, incoming):
    s, i = spark.createDataFrame(stored, STORED), spark.createDataFrame(incoming, INCOMING)
    after, outcomes = imports.import_snapshots({"attempts": s}, {"attempts": i})
    got = {}
    for r in outcomes.orderBy("seq").collect():
        got.setdefault((r.file, r.attempt_id), []).append(r.outcome)
    return {r[0]: list(r[1:5]) for r in after["attempts"].collect()}, got, after["attempts"].count(), imports.file_outcomes(outcomes)


def test_the_three_cases(spark):
    stored = [(1, "T1", None, "P", None, None)]
    incoming = [
        ("a", 7, True, "T1", None, "P", "2024-01-01T10:00:00+09:00", None),  # an hour before the next in truth
        ("b", 7, True, "T1", None, "P", "2024-01-01T02:00:00Z", None),
        ("c", 8, True, "T1", None, "P", "2024-01-01T00:00:00Z", None),  # new, claimed by two terminals
        ("d", 8, True, "T2", None, "P", "2024-01-02T00:00:00Z", None),
        ("e", 9, True, "T1", None, "P", "2024-01-01T00:00:00Z", None),  # twice in its file
        ("e", 9, True, "T1", None, "P", "2024-01-01T00:00:00Z", None),
        ("f", 1, True, "T9", None, "P", "2024-01-01T00:00:00Z", None),  # stored without a time: known all the same
    ]
    rows, got, n, files = result(spark, stored, incoming)
    assert got == {("a", 7): ["imported"], ("b", 7): ["imported"], ("c", 8): ["imported"], ("d", 8): ["failed"], ("e", 9): ["imported", "skipped"], ("f", 1): ["failed"]}
    assert n == 4 and rows[7][3] == "2024-01-01T02:00:00Z" and rows[8][0] == "T1" and rows[1] == ["T1", None, "P", None]
    assert {r.file: r.status for r in files.collect()} == {"a": "ok", "b": "ok", "c": "ok", "d": "failed", "e": "ok", "f": "failed"}


def test_a_failure_can_save_a_later_file(spark):
    """The second file only fails if the first is taken; the first fails."""
    incoming = [("a", 1, True, "T1", None, "P", "2024-01-01T00:00:00Z", None), ("b", 2, True, "T2", None, "P", "2024-01-01T00:00:00Z", None), ("b", 1, False, "T1", None, "P", "2024-01-02T00:00:00Z", None)]
    stored = [(2, "T1", None, "P", "2023-01-01T00:00:00Z", None)]
    incoming += [("c", 1, True, "T1", None, "P", "2024-01-01T12:00:00Z", None)]
    _, got, _, _ = result(spark, stored, incoming)
    assert got == {("a", 1): ["imported"], ("b", 2): ["failed"], ("b", 1): ["failed"], ("c", 1): ["imported"]}


def test_random_files_one_by_one(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        row = lambda a: (a, rnd.choice(["T1"] * 9 + ["T2"]), rnd.choice([None, None, "I1", "I1", "I2"]), rnd.choice(["", "P1", "P2", None]), rnd.choice([None] + [f"2024-01-{d:02d}T00:00:00Z" for d in range(1, 20)] + ["not a time"]), rnd.choice([None, None, "x", "x", "x", "y"]))
        stored = [row(a) for a in rnd.sample(range(30), 12)]
        incoming = []
        for f in range(25):
            members = rnd.sample(range(30), rnd.randint(1, 5))
            incoming += [(f"f{f:02d}", a, k == 0 and rnd.random() < 0.95, *row(a)[1:]) for k, a in enumerate(members)]
        after, said = one_by_one(stored, incoming)
        rows, got, n, _ = result(spark, stored, incoming)
        assert got == said, seed
        assert n == len(after) and rows == {a: v[:4] for a, v in after.items()}, seed


def test_empty(spark):
    rows, got, n, _ = result(spark, [(1, "T", None, "P", "2024-01-01T00:00:00Z", None)], [])
    assert (rows, got, n) == ({1: ["T", None, "P", "2024-01-01T00:00:00Z"]}, {}, 1)


def test_outcomes_are_computed_once(spark):
    """All child tables read written verdicts; none folds the events again."""
    s = spark.createDataFrame([(1, "T1", None, "P", None, None)], STORED)
    i = spark.createDataFrame([("a", 1, True, "T1", None, "P", "2024-01-01T00:00:00Z", None)], INCOMING)
    child = spark.createDataFrame([(1, "old")], "attempt_id long, v string")
    new = spark.createDataFrame([("a", 1, "new")], "file string, attempt_id long, v string")
    after, outcomes = imports.import_snapshots({"attempts": s, "one": child, "two": child}, {"attempts": i, "one": new, "two": new})
    for df in (outcomes, after["attempts"], after["one"], after["two"]):
        assert "kept-" in df.inputFiles()[0]
        assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString().lower().replace("aggregate [", "")
    assert [r.v for r in after["two"].collect()] == ["new"]


def test_children_send_no_table_through_the_driver(spark):
    """Attempts are joined by no estimate of their files; only the list of
    failed files, after a count, goes to every task."""
    from tallyloom import plans

    plan = plans.QUERIES["mut_import_children"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
