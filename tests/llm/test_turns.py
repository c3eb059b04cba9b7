"""Conversation repair against the cheapest of all edit strings."""

import hashlib
import itertools
import random
import zlib

import pytest

from tallyloom.llm import queries, turns

SPACES = " \t\n\v\f\r"


def legal(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return not roles or (len(rest) > 0 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def faults(rows):
    """(role, text) in order to one fault or none each."""
    said, out = set(), []
    for role, text in rows:
        body = text.rstrip(SPACES)
        out.append("blank" if not body else "duplicate" if (role, text) in said else "truncated" if body[-1] not in ".!?" else None)
        said.add((role, text))
    return out


def every_repair(rows):
    """(cost, audit, turns) of all edits with up to two inserts at each place."""
    marks = faults(rows)
    for before in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(m in ("blank", "duplicate") and e != "D" for m, e in zip(marks, edits, strict=True)):
                continue
            audit = "".join("I" * n + e for n, e in zip(before, [*edits, ""], strict=True))
            n = sum(e != "D" for e in audit)
            want = ("s" if n % 2 else "") + "ua" * (n // 2)
            out, k, cost, roles = [], 0, 0, ""
            for e in audit:
                new = want[len(out) : len(out) + 1]
                name = {"u": "user", "a": "assistant", "s": None, "": None}[new]
                if e == "I":
                    out.append((name, ""))
                elif e == "R":
                    out.append((name, rows[k][1]))
                elif e == "K":
                    out.append(rows[k])
                roles += (rows[k][0][:1] or "?") if e == "K" else (new if name else "?") if e in "IR" else ""
                cost += {"K": 0, "D": 4, "R": 3, "I": 3}[e] + (3 if e in "KR" and marks[k] == "truncated" else 0)
                k += e != "I"
            if legal(roles):
                yield cost, audit, out


def random_rows(rnd, n):
    return [(rnd.choice(["user", "assistant", "system", "tool", "a2", ""]), rnd.choice(["Yes.", "No!", "cut", " ", "", "x.\n", "long", f"{rnd.randrange(9)}?"])) for _ in range(n)]


def codes(rows):
    return [turns._Code(r[:1], f in ("blank", "duplicate"), f == "truncated") for (r, _), f in zip(rows, faults(rows), strict=True)]


def test_search_finds_the_least_of_all_repairs():
    rnd = random.Random(4)
    for _ in range(150):
        rows = random_rows(rnd, rnd.randint(0, 4))
        cost, audit, out = min(every_repair(rows))
        assert turns.cheapest(codes(rows)) == (cost, audit), rows
        assert turns.edited(audit, 0, rows) == out


def test_pieces_give_what_the_whole_gives():
    rnd = random.Random(5)
    for _ in range(400):
        rows = random_rows(rnd, rnd.randint(0, 24))
        cs, size = codes(rows), rnd.randint(1, 7)
        parts = [cs[k : k + size] for k in range(0, len(cs), size)] or [[]]
        cost, picked, tail = turns.folded([turns.ways(p) for p in parts])
        whole = turns.cheapest(cs)
        assert (cost, "".join(a for _, a in picked) + tail) == whole
        picked[-1] = (picked[-1][0], picked[-1][1] + tail)
        out, at = [], 0
        for p, (state, audit) in zip(parts, picked, strict=True):
            out += turns.edited(audit, state, rows[at : at + len(p)])
            at += len(p)
        assert out == turns.edited(whole[1], 0, rows)


def damaged(table):
    out = {}
    for conv, turn, role, text in table:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if k == 4 else " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if k == 2 else text
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(k, 1))
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, rs in out.items()}


def expected(table):
    """The contract in plain Python, the search on one whole conversation."""
    out = []
    for conv, rs in damaged(table).items():
        rows = [(r, t) for _, r, t in rs]
        marks, times = faults(rows), [t for t, _, _ in rs if t is not None]
        gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = turns.cheapest(codes(rows))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns.edited(audit, 0, rows)).encode()).hexdigest()
        out.append((conv, gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return out


def test_query(spark, tmp_path):
    rnd = random.Random(6)
    table = [(c, t, *random_rows(rnd, 1)[0]) for c in range(150) for t in range(rnd.randint(1, 7)) if rnd.random() < 0.9]
    table += [(None, 1, "user", "Hello."), (None, None, None, None), (400, None, "user", "A."), (400, None, "user", "A."), (400, 3, "user", "A."), (401, 2**40, "assistant", "x" * 50_000), (402, -3, "user", "B."), (402, 5, "user", "B.")]
    table += [(500, t % 700, "user" if t % 2 else "assistant", f"Line {t % 40}.") for t in range(3000)]  # a hot one
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "role AS conv")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(table)))


@pytest.mark.parametrize("segment", [1, 3, 50])
def test_cut_conversations(spark, segment):
    rnd = random.Random(segment)
    table = [(c, t, *random_rows(rnd, 1)[0]) for c in range(25) for t in range(rnd.randint(1, 9))] + [(9, 90, "user", "Same.")] * 130
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    pick = lambda d: sorted(map(str, d.collect()))
    assert pick(turns.repair(df, segment=segment)) == pick(turns.repair(df))


def test_empty_table(spark):
    assert turns.repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string")).collect() == []
