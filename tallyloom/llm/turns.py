"""Repair of conversation structure: the cheapest edits to a legal sequence.

Roles must read ``(s?(ua)+)?`` by their initials. Keep costs nothing, Rerole
to user or assistant 3, Delete 4, Insert of an empty user or assistant turn 3;
a turn with a fault (blank, or role and text seen earlier) must be deleted,
and a truncated one that stays adds 3. The cheapest edits are the shortest
path in a lattice of (turn index, grammar state), found by Dijkstra with the
key (cost, audit), where the audit is the string of edit initials; the first
accepting end node that is popped ends the search. Two paths of one cost to
one node never have audits of which one begins the other, so the key is safe.

Rows are sorted by ranges of (conversation, turn), so a conversation of any
length is spread over tasks. One that lies inside a range is solved where it
lies. Of one that a border or the bound of ``segment`` turns cuts, each piece
gives the cheapest way between each pair of grammar states; a fold over the
pieces picks the ways, and each piece is repaired where it lies.

Defined cases: null role and text count as one space; null turns come first
and are ignored by gaps; rows of one turn come by role, then text, and equal
rows side by side; a null conversation id is a conversation; one without rows
(``copies`` of 0 only) has zeros and an empty audit; roles other than system,
user and assistant count by their first letter; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import materialise

#: Grammar states: nothing yet, after system, after user, after assistant.
MOVES: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
#: Inserts that end a conversation from each state, and their cost.
TAILS = ("", "II", "I", "")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_LEGAL = {"su", "ua", "au"}
_NAMES = {"u": "user", "a": "assistant"}

Way = tuple[int, str]


class _Code:
    """One turn: its initial, whether it must go, what it costs to stay."""

    __slots__ = ("extra", "forced", "initial")

    def __init__(self, initial: str, forced: bool, truncated: bool) -> None:
        self.initial, self.forced, self.extra = initial, forced, TRUNCATED if truncated and not forced else 0


def _edits(code: _Code, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, initial of the edit, next state) of what may be done with a turn."""
    yield DELETE, "D", state
    if code.forced:
        return
    if code.initial in MOVES[state]:
        yield code.extra, "K", MOVES[state][code.initial]
    for role, to in MOVES[state].items():
        if role != "s":
            yield REROLE + code.extra, "R", to


def _search(codes: list[_Code], start: int, inserts_at_end: bool) -> Iterator[tuple[int, Way]]:
    """End nodes as Dijkstra settles them: (state, (cost, audit))."""
    heap, settled = [(0, "", 0, start)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == len(codes):
            yield state, (cost, audit)
            if not inserts_at_end:
                continue
        else:
            for more, edit, to in _edits(codes[i], state):
                if (i + 1, to) not in settled:
                    heapq.heappush(heap, (cost + more, audit + edit, i + 1, to))
        for role, to in MOVES[state].items():
            if role != "s" and (i, to) not in settled:
                heapq.heappush(heap, (cost + INSERT, audit + "I", i, to))


def cheapest(codes: list[_Code]) -> Way:
    """Cost and audit of the cheapest repair of a whole conversation."""
    return next(way for state, way in _search(codes, 0, True) if state in ACCEPTING)


def ways(codes: list[_Code]) -> list[dict[int, Way]]:
    """For each state before a piece the cheapest way to each state after it.

    No insert follows the last turn of a piece: it leads the next one.
    """
    return [dict(_search(codes, start, False)) for start in range(len(MOVES))]


def folded(pieces: list[list[dict[int, Way]]]) -> tuple[int, list[tuple[int, str]], str]:
    """Cost, (state before, audit) of each piece, inserts at the end.

    States that are reached carry the rank of their audit so far, so that no
    audit is put together to be compared.
    """
    best, back = {0: (0, 0)}, []
    for piece in pieces:
        reached: dict[int, tuple[int, int, str, int]] = {}
        for before, (cost, rank) in best.items():
            for after, (more, audit) in piece[before].items():
                way = (cost + more, rank, audit, before)
                if after not in reached or way < reached[after]:
                    reached[after] = way
        order = sorted(reached, key=lambda s: reached[s][1:3])
        best = {s: (reached[s][0], order.index(s)) for s in reached}
        back.append(reached)
    cost, _, tail, state = min((c + INSERT * len(TAILS[s]), rank, TAILS[s], s) for s, (c, rank) in best.items())
    chosen = []
    for reached in reversed(back):
        _, _, audit, before = reached[state]
        chosen.append((before, audit))
        state = before
    return cost, chosen[::-1], tail


def edited(audit: str, state: int, rows: list[tuple[str, str] | None]) -> list[tuple[str, str]]:
    """The turns that an audit leaves; ``rows`` are None where they must go."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            role, text = rows[i]
            state = MOVES[state][role[:1]]
        else:
            initial = next(r for r in MOVES[state] if r != "s")
            role, text, state = _NAMES[initial], "" if edit == "I" else rows[i][1], MOVES[state][initial]
        i += edit != "I"
        out.append((role, text))
    return out


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_WAY = pa.struct([("before", pa.int8()), ("after", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())])
_COUNTS = ("n_turns", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal")
_PIECE = f"part long, whole boolean, {', '.join(f'{c} long' for c in _COUNTS)}, first_initial string, last_initial string, cost long, audit string, turns array<struct<role:string,text:string>>, ways array<struct<before:tinyint,after:tinyint,cost:long,audit:string>>, rows array<struct<role:string,text:string>>"


class _Piece:
    def __init__(self, conv: Any, opened: bool) -> None:
        self.conv, self.opened = conv, opened
        self.codes: list[_Code] = []
        self.rows: list[tuple[str, str] | None] = []
        self.counts = dict.fromkeys(_COUNTS, 0) | {"first_turn": None, "last_turn": None}

    def add(self, turn: int | None, role: str, text: str, forced: bool, truncated: bool) -> None:
        c = self.counts
        if turn is not None:
            c["n_turns"] += turn != c["last_turn"]
            c["first_turn"] = turn if c["first_turn"] is None else c["first_turn"]
            c["last_turn"] = turn
        if self.codes:
            c["illegal"] += self.codes[-1].initial + role[:1] not in _LEGAL
        self.codes.append(_Code(role[:1], forced, truncated))
        self.rows.append(None if forced else (role, text))

    def row(self, part: int, closed: bool) -> dict:
        whole = closed and not self.opened
        out = {"conv": self.conv, "part": part, "whole": whole, **self.counts, "first_initial": None, "last_initial": None, "cost": 0, "audit": "", "turns": [], "ways": [], "rows": []}
        if self.codes:
            out |= {"first_initial": self.codes[0].initial, "last_initial": self.codes[-1].initial}
        if whole:
            out["cost"], out["audit"] = cheapest(self.codes)
            out["turns"] = [{"role": r, "text": t} for r, t in edited(out["audit"], 0, self.rows)]
        else:
            out["ways"] = [{"before": b, "after": a, "cost": c, "audit": w} for b, to in enumerate(ways(self.codes)) for a, (c, w) in to.items()]
            out["rows"] = [None if x is None else {"role": x[0], "text": x[1]} for x in self.rows]
        return out


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _piece_schema(kind: pa.DataType) -> pa.Schema:
    longs = [(c, pa.int64()) for c in _COUNTS]
    return pa.schema([("conv", kind), ("part", pa.int64()), ("whole", pa.bool_()), *longs, ("first_initial", pa.string()), ("last_initial", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("turns", pa.list_(_TURN)), ("ways", pa.list_(_WAY)), ("rows", pa.list_(_TURN))])


_Batches = Iterator[pa.RecordBatch]


def _pieces(segment: int, most: int = 256) -> Callable[[_Batches], _Batches]:
    """Sorted rows to solved conversations, or pieces where they may go on elsewhere.

    The first and the last conversation of a range may reach over its borders.
    """

    def run(batches: _Batches) -> _Batches:
        part = TaskContext.get().partitionId() << 32
        piece, schema, out = None, None, []
        for batch in batches:
            schema = schema or _piece_schema(batch.schema.field("conv").type)
            for r in batch.to_pylist():
                if piece is None or r["conv"] != piece.conv:
                    if piece is not None:
                        out.append(piece.row(part, True))
                        part += 1
                    piece = _Piece(r["conv"], piece is None)
                for k in range(r["copies"]):
                    if len(piece.codes) == segment:
                        out.append(piece.row(part, False))
                        part += 1
                        piece = _Piece(r["conv"], True)
                    again = r["seen"] or k > 0
                    fault = "blank" if r["blank"] else "duplicate" if again else "truncated" if r["truncated"] else None
                    if fault:
                        piece.counts[fault] += 1
                    piece.add(r["turn"], r["role"], r["text"], fault in ("blank", "duplicate"), fault == "truncated")
                if len(out) >= most:
                    yield _table(out, schema)
                    out = []
        if piece is not None:
            out.append(piece.row(part, False))
        if out:
            yield _table(out, schema)

    return run


def _fold(batches: _Batches) -> _Batches:
    """Pieces of a conversation, in order, to its facts and the way of each piece."""
    chosen = pa.list_(pa.struct([("part", pa.int64()), ("before", pa.int8()), ("audit", pa.string())]))
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    for batch in batches:
        schema = pa.schema([("conv", batch.schema.field("conv").type), *((c, pa.int64()) for c in names), ("audit", pa.string()), ("chosen", chosen)])
        out = []
        for r in batch.to_pylist():
            pieces = r["pieces"]
            tables = []
            for p in pieces:
                table: list[dict[int, Way]] = [{} for _ in MOVES]
                for w in p["ways"]:
                    table[w["before"]][w["after"]] = (w["cost"], w["audit"])
                tables.append(table)
            cost, picked, tail = folded(tables)
            sums = {c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal", "n_turns")}
            filled = [p for p in pieces if p["first_initial"] is not None]
            sums["illegal"] += sum(a["last_initial"] + b["first_initial"] not in _LEGAL for a, b in zip(filled, filled[1:], strict=False))
            timed = [p for p in pieces if p["first_turn"] is not None]
            distinct = sums.pop("n_turns") - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:], strict=False))
            gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - distinct if timed else 0
            picked[-1] = (picked[-1][0], picked[-1][1] + tail)
            out.append({"conv": r["conv"], "gaps": gaps, **sums, "cost": cost, "audit": "".join(a for _, a in picked), "chosen": [{"part": p["part"], "before": b, "audit": a} for p, (b, a) in zip(pieces, picked, strict=True)]})
        yield _table(out, schema)


def _apply(batches: _Batches) -> _Batches:
    """The repaired turns of each piece."""
    for batch in batches:
        turns = []
        for r in batch.to_pylist():
            rows = [None if x is None else (x["role"], x["text"]) for x in r["rows"]]
            turns.append([{"role": a, "text": b} for a, b in edited(r["audit"], r["before"], rows)])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), pa.array(turns, pa.list_(_TURN))], names=["conv", "part", "turns"])


def _rows(conversations: DataFrame, names: tuple[str, str, str, str], copies: Column) -> DataFrame:
    """Distinct rows with their number and faults; a crowd of equal rows is one."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in names)
    there = copies > 0
    c = conversations.select(
        conv.alias("conv"),
        F.when(there, turn.cast("long")).alias("turn"),
        F.when(there, F.coalesce(role, F.lit(" "))).otherwise("").alias("role"),
        F.when(there, F.coalesce(text, F.lit(" "))).otherwise("").alias("text"),
        copies.cast("long").alias("copies"),
    )
    once = c.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("said", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    once = materialise(once, "turns")
    # Only what is said at several turns of a conversation is looked up, and a
    # crowd of such rows is spread over eight keys.
    said = once.filter("copies > 0").groupBy("conv", "said").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    said = said.select(F.col("conv").alias("c"), F.col("said").alias("s"), "first", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    key = F.pmod(F.xxhash64("turn"), F.lit(8))
    met = once.join(said, F.col("conv").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")) & (key == F.col("k")), "left")
    later = F.col("first").isNotNull() & (F.struct("turn") > F.col("first"))
    return met.select(
        "conv",
        "turn",
        "role",
        "text",
        "copies",
        F.coalesce(later, F.lit(False)).alias("seen"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )


def repair(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    copies: Column | None = None,
    segment: int = 1024,
) -> DataFrame:
    """One row per conversation: faults, cost, audit and the repaired turns.

    ``copies`` says how often a row counts (1); a conversation of which all
    rows count 0 times is returned as an empty one.
    """
    rows = _rows(conversations, (conv, turn, role, text), F.lit(1) if copies is None else copies)
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    pieces = materialise(ordered.mapInArrow(_pieces(segment), f"conv {kind}, {_PIECE}"), "pieces")

    facts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    solved = pieces.filter("whole").select("conv", gaps.alias("gaps"), *facts[1:], "audit", "turns")

    cut = pieces.filter("not whole")
    listed = cut.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", *_COUNTS, "first_initial", "last_initial", "ways"))).alias("pieces"))
    picked = "array<struct<part:long,before:tinyint,audit:string>>"
    put = materialise(listed.mapInArrow(_fold, f"conv {kind}, {', '.join(f'{c} long' for c in facts)}, audit string, chosen {picked}"), "ways")
    each = put.select(F.explode("chosen").alias("w")).select(F.col("w.part").alias("p"), "w.before", "w.audit")
    turns = cut.select("conv", "part", "rows").join(each, F.col("part") == F.col("p")).mapInArrow(_apply, f"conv {kind}, part long, turns array<struct<role:string,text:string>>")
    whole = turns.groupBy(F.col("conv").alias("c")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "turns"))), lambda x: x["turns"])).alias("turns"))
    joined = put.join(whole, F.col("conv").eqNullSafe(F.col("c"))).select("conv", *facts, "audit", "turns")
    return solved.unionByName(joined).withColumnRenamed("conv", conv)
