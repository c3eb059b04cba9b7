"""Replay of answer events to intervals, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

OPENS, CLOSES = ("enter", "focus"), ("leave", "blur")
INTERVALS = "attempt_id long, passage_index int, seconds double, complete boolean"


def replay(rows: list[tuple]) -> tuple[list[tuple[int, float]], bool]:
    """(passage, duration) of each paired open and close of one attempt, from
    (event_type, passage, clock, clock_id) in order. Complete only if every
    event pairs up on one clock and nothing stays open; an empty log isn't."""
    open_: dict[int, tuple[float, str]] = {}
    out, complete = [], bool(rows)
    for kind, passage, clock, clock_id in rows:
        if kind in OPENS:
            complete &= passage not in open_
            open_[passage] = (clock, clock_id)
        elif kind in CLOSES:
            began = open_.pop(passage, None)
            if began is None or began[1] != clock_id or clock < began[0]:
                complete = False
            else:
                out.append((passage, clock - began[0]))
    return out, complete and not open_


def intervals(events: DataFrame) -> DataFrame:
    """attempt_id, passage_index, seconds, complete of each paired open and
    close, by windows over an attempt's passages in order of seq.

    Columns attempt_id, seq, event_type, passage_index, clock, clock_id. An
    open that follows an open takes its place; a close pairs with an open just
    before it on the same clock that isn't later. An attempt is complete if
    all of its opens and closes pair up. Other events and events without a
    passage count for nothing.
    """
    kind = F.when(F.col("event_type").isin(*OPENS), True).when(F.col("event_type").isin(*CLOSES), False)
    e = events.withColumn("_open", kind).filter("_open IS NOT NULL AND passage_index IS NOT NULL")
    by = W.partitionBy("attempt_id", "passage_index").orderBy("seq")
    e = e.withColumn("_before", F.lag(F.struct("_open", "clock", "clock_id")).over(by)).withColumn("_last", F.lead("seq").over(by).isNull())
    opened = F.coalesce(F.col("_before._open"), F.lit(False))
    pair = ~F.col("_open") & opened & F.col("_before.clock_id").eqNullSafe(F.col("clock_id")) & F.coalesce(F.col("clock") >= F.col("_before.clock"), F.lit(False))
    wrong = (F.col("_open") & (opened | F.col("_last"))) | (~F.col("_open") & ~F.col("_pair"))
    e = e.withColumn("_pair", pair).withColumn("_wrong", F.max(wrong).over(W.partitionBy("attempt_id")))
    return e.filter("_pair").select("attempt_id", F.col("passage_index").cast("int").alias("passage_index"), (F.col("clock") - F.col("_before.clock")).cast("double").alias("seconds"), (~F.col("_wrong")).alias("complete"))


class IntervalProcessor(StatefulProcessor):
    """Keeps the events of an attempt until its timer, then pairs them up.

    Events may come in any order within the delay; each moves the timer to its
    own time plus the delay, if that is later.
    """

    def __init__(self, delay_ms: int) -> None:
        self.delay = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "seq long, event_type string, passage_index int, clock double, clock_id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        due = 0
        for pdf in rows:
            due = max(due, int(pd.Timestamp(pdf["at"].max()).timestamp() * 1000) + self.delay)
            for r in pdf[["seq", "event_type", "passage_index", "clock", "clock_id"]].itertuples(index=False):
                self.events.appendValue((int(r.seq), r.event_type, int(r.passage_index), float(r.clock), r.clock_id))
        set_ = list(self.handle.listTimers())
        if all(t < due for t in set_):
            for t in set_:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)
        yield pd.DataFrame({"attempt_id": [], "passage_index": [], "seconds": [], "complete": []})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = sorted(self.events.get())
        found, complete = replay([r[1:] for r in rows])
        self.events.clear()
        yield pd.DataFrame({"attempt_id": [key[0]] * len(found), "passage_index": [p for p, _ in found], "seconds": [s for _, s in found], "complete": [complete] * len(found)})

    def close(self) -> None:
        """Nothing is open."""


def stream_intervals(stream: DataFrame, delay_minutes: int = 60) -> DataFrame:
    """The same over a stream, with the event's time in ``at``: an attempt is
    told once no event of it came for the delay. What comes later than that is
    dropped. Needs the RocksDB state store."""
    late = stream.withWatermark("at", f"{delay_minutes} minutes")
    kept = late.filter(F.col("event_type").isin(*OPENS, *CLOSES) & F.col("passage_index").isNotNull() & F.col("clock").isNotNull())
    return kept.groupBy("attempt_id").transformWithStateInPandas(IntervalProcessor(delay_minutes * 60_000), INTERVALS, "Append", "EventTime")


def version_gate_state(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Stream form of the version gate: keep what exceeds the version seen."""
    best = state.get[0] if state.exists else None
    kept = []
    for pdf in batches:
        for r in pdf.sort_values("seq").itertuples(index=False):
            if best is None or r.version > best:
                best = int(r.version)
                kept.append(r)
    if best is not None:
        state.update((best,))
    yield pd.DataFrame(kept, columns=["key", "seq", "version"]) if kept else pd.DataFrame({"key": pd.Series(dtype="int64"), "seq": pd.Series(dtype="int64"), "version": pd.Series(dtype="int64")})
