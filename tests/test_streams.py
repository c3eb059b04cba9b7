"""Drop folders as a stream with a ledger, and intervals from shuffled batches."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import events
from tallyloom.streaming import drops


def put(root, terminal, stem, content, marker=True, sha=None):
    folder = root / terminal
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{stem}.sqlite").write_bytes(content)
    (folder / f"{stem}.meta.json").write_text(json.dumps({"attemptId": stem, "sizeBytes": len(content), "sha256": sha or hashlib.sha256(content).hexdigest()}))
    if marker:
        (folder / f"{stem}.ready").touch()


@pytest.fixture
def drop(spark, tmp_path):
    root, log, ledger, checkpoint = (tmp_path / n for n in ("root", "log", "ledger", "checkpoint"))
    root.mkdir()
    loads = []

    def load(files, number):
        rows = [(r.file, r.sha256) for r in files.select("file", "sha256").collect()]
        loads.append((number, sorted(f for f, _ in rows)))
        fail = (tmp_path / "fail").exists()
        out = [(f, "failed" if fail else "ok", "the table is locked" if fail else None, 0 if fail else 1) for f, _ in rows]
        return files.sparkSession.createDataFrame(out, "file string, status string, error string, imported long")

    def run(log=log, checkpoint=checkpoint, load=load):
        stream = drops.drop_stream(spark, str(root), str(log), str(ledger))
        drops.ingest_drops(stream, str(ledger), load, str(checkpoint)).awaitTermination(180)

    return root, ledger, tmp_path, loads, run


def ledger_of(spark, ledger):
    return sorted((r.batch, r.file, r.status) for r in drops.ledger_rows(spark, str(ledger)).collect())


def test_marker_ledger_and_retry(spark, drop):
    root, ledger, tmp, loads, run = drop
    put(root, "T1", "a", b"one")
    put(root, "T1", "b", b"two", marker=False)
    put(root, "T2", "bad", b"three", sha="0" * 64)
    (tmp / "fail").touch()
    run()
    assert loads == [(0, ["T1/a.sqlite"])] and ledger_of(spark, ledger) == [(0, "T1/a.sqlite", "failed"), (0, "T2/bad.sqlite", "failed")]
    (tmp / "fail").unlink()
    (root / "T1" / "b.ready").touch()
    put(root, "T2", "bad", b"three")  # the sidecar is mended
    run()
    assert loads[1:] == [(1, ["T1/a.sqlite", "T1/b.sqlite", "T2/bad.sqlite"])]
    assert [x for x in ledger_of(spark, ledger) if x[0] == 1] == [(1, f, "ok") for f in ("T1/a.sqlite", "T1/b.sqlite", "T2/bad.sqlite")]
    run()  # nothing is new, nothing failed
    assert len(loads) == 2
    put(root, "T1", "a", b"one")  # the same content again, under a new time
    put(root, "T1", "b", b"other")
    run()
    assert loads[2:] == [(2, ["T1/b.sqlite"])]
    assert [x for x in ledger_of(spark, ledger) if x[0] == 2] == [(2, "T1/a.sqlite", "skipped"), (2, "T1/b.sqlite", "ok")]


def test_a_batch_that_breaks_runs_again_with_the_same_files(spark, drop):
    root, ledger, tmp, loads, run = drop
    put(root, "T1", "a", b"one")

    def breaks(files, number):
        files.count()
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(load=breaks)
    put(root, "T1", "late", b"two")
    run()  # the batch of before, with the files of before
    assert loads == [(0, ["T1/a.sqlite"])]
    run()
    assert loads == [(0, ["T1/a.sqlite"]), (1, ["T1/late.sqlite"])]
    assert ledger_of(spark, ledger) == [(0, "T1/a.sqlite", "ok"), (1, "T1/late.sqlite", "ok")]


EVENTS = "attempt_id long, seq long, event_type string, passage_index int, clock double, clock_id string"


def logs(rnd, n):
    rows = []
    for a in range(n):
        for seq in range(rnd.randint(0, 14)):
            rows.append((a, seq, rnd.choice(["enter", "leave", "focus", "blur", "other"]), rnd.choice([1, 1, 2, None]), float(seq + rnd.choice([0, 0, 0, -3])), rnd.choice(["c", "c", "c", "d"])))
        if rnd.random() < 0.5:
            rows = [r for r in rows if r[0] != a]
            rows += [(a, k, "enter" if k % 2 == 0 else "leave", 1, float(k), "c") for k in range(2 * rnd.randint(1, 4))]
    return rows


def replayed(rows):
    out = []
    for a in sorted({r[0] for r in rows}):
        own = [r[2:] for r in sorted(rows) if r[0] == a and r[3] is not None and r[2] != "other"]
        found, complete = events.replay(own)
        out += [(a, p, s, complete) for p, s in found]
    return sorted(out)


def test_intervals_by_replay(spark):
    rows = logs(random.Random(1), 80)
    got = sorted(map(tuple, events.intervals(spark.createDataFrame(rows, EVENTS)).collect()))
    assert got == replayed([r for r in rows]) and {r[3] for r in got} == {True, False}
    assert events.intervals(spark.createDataFrame([], EVENTS)).count() == 0


def test_streamed_intervals_from_shuffled_batches(spark, tmp_path):
    rnd = random.Random(2)
    rows = [r for r in logs(rnd, 30)]
    rnd.shuffle(rows)
    whole = spark.createDataFrame(rows, EVENTS).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 60))
    source = tmp_path / "source"
    parts = [rows[k::4] for k in range(4)]
    for k, part in enumerate(parts):
        whole.join(spark.createDataFrame([(r[0], r[1]) for r in part], "attempt_id long, seq long"), ["attempt_id", "seq"]).select(*EVENTS.replace(" long", "").replace(" string", "").replace(" int", "").replace(" double", "").split(", "), "at").coalesce(1).write.mode("append").parquet(f"{source}/{k}")
    for k in range(2):  # much later events, which let the watermark pass
        spark.createDataFrame([(10_000 + k, 0, "enter", 1, 0.0, "c")], EVENTS).withColumn("at", F.timestamp_seconds(F.lit(1_700_900_000 + k * 90_000))).coalesce(1).write.parquet(f"{source}/{8 + k}")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
        out = events.stream_intervals(stream, 60)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == replayed(rows)
