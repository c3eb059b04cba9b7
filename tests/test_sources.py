import hashlib
import json
import sqlite3

from pyspark.sql import functions as F

from tallyloom.sources import files, snapshots
from tallyloom.streaming import ingest


def test_snapshots(spark, tmp_path):
    root = tmp_path / "T1"
    root.mkdir()
    for name in ("a1", "a2"):
        con = sqlite3.connect(root / f"{name}.sqlite")
        con.execute("CREATE TABLE exam_attempts (attempt_id, batch_id, status)")
        con.execute("INSERT INTO exam_attempts VALUES (?, 'B', 'submitted')", (name,))
        con.commit()
        con.close()
    (root / "a1.ready").touch()
    (root / "bad.sqlite").write_bytes(b"no database at all" * 100)
    ready, waiting = snapshots.scan(spark, str(tmp_path))
    assert [r.stem for r in ready.collect()] == ["a1"] and {r.stem for r in waiting.collect()} == {"a2", "bad"}
    rows = snapshots.read_tables(spark, str(tmp_path), "exam_attempts")
    assert {(r.attempt_id, r.candidate_name, r.error is None) for r in rows.collect()} == {("a1", None, True), ("a2", None, True), (None, None, False)}
    data = (root / "a1.sqlite").read_bytes()
    (root / "a1.meta.json").write_text(json.dumps({"attemptId": "a1", "schemaVersion": 1, "dbSchemaVersion": 1, "sizeBytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}))
    meta = snapshots.metadata(spark, str(tmp_path))
    assert meta.first().compatible
    assert {r.attemptId: r.ok for r in snapshots.verified(spark, str(tmp_path), meta).collect()} == {"a1": True, "a2": False, "bad": False}


def test_json_lines_and_paper_ids(spark, tmp_path):
    p = tmp_path / "u.jsonl"
    p.write_text('{"recordType":"llm_usage","prompt_tokens":5}\nnot json\n{"recordType":"other"}\n')
    good, bad = files.json_lines(spark, str(p))
    assert good.count() == 1 and bad.count() == 1
    df = spark.createDataFrame([('{"paperId":"P1"}',), ('[{"paperId":"P2"},{"paperId":"P2"}]',), ('[{"paperId":"P2"},{"paperId":"P3"}]',), ('{"passageCount":3}',)], "j string")
    assert [(r.paper_id, r.paper_conflict) for r in snapshots.paper_ids(df, "j").collect()] == [("P1", False), ("P2", False), (None, True), (None, False)]


def test_stream_ingest_is_idempotent_and_newer_only(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "id long, v long, t string"
    (src / "1.json").write_text('{"id":1,"v":2,"t":"a"}\n{"id":2,"v":1,"t":"b"}\n')
    run = lambda: ingest.ingest(ingest.file_stream(spark, str(src), schema), str(tmp_path / "store"), ["id"], str(tmp_path / "cp"), newer="v").awaitTermination()
    run()
    (src / "2.json").write_text('{"id":1,"v":1,"t":"late"}\n{"id":2,"v":3,"t":"new"}\n')
    run()
    run()
    assert {tuple(r) for r in ingest.current(spark, str(tmp_path / "store")).select("id", "v", "t").collect()} == {(1, 2, "a"), (2, 3, "new")}


def test_stream_version_gate(spark, tmp_path):
    src = tmp_path / "g"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"key": 1, "seq": i, "version": v}) for i, v in enumerate([1, 3, 2, 3, 4])))
    out = ingest.version_gate(ingest.file_stream(spark, str(src), "key long, seq long, version long"))
    q = out.writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.version for r in spark.table("gate").collect()) == [1, 3, 4]


def test_sinks(spark, tmp_path):
    files.write_tables({"scores": spark.range(3).withColumn("x", F.lit("y"))}, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "out" / "scores")).count() == 3


def test_stream_keeps_two_versions_of_touched_buckets(spark, tmp_path):
    src, store = tmp_path / "drops", tmp_path / "versions"
    src.mkdir()
    for n in range(4):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "v": n}) for i in range(3)))
        ingest.ingest(ingest.file_stream(spark, str(src), "id long, v long"), str(store), ["id"], str(tmp_path / "cp2"), newer="v", buckets=8).awaitTermination()
    assert sorted(tuple(r) for r in ingest.current(spark, str(store)).select("id", "v").collect()) == [(i, 3) for i in range(3)]
    kept = [p for p in store.glob("v*/_bucket=*")]
    assert len(kept) == 2 * len({p.name for p in kept})


def test_change_feed_and_refetch(spark, tmp_path):
    src, seen, fresh = tmp_path / "changes", [], []
    src.mkdir()
    table = {"rows": [(1, "a"), (2, "b")]}
    for n in range(2):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "at": i}) for i in (2, 1, 5)))
        table["rows"] = [(1, "a"), (2, f"b{n}")]
        stream = lambda: ingest.file_stream(spark, str(src), "id long, at long")
        ingest.change_feed(stream(), ["at"], lambda df, k: seen.extend((r.event_seq, r.id) for r in df.collect()), str(tmp_path / "cp3")).awaitTermination()
        ingest.refetch(stream(), lambda: spark.createDataFrame(table["rows"], "id long, t string"), ["id"], lambda df, k: fresh.append(sorted(tuple(r) for r in df.collect())), str(tmp_path / "cp4")).awaitTermination()
    assert [i for _, i in sorted(seen)] == [1, 2, 5, 1, 2, 5] and len({s for s, _ in seen}) == 6
    assert fresh == [[(1, "a"), (2, "b0")], [(1, "a"), (2, "b1")]]


def test_typed_tables_of_snapshots(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.sqlite")
    con.execute("CREATE TABLE answer_events (attempt_id, event_seq, event_type, clock_id, monotonic_ms, passage_index)")
    con.executemany("INSERT INTO answer_events VALUES (?, ?, ?, ?, ?, ?)", [("x", 1, "part_enter", "c", 10.5, 0), ("x", 2, "part_leave", "c", 20, 0), ("x", "late", "part_leave", "c", None, 1)])
    con.execute("CREATE TABLE listening_answers (attempt_id, slot_id, is_correct, weight)")
    con.execute("INSERT INTO listening_answers VALUES ('x', 's1', 1, 2.5)")
    con.commit()
    con.close()
    e = snapshots.read_tables(spark, str(tmp_path), "answer_events").orderBy("monotonic_ms").collect()
    assert [(r.event_seq, r.monotonic_ms, r.passage_index, r.error) for r in e] == [(None, None, 1, "not of its kind: event_seq"), (1, 10.5, 0, None), (2, 20.0, 0, None)]
    (one,) = snapshots.read_tables(spark, str(tmp_path), "listening_answers").collect()
    assert (one.is_correct, one.weight, one.user_answer_json) == (1, 2.5, None)
    assert snapshots.read_tables(spark, str(tmp_path), "listening_attempts").count() == 0


def test_latest_beacons(spark):
    rows = [("a", "2024-01-01T10:00:00+09:00", "submitted", "f2"), ("a", "2024-01-01T02:00:00Z", "failed", "f1"), ("b", "no time", "checked_in", "f3"), ("b", None, "x", "f4")]
    got = snapshots.latest_beacons(spark.createDataFrame(rows, "attemptId string, updatedAt string, status string, file string"))
    assert {r.attemptId: r.status for r in got.collect()} == {"a": "failed", "b": "checked_in"}
