"""Snapshot drops: SQLite files with a ready marker and a metadata sidecar."""

from __future__ import annotations

import sqlite3
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of one snapshot and the columns that the engine reads, with their kinds.
TABLES = {
    "exam_attempts": "attempt_id string, batch_id string, terminal_id string, candidate_id string, candidate_name string, checkin_at string, started_at string, submitted_at string, status string, app_version string, session_id string, student_uuid string, abandon_reason string",
    "reading_suite_attempts": "suite_attempt_id string, attempt_id string, status string, started_at string, completed_at string, submitted_at string, total_passages int, aggregate_json string",
    "reading_passages": "suite_attempt_id string, passage_index int, asset_id string, exam_id string, title string, category string, source_hash string, started_at string, ended_at string, duration_sec double, score_info_json string, raw_submission_json string",
    "reading_answers": "suite_attempt_id string, passage_index int, question_id string, display_label string, question_kind string, control string, source string, match_mode string, user_answer_json string, correct_answer_json string, normalized_answer_json string, is_correct int, weight double, change_count int, visit_count int, elapsed_ms bigint, duration_ms bigint, response_slot_id string, max_score double, score double",
    "writing_submissions": "writing_submission_id string, attempt_id string, task_type string, prompt_text string, content string, word_count int, started_at string, submitted_at string, duration_sec double, metadata_json string",
    "exam_kv": "key string, value_json string",
    "answer_events": "attempt_id string, event_seq bigint, client_event_id string, event_type string, clock_id string, wall_time string, monotonic_ms double, passage_index int",
    "listening_attempts": "attempt_id string, exam_id string, payload_hash string, runtime_sha256 string",
    "listening_answers": "attempt_id string, slot_id string, user_answer_json string, is_correct int, weight double",
}
META = "attemptId string, terminalId string, installId string, batchId string, paperId string, exportedAt string, schemaVersion int, dbSchemaVersion int, sizeBytes long, sha256 string"
BEACON = "attemptId string, terminalId string, batchId string, paperId string, candidateId string, candidateName string, status string, updatedAt string, _bad string"


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(ready, not ready) files below ``root``/terminal: a snapshot is ready
    once its marker stands beside it. Dot files don't count."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    rows = []
    while found.hasNext():  # markers are empty files, which a scan skips
        f = found.next()
        rows.append((f.getPath().toString(), f.getLen()))
    files = spark.createDataFrame(rows, "path string, length long").filter(F.col("path").rlike(r"\.(sqlite|ready)$"))
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select("path", F.element_at(F.split("path", "/"), -2).alias("terminal"), F.regexp_replace(name, r"\.(sqlite|ready)$", "").alias("stem"), F.regexp_extract(name, r"\.(\w+)$", 1).alias("kind"), "length").filter(~name.startswith("."))
    marks = named.filter("kind = 'ready'").select("terminal", "stem")
    databases = named.filter("kind = 'sqlite'").drop("kind")
    return databases.join(marks, ["terminal", "stem"], "left_semi"), databases.join(marks, ["terminal", "stem"], "left_anti")


def metadata(spark: SparkSession, root: str, versions: tuple[tuple[int, int], ...] = ((1, 1), (2, 2))) -> DataFrame:
    """Sidecars with whether their pair of versions is known."""
    m = spark.read.schema(META).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").option("multiLine", "true").json(root)
    known = F.lit(False)
    for a, b in versions:
        known = known | ((F.col("schemaVersion") == a) & (F.col("dbSchemaVersion") == b))
    return m.withColumn("compatible", F.coalesce(known, F.lit(False)))


def verified(spark: SparkSession, root: str, meta: DataFrame) -> DataFrame:
    """Each snapshot with whether size and SHA-256 equal its metadata's."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sqlite").load(root)
    own = f.select("path", "length", F.sha2("content", 256).alias("found"), F.regexp_extract("path", r"([^/]+)\.sqlite$", 1).alias("attemptId"))
    return own.join(meta, "attemptId", "left").select("attemptId", "path", F.coalesce((F.col("length") == F.col("sizeBytes")) & (F.col("found") == F.col("sha256")), F.lit(False)).alias("ok"))


def _fields(table: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in TABLES[table].split(", ")]


def _table_rows(path: str, table: str, columns: list[str]) -> tuple[list[tuple], str | None]:
    """Rows of a table as texts, or what is wrong with the file."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        if con.execute("PRAGMA quick_check").fetchone()[0] != "ok":
            return [], "integrity check failed"
        have = {r[1] for r in con.execute(f"PRAGMA table_info({table})")}
        wanted = ", ".join(f"CAST({c} AS TEXT)" if c in have else "NULL" for c in columns)
        return (con.execute(f"SELECT {wanted} FROM {table}").fetchall() if have else []), None
    except sqlite3.DatabaseError as e:
        return [], str(e)
    finally:
        con.close()


def read_tables(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of one table of all snapshots with the file's path and an error.

    A missing table has no rows and a missing column is null. A file that fails
    its integrity check gives one row with an error, and a row with a value
    that is not of its column's kind has that value null and says so.
    """
    fields = _fields(table)
    columns = [c for c, _ in fields]
    schema = "path string, error string, " + ", ".join(f"{c} string" for c in columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(c, pa.string()) for c in ("path", "error", *columns)])
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                with tempfile.NamedTemporaryFile(suffix=".sqlite") as f:  # the engine reads files only
                    f.write(content.as_py())
                    f.flush()
                    found, error = _table_rows(f.name, table, columns)
                found = [(None,) * len(columns)] if error is not None else found
                for k in range(0, len(found), 10_000):
                    part = list(zip(*((path.as_py(), error, *r) for r in found[k : k + 10_000]), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in part], schema=kind)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sqlite").load(root)
    texts = files.select("path", "content").mapInArrow(rows, schema)
    typed = [F.col(c).try_cast(kind).alias(c) for c, kind in fields]
    wrong = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull(), c) for c, kind in fields if kind != "string"), F.lit(None).cast("string")))
    said = F.when(F.size(wrong) > 0, F.concat(F.lit("not of its kind: "), F.array_join(wrong, ", ")))
    return texts.select("path", F.coalesce("error", said).alias("error"), *typed)


def beacons(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(beacons, errors) of status files; a bad file is an error, not a stop."""
    raw = spark.read.schema(BEACON).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", "true").option("recursiveFileLookup", "true").json(root)
    raw = raw.withColumn("file", F.input_file_name())
    bad = F.col("_bad").isNotNull() | F.col("attemptId").isNull()
    return raw.filter(~bad).drop("_bad"), raw.filter(bad).select("file")


def latest_beacons(found: DataFrame) -> DataFrame:
    """The last status of each attempt, by time and then file."""
    at = F.struct(F.coalesce(F.try_to_timestamp("updatedAt"), F.lit(0).cast("timestamp")).alias("t"), "updatedAt", "file")
    return found.groupBy("attemptId").agg(F.max_by(F.struct(*(c for c in found.columns if c != "attemptId")), at).alias("r")).select("attemptId", "r.*")


def paper_ids(rows: DataFrame, column: str) -> DataFrame:
    """Paper ids of the three shapes of a JSON column, in order of precedence:
    an object's paperId, its locked list, a bare list; several are a conflict."""
    doc = F.col(column)
    own = F.get_json_object(doc, "$.paperId")
    locked = F.from_json(F.coalesce(F.get_json_object(doc, "$.lockedSequence"), F.when(doc.rlike(r"^\s*\["), doc)), "array<struct<paperId:string>>")
    many = F.array_distinct(F.array_compact(F.transform(locked, lambda x: x["paperId"])))
    return rows.withColumn("paper_id", F.coalesce(own, F.when(F.size(many) == 1, many[0]))).withColumn("paper_conflict", F.coalesce(own.isNull() & (F.size(many) > 1), F.lit(False)))
