"""A drop folder as a stream: a source with offsets, a ledger, retries.

A snapshot is offered once its ready marker stands beside it. Which files an
offset stands for is written down before it is given out, so that a batch that
runs again after a failure has the same files. A file that failed is offered
again; whether content was imported is known by (file, SHA-256) in the ledger.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "file string, terminal string, stem string, path string, bytes bigint, sha256 string, meta string"
LEDGER = "file string, sha256 string, status string, error string, imported bigint, at double"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, by URI or as a local path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _listed(path: str, recursive: bool = True) -> list[pafs.FileInfo]:
    system, where = _open(path)
    return [f for f in system.get_file_info(pafs.FileSelector(where, allow_not_found=True, recursive=recursive)) if f.type == pafs.FileType.File]


def ready_files(root: str) -> list[dict]:
    """Snapshots below ``root``/terminal whose marker is there, by name. Dot
    files don't count."""
    found = {f.path: f for f in _listed(root) if not f.base_name.startswith(".")}
    out = []
    for path, f in sorted(found.items()):
        stem = path.removesuffix(".sqlite")
        if stem != path and f"{stem}.ready" in found:
            terminal, name = path.rsplit("/", 2)[-2:]
            out.append({"file": f"{terminal}/{name}", "path": path, "bytes": f.size, "modified": f.mtime_ns})
    return out


class _Files(InputPartition):
    def __init__(self, files: list[dict]) -> None:
        super().__init__(0)
        self.files = files


class DropReader(DataSourceStreamReader):
    """Offsets count the entries of a log of file lists."""

    def __init__(self, options: dict) -> None:
        self.root, self.log = options["path"], options["log"]
        self.ledger = options.get("ledger")
        self.wait = float(options.get("retrySeconds", "0"))
        self.most = int(options.get("maxFilesPerTrigger", "1000"))

    def _entries(self) -> dict[int, str]:
        return {int(f.base_name.removesuffix(".json")): f.path for f in _listed(self.log, False) if f.base_name.endswith(".json")}

    def _entry(self, path: str) -> list[dict]:
        with _open(self.log)[0].open_input_stream(path) as f:
            return json.loads(f.read())

    def _failed(self, entries: dict[int, str]) -> dict[str, float]:
        """Files whose last entry in the ledger is a failure, and its time.

        Only entries that the ledger has seen count: what is under way is not
        offered a second time.
        """
        last: dict[str, tuple[int, str, float]] = {}
        if self.ledger:
            for f in _listed(f"{self.ledger}/status"):
                if f.base_name.endswith(".json"):
                    with _open(self.ledger)[0].open_input_stream(f.path) as s:
                        said = json.loads(s.read())
                    for x in said["files"]:
                        if said["batch"] >= last.get(x["file"], (-1,))[0]:
                            last[x["file"]] = (said["batch"], x["status"], said["at"])
        return {name: at for name, (_, status, at) in last.items() if status == "failed"}

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        entries = self._entries()
        offered: dict[str, tuple[int, int]] = {}
        told: dict[str, float] = {}
        for n in sorted(entries):
            for x in self._entry(entries[n]):
                offered[x["file"]], told[x["file"]] = (x["bytes"], x["modified"]), x["offered"]
        failed, now = self._failed(entries), time.time()
        new = [
            x | {"offered": now}
            for x in ready_files(self.root)
            if offered.get(x["file"]) != (x["bytes"], x["modified"]) or (failed.get(x["file"], 0.0) > told[x["file"]] and now - failed[x["file"]] >= self.wait)
        ][: self.most]
        last = max(entries, default=0)
        if new:
            last += 1
            system, where = _open(self.log)
            system.create_dir(where, recursive=True)
            with system.open_output_stream(f"{where}/{last:09d}.part") as f:
                f.write(json.dumps(new).encode())
            system.move(f"{where}/{last:09d}.part", f"{where}/{last:09d}.json")
        return {"entry": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        entries = self._entries()
        files = [x for n in range(start["entry"] + 1, end["entry"] + 1) for x in self._entry(entries[n])]
        return [_Files(files[k : k + 16]) for k in range(0, len(files), 16)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _open(self.root)
        for x in partition.files:
            digest, size = hashlib.sha256(), 0
            try:
                with system.open_input_stream(x["path"]) as f:
                    while block := f.read(1 << 20):
                        digest.update(block)
                        size += len(block)
                side = x["path"].removesuffix(".sqlite") + ".meta.json"
                there = system.get_file_info(side).type == pafs.FileType.File
                meta = system.open_input_stream(side).read().decode("utf-8", "replace") if there else None
            except FileNotFoundError:  # taken away since: the batch says so
                yield x["file"], *x["file"].split("/", 1)[:1], x["file"].split("/", 1)[1].removesuffix(".sqlite"), x["path"], None, None, None
                continue
            terminal, name = x["file"].split("/", 1)
            yield x["file"], terminal, name.removesuffix(".sqlite"), x["path"], size, digest.hexdigest(), meta

    def commit(self, end: dict) -> None:
        """Lists stay: they say which content was offered."""


class DropSource(DataSource):
    """Format ``snapshot_drop``; options path, log, ledger, retrySeconds,
    maxFilesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "snapshot_drop"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DropReader:
        return DropReader(self.options)


def drop_stream(spark: SparkSession, root: str, log: str, ledger: str | None = None, **options: str) -> DataFrame:
    spark.dataSource.register(DropSource)
    reader = spark.readStream.format("snapshot_drop").option("log", log)
    for key, value in ({"ledger": ledger} if ledger else {}).items():
        reader = reader.option(key, value)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(root)


def checked(files: DataFrame) -> DataFrame:
    """Files with ``error`` where the sidecar is missing or unreadable, or its
    size or SHA-256 is not the file's."""
    m = F.from_json("meta", "sizeBytes long, sha256 string, attemptId string, exportedAt string, installId string, paperId string")
    wrong = (
        F.when(F.col("sha256").isNull(), "file is gone")
        .when(F.col("meta").isNull(), "no metadata")
        .when(m["sizeBytes"].isNull() | m["sha256"].isNull(), "metadata can't be read")
        .when(m["sizeBytes"] != F.col("bytes"), "size differs from the metadata")
        .when(F.lower(m["sha256"]) != F.col("sha256"), "SHA-256 differs from the metadata")
    )
    return files.withColumn("error", wrong).withColumn("about", m)


def ledger_rows(spark: SparkSession, ledger: str, before: int | None = None) -> DataFrame:
    """The ledger, (file, sha256) by batch; ``before`` leaves later batches out."""
    system, where = _open(ledger)
    there = system.get_file_info(f"{where}/batches").type == pafs.FileType.Directory
    rows = spark.read.schema(LEDGER + ", batch bigint").parquet(f"{ledger}/batches") if there else spark.createDataFrame([], LEDGER + ", batch bigint")
    return rows if before is None else rows.filter(F.col("batch") < before)


def ingest_drops(stream: DataFrame, ledger: str, load: Callable[[DataFrame, int], DataFrame], checkpoint: str) -> StreamingQuery:
    """Give each new file to ``load`` once and write down what became of it.

    ``load`` takes (files, batch number) and returns file, status (ok, skipped
    or failed), error, imported; it must overwrite what it wrote under the
    same number. Content that the ledger has as ok is skipped; a file that
    fails its checks or its load is failed, and offered again later. A batch
    that runs again sees the ledger of the batches before it only.
    """

    def batch(files: DataFrame, number: int) -> None:
        spark = files.sparkSession
        files = files.persist()
        try:
            done = ledger_rows(spark, ledger, number).filter("status = 'ok'").select("file", "sha256").distinct()
            looked = checked(files).join(done.withColumn("_done", F.lit(True)), ["file", "sha256"], "left")
            known = looked.filter("_done").select("file", F.lit("skipped").alias("status"), F.lit("the same content was imported").alias("error"), F.lit(0).cast("long").alias("imported"))
            bad = looked.filter("_done IS NULL AND error IS NOT NULL").select("file", F.lit("failed").alias("status"), "error", F.lit(0).cast("long").alias("imported"))
            loaded = load(looked.filter("_done IS NULL AND error IS NULL").drop("_done", "error"), number).select("file", "status", "error", F.col("imported").cast("long").alias("imported"))
            every = known.unionByName(bad).unionByName(loaded).join(files.select("file", "sha256"), "file")
            out = every.select("file", "sha256", "status", "error", "imported", F.lit(time.time()).alias("at"))
            out.write.mode("overwrite").parquet(f"{ledger}/batches/batch={number}")
            said = spark.read.schema(LEDGER).parquet(f"{ledger}/batches/batch={number}").select("file", "status", "at").collect()  # maxFilesPerTrigger at most
            _mark(ledger, number, [{"file": r["file"], "status": r["status"]} for r in said])
        finally:
            files.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _mark(ledger: str, number: int, files: list[dict]) -> None:
    """What the source reads to offer failed files again."""
    system, where = _open(ledger)
    system.create_dir(f"{where}/status", recursive=True)
    with system.open_output_stream(f"{where}/status/{number:09d}.json") as f:
        f.write(json.dumps({"batch": number, "at": time.time(), "files": files}).encode())
