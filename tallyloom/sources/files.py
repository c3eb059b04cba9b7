"""Text, JSON lines, audio folders, and the table sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text

USAGE = "recordType string, commandName string, stepIndex int, requestBytes long, inputBytes long, prompt_tokens long, completion_tokens long, prompt_cache_hit_tokens long, prompt_cache_miss_tokens long, _bad string"


def json_lines(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("llm_usage", "llm_call"), schema: str = USAGE) -> tuple[DataFrame, DataFrame]:
    """(records of the kinds, malformed lines)."""
    parsed = spark.read.text(path).select("value", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.filter(~bad & F.col("r.recordType").isin(*kinds)).select("r.*").drop("_bad"), parsed.filter(bad & (F.trim("value") != "")).select("value")


def paragraphs(c):
    """Blank-line paragraphs; one alone is cut at headings and questions."""
    parts = F.filter(F.transform(F.split(c, r"\n\s*\n"), F.trim), lambda x: x != "")
    marked = F.regexp_replace(c, r"(?m)^\s*(?=(?:Questions? \d|READING PASSAGE|Answers?\b))", "\u0001")
    semantic = F.filter(F.transform(F.split(marked, "\u0001"), F.trim), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(semantic)


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, text) of text and markdown files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", F.posexplode(paragraphs(F.col("value"))).alias("block", "text"))


def binary_documents(spark: SparkSession, path: str, suffix: str, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, block, text) of files that ``parse`` turns into blocks; the seam
    for formats that need a library of their own, such as PDF."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                blocks = parse(content)
                yield pd.DataFrame({"path": p, "block": range(len(blocks)), "text": blocks})

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, block int, text string")


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """Audio file names in natural order."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp3").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return f.orderBy(text.natural_key(F.col("name")), "name")


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the named columns, null where it lacks them."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def union_optional(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_tables(tables: dict[str, DataFrame], root: str, kind: str = "parquet") -> None:
    """Each table of an export in a folder of its own."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(f"{root}/{name}")
