"""From raw documents to a training mix, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's documents. All stages but the
last return the columns of ``documents``; ``n_chars`` follows the text. The
last gives one row for each pass over a document, in training order, with
``epoch``, ``taken`` and ``position``.

A text of which no line fails a rule or repeats comes through byte for byte,
blank lines included, until the mix takes it or not.

Defined cases: a null or empty text fails the quality rules and goes; rows
that repeat an id and its text are one document from the third stage on; rows
without an id stay apart there; a null source is a source of its own; an empty
table gives an empty result; other columns pass through whatever their names,
and a new column of the last stage takes an underscore if its name is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, line_dedup, mixing, quality_rules, simhash
from tallyloom.llm._shared import materialise, table

#: No SQL text: edit distance joins, tiling and shingle similarity are beyond it.
ORACLE_SQL: str | None = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(quality_rules.clean_documents(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.without_repeated_lines(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
