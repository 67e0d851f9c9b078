"""Clean a corpus: language, repeated lines, near copies, benchmark passages, mixture of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqtables.llm import decontaminate, language, line_dedup, mixing, near_dedup
from seqtables.session import release, remove_path, scratch_path

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language.stage),
    ("line dedup", line_dedup.stage),
    ("near dedup", near_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: SQL expresses neither the language models nor MinHash; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on what the one before has kept, written between them.

    A stage's table is deleted once the next one's is written, and so are a stage's shuffle files.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    former = None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if former is not None:
            remove_path(spark, former)
        former = path
        release(spark, 0.0)
    return docs
