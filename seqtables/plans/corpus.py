"""Build a labelled, leak-free corpus from protein entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqtables.operators.clean import assign_classes, clean_corpus
from seqtables.operators.cluster import CLUSTER, cluster, dereplicate, group_split
from seqtables.operators.truncate import truncate_classes
from seqtables.session import stack
from seqtables.sources.proteins import read_protein_xml
from seqtables.sources.store import stage, write_splits


def prepare(entries: DataFrame, classes: int, marker: str = "U", domain: str = "Bacteria", min_length: int = 10, max_length: int = 1000) -> DataFrame:
    """Clean, dereplicate, label and truncate protein entries."""
    kept = dereplicate(clean_corpus(entries, min_length, max_length, domain))
    return truncate_classes(assign_classes(kept, classes, marker), marker, min_length)


def split(corpus: DataFrame, identity: float = 0.3, seed: int = 42) -> DataFrame:
    """Cluster the corpus and deal whole clusters to train, val and test."""
    return group_split(cluster(corpus, identity), CLUSTER, seed)


def build_corpus(
    spark: SparkSession, paths: list[str], folder: str, classes: int = 2, marker: str = "U", seed: int = 42, overwrite: bool = False
) -> DataFrame:
    """Read XML files, prepare and split the corpus and write one folder per split.

    Each file's entries and the prepared corpus are stages: present ones are reused.
    """
    parts = [
        stage(spark, f"{folder}/entries/{i}", lambda path=path: read_protein_xml(spark, path), overwrite)
        for i, path in enumerate(paths)
    ]
    entries = stack(*parts, allow_missing=True)
    corpus = stage(spark, f"{folder}/prepared_{classes}c", lambda: prepare(entries, classes, marker), overwrite)
    write_splits(split(corpus, seed=seed), f"{folder}/corpus_{classes}c")
    return spark.read.parquet(f"{folder}/corpus_{classes}c")
