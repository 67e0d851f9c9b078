"""Joins and unions that put result tables together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtables.session import stack


def results_star(predictions: DataFrame, genes: DataFrame, annotations: DataFrame, copies: DataFrame, genomes: DataFrame) -> DataFrame:
    """Predictions with gene data, annotations (one row each), copy numbers and genome data.

    Plain left joins: small sides are broadcast by their measured size, hot keys are split
    by adaptive execution.
    """
    return (
        predictions.join(genes, "id", "left")
        .join(annotations, "id", "left")
        .join(copies, "genome_id", "left")
        .join(genomes, "genome_id", "left")
    )


def outer_zero_fill(left: DataFrame, others: Sequence[DataFrame], key: str, sizes: DataFrame | None = None) -> DataFrame:
    """Full outer joins on a key with missing counts as 0, then one size per key."""
    joined = reduce(lambda a, b: a.join(b, key, "full_outer"), others, left)
    filled = joined.fillna(0, [c for c in joined.columns if c != key])
    if sizes is None:
        return filled
    rest = [c for c in sizes.columns if c != key]
    single = sizes.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*")
    return filled.join(single, key, "left")


def counts_with_first(df: DataFrame, key: str, value: str, order: str = "id") -> DataFrame:
    """Per key the number of rows and the value of the first row; keys come from the counts."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("count"), F.min_by(value, order).alias(value)
    )


def with_attributes(df: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Copy the attributes of a small table to every row of its key."""
    return df.join(attributes, key, "left")


def model_outputs(extended: DataFrame, outputs: Mapping[str, DataFrame]) -> DataFrame:
    """Inner join of a table with each model's ``prediction`` under the model's name."""
    renamed = [
        output.select("id", F.col("prediction").alias(f"{model}_model_prediction")) for model, output in outputs.items()
    ]
    return reduce(lambda a, b: a.join(b, "id"), renamed, extended)


def union_tables(parts: Mapping[str, DataFrame], name: str = "dataset") -> DataFrame:
    """All tables below each other with their name; missing columns become null."""
    named = [df.withColumn(name, F.lit(part)) for part, df in parts.items()]
    return stack(*named, allow_missing=True)


def shared_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys in both tables."""
    keys = lambda df: df.select(key).where(F.col(key).isNotNull())
    return keys(left).intersect(keys(right))


def source_only(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str], tag: str = "source") -> DataFrame:
    """Rows with a non-null key found in one table alone, tagged with that table's name."""
    held = lambda df: df.where(F.col(key).isNotNull())
    only = lambda a, b, name: held(a).join(b.select(key), key, "left_anti").withColumn(tag, F.lit(name))
    return stack(only(left, right, names[0]), only(right, left, names[1]), allow_missing=True)


def consolidate_embeddings(
    proteins: DataFrame, vectors: DataFrame, genomes: DataFrame, keys: Sequence[str] = ("genome_id", "ID"), max_length: int = 2000
) -> DataFrame:
    """Proteins below a length with their vector and their genome's attributes."""
    short = proteins.where(F.length("seq") < max_length)
    return short.join(vectors, list(keys)).join(genomes, "genome_id", "left")


def unmatched(proteins: DataFrame, vectors: DataFrame, keys: Sequence[str] = ("genome_id", "ID"), max_length: int = 2000) -> DataFrame:
    """Keys that break the one-to-one match of proteins and vectors, with both counts.

    An empty result means that every protein has exactly one vector.
    """
    keys = list(keys)
    short = proteins.where(F.length("seq") < max_length).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_proteins"))
    have = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_vectors"))
    both = short.join(have, keys, "left").fillna(0, ["n_vectors"])
    return both.where("n_proteins != 1 or n_vectors != 1")
