"""Pick rows per group: best hits, representatives, ordered pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order.

    Spark limits ranked groups before the shuffle, so a hot key sends one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows per key with their rank."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)


def best_hit(hits: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """The hit with the lowest e-value per query."""
    return pick(hits, ["query_id"], [F.asc("e_value"), *[F.asc(t) for t in ties]])


def best_hsp(hits: DataFrame, column: str = "alignment_length", how: str = "highest", ties: Sequence[str] = ()) -> DataFrame:
    """One aligned segment per (query, subject)."""
    if how not in ("highest", "lowest"):
        raise ValueError(f"how must be 'highest' or 'lowest', not {how!r}")
    first = F.asc(column) if how == "lowest" else F.desc(column)
    return pick(hits, ["query_id", "subject_id"], [first, *[F.asc(t) for t in ties]])


def cluster_reps(members: DataFrame, representative: str = "mmseqs_representative") -> DataFrame:
    """One row per cluster: the representative's own row if present, else the smallest id."""
    own = (F.col("id") == F.col(representative)).cast("int")
    return pick(members, [representative], [own.desc(), F.asc("id")])


def top_per_taxon(genomes: DataFrame, level: str, score: str = "checkm_completeness", key: str = "genome_id") -> DataFrame:
    """The genome with the highest score per taxon."""
    return pick(genomes, [level], [F.desc(score), F.asc(key)])


def strand_ordered_pair(genes: DataFrame, group: str, value: str) -> DataFrame:
    """Per group the values of the first and second gene along the strand of its first gene.

    The first holds the C-terminal side's value, the second the N-terminal side's.
    """
    ties = "id"
    strand = F.min_by("strand", F.struct("start", ties))
    strands = genes.groupBy(group).agg(strand.alias("__strand"))
    keyed = genes.join(strands, group)
    along = F.when(F.col("__strand") == 1, F.col("start")).otherwise(-F.col("start"))
    two = top_n(keyed, [group], [along.asc(), F.asc(ties)], 2, "__rank")
    return two.groupBy(group).agg(
        F.max(F.when(F.col("__rank") == 1, F.col(value))).alias("c_terminus"),
        F.max(F.when(F.col("__rank") == 2, F.col(value))).alias("n_terminus"),
    )
