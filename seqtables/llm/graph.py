"""Connected components over links, as joins and aggregates on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtables.llm.common import settled


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; component is the smallest id reachable.

    Each round, all ids that share a label take the smallest label next to any of them, and
    chains of such moves are followed to their ends by doubling, so long chains close quickly. Everything is an
    equi-join or a minimum that Spark combines before the shuffle; nothing is gathered per
    group. Each round is checkpointed. Links with a null end and loops are ignored.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = settled(pairs.union(pairs.select("v", "u")).distinct())
    labels = settled(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")))
    while True:
        of_v = labels.select(F.col("id").alias("v"), F.col("label").alias("low"))
        near = edges.join(of_v, "v").groupBy("u").agg(F.min("low").alias("low"))
        moves = settled(
            labels.join(near, F.col("id") == F.col("u"))
            .groupBy("label")
            .agg(F.min("low").alias("to"))
            .where(F.col("to") < F.col("label"))
        )
        if moves.isEmpty():
            return labels.select("id", F.col("label").alias("component"))
        while True:  # follow moves that lead to moving labels, twice as far each time
            onward = moves.select(F.col("label").alias("to"), F.col("to").alias("further"))
            if moves.join(onward, "to", "left_semi").isEmpty():
                break
            moves = settled(moves.join(onward, "to", "left").select("label", F.coalesce("further", "to").alias("to")))
        labels = settled(labels.join(moves, "label", "left").select("id", F.coalesce("to", "label").alias("label")))
