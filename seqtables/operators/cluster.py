"""Cluster, dereplicate and split sequence tables without leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtables.operators.ordered import dense_ids, number_rows
from seqtables.operators.similarity import compared_pairs, distinct_sequences, jaccard_for_identity
from seqtables.session import cut, spread, stack, written

REPRESENTATIVE, CLUSTER = "mmseqs_representative", "mmseqs_cluster"


def pick_representatives(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Table (id, representative): greedy cover of ``nodes`` by the centres of ``edges``.

    Every edge points from a sequence to an earlier one (longer, or as long with a smaller
    id). A sequence represents itself unless one of its centres represents itself; then it
    joins the most similar of these. Each round settles all sequences whose centres are
    settled.
    """
    edges = cut(edges.select("id", "center", "jaccard"))
    linked = edges.select("id").distinct()
    state = cut(
        nodes.select("id").join(linked.withColumn("linked", F.lit(True)), "id", "left").select(
            "id", F.when(F.col("linked").isNull(), F.lit(True)).alias("is_rep")
        )
    )
    while state.where("is_rep is null").limit(1).count():
        centers = state.select(F.col("id").alias("center"), F.col("is_rep").alias("center_rep"))
        verdict = (
            edges.join(state.where("is_rep is null").select("id"), "id", "left_semi")
            .join(centers, "center")
            .groupBy("id")
            .agg(
                F.max(F.coalesce("center_rep", F.lit(False))).alias("covered"),
                F.max(F.col("center_rep").isNull()).alias("waiting"),
            )
            .select("id", F.when(F.col("covered"), False).when(~F.col("waiting"), True).alias("settled"))
        )
        state = cut(state.join(verdict, "id", "left").select("id", F.coalesce("is_rep", "settled").alias("is_rep")))
    reps = state.where("is_rep").select(F.col("id").alias("center"))
    joined = (
        edges.join(state.where("not is_rep").select("id"), "id", "left_semi")
        .join(reps, "center")
        .groupBy("id")
        .agg(F.min(F.struct((-F.col("jaccard")).alias("less"), "center")).alias("best"))
        .select("id", F.col("best.center").alias("representative"))
    )
    return stack(joined, reps.select(F.col("center").alias("id"), F.col("center").alias("representative")))


def representatives(df: DataFrame, identity: float, k: int = 5) -> DataFrame:
    """Table (seq, representative) over the distinct sequences of ``df``.

    Identity is estimated from the k-mers shared beyond chance; all pairs that reach it are edges
    (see ``similar_pairs``).
    """
    single = spread(written(distinct_sequences(df), "sequences")[0])
    edges = compared_pairs(single, k, jaccard_for_identity(identity, k), beyond=True)
    return single.join(pick_representatives(single, edges), "id").select("seq", "representative")


def cluster(df: DataFrame, identity: float = 0.3, k: int = 3) -> DataFrame:
    """Add the representative and a dense cluster number to every row.

    Sequences are linked by the identity that their shared k-mers suggest beyond what chance
    explains (see ``chance_rate``). With few kinds of k-mers a low identity leaves no more shared
    ones than chance does; such pairs stay apart. Rows without a sequence keep null in both columns.
    """
    bare = df.drop(REPRESENTATIVE, CLUSTER)
    found = representatives(bare, identity, k).withColumnRenamed("representative", REPRESENTATIVE)
    found = cut(found)
    numbers = dense_ids(found, REPRESENTATIVE, CLUSTER)
    return bare.join(found.join(numbers, REPRESENTATIVE), "seq", "left").select(*bare.columns, REPRESENTATIVE, CLUSTER)


def dereplicate(df: DataFrame, identity: float = 0.95, k: int = 5) -> DataFrame:
    """Only the representatives' rows, without cluster columns."""
    bare = df.drop(REPRESENTATIVE, CLUSTER)
    reps = representatives(bare, identity, k).select(F.col("representative").alias("id")).distinct()
    return bare.join(reps, "id", "left_semi")


def dereplicate_exact(df: DataFrame) -> DataFrame:
    """One row per distinct sequence, the smallest id."""
    rest = [c for c in df.columns if c != "seq"]
    first = df.groupBy("seq").agg(F.min_by(F.struct(*rest), "id").alias("row"))
    return first.select(*[c if c == "seq" else F.col(f"row.{c}").alias(c) for c in df.columns])


def connected_components(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Table (id, component): the smallest id reachable over undirected edges.

    Labels take the smallest label next to them and then jump to their label's label, so
    long chains close in a logarithmic number of rounds.
    """
    both = cut(edges.select(F.col(source).alias("a"), F.col(target).alias("b")))  # read twice
    both = cut(stack(both, both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(
        both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label"))
    )
    while True:
        near = (
            both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "id")
        )
        lowered = cut(
            labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        )
        roots = lowered.select(F.col("id").alias("label"), F.col("label").alias("root"))
        jumped = cut(
            lowered.join(roots, "label", "left").select("id", "old", F.least("label", "root").alias("label"))
        )
        labels = jumped.select("id", "label")
        if not jumped.where("label != old").limit(1).count():
            return labels.withColumnRenamed("label", "component")


def group_split(df: DataFrame, group: str, seed: int = 42, fraction: float = 0.8) -> DataFrame:
    """Add ``dataset`` so that no group spans two splits.

    Groups are ordered by a seeded hash; the first 80% of them are train and val, split
    80/20 again, the rest is test. The quotas on groups are exact. Rows without a group are
    one group.
    """
    groups = df.select(group).distinct().withColumn(
        "__hash", F.md5(F.concat(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit(f"_{seed}")))
    )
    placed = number_rows(groups, ["__hash", group], "__place")
    total = groups.agg(F.count(F.lit(1)))
    kept = F.floor(F.lit(fraction) * F.col("__total"))
    named = placed.withColumn("__total", total.scalar()).select(
        group,
        F.when(F.col("__place") <= F.floor(F.lit(fraction) * kept), "train")
        .when(F.col("__place") <= kept, "val")
        .otherwise("test")
        .alias("dataset"),
    )
    x, y = df.alias("x"), named.alias("y")
    joined = x.join(y, F.col(f"x.{group}").eqNullSafe(F.col(f"y.{group}")))
    return joined.select("x.*", "y.dataset")


def leakage(splits: DataFrame, external: DataFrame, key: str, split: str = "dataset") -> DataFrame:
    """Per split: distinct keys and how many of them also occur in an external table."""
    keys = splits.select(split, key).where(F.col(key).isNotNull()).distinct()
    outside = external.select(key).distinct().withColumn("__there", F.lit(1))
    return (
        keys.join(outside, key, "left")
        .groupBy(split)
        .agg(F.count(F.lit(1)).alias("n_keys"), F.count("__there").alias("n_shared"))
    )
