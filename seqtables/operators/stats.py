"""Grouped statistics. Every one reduces its rows before anything is shuffled by group."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from seqtables.operators.ordered import running_sums
from seqtables.session import stack


def share(condition: Column) -> Column:
    """Fraction of rows that meet a condition; null conditions count as not met."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def group_counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value without nulls, most frequent first, ties by value."""
    counts = group_counts(df.where(F.col(column).isNotNull()), column, name=name)
    return counts.orderBy(F.desc(name), F.asc(column))


def top_values(df: DataFrame, column: str, k: int = 10, name: str = "n") -> DataFrame:
    """The k most frequent values."""
    return value_counts(df, column, name).limit(k)


def pivot_counts(df: DataFrame, key: str, column: str, names: Mapping[str, str]) -> DataFrame:
    """Per key, one count column for each of the named values; absent pairs count 0."""
    counts = [F.count_if(F.col(column) == value).alias(name) for value, name in names.items()]
    return df.where(F.col(column).isin(*names)).groupBy(key).agg(*counts)


def unpivot_predictions(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long table of model predictions: ids, model, prediction."""
    return df.unpivot(list(ids), list(columns), "model", "prediction")


def prediction_crosstab(
    df: DataFrame, organism: str, columns: Sequence[str], classes: Sequence[int]
) -> DataFrame:
    """Per model and organism the count of each class, with a ``total`` line over organisms."""
    long = unpivot_predictions(df, [organism], columns)
    per = long.rollup("model", organism).agg(
        F.grouping(organism).alias("is_total"),
        F.grouping("model").alias("no_model"),
        *[F.count_if(F.col("prediction") == c).alias(f"class_{c}") for c in classes],
    )
    return per.where("no_model = 0").select(
        "model",
        F.when(F.col("is_total") == 1, "total").otherwise(F.col(organism).cast("string")).alias(organism),
        *[f"class_{c}" for c in classes],
    )


def confusion_matrix(
    df: DataFrame, label: str, prediction: str, classes: Sequence[int]
) -> DataFrame:
    """Long matrix (label, prediction, n, share of the label's rows); absent cells are 0."""
    counts = df.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(prediction) == c).alias(f"c{c}") for c in classes],
    )
    cells = F.array(*[F.struct(F.lit(c).alias("prediction"), F.col(f"c{c}").alias("n")) for c in classes])
    return counts.select("label", "total", F.inline(cells)).select(
        "label", "prediction", "n", (F.col("n") / F.col("total")).alias("fraction")
    )


def contingency(df: DataFrame, left: str, right: str, left_values: Sequence[int], right_values: Sequence[int]) -> DataFrame:
    """Counts of every pair of two models' outputs, absent pairs 0."""
    pairs = [(a, b) for a in left_values for b in right_values]
    counts = df.agg(*[F.count_if((F.col(left) == a) & (F.col(right) == b)).alias(f"p_{a}_{b}") for a, b in pairs])
    cells = [
        F.struct(F.lit(a).alias(left), F.lit(b).alias(right), F.col(f"p_{a}_{b}").alias("n")) for a, b in pairs
    ]
    return counts.select(F.inline(F.array(*cells)))


def balanced_accuracy(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes present among the labels."""
    recall = df.groupBy(*keys, label).agg(share(F.col(label) == F.col(prediction)).alias("recall"))
    return recall.groupBy(*keys).agg(F.avg("recall").alias("balanced_accuracy"))


def accuracy_sweep(
    df: DataFrame, label: str, columns: Sequence[str], keys: Sequence[str], merge: Mapping[int, int] | None = None
) -> DataFrame:
    """Balanced accuracy of every model on every split, in one grouped job."""
    long = unpivot_predictions(df, [*keys, label], columns)
    if merge:
        long = long.replace(dict(merge), subset=[label, "prediction"])
    return balanced_accuracy(long, label, "prediction", [*keys, "model"])


def grid(low: Column, high: Column, points: int) -> Column:
    """Array of evenly spaced values from low to high."""
    step = (high - low) / F.lit(float(points - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + i.cast("double") * step)


def ecdf(df: DataFrame, value: str, group: str, top: float, points: int) -> DataFrame:
    """Share of values strictly below each point of an even grid from 0 to ``top``.

    A value counts from the first grid point above it on, so one number per value and a
    running sum over at most ``points`` rows per group replace all comparisons.
    """
    step = top / (points - 1)
    near = F.greatest(F.floor(F.col(value) / F.lit(step)).cast("long"), F.lit(-1))
    # Rounding may put the quotient one off; the exact test is value < grid point.
    first = F.when(F.col(value) < (near.cast("double") * step), near)
    first = first.when(F.col(value) < ((near + 1).cast("double") * step), near + 1).otherwise(near + 2)
    first = F.greatest(first, F.lit(0))
    counted = df.where(F.col(value).isNotNull()).groupBy(group, first.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    filled = _fill_steps(counted, group, points)
    return filled.select(
        group, (F.col("i").cast("double") * step).alias("x"), (F.col("upto") / F.col("total")).alias("fraction")
    )


def _fill_steps(counted: DataFrame, group: str, points: int) -> DataFrame:
    """Spread (group, i, n) over all grid points with running sums and the group's total."""
    totals = counted.groupBy(group).agg(F.sum("n").alias("total"))
    grid_rows = totals.select(
        group, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("i"), F.lit(0).alias("n")
    )
    window = Window.partitionBy(group).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    inside = stack(counted.where(F.col("i") < points), grid_rows)
    per_point = inside.groupBy(group, "i").agg(F.sum("n").alias("n"))
    return per_point.withColumn("upto", F.sum("n").over(window)).join(totals, group)


def histogram(
    df: DataFrame, value: str, bins: int, group: str | None = None, below: float | None = None
) -> DataFrame:
    """Equal-width bins over the range of all groups together; the last bin is closed.

    Returns (group, bin, low, n, density), empty bins left out. ``below`` drops larger values first.
    """
    values = df.where(F.col(value).isNotNull())
    if below is not None:
        values = values.where(F.col(value) < below)
    edges = values.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    span = F.struct("low", "high")
    keyed = values.withColumn("span", edges.select(span).scalar())
    low, width = F.col("span.low"), (F.col("span.high") - F.col("span.low")) / F.lit(float(bins))
    place = F.when(width > 0, F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))).otherwise(0)
    keys = [group] if group else []
    counts = keyed.groupBy(*keys, place.cast("int").alias("bin"), low.alias("base"), width.alias("width")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.select(
        *keys,
        "bin",
        (F.col("base") + F.col("bin") * F.col("width")).alias("low"),
        "n",
        F.try_divide(F.col("n"), total * F.col("width")).alias("density"),
    )


def kernel_density(df: DataFrame, value: str, group: str, points: int = 50) -> DataFrame:
    """Gaussian kernel density on an even grid over each group's range, Scott bandwidth.

    Rows are first counted per distinct value; only those counts meet the grid. A group without
    spread (one row, or equal values) has the grid with a null density.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("w")
    )
    # Deviations are taken from the mean, so that values far from zero keep their spread.
    totals = counts.groupBy(group).agg(
        F.sum("w").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"), (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean")
    )
    same = lambda x, y: F.col(f"{x}.{group}").eqNullSafe(F.col(f"{y}.{group}"))
    apart = F.col("v") - F.col("mean")
    variance = (F.sum(F.col("w") * apart * apart) - F.pow(F.sum(F.col("w") * apart), F.lit(2.0)) / F.first("total")) / (F.first("total") - 1)
    shape = (
        counts.alias("c")
        .join(totals.alias("t"), same("c", "t"))
        .groupBy(F.col(f"c.{group}"))
        .agg(
            F.first("total").alias("total"),
            F.first("low").alias("low"),
            F.first("high").alias("high"),
            F.when(F.first("total") > 1, F.sqrt(F.greatest(variance, F.lit(0.0))) * F.pow(F.first("total").cast("double"), F.lit(-0.2))).alias("h"),
        )
    )
    spread = counts.alias("c").join(shape.alias("s"), same("c", "s")).select(
        f"c.{group}", "v", "w", "total", "h", F.posexplode(grid(F.col("low"), F.col("high"), points)).alias("i", "x")
    )
    z = F.try_divide(F.col("x") - F.col("v"), F.col("h"))
    return (
        spread.groupBy(group, "i", "x", "h", "total")
        .agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("mass"))
        .select(group, "i", "x", F.when(F.col("h") > 0, F.col("mass") / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))
    )


def mean_sem(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, sample deviation, standard error and count per group."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
    )


def long_vectors(df: DataFrame, *keep: str, vector: str = "features", value: str = "value") -> DataFrame:
    """One row per vector element: kept columns, dim, value."""
    # The outer form keeps the optimizer from evaluating the vector a second time in a filter.
    long = df.select(*keep, F.posexplode_outer(vector).alias("dim", value)).where("dim is not null")
    return long.withColumn(value, F.col(value).cast("double"))


def mann_whitney_u(df: DataFrame, value: str, is_first: Column, group: str | None = None) -> DataFrame:
    """U of the first sample, sizes, tie term and continuity-corrected z, per group.

    Rows are counted per distinct value first. Running counts over the distinct values give
    how many of the second sample lie below each of the first; nothing is ranked row by row.
    """
    keys = [group] if group else []
    first = is_first.cast("int")
    counts = (
        df.where(F.col(value).isNotNull() & is_first.isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.sum(first).alias("a"), F.sum(1 - first).alias("b"))
    )
    ranked = running_sums(counts, ["v"], {"b_upto": "b"}, group=keys)
    tied = (F.col("a") + F.col("b")).cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("a").alias("n1"),
        F.sum("b").alias("n2"),
        F.sum(F.col("a") * (F.col("b_upto") - F.col("b") + 0.5 * F.col("b"))).alias("u"),
        F.sum(tied * tied * tied - tied).alias("tie_term"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    return sums.withColumn("sigma", spread).withColumn(
        "z", F.try_divide(F.abs(F.col("u") - n1 * n2 / 2.0) - 0.5, F.col("sigma"))
    )


@F.pandas_udf(DoubleType())
def _upper_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2.0)), na_action="ignore")


#: Samples up to this size have the exact distribution of U, unless there are ties.
EXACT_SIZE = 8
#: Largest product of the sizes that is worked out exactly: one double per possible U.
EXACT_PLACES = 50_000_000


def _exact_tail(n1: int, n2: int, u: float) -> float:
    """P(U >= u) without ties.

    The number of orders with each U is a coefficient of the product of (1 - q^(n+i)) / (1 - q^i)
    for i up to the smaller size m, n being the larger: running sums with stride i, then
    differences at n + i. The lower half of the distribution is enough.
    """
    m, n = sorted((int(n1), int(n2)))
    upto = m * n - math.ceil(u)  # P(U >= u) = P(U <= upto)
    if upto < 0 or upto >= m * n:
        return float(upto >= 0)
    if 2 * upto >= m * n:
        return 1.0 - _exact_tail(m, n, upto + 1)
    ways = np.zeros(upto + 1)
    ways[0] = 1.0
    for i in range(1, m + 1):
        for r in range(min(i, upto + 1)):
            ways[r::i] = np.cumsum(ways[r::i])
    for step in range(n + 1, n + m + 1):
        if step <= upto:
            ways[step:] = ways[step:] - ways[:-step]
    return float(ways.sum() / math.comb(m + n, m))


@F.pandas_udf(DoubleType())
def _exact_upper(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    found = [None if math.isnan(x) else _exact_tail(int(a), int(b), x) for a, b, x in zip(n1, n2, u)]
    return pd.Series(found, dtype="float64")


def mann_whitney_p(tests: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """Add the p-value to ``mann_whitney_u`` rows (one row per test).

    It is exact if one sample has at most EXACT_SIZE values, no two values are equal and the sizes'
    product is at most EXACT_PLACES; else it comes from the normal approximation with corrections
    for ties and continuity. An empty sample has none.
    """
    places = F.col("n1").cast("double") * F.col("n2")
    small = (F.least("n1", "n2") <= EXACT_SIZE) & (F.col("tie_term") == 0) & (places <= EXACT_PLACES) & (places > 0)
    if alternative == "two-sided":
        u, z, sides = F.greatest(F.col("u"), places - F.col("u")), F.col("z"), 2.0
    elif alternative in ("less", "greater"):
        # U1 small speaks for 'less': test the second sample's U against the centre.
        u = places - F.col("u") if alternative == "less" else F.col("u")
        z, sides = F.try_divide(u - places / 2.0 - 0.5, F.col("sigma")), 1.0
    else:
        raise ValueError(f"unknown alternative {alternative!r}")
    # Python is called for every row, whatever its branch; a missing U costs nothing there.
    exact = _exact_upper(F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0)), F.when(small, u.cast("double")))
    p = sides * F.when(small, exact).otherwise(_upper_tail(z))
    return tests.withColumn("p", p).withColumn("p", F.when(F.col("p") > 1, 1.0).otherwise(F.col("p")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weight N / (n_class * classes) per class."""
    counts = group_counts(df, label)
    every = Window.partitionBy()  # one row per class
    return counts.withColumn("weight", F.sum("n").over(every) / (F.col("n") * F.count(F.lit(1)).over(every)))


def balanced_sample_size(df: DataFrame, label: str, p: float = 0.99) -> DataFrame:
    """Draws needed to see every row with probability p, and the number of classes."""
    draws = F.ln(F.lit(1 - p)) / F.ln(1 - 1 / F.col("n"))
    return group_counts(df, label).agg(
        (F.floor(F.max(draws)) * F.count(F.lit(1))).cast("long").alias("sample_size"),
        F.count(F.lit(1)).alias("classes"),
    )


def family_rollup(df: DataFrame, definition: str, count: str, families: Mapping[str, str]) -> DataFrame:
    """Sum counts per family after dropping ``[EC:..]``; unnamed definitions stand for themselves."""
    plain = F.trim(F.regexp_replace(F.col(definition), "\\[EC:.*\\]", ""))
    family = F.create_map(*[F.lit(x) for pair in families.items() for x in pair]) if families else None
    named = F.coalesce(F.try_element_at(family, plain), plain) if families else plain
    return df.groupBy(named.alias("family")).agg(F.sum(count).alias("n")).orderBy(F.desc("n"), "family")


def adjusted_codon_frequency(df: DataFrame, organism: str, label: str, codon: str) -> DataFrame:
    """Share of a codon's uses that fall in a class, over the class size, per organism."""
    counts = df.groupBy(organism, label, codon).agg(F.count(F.lit(1)).alias("n"))
    of_codon = F.sum("n").over(Window.partitionBy(organism, codon))
    of_class = F.sum("n").over(Window.partitionBy(organism, label))
    return counts.withColumn("adjusted", F.col("n") / of_codon / of_class).where(F.col(codon) != "none")


def threshold_sweep(
    queries: DataFrame, hits: DataFrame, group: str, low: float = 1e-4, points: int = 20, key: str = "query_id", score: str = "e_value"
) -> DataFrame:
    """Per group and threshold: mean and standard error of hits per query below it, share without any.

    Hits are reduced to one row of counts per query before the queries are joined.
    """
    top = hits.agg(F.max(score)).scalar()
    steps = [F.lit(low) + F.lit(float(i)) * ((F.col("__top") - low) / F.lit(float(points - 1))) for i in range(points)]
    counts = (
        hits.select(key, score)
        .withColumn("__top", top)
        .groupBy(key)
        .agg(*[F.count_if(F.col(score) < step).alias(f"n{i}") for i, step in enumerate(steps)])
    )
    cells = [F.struct(F.lit(i).alias("step"), F.coalesce(f"n{i}", F.lit(0)).alias("n")) for i in range(points)]
    long = queries.join(counts, key, "left").select(group, F.inline(F.array(*cells)))
    return (
        long.groupBy(group, "step")
        .agg(
            F.avg("n").alias("mean"),
            (F.stddev_samp("n") / F.sqrt(F.count("n"))).alias("sem"),
            share(F.col("n") == 0).alias("fraction_none"),
        )
        .withColumn("__top", top)
        .withColumn(
            "threshold", F.lit(low) + F.col("step").cast("double") * ((F.col("__top") - low) / F.lit(float(points - 1)))
        )
        .drop("__top")
    )


def contig_stats(contigs: DataFrame, genome: str = "genome_id") -> DataFrame:
    """Contigs per genome; one contig makes the genome complete."""
    return group_counts(contigs, genome, name="n_contigs").withColumn("complete", F.col("n_contigs") == 1)


def species_summary(hits: DataFrame, group: str, prediction: str, cutoff: float, score: str = "e_value") -> DataFrame:
    """Best hits under a cutoff: count and predicted positives per group."""
    return hits.where(F.col(score) <= cutoff).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(prediction) == 1).alias("n_positive")
    )
