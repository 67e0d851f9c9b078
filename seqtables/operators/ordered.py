"""Ordered prefix work (running sums, ranks, row numbers) without a one-task window.

A window over one big group runs in one task. Here the rows are split into ordered
blocks, each block is summed up, the few block totals are accumulated, and every block
then accumulates its own rows from that offset.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtables.session import cut

_BLOCK = "__block"


def range_blocks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Split ``df`` into sampled key ranges, numbered in key order in a ``__block`` column.

    The split is written out once, so every later reader sees the same blocks.
    """
    # The width of the key ranges follows the session's shuffle partitions.
    return cut(df.repartitionByRange(*keys).withColumn(_BLOCK, F.spark_partition_id()))


def running_sums(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, str | Column],
    group: Sequence[str] = (),
    block: Column | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums in ascending order of ``order`` within ``group``.

    ``sums`` maps new column names to the summed column. ``block`` may name a fixed,
    order-preserving block number per row (for instance a position divided by a width);
    without it the blocks are sampled key ranges. With ``descending`` the sums run from
    the largest key down. The order must be total for the result to be determined.
    """
    group = list(group)
    inputs = {f"__in_{i}": column for i, column in enumerate(sums.values())}
    prepared = df.withColumns(
        {name: (F.col(c) if isinstance(c, str) else c).cast("long") for name, c in inputs.items()}
    )
    if block is None:
        blocked = range_blocks(prepared, [*group, *order])
    else:
        blocked = prepared.withColumn(_BLOCK, block)

    direction = (lambda name: F.col(name).desc()) if descending else (lambda name: F.col(name).asc())
    # One row per block and group: a window over block totals stays small.
    before = Window.partitionBy(*group).orderBy(direction(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        blocked.groupBy(*group, _BLOCK)
        .agg(*[F.sum(name).alias(name) for name in inputs])
        .select(
            *group,
            _BLOCK,
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n.replace("in", "off")) for n in inputs],
        )
    )
    keys = [*group, _BLOCK]
    same = None
    left, right = blocked.alias("rows"), totals.alias("offsets")
    for key in keys:
        equal = F.col(f"rows.{key}").eqNullSafe(F.col(f"offsets.{key}"))
        same = equal if same is None else same & equal
    offsets = [f"__off_{i}" for i in range(len(inputs))]
    joined = left.join(right, same, "inner").select("rows.*", *[F.col(f"offsets.{o}") for o in offsets])
    inside = (
        Window.partitionBy(*keys)
        .orderBy(*[direction(name) for name in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return joined.select(
        *[F.col(f"`{name}`") for name in df.columns],
        *[
            (F.sum(name).over(inside) + F.col(offset)).alias(target)
            for target, name, offset in zip(sums, inputs, offsets)
        ],
    )


def number_rows(
    df: DataFrame, order: Sequence[str], name: str = "row_number", group: Sequence[str] = ()
) -> DataFrame:
    """Add a 1-based row number in ``order``."""
    return running_sums(df, order, {name: F.lit(1)}, group=group)


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Table (key, name) with a 0-based dense integer per distinct key, in key order."""
    distinct = df.select(key).where(F.col(key).isNotNull()).distinct()
    numbered = number_rows(distinct, [key], name)
    return numbered.withColumn(name, (F.col(name) - 1).cast("long"))


def row_slice(df: DataFrame, order: Sequence[str], start: int, end: int) -> DataFrame:
    """Rows start..end-1 (0-based) in the given order."""
    numbered = number_rows(df, order, "__row")
    return numbered.where((F.col("__row") > start) & (F.col("__row") <= end)).drop("__row")


def residue_batches(
    df: DataFrame, budget: int, length: str = "length", id_col: str = "id"
) -> DataFrame:
    """Batch number per row: longest rows first, cut by total length over ``budget``.

    A row's batch follows from the lengths before it, so no task walks the whole table.
    """
    keyed = df.withColumn("__neg", -F.col(length).cast("long"))
    summed = running_sums(keyed, ["__neg", id_col], {"__upto": length})
    before = F.col("__upto") - F.col(length)
    return summed.withColumn("batch", F.floor(before / F.lit(budget)).cast("long")).drop("__neg", "__upto")
