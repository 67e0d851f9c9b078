"""Truncated forms of marked sequences, and reports on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtables.functions.sequence import count_of, first_index, has_marker, last_index, truncate_c, truncate_n
from seqtables.session import stack


def truncated(terminus: str, marker: str, min_length: int, **options) -> Column:
    """Truncation of ``seq`` at either end."""
    if terminus == "c":
        return truncate_c(F.col("seq"), marker, min_length)
    if terminus == "n":
        return truncate_n(F.col("seq"), marker, min_length, **options)
    raise ValueError(f"terminus must be 'c' or 'n', not {terminus!r}")


def truncate_frame(
    df: DataFrame, terminus: str = "c", marker: str = "U", min_length: int = 10, drop_failures: bool = True, **options
) -> DataFrame:
    """Truncate every marked row and say where and how much; ids become ``x-`` (C) or ``-x`` (N)."""
    seq, size = F.col("seq"), F.length("seq").cast("long")
    cut = truncated(terminus, marker, min_length, **options)
    dash = F.lit("-")
    name = F.col("id").cast("string")
    frame = (
        df.where(has_marker(seq, marker))
        .withColumns(
            {
                "sec_index_n": first_index(seq, marker),
                "sec_index_c": last_index(seq, marker),
                "sec_count": count_of(seq, marker),
                "original_length": size,
                "__cut": cut,
            }
        )
        .withColumn("trunc_size", F.col("original_length") - F.length("__cut"))
        .withColumn("trunc_ratio", F.col("trunc_size") / F.col("original_length"))
        .withColumn("original_length", F.when(F.col("__cut").isNotNull(), F.col("original_length")))
        .withColumn("id", F.concat(name, dash) if terminus == "c" else F.concat(dash, name))
        .withColumn("seq", F.col("__cut"))
        .drop("__cut")
    )
    return frame.where("seq is not null") if drop_failures else frame


def truncate_classes(df: DataFrame, marker: str = "U", min_length: int = 10) -> DataFrame:
    """Truncate label 1 at the C-terminal and label 3 at the N-terminal side; other labels pass."""
    whole = df.where(~F.col("label").isin(1, 3)).withColumn("id", F.col("id").cast("string"))
    ends = [truncate_frame(df.where(F.col("label") == label), end, marker, min_length) for label, end in ((1, "c"), (3, "n"))]
    return stack(whole, *ends, allow_missing=True)


def detection_limit(df: DataFrame, marker: str = "U", limit: int = 30, starts: Sequence[str] = ("M", "V")) -> DataFrame:
    """Both truncated lengths of every marked row (none counts as 1) and whether both miss the limit."""
    length = lambda part: F.coalesce(F.length(part), F.lit(1)).cast("long")
    return (
        df.where(has_marker(F.col("seq"), marker))
        .select(
            "id",
            length(truncated("c", marker, 1)).alias("c_length"),
            length(truncated("n", marker, 1, starts=starts)).alias("n_length"),
        )
        .withColumn("below_limit", (F.col("c_length") < limit) & (F.col("n_length") < limit))
    )


def marker_start_gap(
    df: DataFrame, marker: str = "U", min_length: int = 30, starts: Sequence[str] = ("V", "M")
) -> DataFrame:
    """Distance between the last marker and the start residue taken, with that residue."""
    frame = truncate_frame(df, "n", marker, min_length, starts=starts, bias="length")
    return frame.select(
        "id", F.left("seq", F.lit(1)).alias("start_residue"), (F.col("trunc_size") - F.col("sec_index_c")).alias("gap")
    )
