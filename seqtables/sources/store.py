"""Stored tables: feature store, reusable stages and split output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.operators.clean import drop_null_seq, fill_none
from seqtables.session import path_exists

METADATA = "metadata"


def _done(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/_SUCCESS")


def write_metadata(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Store the metadata of all sequences, sorted by id, text nulls as 'none'."""
    target = f"{path}/{METADATA}"
    if overwrite or not _done(df.sparkSession, target):
        rows = fill_none(drop_null_seq(df))
        rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(target)


def write_features(df: DataFrame, path: str, feature_type: str, overwrite: bool = False) -> bool:
    """Store (id, features) under its feature type, sorted by id; present types stay unless overwritten."""
    target = f"{path}/features/feature_type={feature_type}"
    if not overwrite and _done(df.sparkSession, target):
        return False
    df.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(target)
    return True


def read_features(spark: SparkSession, path: str, feature_type: str) -> DataFrame:
    """The metadata with the features of one type."""
    features = spark.read.parquet(f"{path}/features/feature_type={feature_type}")
    return features.join(spark.read.parquet(f"{path}/{METADATA}"), "id")


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """A table that is built once and read back afterwards."""
    if overwrite or not _done(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "dataset") -> None:
    """The full table with one folder per split, so that a filter on the split reads that folder alone."""
    # A salt spreads each split over several files instead of one task.
    salted = df.repartition(F.col(split), F.pmod(F.xxhash64("id"), F.lit(64)))
    salted.write.mode("overwrite").partitionBy(split).parquet(path)
