"""Filters, projections and clean-up of sequence tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtables.functions.sequence import has_marker

CLASS_NAMES = {0: "full-length", 1: "truncated", 2: "short full-length"}  # fixed values
SHORT_LENGTH = 200  # fixed value


def filter_length(df: DataFrame, low: int = 10, high: int = 1000, seq: str = "seq") -> DataFrame:
    """Sequences with low <= length < high."""
    return df.where((F.length(seq) >= low) & (F.length(seq) < high))


def filter_domain(df: DataFrame, domain: str = "Bacteria") -> DataFrame:
    """Rows of one domain."""
    return df.where(F.col("domain") == domain)


def drop_fragments(df: DataFrame) -> DataFrame:
    """Rows without a non-terminal residue."""
    return df.where(F.col("non_terminal_residue").isNull())


def drop_partial(df: DataFrame) -> DataFrame:
    """Rows whose gene is complete at both ends."""
    return df.where(F.col("partial").startswith("00"))


def drop_null_seq(df: DataFrame) -> DataFrame:
    """Rows with a sequence."""
    return df.where(F.col("seq").isNotNull())


def dedupe_first(df: DataFrame, keys: Sequence[str], order: str = "id") -> DataFrame:
    """The first row per key by ``order``. Reduced before the shuffle, so hot keys stay small."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("row")
    return df.groupBy(*keys).agg(first).select(*[c if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])


def clean_corpus(df: DataFrame, low: int = 10, high: int = 1000, domain: str = "Bacteria") -> DataFrame:
    """One row per name, then length, domain and fragment filters."""
    return drop_fragments(filter_domain(filter_length(dedupe_first(df, ["name"]), low, high), domain))


def assign_classes(df: DataFrame, classes: int, marker: str = "U", short: int = SHORT_LENGTH) -> DataFrame:
    """Add ``label``: 0 no marker, 1 marker, 2 (from three classes on) short without marker.

    With four classes every marker row appears twice, labelled 1 and 3.
    """
    if classes not in (2, 3, 4):
        raise ValueError("classes must be 2, 3 or 4")
    marked = has_marker(F.col("seq"), marker)
    plain = F.array(F.lit(0)) if classes == 2 else F.array(F.when(F.length("seq") < short, 2).otherwise(0))
    held = F.array(F.lit(1), F.lit(3)) if classes == 4 else F.array(F.lit(1))
    return df.select("*", F.explode(F.when(marked, held).otherwise(plain)).alias("label"))


def feature_columns(df: DataFrame) -> list[str]:
    """Columns whose name is a number, in numeric order."""

    def number(name: str) -> float | None:
        try:
            return float(name)
        except ValueError:
            return None

    return sorted((c for c in df.columns if number(c) is not None), key=float)


def wide_to_vector(df: DataFrame) -> DataFrame:
    """Gather the numerically named columns into ``features``."""
    columns = feature_columns(df)
    others = [c for c in df.columns if c not in columns]
    return df.select(*[f"`{c}`" for c in others], F.array(*[f"`{c}`" for c in columns]).alias("features"))


def fill_none(df: DataFrame, text: str = "none") -> DataFrame:
    """String nulls as the word 'none'."""
    return df.fillna(text, [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])


def fill_infinity(df: DataFrame, column: str) -> DataFrame:
    """Missing scores as +inf, so that they sort last."""
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), F.lit(float("inf"))))


def remap(df: DataFrame, columns: Sequence[str], values: Mapping) -> DataFrame:
    """Replace values in the given columns, all others stay."""
    return df.replace(dict(values), subset=list(columns))


def merge_classes(df: DataFrame, old: int = 2, new: int = 0) -> DataFrame:
    """Fold one class into another in the label and every prediction column."""
    return remap(df, [c for c in df.columns if c == "label" or "prediction" in c], {old: new})


def prefix_columns(df: DataFrame, prefix: str, skip: Iterable[str] = ()) -> DataFrame:
    """All columns under a prefix."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in set(skip)})


def upsert_predictions(metadata: DataFrame, predictions: DataFrame, model: str) -> DataFrame:
    """Predictions under the model's name joined to the metadata, replacing that model's old columns."""
    renamed = prefix_columns(predictions, f"{model}_", skip=["id"])
    kept = metadata.drop(*[c for c in renamed.columns if c != "id"])
    return renamed.join(kept, "id", "left")


def threshold(df: DataFrame, score: str, cutoff: float = 0.5) -> DataFrame:
    """Add a 0/1 prediction."""
    return df.withColumn("prediction", F.when(F.col(score) > cutoff, 1).otherwise(0))


def positives(df: DataFrame, score: str, cutoff: float = 0.5) -> DataFrame:
    """Rows predicted 1."""
    return threshold(df, score, cutoff).where("prediction = 1")


def without(df: DataFrame, banned: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in another table."""
    return df.join(banned.select(key), key, "left_anti")


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in another table; keys without a match are no error."""
    return df.join(keys.select(key), key, "left_semi")


def with_source(df: DataFrame, **literals) -> DataFrame:
    """Add constant columns."""
    return df.withColumns({name: F.lit(value) for name, value in literals.items()})


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """n rows in a seeded pseudo-random order, the MD5 of key and seed, that no partitioning changes."""
    return df.orderBy(F.md5(F.concat_ws("_", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def cast_declared(df: DataFrame, types: Mapping[str, str], lenient: bool = True) -> DataFrame:
    """Cast the declared columns that are present; lenient casts turn bad values into null."""
    present = {name: kind for name, kind in types.items() if name in df.columns}
    cast = lambda name, kind: F.col(f"`{name}`").try_cast(kind) if lenient else F.col(f"`{name}`").cast(kind)
    return df.withColumns({name: cast(name, kind) for name, kind in present.items()})


def marker_fraction(df: DataFrame, group: str, marker: str) -> DataFrame:
    """Rows and share of rows with the marker per group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(has_marker(F.col("seq"), marker).cast("double")).alias("fraction")
    )
