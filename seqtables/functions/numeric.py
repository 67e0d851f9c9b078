"""Arithmetic on vectors, scores and lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqtables.functions.rows import let


def array_sum(values: Column) -> Column:
    """Sum of a double array."""
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda total, x: total + x.cast("double"))


def _shifted_weights(logits: Column) -> Column:
    return let(
        F.array_max(logits).cast("double"),
        lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top)),
    )


def softmax(logits: Column) -> Column:
    """Probabilities of a logit array, shifted by its maximum."""
    return let(
        _shifted_weights(logits),
        lambda weights: let(array_sum(weights), lambda total: F.transform(weights, lambda w: w / total)),
    )


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    """Softmax cross entropy of one row, kept finite by the maximum shift."""
    top = F.array_max(logits).cast("double")
    return F.ln(array_sum(_shifted_weights(logits))) + top - F.get(logits, label.cast("int")).cast("double")


def dot(left: Column, right: Column) -> Column:
    """Inner product of two arrays."""
    return array_sum(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def subset(values: Column, indices: Column) -> Column:
    """The elements at the given 0-based indices."""
    return let(values, lambda bound: F.transform(indices, lambda i: F.get(bound, i)))


def signed_log2_diff(length: Column, reference: Column) -> Column:
    """Signed log2 of a length difference moved one away from zero; no difference counts as 1."""
    diff = (length - reference).cast("double")
    moved = F.when(diff == 0, F.lit(1.0)).otherwise(diff + F.signum(diff))
    return F.signum(moved) * F.log2(F.abs(moved))
