"""Evaluate a costly expression once.

An optimizer may copy an expression into every place that names it: into each step of a
lambda, into a filter pushed below a projection, into the filter that it infers for an
explode. These helpers bind the value instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value bound to one lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, value: Column, body: Callable[[Column], Column]) -> DataFrame:
    """All columns of ``df`` and the fields of the struct ``body(value)``; later filters stay above it."""
    return df.select("*", F.inline_outer(F.transform(F.array(value), body)))


def explode_words(df: DataFrame, words: Column, name: str, *keep: str | Column) -> DataFrame:
    """Kept columns and one row per array element, without evaluating the array twice."""
    return df.select(*keep, F.explode_outer(words).alias(name)).where(F.col(name).isNotNull())
