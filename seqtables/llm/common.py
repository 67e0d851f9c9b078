"""Text and table helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.session import cut, release, remove_path, scratch_path

#: Of every ``concluded`` that is running, the innermost last: paths of the tables written so far.
_scopes: list[list[str]] = []

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are maximal runs without blank, tab, line feed, vertical tab, form feed and return.
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole(text: str | Column) -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """Array of words; empty for a text without any."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name like ``wanted`` that ``df`` does not have, whatever case it uses."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def lightest(df: DataFrame, max_rows: int = 4_000_000) -> DataFrame:
    """``df``, narrow and already written out, marked for broadcast if it has at most ``max_rows`` rows.

    Beyond that it stays as it is, and joins with it shuffle. The rows are the same either way.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def keep_rows(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in ``dropped`` (one column ``gone``); rows without id stay."""
    gone = fresh(docs, "gone")
    held = lightest(dropped.distinct().withColumnRenamed("gone", gone))
    return docs.join(held, F.col(doc_id) == F.col(gone), "left_anti")


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, without the conditions that the optimizer derives from its plan.

    A loop's conditions would otherwise grow with every round, and planning with them. Shuffle files
    of what was settled before are released on the way.
    """
    release(df.sparkSession)
    out = cut(df.select(F.inline(F.array(F.struct("*")))))
    if _scopes:
        written = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if written.isDefined():
            _scopes[-1].append(written.get())
    return out


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; takes less room than a checkpoint."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def concluded(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` returns, settled. All tables settled or stored on the way are deleted.

    Nothing refers to these any more then, as the result is written out whole.
    """
    _scopes.append([])
    try:
        plain = make()
        inner = len(_scopes[-1])
        found = settled(plain)
        kept = _scopes[-1][inner:]
    except BaseException:
        _scopes.pop()
        raise
    for path in _scopes.pop()[:inner]:
        remove_path(spark, path)
    release(spark)
    if _scopes:
        _scopes[-1].extend(kept)
    return found
