"""The flagship query: clean, assign classes, truncate, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.catalog.registry import Tables, query
from seqtables.operators import clean, truncate

MARKER = "Q"


def _summary(t: Tables) -> DataFrame:
    unique = clean.dedupe_first(clean.filter_length(t.seqs, 10, 1000), ["name"])
    labelled = clean.assign_classes(unique, 2, MARKER)
    cut = truncate.truncate_classes(labelled, MARKER)
    return cut.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.length("seq")), 6).alias("mean_length"),
        F.round(F.avg("trunc_ratio"), 9).alias("mean_trunc_ratio"),
    )


def truncation_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Count, mean length and mean truncated share per class."""
    return _summary(Tables(spark, folder))


query(
    f"""
with u as (select id, seq from {{seqs}} where length(seq) >= 10 and length(seq) < 1000 qualify row_number() over (partition by name order by id) = 1),
c as (select cast(contains(seq, '{MARKER}') as integer) as label, length(seq) as size,
             case when contains(seq, '{MARKER}') then split_part(seq, '{MARKER}', 1) else seq end as seq from u)
select label, count(*) as n, round(avg(length(seq)), 6) as mean_length, round(avg(case when label = 1 then (size - length(seq)) / size end), 9) as mean_trunc_ratio
from c where label = 0 or length(seq) >= 10 group by label""",
    name="truncation_summary",
)(_summary)
