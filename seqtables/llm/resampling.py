"""Importance resampling towards a target distribution, by hashed n-grams.

Texts stay bytes: a table of 256 bytes lower-cases A-Z and blanks what separates words, ``split``
yields the words, and CRC-32 runs on from the value of the shorter n-gram to that of the longer one.
Counters reduce the features of all documents and of the target to counts per bucket. A document's
weight is the sum of its features' log ratios of the two, and the highest weights, disturbed by a
seeded Gumbel draw, are taken.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtables.llm.common import documents
from seqtables.operators.ordered import number_rows
from seqtables.session import cut, spread

#: Digits, a-z and all bytes of other letters stay, A-Z become a-z, all else a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 1 << 20  # bytes that are split at a time


def word_lists(text: bytes, width: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists from about ``width`` bytes each."""
    plain = text.translate(TABLE)
    start = 0
    while start < len(plain):
        stop = plain.find(b" ", start + width)
        stop = len(plain) if stop < 0 else stop
        yield plain[start:stop].split()
        start = stop


def feature_lists(text: bytes, n: int) -> Iterator[tuple[int, list[int]]]:
    """CRC-32 values of all runs of 1 to n words, joined by a blank, with the number of words of each list."""
    held: list[bytes] = []  # the last n - 1 words before the list
    for found in word_lists(text):
        words, new = held + found, len(held)
        values = list(map(crc32, words))
        every = values[new:]
        spaced = [b" " + word for word in words] if n > 1 else []
        for size in range(2, n + 1):
            # the value of words i to i + size - 1 goes on from that of words i to i + size - 2
            values = list(map(crc32, spaced[size - 1 :], values))
            every += values[max(0, new - size + 1) :]
        yield len(found), every
        held = words[-(n - 1) :] if n > 1 else []


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, found) over all texts of a one-column table: counted per task, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)

        def reduce(values: Counter) -> None:
            if values:
                keys = np.fromiter(values.keys(), np.int64, len(values)) % buckets
                np.add.at(total, keys, np.fromiter(values.values(), np.int64, len(values)))
                values.clear()

        some: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for _, values in feature_lists(text.as_py() or b"", n):
                    some.update(values)
                    if len(some) > 500_000:
                        reduce(some)
        reduce(some)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "found"])

    return texts.mapInArrow(count, "bucket long, found long").groupBy("bucket").agg(F.sum("found").alias("found"))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of target and raw features, per bucket."""
    n_raw, n_target, size = int(raw.sum()), int(target.sum()), len(raw)
    ratio = ((target + 1.0) * float(n_raw + size)) / ((raw + 1.0) * float(n_target + size))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def gumbel(seed: int, doc_id: int | None) -> int:
    """floor(1000 g) of the Gumbel draw that belongs to an id; a missing id counts as an empty one."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _counted(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    counts = np.zeros(buckets, np.int64)
    for row in bucket_counts(texts, n, buckets).collect():  # at most ``buckets`` rows
        counts[row["bucket"]] = row["found"]
    return counts


def weigh(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 1, buckets: int = 10_000, seed: int = 2024
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document.

    Whole texts count, split in pieces, so their length is not limited by memory but for one copy. A
    missing or empty text has no features and weight 0. Rows that repeat an id count each, with the
    same draw. An empty target leaves only the smoothing. Gains are as many numbers as there are
    buckets, on the driver and in the tasks, however much data there is.
    """
    raw_texts = lambda df: spread(df.select(F.col(text).cast("binary").alias("text")))
    held = gains(_counted(raw_texts(docs), n, buckets), _counted(raw_texts(target), n, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple[int, int, int, int]] = []
            for key, value in zip(ids, batch.column(1)):
                n_words = n_features = weight = 0
                for found, values in feature_lists(value.as_py() or b"", n):
                    n_words += found
                    n_features += len(values)
                    weight += int(gain[np.array(values, np.int64) % buckets].sum())
                rows.append((n_words, n_features, weight, weight + gumbel(seed, key)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")))
    return rows.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    text: str = "text",
    doc_id: str = "doc_id",
    n: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
) -> DataFrame:
    """Every document with its weight, its score and, if it is drawn, its rank from 1 on.

    Of the documents with at least ``least_words`` words, floor(percent / 100) of them are drawn, the
    highest scores first, ties to the smaller id, a missing id before all; rows that are equal in both
    share the places in any order. An empty table gives an empty result.
    """
    weighed = cut(weigh(docs, target, text, doc_id, n, buckets, seed))
    keyed = weighed.withColumn("below", F.when(F.col("n_words") >= least_words, -F.col("score")))
    wanted = keyed.where("below is not null").count() * percent // 100
    drawn = F.col("below").isNotNull() & (F.col("place") <= wanted)
    ranked = number_rows(keyed.where("below is not null"), ["below", "doc_id"], "place")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = keyed.where("below is null").select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, F.when(drawn, F.col("place")).alias("rank")).union(rest)


def op12_resampling(spark, folder: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's distribution of words."""
    target = spark.read.parquet(f"{folder}/benchmark.parquet")
    return resample(documents(spark, folder), target).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = """
with crc_table as (
  select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
  from range(256) as t(i)
), crc_list as (
  select list(v order by i) as vs from crc_table
), texts as (
  select 0 as kind, doc_id, row_number() over () as row_no, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all
  select 1, null, row_number() over (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark
), word_counts as (
  select kind, row_no, w, count(*) as n from (
    select kind, row_no, unnest(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w from texts) group by kind, row_no, w
), buckets as (
  select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex(encode(w))) // 2),
      lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::bigint)),
      lambda c, b: xor(c >> 8, vs[1 + (xor(c, b) & 255)])), 4294967295) % 10000 as bucket
  from (select distinct w from word_counts), crc_list
), totals as (
  select bucket, sum(n) filter (where kind = 0) as s, sum(n) filter (where kind = 1) as t from word_counts join buckets using (w) group by bucket
), gains as (
  select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select sum(s) from totals) + 10000)::double)
      / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from totals) + 10000)::double)))::bigint as gain
  from totals
), weights as (
  select row_no, sum(n) as n_features, sum(n * gain) as weight from word_counts join buckets using (w) join gains using (bucket) where kind = 0 group by row_no
), scored as (
  select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from texts left join weights using (row_no) where kind = 0
), ranked as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as n from scored
)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= n * 10 // 100 then place end as rank from ranked"""
