"""Benchmark decontamination by spaced seeds.

Column expressions only. A seed mask keeps some positions of a window of words and ignores the
rest, so a window of a document still meets one of a benchmark item when words at ignored
positions were substituted. A hit fixes how the two texts lie on each other; the overlap is then
compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtables.functions.rows import let
from seqtables.llm.common import GAP, documents, keep_rows, lightest, settled, whole

#: Positions that each mask keeps, from its first one on. Whatever words are substituted in 9 to 13 words of
#: which 75 % stay equal, some mask meets equal words only at some place in them (enumerated in the tests).
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 7, 8), (0, 3, 4, 5, 6), (0, 1, 2, 6, 8), (0, 1, 3, 4, 5))
SPAN = max(mask[-1] for mask in MASKS) + 1
WINDOW = 13  # words that are compared around a hit
PERCENT = 75  # least share of equal words


def _hashes(text: Column) -> Column:
    """Hashes of the text's words in lower case; a text without words has one of an empty word."""
    plain = F.lower(F.trim(whole(text), F.lit(" \t\n\r\x0b\x0c")))
    return F.transform(F.split(plain, GAP), lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, at, seed): the hash of what every mask keeps at every place where it fits into the text.

    Windows are rows of word hashes taken side by side from shifted copies of the array, so that
    their hashes are plain columns; past the text's end these are null.
    """
    hashed = df.select(F.col(key).alias("key"), F.inline(F.array(F.struct(_hashes(text).alias("h")))))
    shifted = [F.slice("h", k + 1, F.greatest(F.size("h") - k, F.lit(0))).alias(f"w{k}") for k in range(SPAN)]
    windows = hashed.select("key", F.posexplode_outer(F.arrays_zip(*shifted)).alias("at", "w"))
    hashes = [F.xxhash64(F.lit(m), *[F.col(f"w.w{k}") for k in mask]) for m, mask in enumerate(MASKS)]
    seeds = F.array(*[F.when(F.col(f"w.w{mask[-1]}").isNotNull(), x) for mask, x in zip(MASKS, hashes)])
    return windows.select("key", "at", F.explode(seeds).alias("seed")).where("seed is not null")


def _best(a: Column, b: Column, width: Column) -> Column:
    """Most equal words in any ``width`` neighbouring places of two aligned arrays."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))

    def of(s: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(s) - width + 1)
        sums = F.transform(starts, lambda i: F.aggregate(F.slice(s, i, width), F.lit(0), lambda x, y: x + y))
        return F.when(F.size(s) >= width, F.array_max(sums))

    return let(same, of)


def contaminations(
    docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """(doc_id, item_id, n_window, n_equal) of documents that hold a passage of an item.

    A document and an item that share a seed are laid on each other there. If any n_window
    neighbouring words (WINDOW, or all of a shorter item) have PERCENT or more equal ones, the pair
    is reported once, with the most equal words of any placement. Words are compared in lower case.

    Nothing that passes is missed in items of 9 words or more. Items of six to eight words are found
    when whole, and with some of the substitutions that would pass; shorter items, which are too common to tell
    anything, and documents with fewer words than n_window are never reported; nor are rows without id and
    missing texts. Rows that repeat an id are reported once; empty tables give none. Whole texts are
    read, however long; extra columns are not looked at.
    """
    of_docs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    of_items = settled(
        items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    )
    wanted = settled(
        _seeds(of_items, "item_id", F.col("text"))
        .select(F.col("key").alias("item_id"), F.col("at").alias("item_at"), F.col("seed").alias("wanted"))
        .distinct()
    )
    hits = _seeds(of_docs, "doc_id", F.col("text")).join(lightest(wanted), F.col("seed") == F.col("wanted"))
    placed = settled(hits.select(F.col("key").alias("doc_id"), "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct())

    hit_docs = settled(placed.select(F.col("doc_id").alias("hit")).distinct())
    d = of_docs.join(lightest(hit_docs), F.col("doc_id") == F.col("hit"), "left_semi").select("doc_id", _hashes(F.col("text")).alias("h"))
    g = of_items.select("item_id", _hashes(F.col("text")).alias("g"))
    met = placed.join(g, "item_id").join(d, "doc_id")
    begin = F.greatest("shift", F.lit(0))
    length = F.least(F.size("h"), F.col("shift") + F.size("g")) - begin
    width = F.least(F.size("g"), F.lit(WINDOW))
    best = _best(F.slice("h", begin + 1, length), F.slice("g", begin - F.col("shift") + 1, length), width)
    compared = met.select("doc_id", "item_id", F.inline(F.array(F.struct(width.alias("n_window"), best.alias("n_equal")))))
    enough = compared.where(F.lit(100) * F.col("n_equal") >= F.lit(PERCENT) * F.col("n_window"))
    return enough.groupBy("doc_id", "item_id").agg(F.max("n_window").alias("n_window"), F.max("n_equal").alias("n_equal"))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = contaminations(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return keep_rows(docs, settled(found.select(F.col("doc_id").alias("gone")).distinct()))


def op5_decontamination(spark, folder: str) -> DataFrame:
    return contaminations(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def _sql_words(table: str, key: str) -> str:
    return f"select distinct {key}, regexp_split_to_array(trim(lower(coalesce(text, '')), E' \\t\\n\\r\\x0b\\x0c'), '[\\x20\\x09-\\x0D]+') as w from {table} where {key} is not null"


_SQL_SEEDS = ", ".join(
    f"case when p + {mask[-1]} <= len(w) then [" + ", ".join([f"'{m}'", *(f"w[p + {k}]" for k in mask)]) + "] end" for m, mask in enumerate(MASKS)
)

#: The same seeds as lists of words, joined without hashes.
OP5_SQL = f"""
with d as ({_sql_words('documents', 'doc_id')}), g as ({_sql_words('benchmark', 'item_id')}),
dw as (select doc_id, p, unnest([{_SQL_SEEDS}]) as seed from (select *, unnest(range(1, len(w) + 1)) as p from d)),
gw as (select item_id, p, unnest([{_SQL_SEEDS}]) as seed from (select *, unnest(range(1, len(w) + 1)) as p from g)),
placed as (select distinct doc_id, item_id, dw.p - gw.p as shift from dw join gw using (seed)),
places as (
  select doc_id, item_id, shift, least(len(g.w), {WINDOW}) as n_window, d.w as h, g.w as g,
         greatest(shift, 0) as first, least(len(d.w), shift + len(g.w)) as stop
  from placed join d using (doc_id) join g using (item_id)),
windows as (
  select doc_id, item_id, n_window,
         len([k for k in range(1, n_window + 1) if h[i + k] = g[i - shift + k]]) as n_equal
  from (select *, unnest(range(first, stop - n_window + 1)) as i from places))
select doc_id, item_id, cast(max(n_window) as integer) as n_window, cast(max(n_equal) as integer) as n_equal
from windows where 100 * n_equal >= {PERCENT} * n_window group by doc_id, item_id"""
