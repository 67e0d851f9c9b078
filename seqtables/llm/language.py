"""Language identification by fusing the evidence of text, markup, address and host.

log P(language | all) = log P(language | host) + weight * log P(text | language)
                        + log P(declared | language) + log P(suffix | language) + constant

The text model counts byte trigrams. How reliable a declaration or an address suffix is, and what
a host tends to write, are counted over all rows from the decisions on text alone. A host's prior
is smoothed towards its domain's and that towards the one of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from seqtables.llm.common import documents, keep_rows, settled, whole

BINS = 1 << 16  # of hashed trigrams
SAMPLE = 400  # labelled documents per language that the text model is fitted on, the first by a hash of the id
SMOOTH = 0.5  # added to each trigram count
TEXT_WEIGHT = 0.1  # trigrams overlap and depend on each other, so they count less than independent facts
PULL = 20.0  # rows' worth of the parent's share in a host's prior
LOOSE = 1.0  # added to each count of declarations and suffixes
LEAST = 0.5  # posterior of an accepted language
PIECE = 1 << 21

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[*range(0x21), *range(0x30, 0x3A)]] = 0x20  # digits and controls count as blanks


def _grams(raw: bytes) -> np.ndarray:
    """Bins of the trigrams of a text."""
    data = _FOLD[np.frombuffer(raw, np.uint8)]
    if len(data) < 3:
        return np.zeros(0, np.int64)
    mixed = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA6B)) ^ (data[2:] * np.uint32(0xC2B2AE35))
    keep = (data[:-2] != 0x20) | (data[1:-1] != 0x20)  # runs of blanks say nothing
    return ((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BINS - 1))[keep].astype(np.int64)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Pieces of a long text that overlap by two bytes, so that each trigram lies in one."""
    for at in range(0, max(len(raw) - 2, 1), PIECE):
        yield raw[at : at + PIECE + 2]


def fit_text_model(labelled: DataFrame, text: str, lang: str, key: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of each trigram bin, fitted on at most ``sample`` rows of each."""
    first = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")
    )
    turns = rows.select("lang", "key").distinct().withColumn("turn", F.row_number().over(first))
    ids = turns.where(F.col("turn") <= sample).select("key").distinct()  # at most sample of each language
    chosen = rows.join(F.broadcast(ids), "key", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in _pieces(text.encode("utf-8", "surrogatepass")):
                    grams = np.bincount(_grams(piece), minlength=BINS)
                    totals[lang] = totals.get(lang, 0) + grams
        for lang, grams in totals.items():
            bins = np.flatnonzero(grams)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins)), pa.array(bins), pa.array(grams[bins])], names=["lang", "bin", "n"])

    counts = chosen.mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    languages = sorted({row.lang for row in counts})
    table = np.full((BINS, max(1, len(languages))), SMOOTH)
    for row in counts:
        table[row.bin, languages.index(row.lang)] += row.n
    return languages, np.log(table / table.sum(axis=0)).astype(np.float32)


def _score(rows: DataFrame, text: str, model: np.ndarray) -> DataFrame:
    """rows without the text, with n_grams and the text's log-likelihood per language."""
    carried = [name for name in rows.columns if name != text]
    schema = T.StructType([rows.schema[name] for name in carried])
    schema = schema.add("n_grams", T.LongType()).add("likely", T.ArrayType(T.DoubleType()))
    shared = rows.sparkSession.sparkContext.broadcast(model)  # BINS rows of a column per language
    width = model.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = batch.column(len(carried)).to_pylist()
            sums, sizes = np.zeros((len(texts), width)), np.zeros(len(texts), np.int64)
            for i, value in enumerate(texts):
                for piece in _pieces((value or "").encode("utf-8", "surrogatepass")):
                    grams = _grams(piece)
                    sizes[i] += len(grams)
                    sums[i] += table[grams].sum(axis=0, dtype=np.float64)
            likely = pa.ListArray.from_arrays(np.arange(0, len(texts) * width + 1, width, dtype=np.int32), sums.ravel())
            columns = [batch.column(k) for k in range(len(carried))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), likely], names=[*carried, "n_grams", "likely"])

    return rows.select(*carried, text).mapInArrow(run, schema)


def _argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def _table(counted: DataFrame, name: str, size: int, smooth: float) -> DataFrame:
    """(name, log_name): log P(value | language) of every value, one array slot per language."""
    wide = settled(
        counted.groupBy(name).agg(*[F.sum(F.when(F.col("own") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(size)])
    )
    totals = wide.agg(F.count(F.lit(1)), *[F.sum(f"n{k}") for k in range(size)]).first()
    logs = [F.log((F.col(f"n{k}") + smooth) / ((totals[k + 1] or 0) + smooth * (totals[0] + 1))) for k in range(size)]
    return wide.select(name, F.array(*logs).alias(f"log_{name}"))


def identify(rows: DataFrame, languages: list[str], model: np.ndarray, text: str = "text", least: float = LEAST) -> DataFrame:
    """rows without the text, with language, posterior, and accepted.

    rows has the text and the columns declared, suffix, domain and host; any of them may be null,
    which counts as no evidence. A row is accepted if some language reaches ``least`` and its text,
    if any, is more likely in that language than as random bytes. Rows without a trigram (missing,
    empty or blank texts) are decided by the other evidence; without any they are undecided:
    language null, accepted false. Equal posteriors go to the first language by name.
    """
    size = len(languages)
    if not size:
        empty = rows.drop(text)
        return empty.withColumns({"language": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"), "accepted": F.lit(False)})
    scored = settled(_score(rows, text, model).withColumn("own", F.when(F.col("n_grams") > 0, _argmax(F.col("likely")))))
    voting = scored.where("own is not null")
    facts = {
        name: _table(voting.where(F.col(name).isNotNull()).groupBy(name, "own").agg(F.count(F.lit(1)).alias("n")), name, size, LOOSE)
        for name in ("declared", "suffix")
    }
    by_host = voting.groupBy("domain", "host", "own").agg(F.count(F.lit(1)).alias("n"))
    sums = [F.sum(F.when(F.col("own") == k, F.col("n")).otherwise(0)) for k in range(size)]
    hosts = settled(by_host.groupBy("domain", "host").agg(F.array(*sums).alias("c")))
    add = lambda name: F.array(*[F.sum(F.get(name, F.lit(k))) for k in range(size)])
    domains = hosts.groupBy("domain").agg(add("c").alias("c"))
    counts = [n or 0 for n in hosts.agg(add("c").alias("all")).first().all]
    base = F.array(*[F.lit((n + 1.0) / (sum(counts) + size)) for n in counts])

    def smoothed(counts: str, parent: str | Column) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, parent, lambda c, p: (c + F.lit(PULL) * p) / (n + F.lit(PULL)))

    of_domain = domains.select(F.col("domain").alias("d"), smoothed("c", base).alias("p_domain"))
    priors = hosts.join(of_domain, F.col("domain").eqNullSafe(F.col("d"))).select(
        F.col("domain").alias("d"), F.col("host").alias("h"), smoothed("c", "p_domain").alias("prior")
    )
    joined = scored.join(priors, F.col("domain").eqNullSafe(F.col("d")) & F.col("host").eqNullSafe(F.col("h")), "left")
    joined = joined.join(of_domain.withColumnRenamed("d", "d2"), F.col("domain").eqNullSafe(F.col("d2")), "left")
    for name, table in facts.items():
        joined = joined.join(table.withColumnRenamed(name, f"key_{name}"), F.col(name) == F.col(f"key_{name}"), "left")
    nothing = F.array(*[F.lit(0.0)] * size)
    prior = F.coalesce("prior", "p_domain", base)
    parts = F.arrays_zip(
        prior.alias("p"),
        F.col("likely").alias("t"),
        F.coalesce("log_declared", nothing).alias("d"),
        F.coalesce("log_suffix", nothing).alias("s"),
    )
    logs = F.transform(parts, lambda x: F.log(x["p"]) + F.lit(TEXT_WEIGHT) * x["t"] + x["d"] + x["s"])
    told = (F.col("n_grams") > 0) | F.coalesce("log_declared", "log_suffix").isNotNull() | F.col("prior").isNotNull()
    carried = [name for name in rows.columns if name != text]
    summed = joined.select(*carried, "n_grams", "likely", told.alias("told"), F.inline(F.array(F.struct(logs.alias("logs")))))
    best = _argmax(F.col("logs"))
    chosen = summed.select(*carried, "n_grams", "likely", "told", F.inline(F.array(F.struct(best.alias("best"), F.col("logs").alias("l")))))
    peak = F.array_max("l")
    posterior = 1.0 / F.aggregate("l", F.lit(0.0), lambda a, b: a + F.exp(b - peak))
    noise = F.get("likely", F.col("best")) < F.col("n_grams") * F.lit(-float(np.log(BINS)))
    names = F.array(*[F.lit(name) for name in languages])
    done = chosen.select(*carried, "told", noise.alias("noise"), F.get(names, F.col("best")).alias("language"), posterior.alias("posterior"))
    return done.select(
        *carried,
        F.when(F.col("told"), F.col("language")).alias("language"),
        F.when(F.col("told"), F.round("posterior", 6)).alias("posterior"),
        (F.col("told") & ~F.col("noise") & (F.col("posterior") >= least)).alias("accepted"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as evidence: the lang column is what they declare, the source is their host."""
    return docs.select(
        "doc_id",
        F.col("text"),
        F.lower(F.col("lang").cast("string")).alias("declared"),
        F.lit(None).cast("string").alias("suffix"),
        F.lit(None).cast("string").alias("domain"),
        F.col("source").cast("string").alias("host"),
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as evidence: the lang attribute, the last label of the host, the host and its domain."""
    html = whole("html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:/?#]+://([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract(html, "(?i)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([A-Za-z]+)", 1))
    body = F.regexp_replace(html, "(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")
    filled = lambda c: F.when(c != "", c)
    return pages.select(
        "page_id",
        body.alias("text"),
        filled(declared).alias("declared"),
        filled(F.substring_index(host, ".", -1)).alias("suffix"),
        filled(F.substring_index(host, ".", -2)).alias("domain"),
        filled(host).alias("host"),
    )


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is one of those that the labels name."""
    languages, model = fit_text_model(docs, "text", "lang", "doc_id")
    found = identify(document_rows(docs), languages, model)
    return keep_rows(docs, settled(found.where("not accepted and doc_id is not null").select(F.col("doc_id").alias("gone"))))


def op1_language_id(spark, folder: str) -> DataFrame:
    """Every document and every page; doc_id or page_id tells which."""
    docs, pages = documents(spark, folder), spark.read.parquet(f"{folder}/pages.parquet")
    languages, model = fit_text_model(docs, "text", "lang", "doc_id")
    rows = document_rows(docs).unionByName(page_rows(pages), allowMissingColumns=True)
    return identify(rows, languages, model)
