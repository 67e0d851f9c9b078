"""Turn sequences into feature vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtables.functions.sequence import AMINO_ACIDS, kmers, normalize_residues
from seqtables.operators.dedupe import top_n
from seqtables.operators.stats import long_vectors

Encoder = Callable[[list[str]], np.ndarray]
ENCODERS: dict[str, Encoder] = {}


def kmer_names(k: int) -> list[str]:
    """The k-mers that are counted: no letter twice, sorted."""
    return sorted("".join(letters) for letters in permutations(AMINO_ACIDS, k))


def kmer_features(df: DataFrame, k: int = 1, compat: bool = True) -> DataFrame:
    """Table (id, features): k-mer counts over the sequence length, in the order of ``kmer_names``.

    Rare residues count as X. Sequences shorter than k are left out. ``compat`` leaves out
    the last k-mer of every sequence. Counting stays within the row: no shuffle.
    """
    clean = normalize_residues(F.col("seq"), drop="")
    words = df.where(F.length("seq") >= k).select(
        "id", F.length("seq").alias("size"), kmers(clean, k, stop_early=compat).alias("words")
    )
    names = kmer_names(k)
    counter = CountVectorizerModel.from_vocabulary(names, inputCol="words", outputCol="counts")
    sizes = F.array_repeat(F.col("size"), len(names))
    shares = F.zip_with(vector_to_array("counts"), sizes, lambda count, size: count / size)
    return counter.transform(words).select("id", shares.alias("features"))


def kmer_profile(df: DataFrame, k: int = 1, compat: bool = True) -> DataFrame:
    """Table (id, kmer, value) of the k-mers that occur."""
    names = F.array(*[F.lit(name) for name in kmer_names(k)])
    held = long_vectors(kmer_features(df, k, compat), "id").where("value > 0")
    return held.select("id", F.get(names, F.col("dim")).alias("kmer"), "value")


def length_features(df: DataFrame) -> DataFrame:
    """Table (id, features) holding the sequence length alone."""
    return df.select("id", F.array(F.length("seq").cast("double")).alias("features"))


def append_length(df: DataFrame) -> DataFrame:
    """The sequence length as one more feature."""
    longer = F.concat(F.col("features").cast("array<double>"), F.array(F.length("seq").cast("double")))
    return df.withColumn("features", longer)


def _crc_table() -> np.ndarray:
    """What CRC-32 adds for each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def kmer_hashes(text: str, k: int) -> np.ndarray:
    """CRC-32 of the bytes of every k-mer in order; texts of ASCII letters take one step a byte for all k-mers at once."""
    size = max(len(text) - k + 1, 0)
    if not text.isascii():
        return np.fromiter((zlib.crc32(text[i : i + k].encode()) for i in range(size)), dtype=np.int64)
    letters = np.frombuffer(text.encode("ascii"), np.uint8)
    state = np.full(size, 0xFFFFFFFF, np.uint32)
    for offset in range(k):
        state = _CRC[(state & np.uint32(0xFF)) ^ letters[offset : offset + size]] ^ (state >> np.uint32(8))
    return (state ^ np.uint32(0xFFFFFFFF)).astype(np.int64)


def hash_encoder(dims: int = 32, k: int = 3) -> Encoder:
    """A deterministic stand-in encoder: k-mers hashed to signed dimensions, averaged."""

    def encode(seqs: list[str]) -> np.ndarray:
        out = np.zeros((len(seqs), dims), dtype=np.float32)
        for row, seq in enumerate(seqs):
            codes = kmer_hashes(seq, k)
            if len(codes):
                out[row] = np.bincount(codes % dims, np.where((codes >> 16) & 1, 1.0, -1.0), dims)
                out[row] /= len(codes)
        return out

    return encode


def encode(df: DataFrame, encoder: Encoder, budget: int = 1000, rows: int = 1000) -> DataFrame:
    """Table (id, features, error): an encoder run over batches of about ``budget`` residues.

    Longest sequences go first, as in any padded batch. A failing batch gives rows with an
    error and no features instead of being lost. Results go out ``rows`` at a time or a little more.
    """
    id_type = df.schema["id"].dataType.simpleString()
    clean = df.where("seq is not null").select("id", F.replace("seq", F.lit("*"), F.lit("")).alias("seq"))

    def run(seqs: list[str]) -> list[tuple[np.ndarray | None, str | None]]:
        try:
            vectors = list(encoder(seqs))
        except RuntimeError as failure:
            return [(None, str(failure) or "failed")] * len(seqs)
        if len(vectors) != len(seqs):
            raise ValueError(f"the encoder gave {len(vectors)} vectors for {len(seqs)} sequences")
        return [(vector, None) for vector in vectors]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["seq"].str.len().to_numpy()
            order = np.argsort(-sizes, kind="stable")
            ids, seqs, sizes = frame["id"].to_numpy()[order], frame["seq"].to_numpy()[order].tolist(), sizes[order]
            ends = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // budget, append=-1)) + 1
            done, first, found = 0, 0, []
            for end in ends.tolist():
                found += run(seqs[first:end])
                first = end
                if end - done >= rows or end == len(seqs):
                    yield pd.DataFrame({"id": ids[done:end], "features": [v for v, _ in found], "error": [e for _, e in found]})
                    done, found = end, []

    return clean.mapInPandas(batches, f"id {id_type}, features array<float>, error string")


def register_encoder(feature_type: str, encoder: Encoder) -> None:
    """Make a feature type such as ``plm_pt5`` available; pretrained weights are the caller's."""
    ENCODERS[feature_type] = encoder


def featurizer(feature_type: str) -> Callable[[DataFrame], DataFrame]:
    """The transformer of a feature type: ``aa_{k}mer``, ``len`` or a registered encoder."""
    counted = re.fullmatch("aa_([0-9]+)mer", feature_type)
    if counted:
        return lambda df: kmer_features(df, int(counted.group(1)))
    if feature_type == "len":
        return length_features
    if feature_type in ENCODERS:
        return lambda df: encode(df, ENCODERS[feature_type]).where("error is null").drop("error")
    if feature_type == "plm_pt5" or re.fullmatch("plm_esm_(log|cls|gap)", feature_type):
        raise ValueError(f"feature type {feature_type} needs an encoder: call register_encoder first")
    raise ValueError(f"unknown feature type {feature_type}")


def pool_tokens(tokens: Column, size: Column, how: str = "mean", last_n: int | None = None) -> Column:
    """Pool an array of token vectors (first token, residues, end token, padding).

    ``mean`` averages the residues, or the last n of them; ``first`` takes the first token;
    ``end`` the token after the last residue. Too few residues for ``last_n`` give null.
    """
    if how == "first":
        return F.get(tokens, F.lit(0))
    if how == "end":
        return F.get(tokens, size + 1)
    if how != "mean":
        raise ValueError(f"unknown pooling {how!r}")
    count = size if last_n is None else F.lit(last_n)
    body = F.slice(tokens, F.lit(2) + size - count, count)
    zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(body, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    pooled = F.transform(total, lambda x: x / count)
    return F.when(size >= count, pooled)


def pool_long(tokens: DataFrame, last_n: int | None = None) -> DataFrame:
    """Table (id, dim, value): token rows (id, pos, v) averaged per dimension, or the last n of them."""
    rows = tokens if last_n is None else top_n(tokens, ["id"], [F.desc("pos")], last_n, "__rank")
    long = long_vectors(rows, "id", vector="v")
    return long.groupBy("id", "dim").agg(F.avg("value").alias("value"))
