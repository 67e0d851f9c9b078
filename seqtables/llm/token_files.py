"""Token counts from flat token files, found by scanning for the identifier that ends documents.

A flat file holds the token ids of many documents, each followed by the end-of-document id, and no
index. Files are read in blocks, spread over tasks; a block reports where its separators are, and a
prefix scan over the blocks of a file gives every document its number and its length, also where it
runs across blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqtables.llm.common import documents, settled
from seqtables.session import file_system, scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END = 50256  # free in that vocabulary
BLOCK = 4 << 20  # tokens of a block
TOKEN = np.dtype("<u2")


def encoder(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(
    docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, end: int = END
) -> DataFrame:
    """Encode texts into flat files below ``folder``, one per task; (path, ordinal, doc_id) of what was written.

    A task that is run again writes another file, and only files that this table names count. A
    missing text has no token. Text that looks like a special token is ordinary text.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        name = f"{folder.rstrip('/')}/{TaskContext.get().taskAttemptId()}.tokens"
        system, place = file_system(name)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        written = 0
        with system.open_output_stream(place) as out:
            for batch in batches:
                for value in batch.column(1).to_pylist():
                    out.write(np.array([*coder.encode_ordinary(value or ""), end], TOKEN).tobytes())
                count = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * count).dictionary_encode().cast(pa.string()), pa.array(range(written, written + count), pa.int64()), batch.column(0)],
                    names=["path", "ordinal", "doc_id"],
                )
                written += count

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return settled(rows.mapInArrow(encode, "path string, ordinal long, doc_id long"))


def scan_token_files(paths: DataFrame, end: int = END, block: int = BLOCK) -> DataFrame:
    """(path, ordinal, first, n_tokens, ended) of every document in the files of ``paths`` (column path).

    ordinal counts from 0 in a file, first is the place of its first token. Tokens after the last
    separator are a document with ended false; an empty file has none, two separators in a row
    enclose an empty document. A file of an odd number of bytes is an error.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes = []
            for name in names:
                system, place = file_system(name)
                size = system.get_file_info(place).size
                if size % TOKEN.itemsize:
                    raise ValueError(f"{name} ends within a token")
                sizes.append(size // TOKEN.itemsize)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "total"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("total", pa.int64()), ("start", pa.int64()), ("ends", pa.list_(pa.int64()))])
        for batch in batches:
            for name, total, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                system, place = file_system(name)
                with system.open_input_file(place) as data:
                    data.seek(start * TOKEN.itemsize)
                    ids = np.frombuffer(data.read(min(block, total - start) * TOKEN.itemsize), TOKEN)
                found = pa.array([start + np.flatnonzero(ids == end)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total]), pa.array([start]), found], schema=kind)

    files = paths.select("path").distinct().mapInArrow(lengths, "path string, total long").where("total > 0")
    starts = files.select("path", "total", F.explode(F.expr(f"sequence(0L, total - 1, {block}L)")).alias("start"))
    spread = starts.repartition("path", "start")
    blocks = settled(spread.mapInArrow(search, "path string, total long, start long, ends array<bigint>"))

    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    last = F.element_at("ends", -1)
    stitched = blocks.select(
        "path",
        "total",
        "start",
        "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("earlier"),
        F.coalesce(F.max(F.when(F.size("ends") > 0, last)).over(before) + 1, F.lit(0)).alias("open"),
    )
    closed = stitched.select(
        "path",
        F.posexplode("ends").alias("i", "at"),
        "earlier",
        "open",
        "ends",
    ).select(
        "path",
        (F.col("earlier") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("open")).otherwise(F.get("ends", F.col("i") - 1) + 1).alias("first"),
        "at",
    )
    whole_ones = closed.select("path", "ordinal", "first", (F.col("at") - F.col("first")).alias("n_tokens"), F.lit(True).alias("ended"))
    summary = blocks.groupBy("path", "total").agg(F.sum(F.size("ends")).alias("ordinal"), (F.coalesce(F.max(F.when(F.size("ends") > 0, last)), F.lit(-1)) + 1).alias("first"))
    rest = summary.where("first < total").select("path", "ordinal", "first", (F.col("total") - F.col("first")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole_ones.union(rest)


def remove(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted in flat files that are written and scanned."""
    held = scratch_path(spark, "tokens")
    written = write_token_files(documents(spark, folder), held)
    counted = settled(scan_token_files(written.select("path")))
    remove(spark, held)
    return written.join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens", "first", "ordinal", "ended")
