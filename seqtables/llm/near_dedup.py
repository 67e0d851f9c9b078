"""Near duplicates by MinHash with sequential Bayesian verification of candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqtables.llm.buckets import link_buckets
from seqtables.llm.common import documents, keep_rows, lightest, settled
from seqtables.llm.shingles import mixed, shingle_set, signatures, word_hashes

WIDTH = 5  # words of a shingle
PERCENT = 75  # least similarity of a link
BANDS, ROWS = 32, 4  # a pair at the least similarity shares no band with probability 5e-6
BATCH, BATCHES = 32, 3  # further hashes, compared batch by batch
MISS = 1e-7  # a candidate is dropped when a link has a smaller posterior probability

SKETCH = "doc_id long, n_shingles long, digest binary, bands binary, checks binary"


def least_matches(similarity: float, miss: float = MISS, batch: int = BATCH, batches: int = BATCHES) -> list[int]:
    """Fewest equal hashes after each batch with which P(similarity or more) is still ``miss`` or more.

    The similarity has a uniform prior, so after m of n equal hashes its posterior is
    Beta(m + 1, n - m + 1).
    """
    x = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(batch, batch * batches + 1, batch):
        tails = []
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            density = np.exp(log - log.max())
            tails.append(density[x >= similarity].sum() / density.sum())
        out.append(next(m for m, tail in enumerate(tails) if tail >= miss))
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.binary()), ("checks", pa.binary())])
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, hashed in word_hashes(texts):
            sets = [shingle_set(words, WIDTH) for words in hashed]
            full = [i for i, s in enumerate(sets) if len(s)]
            rows = {}
            if full:
                drawn = signatures([sets[i] for i in full], BANDS * ROWS + BATCH * BATCHES)
                banded = drawn[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS)
                keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), banded.shape[:2]).copy()
                for r in range(ROWS):
                    keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, r])
                checks = drawn[:, BANDS * ROWS :].astype(np.uint16)
                rows = {i: (keys[k].tobytes(), checks[k].tobytes()) for k, i in enumerate(full)}
            out = [
                (ids[first + i], len(sets[i]), hashlib.blake2b(words.tobytes(), digest_size=16).digest(), *rows.get(i, (b"", b"")))
                for i, words in enumerate(hashed)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), names.types)], schema=names)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), BANDS) for i in (0, 1))
        keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(sizes)], names=["bucket", "id", "size"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for first, hashed in word_hashes(texts):
            blobs = [shingle_set(words, WIDTH).tobytes() for words in hashed]
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(blobs)), pa.array(blobs, pa.binary())], names=["key", "shingles"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = np.frombuffer(blob.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), key)), pa.array(values)], names=["id", "element"])


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as 32-bit hashes, for a first count of what two sets have in common."""
    for batch in batches:
        short = [np.unique(np.frombuffer(b.as_buffer(), np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for b in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], names=["key", "short"])


def _compare_blocks(key: tuple, table: pa.Table) -> pa.Table:
    """Pairs of two blocks, of different components, that have about PERCENT of their elements in common.

    The counts of common elements of all pairs are a product of two matrices, over those elements
    that occur more than once. Shortened hashes can only add to a count; links are confirmed later.
    """
    left, right = key[1].as_py(), key[2].as_py()
    sets = [np.frombuffer(b.as_buffer(), np.uint32) for b in table.column("short").combine_chunks()]
    ids, parts, mine = (table.column(c).to_numpy() for c in ("id", "component", "mine"))
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[place] > 1
    column = np.cumsum(times > 1) - 1
    owner, place = owner[often], column[place[often]]
    x, y = np.flatnonzero(mine == left), np.flatnonzero(mine == right)
    both = np.zeros((len(x), len(y)), np.float32)
    row = np.zeros(len(sets), np.int64)
    row[x] = np.arange(len(x))
    at_y = np.zeros(len(sets), np.int64)
    at_y[y] = np.arange(len(y))
    in_x, in_y = (mine == left)[owner], (mine == right)[owner]
    for start in range(0, int((times > 1).sum()), 4096):
        now = (place >= start) & (place < start + 4096)
        a, b = np.zeros((len(x), 4096), np.float32), np.zeros((len(y), 4096), np.float32)
        a[row[owner[now & in_x]], place[now & in_x] - start] = 1
        b[at_y[owner[now & in_y]], place[now & in_y] - start] = 1
        both += a @ b.T
    either = sizes[x][:, None] + sizes[y][None, :] - both
    close = (100 * both >= PERCENT * either) & (parts[x][:, None] != parts[y][None, :]) & (ids[x][:, None] != ids[y][None, :])
    i, j = np.nonzero(close)
    low, high = np.minimum(ids[x[i]], ids[y[j]]), np.maximum(ids[x[i]], ids[y[j]])
    return pa.table({"a": low, "b": high})


def _screen(similar: list[int]):
    """Compare the check hashes of pairs batch by batch and stop at those that can be no link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BATCHES, BATCH) for i in (2, 3)
            )
            alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k in range(BATCHES):
                matches[alive] += (x[alive, k] == y[alive, k]).sum(axis=1)
                alive = alive[matches[alive] >= similar[k]]
            left = np.zeros(len(x), bool)
            left[alive] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(left)], names=["a", "b", "alive"])

    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of distinct five-word shingles (A-Z as a-z; of fewer words
    the whole sequence) have a similarity of 0.75 or more; component_id is the smallest id reachable
    over links, and its document is the one kept. Documents without words (or text) have an empty
    set, are linked with nothing and kept.

    Equal word sequences are one class from the start, so copies cost one row each. Classes meet in
    the bands of their signatures; further signature batches drop candidates whose posterior
    probability of being a link is under MISS, the rest is compared on full sets (of 64-bit shingle
    hashes). Rows without id are decided by their class: component_id is that of a class with ids,
    else null, and they are kept only in the latter case. Rows that repeat an id share the decision.
    """
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = settled(raw.mapInArrow(_sketches, SKETCH))
    classes = settled(sketches.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    owners = sketches.where("n_shingles > 0").join(classes, (F.col("doc_id") == F.col("rep")) & (sketches.digest == classes.digest), "left_semi")
    owners = settled(owners.select("doc_id", "n_shingles", "bands", "checks").dropDuplicates(["doc_id"]))
    members = owners.select("doc_id", "n_shingles", "bands").mapInArrow(_bands, "bucket long, id long, size long")
    same = Window.partitionBy("bucket")
    met = members.withColumns({"low": F.min("id").over(same), "high": F.max("id").over(same)}).where("low <> high")
    members = settled(met.select("bucket", "id", "size"))

    wanted = settled(members.select(F.col("id").alias("doc_id")).distinct())
    candidates = raw.join(lightest(wanted), "doc_id", "left_semi")
    sets = settled(candidates.mapInArrow(_sets, "key long, shingles binary").dropDuplicates(["key"]))
    checks = owners.select(F.col("doc_id").alias("key"), "checks").join(lightest(wanted), F.col("key") == F.col("doc_id"), "left_semi")
    checks = settled(checks)

    similar = least_matches(PERCENT / 100)

    def both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
        """Pairs with the values of both ends; the pivot comes last, so only one side travels with the pair."""
        b = values.select(F.col("key").alias("b"), F.col(name).alias("of_b"))
        a = values.select(F.col("key").alias("a"), F.col(name).alias("of_a"))
        return pairs.join(b, "b").join(a, "a").select("a", "b", "of_a", "of_b")

    def verify(pairs: DataFrame) -> DataFrame:
        screened = settled(both(pairs, checks, "checks").mapInArrow(_screen(similar), "a long, b long, alive boolean"))
        alive = screened.where("alive").select("a", "b")
        ends = settled(alive.select(F.col("a").alias("id")).union(alive.select("b")).distinct())
        needed = sets.join(lightest(ends), F.col("key") == F.col("id"), "left_semi")
        exact = both(alive, needed, "shingles").mapInArrow(_confirm, "a long, b long, linked boolean")
        lost = screened.where("not alive").select("a", "b", F.lit(False).alias("linked"))
        return exact.union(lost)

    def elements(ids: DataFrame) -> DataFrame:
        needed = sets.join(lightest(ids), F.col("key") == F.col("id"), "left_semi")
        return needed.mapInArrow(_elements, "id long, element long")

    def blocks(dealt: DataFrame) -> DataFrame:
        short = sets.select("key", "shingles").mapInArrow(_shorten, "key long, short binary")
        full = dealt.join(short, F.col("key") == F.col("id")).drop("key")
        return full.groupBy("bucket", "left", "right").applyInArrow(_compare_blocks, "a long, b long")

    found = link_buckets(members, verify, elements, PERCENT, blocks)
    joined = classes.join(found, F.col("rep") == F.col("id"), "left").select(
        F.col("digest").alias("class"), F.coalesce("component", "rep").alias("component_id")
    )
    return sketches.join(joined, F.col("digest") == F.col("class"), "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        ((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without those that have a kept near duplicate."""
    decided = near_duplicates(docs)
    return keep_rows(docs, settled(decided.where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone"))))


def op7_near_dedup(spark, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))
