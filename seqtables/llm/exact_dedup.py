"""Exact duplicates through a cuckoo-filter index of live digests.

The index is sharded by digest. A shard holds a cuckoo filter, which answers "not seen" for
sure and "seen" with a small error, and the bucketed content that settles every hit: its live
digests with their counts. A filter that overflows is rebuilt at twice the size from the stored
digests. Shards are rows of a DataFrame, so an index is written and read as Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtables.llm.common import documents, whole
from seqtables.session import cut

SLOTS = 4  # fingerprints per filter bucket
KICKS = 200  # moves before a filter counts as full
BLOCKS = 16  # batches in which a build feeds the index

SHARD_SCHEMA = "shard int, slots binary, digests binary, counts binary, keep binary"
RESULT_SCHEMA = "shard int, digest binary, keep_id long, live long"


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; 0 marks a free slot."""

    def __init__(self, slots: np.ndarray | None = None, capacity: int = 64):
        n = max(1, 1 << int(np.ceil(np.log2(max(1, capacity) / (0.85 * SLOTS)))))
        self.slots = np.zeros((n, SLOTS), np.uint16) if slots is None else slots.reshape(-1, SLOTS)

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, first and second bucket; the second follows from the first and back."""
        words = digests.view("<u8").reshape(-1, 4)
        prints = (words[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        mask = np.uint64(len(self.slots) - 1)
        first = words[:, 2] & mask
        return prints, first.astype(np.int64), ((first ^ self._jump(prints)) & mask).astype(np.int64)

    @staticmethod
    def _jump(prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) ^ (prints.astype(np.uint64) << np.uint64(17))

    def contains(self, digests: np.ndarray) -> np.ndarray:
        """Whether each digest may be in; false is certain."""
        prints, first, second = self._places(digests)
        same = (self.slots[first] == prints[:, None]) | (self.slots[second] == prints[:, None])
        return same.any(axis=1)

    def insert(self, digests: np.ndarray) -> bool:
        """Add digests; false if the filter overflowed, whose content is then incomplete."""
        prints, first, second = self._places(digests)
        for mark, place, other in zip(prints.tolist(), first.tolist(), second.tolist()):
            for at in (place, other):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = mark
                    break
            else:
                if not self._kick(mark, other):
                    return False
        return True

    def _kick(self, mark: int, at: int) -> bool:
        mask = len(self.slots) - 1
        for turn in range(KICKS):
            slot = (turn + mark) % SLOTS
            mark, self.slots[at, slot] = int(self.slots[at, slot]), mark
            at = (at ^ int(self._jump(np.array([mark], np.uint16))[0])) & mask
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                return True
        return False

    def delete(self, digests: np.ndarray) -> None:
        """Remove one fingerprint of each digest; the digests must be in."""
        prints, first, second = self._places(digests)
        for mark, place, other in zip(prints.tolist(), first.tolist(), second.tolist()):
            for at in (place, other):
                held = np.flatnonzero(self.slots[at] == mark)
                if len(held):
                    self.slots[at, held[0]] = 0
                    break


class Shard:
    """Filter and content of one shard."""

    def __init__(self, row: pd.Series | None = None):
        self.content: dict[bytes, list[int]] = {}  # digest -> largest id, live rows
        self.filter = CuckooFilter()
        self.resizes = 0
        if row is not None:
            raw = row["digests"]
            keep, counts = np.frombuffer(row["keep"], np.int64).tolist(), np.frombuffer(row["counts"], np.int64).tolist()
            self.content = {raw[32 * i : 32 * i + 32]: [k, c] for i, (k, c) in enumerate(zip(keep, counts))}
            self.filter = CuckooFilter(np.frombuffer(row["slots"], np.uint16).copy())

    def _grow(self) -> None:
        """Rebuild the filter from the stored digests, at least twice as large."""
        capacity = 2 * len(self.filter.slots) * SLOTS
        while True:
            self.resizes += 1
            self.filter = CuckooFilter(capacity=max(capacity, len(self.content)))
            if not self.content or self.filter.insert(_stacked(list(self.content))):
                return
            capacity *= 2

    def insert(self, digests: list[bytes], ids: list[int], counts: list[int]) -> None:
        """Add a batch of distinct digests, each with its largest id and its number of rows."""
        hits = self.filter.contains(_stacked(digests)) if digests else []
        new = []
        for digest, hit, key, count in zip(digests, hits, ids, counts):
            known = self.content.get(digest) if hit else None  # a hit counts only once verified
            if known is None:
                self.content[digest] = [key, count]
                new.append(digest)
            else:
                known[0], known[1] = max(known[0], key), known[1] + count
        if new and not self.filter.insert(_stacked(new)):
            self._grow()

    def delete(self, digests: list[bytes], counts: list[int]) -> list[bytes]:
        """Take off rows; digests without a live row leave the filter. Unknown digests are ignored."""
        hits = self.filter.contains(_stacked(digests)) if digests else []
        gone = []
        for digest, hit, count in zip(digests, hits, counts):
            known = self.content.get(digest) if hit else None
            if known is not None:
                known[1] -= count
                if known[1] <= 0:
                    del self.content[digest]
                    gone.append(digest)
        if gone:
            self.filter.delete(_stacked(gone))
        return gone

    def row(self, shard: int) -> pd.DataFrame:
        values = np.array(list(self.content.values()), np.int64).reshape(-1, 2)
        blobs = [self.filter.slots.tobytes(), b"".join(self.content), values[:, 1].tobytes(), values[:, 0].tobytes()]
        return pd.DataFrame([[shard, *blobs]], columns=["shard", "slots", "digests", "counts", "keep"])


def _stacked(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


def digest_of(text: str) -> Column:
    """32 bytes of SHA-256 of the whole text in UTF-8; a missing text counts as empty."""
    return F.unhex(F.sha2(whole(text), 256))


def _shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def _grouped(rows: DataFrame, digest: str, doc_id: str, shards: int) -> DataFrame:
    """Per digest and block: largest id and rows. Copies meet before the shuffle, so a digest has at most BLOCKS rows."""
    counted = rows.groupBy(F.col(digest).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(BLOCKS)).alias("block")).agg(
        F.max(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("live")
    )
    return counted.withColumn("shard", _shard_of(F.col("digest"), shards))


def build(rows: DataFrame, digest: str = "digest", doc_id: str = "doc_id", shards: int | None = None) -> DataFrame:
    """The index, one row per shard, of a table of (digest, id) rows.

    Each shard takes the rows block by block: digests that the filter does not know are new, hits
    are verified against the content. shards bounds what a task holds (its share of the distinct
    digests, about 100 bytes each); by default as many as the session has shuffle partitions.
    """
    shards = shards or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        shard = Shard()
        for _, block in group.groupby("block", sort=True):
            shard.insert(block["digest"].tolist(), block["keep_id"].tolist(), block["live"].tolist())
        return shard.row(int(key[0]))

    grouped = _grouped(rows, digest, doc_id, shards).withColumn("keep_id", F.coalesce("keep_id", F.lit(-(2**63))))
    return grouped.groupBy("shard").applyInPandas(fill, SHARD_SCHEMA)


def update(index: DataFrame, shards: int, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """The index after inserting and deleting (digest, doc_id) rows.

    shards is the number the index was built with. Deleting a group's kept row leaves that id in
    the content as an upper bound; ``survivors`` reads the exact one from the live rows.
    """
    frames = [
        _grouped(rows, "digest", "doc_id", shards).withColumn("sign", F.lit(sign))
        for rows, sign in ((inserts, 1), (deletes, -1))
        if rows is not None
    ]
    changes = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    changes = changes.withColumn("keep_id", F.coalesce("keep_id", F.lit(-(2**63))))

    def change(key: tuple, held: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(held.iloc[0] if len(held) else None)
        for (sign, _), block in group.groupby(["sign", "block"], sort=False):
            digests, counts = block["digest"].tolist(), block["live"].tolist()
            if sign > 0:
                shard.insert(digests, block["keep_id"].tolist(), counts)
            else:
                shard.delete(digests, counts)
        return shard.row(int(key[0]))

    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change, SHARD_SCHEMA)


def content(index: DataFrame) -> DataFrame:
    """The live digests of the index: (digest, keep_id, live)."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                keep, live = np.frombuffer(row.keep, np.int64), np.frombuffer(row.counts, np.int64)
                digests = [row.digests[32 * i : 32 * i + 32] for i in range(len(keep))]
                yield pd.DataFrame({"shard": row.shard, "digest": digests, "keep_id": keep, "live": live})

    flat = index.mapInPandas(unpack, RESULT_SCHEMA)
    return flat.select("digest", F.nullif("keep_id", F.lit(-(2**63))).alias("keep_id"), "live")


def survivors(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(digest, keep_id) of live rows, exact also after deletions: the largest live id of each indexed digest."""
    live = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    return live.join(content(index).select("digest"), "digest", "left_semi")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A missing text equals the empty one. A row
    without id never stays beside one with an id; in a group without any id keep_id is null and
    all rows stay. Rows that repeat an id and its text count in group_size and share the decision.
    """
    rows = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest_of(text).alias("digest")))
    held = content(build(rows, shards=shards))
    return rows.join(held, "digest").select(
        "doc_id",
        "keep_id",
        F.col("live").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op8_exact_dedup(spark, folder: str) -> DataFrame:
    return deduplicate(documents(spark, folder))


OP8_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))"""
