"""Candidates of a similarity join from counts of common words, block of sequences by block.

A join on words makes one row per common word of two sequences, nearly all of which are thrown away
once they are counted. Here sequences are packed into blocks of similar sizes with the words of their
prefixes, one file each below the shared folder. A task indexes a few blocks by their words and reads
the blocks that these may have pairs with one after the other, in memory bounded by the blocks.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtables.session import file_system, release, remove_path, scratch_path, written

#: Words are told apart by so many bits of a hash: words taken for one add to counts, never take from them.
BITS = 23
PART = 1 << 12
STEP = 65535
#: A block has about so many sequences at most, and so many words.
ROWS, LEAST_WORDS, MOST_WORDS = 1 << 12, 1 << 18, 1 << 21
#: A task indexes blocks of about so many words that are looked for, and reads at most so many blocks.
INDEXED, BLOCKS_READ = 3 << 21, 24
MEETINGS, LOOKED_UP, KEPT_CODES = 1 << 17, 1 << 14, 1 << 21
#: Pairs that a task holds before it hands them on, and of one sequence at once.
PAIRS, AT_ONCE = 1 << 16, 128

PAIR = ["id", "other", "length", "other_length", "own", "theirs", "shared"]

#: Slices of rows (id, seq) with the codes of each sequence's distinct words.
Read = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]]


def _buckets(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


def behind(n: np.ndarray, share: float, probe_share: float) -> np.ndarray:
    """How many of n words come after the prefix that looks for ``probe_share`` of the least share."""
    need = np.maximum(1, np.ceil(n * share - 1e-9)).astype(np.int64)
    return np.minimum(np.floor(need * (1 - probe_share)).astype(np.int64), need - 1)


def shares(least: float) -> tuple[float, float, float]:
    """The least shares of common words: of the longer one's, of the shorter one's, and of the shorter one's where the longer one has ``far_off`` times its words."""
    return least, 2 * least / (1 + least), (1 + far_off(least)) * least / (1 + least)


def far_off(least: float) -> float:
    return math.sqrt(1 / least)


def words_and_sizes(single: DataFrame, read: Read) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many sequences hold each bucket of words, on a scale; the different numbers of words of a sequence, and how many have each.

    On the scale 0 and 1 are exact, and more is 2 and eight times the binary logarithm. Of the sizes the
    driver gets at most the root of twice all words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = np.zeros(1 << BITS, np.uint16), Counter()
        for _, found in read(batches):
            for codes in found:
                buckets = _buckets(codes)
                before = held[buckets]
                held[buckets] = before + (before < STEP)
                sizes[len(codes)] += 1
        rows = [(part, counts.tobytes()) for part, counts in enumerate(held.reshape(-1, PART)) if counts.any()]
        rows.append((-1, np.array(list(sizes.items()), np.int64).tobytes()))
        for part, counts in rows:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts], pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        counts, part = table.column("counts").to_pylist(), table.column("part")[0].as_py()
        if part < 0:
            sizes = np.concatenate([np.frombuffer(c, np.int64).reshape(-1, 2) for c in counts])
            n, at = np.unique(sizes[:, 0], return_inverse=True)
            total = np.stack([n, np.bincount(at, sizes[:, 1]).astype(np.int64)], axis=1)
        else:
            total = sum((np.frombuffer(c, np.uint16) for c in counts), np.zeros(PART, np.int64))
            total = np.where(total < 2, total, 2 + 8 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.table({"part": pa.array([part], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, counts binary"
    parts = single.select("id", "seq").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).toArrow()
    held, sizes = np.zeros(((1 << BITS) // PART, PART), np.uint8), np.zeros((0, 2), np.int64)
    for part, counts in zip(parts.column("part").to_pylist(), parts.column("counts").to_pylist()):
        if part < 0:
            sizes = np.frombuffer(counts, np.int64).reshape(-1, 2)
        else:
            held[part] = np.frombuffer(counts, np.uint8)
    sizes = sizes[sizes[:, 0] > 0]
    return held.ravel(), sizes[:, 0], sizes[:, 1]


def size_ranges(n: np.ndarray, sequences: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of numbers of words with about as many words each: their least number, first block and number of blocks."""
    words = n * sequences
    goal = min(max(int(words.sum()) // 16, LEAST_WORDS), MOST_WORDS)
    _, first, inverse = np.unique((np.cumsum(words) - words) // goal, return_index=True, return_inverse=True)
    of = lambda values: np.bincount(inverse, weights=values, minlength=len(first))
    pieces = np.maximum(1, np.maximum(np.rint(of(words) / goal), np.ceil(of(sequences) / ROWS * 1.1))).astype(np.int64)
    return n[first], np.cumsum(pieces) - pieces, pieces


def _packed(words: np.ndarray) -> np.ndarray:
    """Words in rising order as 16-bit steps; a longer step is so many steps of STEP and the rest."""
    steps = np.diff(np.sort(words), prepend=0)
    long = steps // STEP
    out = np.full(len(steps) + int(long.sum()), STEP, np.uint16)
    out[np.arange(len(steps)) + np.cumsum(long)] = steps % STEP
    return out


def _unpacked(packed: pa.Array, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all rows of steps, and per row how many are before and after its first ``held`` steps; held may be several ends in rising order."""
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    steps = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint16)
    ends = (ends - ends[0]) // 2
    held = held.reshape(len(packed), -1)
    bounds = np.append(np.column_stack([ends[:-1], ends[:-1, None] + held]).ravel(), ends[-1])
    sums = np.zeros(len(steps) + 1, np.uint32)  # differences of sums that wrap around are right
    np.cumsum(steps, out=sums[1:])
    words = sums[1:] - np.repeat(sums[bounds[:-1]], np.diff(bounds))
    last = steps != STEP
    np.cumsum(last, out=sums[1:])
    return words[last], np.diff(sums[bounds].astype(np.int64)).reshape(len(packed), -1)


class Pack(NamedTuple):
    """A block that is written: its number, the least and most words of a sequence, how many words are looked for, and where it is."""

    block: int
    low: int
    high: int
    words: int
    path: str


def packed_blocks(single: DataFrame, read: Read, min_jaccard: float, probe_share: float, folder: str | None = None) -> tuple[DataFrame, int]:
    """Rows (block, low, high, words, path) of the blocks written below ``folder``, and the number of blocks.

    ``path`` has (id, n, far, held, words) of a block's sequences, the same with ``.texts`` their letters.
    Of a sequence's n words the rarest are kept, to look for. Rare is what few sequences hold by buckets; any
    one order of the words serves. What only one sequence holds is left out. The first ``held`` steps of
    ``words`` are those that the shorter one of two is looked for by, the first ``far`` those that are enough
    where the longer one has ``far_off`` times its words. A task that is run again writes another file.
    """
    holders, n, sequences = words_and_sizes(single, read)
    least, first, pieces = size_ranges(n, sequences) if len(n) else (n, n, n)
    context = single.sparkSession.sparkContext
    ranges, counted = context.broadcast((least, first, pieces)), context.broadcast(holders)
    folder = folder or scratch_path(single.sparkSession, "blocks")
    schema = "block int, low long, high long, words long, path string"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, first, pieces = ranges.value
        for rows, found in read(batches):
            n = np.array([len(codes) for codes in found], np.int64)
            at = np.searchsorted(least, n[n > 0], side="right") - 1
            kept = rows.filter(pa.array(n > 0))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(first[at]), pa.array(pieces[at])], names=["id", "seq", "first", "pieces"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, looked = [], 0  # a partition is a block
        for rows, found in read(batches):
            id_type = rows.column(0).type
            for codes, (one, text, block) in zip(found, zip(*(column.to_pylist() for column in rows.columns))):
                size = len(codes)
                buckets = _buckets(codes)
                df = counted.value[buckets]
                keys = df.astype(np.uint64) << np.uint64(32) | buckets.astype(np.uint64)
                keys.sort()
                turned = keys.astype(np.uint32).astype(np.int64)
                alone = int(np.count_nonzero(df == 1))
                prefix, few, far = (size - int(behind(np.int64(size), share, probe_share)) for share in shares(min_jaccard))
                if alone < prefix:
                    ends = [alone, max(alone, far), max(alone, few), prefix]
                    parts = [_packed(turned[i:j]) for i, j in zip(ends, ends[1:])]
                    kept.append((one, size, len(parts[0]), len(parts[0]) + len(parts[1]), np.concatenate(parts).tobytes(), text))
                    looked += ends[2] - alone
        if kept:
            kept.sort(key=lambda row: row[1])  # rows next to each other need about as many common words
            path = f"{folder}/{block}-{uuid.uuid4().hex}"
            ids, n, far, held, words, texts = zip(*kept)
            columns = [pa.array(ids, id_type), *(pa.array(c, pa.int64()) for c in (n, far, held)), pa.array(words, pa.binary())]
            _write(path, pa.RecordBatch.from_arrays(columns, names=["id", "n", "far", "held", "words"]), None)
            _write(f"{path}.texts", pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["seq"]), "zstd")
            numbers = [pa.array([v], pa.int64()) for v in (min(n), max(n), looked)]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *numbers, pa.array([path])], names=["block", "low", "high", "words", "path"])

    kind, blocks = single.schema["id"].dataType.simpleString(), int(pieces.sum())
    placed = single.select("id", "seq").mapInArrow(place, f"id {kind}, seq string, first long, pieces long")
    block = F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces"))
    dealt = placed.select("id", "seq", block.cast("int").alias("block")).repartitionById(max(blocks, 1), "block")  # a block is a partition
    return dealt.mapInArrow(pack, schema), blocks


def _write(path: str, rows: pa.RecordBatch, compression: str | None) -> None:
    system, place = file_system(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place) as out, pa.ipc.new_file(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as table:
        table.write_batch(rows)


def _read(path: str) -> pa.RecordBatch:
    system, place = file_system(path)
    with system.open_input_file(place) as data:
        return pa.ipc.open_file(pa.py_buffer(data.read())).get_batch(0)


class _Block:
    """The sequences of a block with their words to look for."""

    def __init__(self, path: str, codes_of: Callable[[str], np.ndarray]):
        self.path, self.texts = path, None
        ids, n, far, held, packed = _read(path).columns
        self.ids, self.kind = ids.to_pylist(), ids.type
        self.n = n.to_numpy(zero_copy_only=False)
        ends = np.column_stack([far.to_numpy(zero_copy_only=False), held.to_numpy(zero_copy_only=False)])
        self.words, self.sizes = _unpacked(packed, ends)
        self.codes_of, self.kept, self.room = codes_of, {}, KEPT_CODES

    def codes(self, row: int) -> np.ndarray:
        """A sequence's codes; the last ones read are kept."""
        if row not in self.kept:
            if self.room < 0:
                self.kept, self.room = {}, KEPT_CODES
            self.kept[row] = self.codes_of(self.seqs[row].as_py())
            self.room -= len(self.kept[row])
        return self.kept[row]

    @property
    def seqs(self) -> pa.Array:
        """The letters, which are read once a pair is compared."""
        if self.texts is None:
            self.texts = _read(f"{self.path}.texts").column(0)
            self.lengths = pc.utf8_length(self.texts).to_numpy(zero_copy_only=False).astype(np.int64)
        return self.texts


class _Index:
    """The sequences of some blocks by the words that each is looked for by as the shorter one.

    With ``far`` these are the words that are enough where the longer one has ``far_off`` times the words.
    """

    def __init__(self, blocks: list[_Block], least: float, probe_share: float, far: bool = False):
        self.blocks, self.least, self.probe_share = blocks, least, probe_share
        self.n = np.concatenate([block.n for block in blocks])
        self.firsts = np.cumsum([0, *[len(block.n) for block in blocks]])
        self.behind = behind(self.n, shares(least)[2 if far else 1], probe_share)
        keys = []
        for block, first in zip(blocks, self.firsts):
            sizes = block.sizes.ravel()
            held = np.repeat(np.arange(len(sizes)) % 3 < (1 if far else 2), sizes)
            of = np.repeat(np.arange(first, first + len(block.n), dtype=np.uint64), block.sizes[:, : 1 if far else 2].sum(axis=1))
            keys.append((block.words[held].astype(np.uint64) << np.uint64(32)) | of)
        keys = np.concatenate(keys)
        keys.sort()
        self.rows = keys.astype(np.uint32).astype(np.int32)
        keys >>= np.uint64(32)
        self.starts = np.zeros((1 << BITS) + 1, np.int32)
        edges = np.searchsorted(keys, np.arange(0, (1 << BITS) + 1, PART, dtype=np.uint64))
        for part, (low, high) in enumerate(zip(edges, edges[1:])):
            counts = np.bincount(keys[low:high].astype(np.int64) - part * PART, minlength=PART)
            self.starts[part * PART + 1 : (part + 1) * PART + 1] = low + np.cumsum(counts)

    def meet(self, asked: _Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the longer ones, ``asked``, and of the shorter ones here that have enough words in common."""
        n, least, size = asked.n, self.least, len(self.n)
        lacking, share = behind(n, least, self.probe_share), least / (1 + least)
        starts, met = np.empty(len(asked.words), np.int32), np.empty(len(asked.words), np.int32)
        for first in range(0, len(starts), LOOKED_UP):
            part = slice(first, first + LOOKED_UP)
            words = asked.words[part].astype(np.intp)
            self.starts.take(words, out=starts[part], mode="clip")
            words += 1
            self.starts.take(words, out=met[part], mode="clip")
        met -= starts
        words = np.flatnonzero(met)  # those that any holds
        starts, met = starts[words], met[words]
        ends = np.searchsorted(words, np.concatenate([[0], np.cumsum(asked.sizes.sum(axis=1))]))
        upto = np.concatenate([[0], np.cumsum(met, dtype=np.int64)])
        sums = upto[ends]
        starts = starts - upto[:-1]  # of the places; each word's go up from here
        many = max(1, MEETINGS // size)
        high = 0
        while high < len(n):
            low = high
            high = max(low + 1, min(low + many, int(np.searchsorted(sums, sums[low] + MEETINGS, side="right")) - 1))
            shortest, longest = n[low:high].min(), n[low:high].max()
            able = (self.n <= longest) & (self.n >= shortest * least - 1e-9)
            if not able.any():
                continue
            # the least that any pair here needs: what the rest cannot make up for
            few = (shortest + self.n) * share - np.maximum(lacking[low:high].max(), self.behind)
            few = max(1, math.ceil(few[able].min() - 1e-6))
            part = slice(ends[low], ends[high])
            places = np.repeat(starts[part], met[part])
            places += np.arange(sums[low], sums[high])
            cells = np.repeat(np.arange(0, (high - low) * size, size), sums[low + 1 : high + 1] - sums[low:high])
            cells += self.rows.take(places, mode="clip")
            found = np.bincount(cells, minlength=(high - low) * size)
            cells = np.flatnonzero(found >= few)
            x, y = low + cells // size, cells % size
            longer, shorter = n[x], self.n[y]
            need = np.ceil((longer + shorter) * share - 1e-9) - np.maximum(lacking[x], self.behind[y])
            fit = (found[cells] >= need) & (longer >= shorter) & (shorter >= longer * least - 1e-9)
            if fit.any():
                yield x[fit], y[fit]

    def pairs(self, asked: _Block) -> Iterator[pa.RecordBatch]:
        """Each pair that meets, once, with both numbers of words and the common ones counted on the whole sets."""
        for x, y in self.meet(asked):
            for first in range(0, len(x), PAIRS):
                part = slice(first, first + PAIRS)
                at = np.searchsorted(self.firsts, y[part], side="right") - 1
                rows, sides, last = [], [], None
                for one, block, other in zip(x[part].tolist(), at.tolist(), (y[part] - self.firsts[at]).tolist()):
                    held = self.blocks[block]
                    if asked.n[one] > held.n[other] or asked.ids[one] < held.ids[other]:
                        if one != last or len(sides) == AT_ONCE:  # pairs come by their longer one
                            rows += _counted(asked, last, sides)
                            sides, last = [], one
                        sides.append((held, other))
                rows += _counted(asked, last, sides)
                if rows:
                    columns = list(zip(*rows))
                    kinds = [asked.kind] * 2 + [pa.int64()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=PAIR)


def _counted(asked: _Block, one: int | None, sides: list[tuple[_Block, int]]) -> list[tuple]:
    """Rows of PAIR of a sequence and others."""
    if not sides:
        return []
    codes, others = asked.codes(one), [held.codes(row) for held, row in sides]
    shared = commons(codes, others) if len(others) > 2 else [common(codes, other) for other in others]
    mine = asked.ids[one], asked.lengths[one], len(codes)
    return [(mine[0], held.ids[row], mine[1], held.lengths[row], mine[2], len(other), n) for (held, row), other, n in zip(sides, others, shared)]


def commons(codes: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """How many codes each other list has in common with the first one; all are rising and none is empty.

    The codes are put into a table by their hashes, where the others look; the few that another one
    has pushed out are searched for. Empty places have the first code, which no other place could give.
    """
    shift = np.uint64(64 - max(8, (16 * len(codes)).bit_length()))
    place = lambda c: (c * np.uint64(0x9E3779B97F4A7C15)) >> shift
    table, places = np.full(1 << (64 - int(shift)), codes[0]), place(codes)
    table[places] = codes
    out = codes[table[places] != codes]
    flat = np.concatenate(others)
    firsts = np.cumsum([0, *[len(other) for other in others]])[:-1]
    found = np.add.reduceat(table[place(flat)] == flat, firsts, dtype=np.int64).tolist()
    return [n + common(out, other) for n, other in zip(found, others)] if len(out) else found


def common(p: np.ndarray, q: np.ndarray) -> int:
    """How many codes two rising lists have in common."""
    few, many = (p, q) if len(p) < len(q) else (q, p)
    if not len(few):
        return 0
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    return int(np.count_nonzero(many[at] == few))


def read_lists(packs: list[Pack], min_jaccard: float) -> list[tuple[list[int], list[int], bool]]:
    """What each task indexes and reads, by place in ``packs``: neighbouring blocks, the blocks that may hold longer ones of their pairs, and whether these all have ``far_off`` times the words.

    Blocks whose sizes rule out every pair do not meet.
    """
    groups: list[list[int]] = []
    order = sorted(range(len(packs)), key=lambda i: (packs[i].low, packs[i].high, packs[i].block))
    words = 0
    for i in order:
        words += packs[i].words
        if not groups or words > INDEXED:
            groups.append([])
            words = packs[i].words
        groups[-1].append(i)
    lists = []
    for group in groups:
        low, high = min(packs[i].low for i in group), max(packs[i].high for i in group)
        fits = [i for i in order if packs[i].high >= low and high >= packs[i].low * min_jaccard - 1e-9]
        apart = [packs[i].low >= far_off(min_jaccard) * high for i in fits]
        for far in (False, True):
            some = [i for i, is_far in zip(fits, apart) if is_far == far]
            lists += [(group, some[i : i + BLOCKS_READ], far) for i in range(0, len(some), BLOCKS_READ)]
    return sorted(lists, key=lambda task: -len(task[1]))


def counted_pairs(single: DataFrame, read: Read, codes_of: Callable[[str], np.ndarray], min_jaccard: float, probe_share: float) -> DataFrame:
    """Pairs (id, other) of ``single`` among which are all with a Jaccard index of ``min_jaccard`` or more.

    With their lengths, their numbers of words (own, theirs) and those in common (shared). The bounds are
    those of ``similarity.candidate_pairs``: the one with more words, id, is looked for by its prefix, other by
    fewer words. The pairs are written out, and the blocks deleted.
    """
    spark = single.sparkSession
    kind = single.schema["id"].dataType.simpleString()
    schema = ", ".join(f"{name} {kind if name in ('id', 'other') else 'long'}" for name in PAIR)
    folder = scratch_path(spark, "blocks")
    packed, blocks = packed_blocks(single, read, min_jaccard, probe_share, folder)
    if not blocks:
        return spark.createDataFrame([], schema)
    release(spark, 0.0)
    packs = [Pack(*row) for row in packed.collect()]
    release(spark, 0.0)  # what was shuffled is in the blocks now
    lists = read_lists(packs, min_jaccard)
    if not lists:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(([pack.path for pack in packs], lists))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, lists = held.value
        for batch in batches:
            for task in batch.column(0).to_pylist():
                indexed, asked, far = lists[task]
                index = _Index([_Block(paths[i], codes_of) for i in indexed], min_jaccard, probe_share, far)
                for i in asked:
                    yield from index.pairs(_Block(paths[i], codes_of))

    tasks = spark.range(len(lists)).select(F.col("id").cast("int").alias("task")).repartitionById(len(lists), "task")
    found, _ = written(tasks.mapInArrow(compare, schema), "pairs")
    remove_path(spark, folder)
    return found
