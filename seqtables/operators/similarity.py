"""Similarity of sequences by shared k-mers: top subjects per query, and all pairs over a threshold."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial, reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtables.functions.rows import explode_words, once
from seqtables.functions.sequence import distinct_kmers
from seqtables.operators.dedupe import top_n
from seqtables.operators.overlaps import counted_pairs
from seqtables.session import cut, release, remove_path, scatter, spread, written

#: Words that a task counts at once, and the binary logarithm of the ranges that they are added up in.
WORDS_AT_ONCE, WORD_PARTS = 1 << 23, 10
ONE_ROUND = 1 << 27


def distinct_sequences(df: DataFrame) -> DataFrame:
    """Table (id, seq): one row per distinct sequence under its smallest id."""
    return df.where("seq is not null").groupBy("seq").agg(F.min("id").alias("id")).select("id", "seq")


def kmer_codes(text: str, k: int) -> np.ndarray:
    """The distinct k-mers of an ASCII text as sorted codes: packed bytes up to eight letters, else strings."""
    letters = np.frombuffer(text.encode("ascii"), dtype=np.uint8)
    if len(letters) < k:
        return np.empty(0, dtype=np.uint64)
    if k > 8:
        windows = np.lib.stride_tricks.sliding_window_view(letters, k)
        return np.unique(np.ascontiguousarray(windows).view(f"S{k}").ravel())
    codes = np.zeros(len(letters) - k + 1, dtype=np.uint64)
    for offset in range(k):
        codes = (codes << np.uint64(8)) | letters[offset : len(codes) + offset]
    codes.sort()  # np.unique takes eight times as long
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])]


def compare_kmers(df: DataFrame, left: str, right: str, k: int) -> DataFrame:
    """Add the numbers of distinct k-mers of two sequence columns (own, other) and in common (shared).

    Set work on whole sequences is far cheaper on packed codes than on arrays of strings.
    Rows next to each other with the same right sequence read its codes once.
    """

    @F.pandas_udf("own long, other long, shared long")
    def overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        last: tuple[str | None, np.ndarray | None] = (None, None)

        def codes_of(text: str) -> np.ndarray:
            nonlocal last
            if text != last[0]:
                last = (text, kmer_codes(text, k))
            return last[1]

        def count(x: str, y: str) -> tuple[int, int, int]:
            if not (x.isascii() and y.isascii()):
                p, q = ({text[i : i + k] for i in range(len(text) - k + 1)} for text in (x, y))
                return len(p), len(q), len(p & q)
            p, q = kmer_codes(x, k), codes_of(y)
            if not (len(p) and len(q)):
                return len(p), len(q), 0
            few, many = (p, q) if len(p) < len(q) else (q, p)
            at = np.minimum(np.searchsorted(many, few), len(many) - 1)
            return len(p), len(q), int(np.count_nonzero(many[at] == few))

        return pd.DataFrame([count(x, y) for x, y in zip(a, b)], columns=["own", "other", "shared"])

    return df.withColumn("__overlap", overlap(left, right)).select(*df.columns, "__overlap.*")


def identity_estimate(jaccard: Column, k: int) -> Column:
    """Residue identity that a k-mer Jaccard index suggests: (2j / (1 + j)) ** (1 / k)."""
    return F.pow(2.0 * jaccard / (1.0 + jaccard), F.lit(1.0 / k))


def beyond_chance(shared: Column, own: Column, other: Column, rate: float, deviations: float = 6.0) -> Column:
    """Shared k-mers beyond those that unrelated sequences of these sizes may share, on the scale of the smaller one.

    A k-mer of one is in the other by chance with probability 1 - exp(-size * rate) at most, so chance
    explains no more than the binomial's mean and six deviations. What lies above is stretched so
    that nothing becomes 0 and all k-mers of the smaller sequence stay all, whatever the lengths.
    """
    few, many = F.least(own, other).cast("double"), F.greatest(own, other)
    outside = F.exp(-many * F.lit(rate))
    mean = few * (1.0 - outside)
    chance = mean + F.lit(deviations) * F.sqrt(mean * outside)
    return F.when(few > chance, F.greatest(F.lit(0.0), shared - chance) * few / (few - chance)).otherwise(0.0)


def jaccard_for_identity(identity: float, k: int) -> float:
    """The Jaccard index at which ``identity_estimate`` reaches an identity."""
    kept = identity**k
    return kept / (2.0 - kept)


class Postings:
    """The distinct k-mers of some sequences and which of these hold each; counts what another sequence shares with them.

    Counts are exact: k-mers of up to eight ASCII letters are compared as packed bytes, others as strings.
    """

    def __init__(self, texts: list[str], k: int):
        self.k = k
        sets = [{text[i : i + k] for i in range(len(text) - k + 1)} for text in texts]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.words: dict[str, int] = {}
        pairs = [(self.words.setdefault(word, len(self.words)), owner) for owner, s in enumerate(sets) for word in s]
        flat = np.array(pairs, np.int64).reshape(-1, 2)
        flat = flat[np.argsort(flat[:, 0], kind="stable")]
        self.owners = flat[:, 1]
        self.starts = np.searchsorted(flat[:, 0], np.arange(len(self.words) + 1))
        packed = [(_word_code(word), n) for word, n in self.words.items() if k <= 8 and word.isascii()]
        codes, numbers = np.array([c for c, _ in packed], np.uint64), np.array([n for _, n in packed], np.int64)
        order = np.argsort(codes)
        self.codes, self.numbers = codes[order], numbers[order]

    def shared(self, text: str) -> tuple[int, np.ndarray]:
        """The number of the text's distinct k-mers, and how many of them each sequence holds."""
        if self.k <= 8 and text.isascii():
            own = kmer_codes(text, self.k)
            at = np.minimum(np.searchsorted(self.codes, own), max(len(self.codes) - 1, 0))
            found = self.numbers[at[self.codes[at] == own]] if len(self.codes) else self.numbers
        else:
            own = {text[i : i + self.k] for i in range(len(text) - self.k + 1)}
            found = np.array([self.words[word] for word in own if word in self.words], np.int64)
        sizes = self.starts[found + 1] - self.starts[found]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[found] - ends + sizes, sizes)
        return len(own), np.bincount(self.owners[places], minlength=len(self.sizes))


def _counted_hits(asked: DataFrame, single: DataFrame, k: int, min_coverage: float) -> DataFrame:
    """Rows of queries and subjects that share enough, counted where the subjects are read; the queries go to all tasks."""
    rows = asked.toArrow()
    ids, texts = rows["query_id"].combine_chunks(), rows["query_seq"].to_pylist()
    postings = Postings(texts, k)
    lengths = np.array([len(text) for text in texts], np.int64)
    need = np.array([max(1, math.ceil(n * min_coverage)) for n in postings.sizes.tolist()], np.int64)
    held = single.sparkSession.sparkContext.broadcast((ids, postings, lengths, need))
    names = ["query_id", "group_id", "shared", "query_kmers", "subject_kmers", "query_sequence_length", "subject_sequence_length"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, postings, lengths, need = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found: list[list[np.ndarray]] = [[] for _ in range(5)]
                for row, text in enumerate(part.column(1).to_pylist()):
                    other, shared = postings.shared(text)
                    enough = np.flatnonzero(shared >= need)
                    for column, values in zip(found, (enough, np.full(len(enough), row), shared[enough], np.full(len(enough), other), np.full(len(enough), len(text)))):
                        column.append(values)
                query, row, shared, other, size = (np.concatenate(column).astype(np.int64) for column in found)
                columns = [ids.take(pa.array(query)), part.column(0).take(pa.array(row)), shared, postings.sizes[query], other, lengths[query], size]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    kinds = [asked.schema["query_id"].dataType.simpleString(), single.schema["group_id"].dataType.simpleString()]
    schema = ", ".join(f"{name} {kind}" for name, kind in zip(names, [*kinds, *["long"] * 5]))
    return single.select("group_id", "subject_seq").mapInArrow(count, schema)


def kmer_search(
    queries: DataFrame,
    subjects: DataFrame,
    k: int,
    max_subjects: int,
    min_coverage: float,
    probe_share: float = 0.75,
    sent: int = 1_000_000,
) -> DataFrame:
    """Best subjects per query by shared distinct k-mers, ties to the smaller subject id.

    Only subjects holding at least ``need``, the share ``min_coverage`` of the query's n
    k-mers, count. Queries of up to ``sent`` letters and ``sent`` / 100 rows are sent to all tasks, which count every
    shared k-mer. More of them are joined: of any n - need + j k-mers such a subject holds at least j. So the rarest
    ones are probed, with j the ``probe_share`` of ``need``: the most common k-mers are never
    joined, and no subject is missed. Copies of a subject are searched once and the smallest ids put back
    afterwards.
    """
    asked = queries.where("seq is not null").select(F.col("id").alias("query_id"), F.col("seq").alias("query_seq"))
    single = distinct_sequences(subjects).select(F.col("id").alias("group_id"), F.col("seq").alias("subject_seq"))
    size = asked.agg(F.sum(F.length("query_seq")).alias("letters"), F.count(F.lit(1)).alias("rows")).first()
    few = (size.letters or 0) <= sent and size.rows <= sent // 100
    scored = _counted_hits(asked, single, k, min_coverage) if few else _joined_hits(asked, single, k, min_coverage, probe_share)
    best = top_n(scored, ["query_id"], [F.desc("shared"), F.asc("group_id")], max_subjects, "group_rank")
    # A copy past the first max_subjects of its group can never be among the best.
    grouped = subjects.where("seq is not null").select(F.col("id").alias("subject_id"), F.col("seq").alias("subject_seq"))
    copies = top_n(grouped, ["subject_seq"], [F.asc("subject_id")], max_subjects, "copy").join(single, "subject_seq")
    expanded = best.drop("group_rank").join(copies.select("group_id", "subject_id"), "group_id")
    ranked = top_n(expanded, ["query_id"], [F.desc("shared"), F.asc("subject_id")], max_subjects)
    jaccard = F.col("shared") / (F.col("query_kmers") + F.col("subject_kmers") - F.col("shared"))
    return ranked.select(
        "query_id",
        "subject_id",
        F.col("rank").cast("long").alias("rank"),
        F.col("shared").alias("shared_kmers"),
        jaccard.alias("jaccard"),
        (100.0 * identity_estimate(jaccard, k)).alias("sequence_identity"),
        (F.col("shared") / F.col("query_kmers")).alias("query_coverage_per_subject"),
        "query_sequence_length",
        "subject_sequence_length",
    )


def _joined_hits(asked: DataFrame, single: DataFrame, k: int, min_coverage: float, probe_share: float) -> DataFrame:
    """Rows of queries and subjects that share enough: the rarest k-mers are joined, and what passes is compared."""
    query_words = explode_words(asked, distinct_kmers(F.col("query_seq"), k), "word", "query_id")
    held = explode_words(single, distinct_kmers(F.col("subject_seq"), k), "word", "group_id")
    # Subject k-mers that no query holds go first; the rest is read twice, so it is written out.
    wanted = cut(query_words.select("word").distinct())
    held = cut(held.join(wanted, "word", "left_semi"))
    seen = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    own = Window.partitionBy("query_id")  # one query's own k-mers
    need = F.ceil(F.col("n") * F.lit(min_coverage))
    probes = (
        query_words.join(seen, "word", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumn("n", F.count(F.lit(1)).over(own))
        .withColumn("rank", F.row_number().over(own.orderBy("df", "word")))
        .withColumn("hits", F.greatest(F.lit(1), F.ceil(need * F.lit(probe_share))))
        .where((F.col("rank") <= F.col("n") - need + F.col("hits")) & (F.col("df") > 0))
        .select("query_id", "word", "hits")
    )
    candidates = (
        held.join(cut(probes), "word")
        .groupBy("query_id", "group_id")
        .agg(F.count(F.lit(1)).alias("found"), F.first("hits").alias("hits"))
        .where(F.col("found") >= F.col("hits"))
        .select("query_id", "group_id")
    )
    candidates = scatter(candidates).sortWithinPartitions("group_id")
    joined = candidates.join(asked, "query_id").join(single, "group_id")
    return (
        compare_kmers(joined, "query_seq", "subject_seq", k)
        .where(F.col("shared") >= F.ceil(F.col("own") * F.lit(min_coverage)))
        .select(
            "query_id",
            "group_id",
            "shared",
            F.col("own").alias("query_kmers"),
            F.col("other").alias("subject_kmers"),
            F.length("query_seq").cast("long").alias("query_sequence_length"),
            F.length("subject_seq").cast("long").alias("subject_sequence_length"),
        )
    )


def _word_code(word: str) -> int:
    """A k-mer's code, the same from whatever text: packed bytes up to eight ASCII letters, else 63 bits of a digest."""
    if len(word) <= 8 and word.isascii():
        return int.from_bytes(word.encode("ascii"), "big")
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little") | 1 << 63


def word_codes(text: str, k: int) -> np.ndarray:
    """The distinct k-mers of any text as sorted codes."""
    if text.isascii() and k <= 8:
        return kmer_codes(text, k)
    return np.unique(np.array([_word_code(word) for word in {text[i : i + k] for i in range(len(text) - k + 1)}], np.uint64))


def _code_batches(k: int):
    """Iterator of (rows, distinct k-mer codes of each sequence) over Arrow batches (id, seq)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield part, [word_codes(text, k) for text in part.column(1).to_pylist()]

    return read


def kmer_holders(single: DataFrame, k: int) -> DataFrame:
    """Table (word, df): the code of each k-mer and the number of sequences that hold it."""
    read = _code_batches(k)

    def added(codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes.sort()
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        words, df = codes[first].view(np.int64), np.diff(np.append(first, len(codes)))
        for start in range(0, len(words), 1 << 16):
            part = slice(start, start + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(words[part]), pa.array(df[part], pa.int64())], names=["word", "df"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0  # words of many sequences are counted at once
        for _, found in read(batches):
            kept += found
            size += sum(map(len, found))
            if size > WORDS_AT_ONCE:
                yield from added(np.concatenate(kept))
                kept, size = [], 0
        if kept:
            yield from added(np.concatenate(kept))

    return single.select("id", "seq").mapInArrow(count, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))


def chance_rate(holders: DataFrame) -> float:
    """Probability that two k-mers drawn from the table are equal, from (word, df): the sum of the squared shares."""
    row = holders.agg(F.sum(F.col("df").cast("double") * F.col("df")).alias("square"), F.sum(F.col("df").cast("double")).alias("total")).first()
    return row.square / row.total**2 if row.total else 0.0


def word_chance(single: DataFrame, k: int) -> float:
    """``chance_rate`` of ``kmer_holders`` without a row for every word.

    Words of many sequences are counted at once, in the order of a hash that tells all apart, and leave the
    task in pieces of that order; pieces of the same range are added up. Tables of more than ``ONE_ROUND`` letters
    are read four times, for a quarter of the hashes each, so that less is shuffled at a time.
    """
    spark, read, parts = single.sparkSession, _code_batches(k), 1 << WORD_PARTS
    letters = single.agg(F.sum(F.length("seq"))).first()[0] or 0
    bits = 2 if letters > ONE_ROUND else 0

    def counted(codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes.sort()
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        words, df = codes[first], np.diff(np.append(first, len(codes))).astype(np.int32)
        edges = np.searchsorted(words, np.arange(parts, dtype=np.uint64) << np.uint64(64 - WORD_PARTS)).tolist()
        for part, (low, high) in enumerate(zip(edges, [*edges[1:], len(words)])):
            if low < high:
                columns = [pa.array([part], pa.int32()), *(pa.array([v[low:high].tobytes()], pa.binary()) for v in (words, df))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "words", "df"])

    def reader(turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, size = [], 0
            for _, found in read(batches):
                hashes = np.concatenate(found) * np.uint64(0x9E3779B97F4A7C15)
                if bits:
                    hashes = hashes[hashes >> np.uint64(64 - bits) == turn]
                kept.append(hashes)
                size += len(hashes)
                if size > WORDS_AT_ONCE:
                    whole, kept, size = np.concatenate(kept), [], 0
                    yield from counted(whole)
            if size:
                yield from counted(np.concatenate(kept))

        return count

    def add(table: pa.Table) -> pa.Table:
        words, df = (np.frombuffer(b"".join(table.column(name).to_pylist()), kind) for name, kind in (("words", np.uint64), ("df", np.int32)))
        order = np.argsort(words)
        words = words[order]
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        held = np.add.reduceat(df[order], first, dtype=np.int64).astype(np.float64)
        return pa.table({"square": pa.array([float((held * held).sum())]), "total": pa.array([float(held.sum())])})

    square = total = 0.0
    for turn in range(1 << bits):
        release(spark, 0.0)  # what the round before has shuffled
        pieces = single.select("id", "seq").mapInArrow(reader(turn), "part int, words binary, df binary")
        sums = pieces.groupBy("part").applyInArrow(add, "square double, total double")
        row = sums.agg(F.sum("square").alias("square"), F.sum("total").alias("total")).first()
        square, total = square + (row.square or 0.0), total + (row.total or 0.0)
    return square / total**2 if total else 0.0


def prefixes(single: DataFrame, holders: DataFrame, k: int, min_jaccard: float, probe_share: float, known: int = 1_000_000) -> DataFrame:
    """Rows (word, df, id, n, at): of each sequence's n words, rarest first, those that are joined.

    The order is that of the ``known`` most frequent words by the number of their holders, all others
    before them, which changes how many pairs are compared and never which are found. Words of one
    holder are left out; at counts them.
    """
    shared = holders.where("df > 1")
    rows = shared.orderBy(F.desc("df"), "word").limit(known).toArrow()
    table = np.array(rows["word"], np.int64), np.array(rows["df"], np.int64)
    whole = len(table[0]) < known
    least_df = 1 if whole else int(table[1].min())
    order = np.argsort(table[0], kind="stable")
    held = single.sparkSession.sparkContext.broadcast((table[0][order], table[1][order]))
    read = _code_batches(k)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, dfs = held.value
        for part, found in read(batches):
            ids = part.column(0)
            columns: dict[str, list[np.ndarray]] = {name: [] for name in ("word", "df", "row", "n", "at")}
            for row, codes in enumerate(found):
                codes = codes.view(np.int64)
                n = len(codes)
                if not n or not len(words) and whole:
                    continue
                at = np.minimum(np.searchsorted(words, codes), max(len(words) - 1, 0))
                df = np.where(words[at] == codes, dfs[at], 0) if len(words) else np.zeros(n, np.int64)
                turned = np.lexsort((codes * np.int64(-7046029254386353131), df))
                need = max(1, math.ceil(n * min_jaccard - 1e-9))
                places = np.arange(n - min(int(need * (1 - probe_share)), need - 1))
                turned = turned[: len(places)]
                if whole:
                    places = places[df[turned] > 0]
                    turned = turned[df[turned] > 0]
                size = len(places)
                values = {"word": codes[turned], "df": np.maximum(df[turned], least_df), "row": np.full(size, row), "n": np.full(size, n), "at": places}
                for name, value in values.items():
                    columns[name].append(value)
            flat = {name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in columns.items()}
            arrays = [ids.take(pa.array(flat[name])) if name == "row" else pa.array(flat[name], pa.int64()) for name in flat]
            yield pa.RecordBatch.from_arrays(arrays, names=["id" if name == "row" else name for name in flat])

    kind = single.schema["id"].dataType.simpleString()
    return single.select("id", "seq").mapInArrow(rank, f"word long, df long, id {kind}, n long, at long")


def _behind(n: Column, share: float, probe_share: float) -> Column:
    """How many of n words come after the prefix that looks for ``probe_share`` of the least share."""
    need = F.greatest(F.lit(1), F.ceil(n * F.lit(share) - 1e-9))
    return F.least(F.floor(need * F.lit(1 - probe_share)), need - 1)


def _sides(rows: DataFrame, min_jaccard: float, probe_share: float, hot: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of the join on words: by bands of sizes, and by blocks where a word has many holders.

    The shorter of two sequences is in the band of the longer one or in the one before; bands too wide
    to leave out more rows than they double are not used. A row probes in
    one block of its word and is held in all of them, so that a word's pairs are made by as many tasks as
    its holders need.
    """
    t = min_jaccard
    banding = t >= 0.4
    band = F.floor(F.ln("n") / F.lit(math.log(1 / min(t, 0.99))) + 1e-9).cast("int") if banding else F.lit(0)
    blocks = F.ceil(F.col("df") / F.lit(hot)).cast("int")
    columns = ["word", "id", "n", "at"]
    probing = rows.select(*columns, band.alias("band"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    held = rows.where(F.col("at") < F.col("n") - _behind(F.col("n"), 2 * t / (1 + t), probe_share))
    banded = held.select(*columns, "df", F.explode(F.array(band, band + 1) if banding else F.array(band)).alias("band"))
    return probing, banded.select(*columns, "band", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))


def candidate_pairs(rows: DataFrame, min_jaccard: float, probe_share: float, hot: int = 2000) -> DataFrame:
    """Pairs (id, other) of the sequences of ``prefixes`` among which are all with a Jaccard index of ``min_jaccard`` or more.

    Two sets that are alike by t share at least t / (1 + t) of the sum of their sizes, and in any fixed
    order of the words the rest of both behind their prefixes cannot hold all of these. So the rarest
    words meet: on the longer one's side all but the last of its own least share, fewer on the shorter
    one's, as the longer one has at least its size. What share of it is looked for in the rarer part
    leaves fewer pairs to compare: a pair needs as many common words there as the rest cannot make up for.
    """
    t = min_jaccard
    probing, holding = _sides(rows, t, probe_share, hot)
    x, y = probing.alias("x"), holding.alias("y")
    n, n_held = F.col("x.n"), F.col("y.n")
    longer = (n > n_held) | ((n == n_held) & (F.col("x.id") < F.col("y.id")))
    need = F.ceil((n + n_held) * F.lit(t / (1 + t)) - 1e-9)
    ahead = F.least(n - F.col("x.at"), n_held - F.col("y.at"))
    keys = [F.col(f"x.{name}") == F.col(f"y.{name}") for name in ("word", "band", "block")]
    met = x.join(y, reduce(lambda a, b: a & b, keys)).where(longer & (n_held >= n * F.lit(t) - 1e-9))
    # the first common word of a pair that passes has enough words behind it on both sides
    counted = met.groupBy(F.col("x.id").alias("id"), F.col("y.id").alias("other")).agg(
        F.count(F.lit(1)).alias("found"), F.first(n).alias("n"), F.first(n_held).alias("n_held"), F.max(ahead >= need).alias("early")
    )
    need = F.ceil((F.col("n") + F.col("n_held")) * F.lit(t / (1 + t)) - 1e-9)
    missing = F.greatest(_behind(F.col("n"), t, probe_share), _behind(F.col("n_held"), 2 * t / (1 + t), probe_share))
    return counted.where((F.col("found") >= need - missing) & F.col("early")).select("id", "other")


def similar_pairs(
    df: DataFrame, k: int, min_jaccard: float, probe_share: float = 0.1, beyond: bool = False
) -> DataFrame:
    """All pairs (id, center, shared, jaccard) of distinct sequences with a k-mer Jaccard index of ``min_jaccard`` or more.

    center is the longer sequence, of equally long ones the one with the smaller id. No pair is
    missed (see ``overlaps.counted_pairs``), and what is compared is exact. With ``beyond`` the index is that
    of the k-mers shared beyond chance (see ``beyond_chance``). Sequences shorter than k have no pairs.
    """
    single, path = written(distinct_sequences(df), "sequences")
    pairs = compared_pairs(spread(single), k, min_jaccard, probe_share, beyond)
    remove_path(df.sparkSession, path)  # the pairs are written
    return pairs


def compared_pairs(single: DataFrame, k: int, min_jaccard: float, probe_share: float = 0.1, beyond: bool = False) -> DataFrame:
    """``similar_pairs`` of a table (id, seq) of distinct sequences."""
    rate = word_chance(single, k) if beyond else 0.0
    release(single.sparkSession, 0.0)  # words are far more rows than all that follows
    compared = counted_pairs(single, _code_batches(k), partial(word_codes, k=k), min_jaccard, probe_share)
    shared = beyond_chance(F.col("shared"), F.col("own"), F.col("theirs"), rate) if beyond else F.col("shared")
    jaccard = shared / (F.col("own") + F.col("theirs") - shared)
    later = (F.col("length") < F.col("other_length")) | ((F.col("length") == F.col("other_length")) & (F.col("id") > F.col("other")))
    turned = F.struct(F.col("other").alias("id"), F.col("id").alias("center"))
    sides = F.when(later, F.struct("id", F.col("other").alias("center"))).otherwise(turned)
    return compared.select(sides.alias("s"), "shared", jaccard.alias("jaccard")).where(F.col("jaccard") >= min_jaccard).select("s.id", "s.center", "shared", "jaccard")
