"""Similarity hits with segments: shared words on a diagonal, scored without gaps.

Two sequences that share words at the same distance have a diagonal in common. Along each such
diagonal the segment with the largest sum of substitution scores is the hit, and its score becomes
bits and an expected number of chance hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtables.functions.sequence import kmers
from seqtables.operators.cluster import CLUSTER, REPRESENTATIVE, pick_representatives
from seqtables.operators.dedupe import top_n
from seqtables.operators.ordered import dense_ids
from seqtables.operators.similarity import distinct_sequences
from seqtables.session import cut, spread

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: Residues that replace each other easily.
GROUPS = ("AST", "C", "DENQ", "FWY", "G", "HKR", "ILMV", "P")


SENT = 1_000_000  # letters of queries whose words, fewer than these, are sent to all tasks


@dataclass(frozen=True)
class Scoring:
    """Substitution scores of letters, and the statistics of chance hits.

    Letters of one group score ``like``, other pairs ``unlike``. ``pairs`` may give scores of
    single pairs, such as those of a published matrix. K is the statistics' constant.
    """

    same: int = 5
    like: int = 1
    unlike: int = -2
    letters: str = RESIDUES
    groups: tuple[str, ...] = GROUPS
    pairs: dict[tuple[str, str], int] = field(default_factory=dict)
    kappa: float = 0.1

    @cached_property
    def table(self) -> np.ndarray:
        """Scores by byte; letters not in the table are unlike all others and themselves."""
        scores = np.full((256, 256), self.unlike, np.int64)
        group = {c: n for n, members in enumerate(self.groups) for c in members}
        for a in self.letters:
            for b in self.letters:
                score = self.same if a == b else self.like if a in group and group.get(a) == group.get(b) else self.unlike
                scores[ord(a), ord(b)] = self.pairs.get((a, b), self.pairs.get((b, a), score))
        return scores

    @cached_property
    def scale(self) -> float:
        """The root of sum p(a) p(b) exp(x score(a, b)) = 1 with equally frequent letters."""
        at = [ord(c) for c in self.letters]
        scores = self.table[np.ix_(at, at)].astype(float)
        if scores.mean() >= 0 or scores.max() <= 0:
            raise ValueError("scores must be negative on average and positive for some pair")
        low, high = 0.0, 1.0
        while np.exp(high * scores).mean() < 1:
            high *= 2
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if np.exp(middle * scores).mean() < 1 else (low, middle)
        return (low + high) / 2


def read_scores(lines: Sequence[str]) -> dict[tuple[str, str], int]:
    """The pairs of a substitution matrix in the usual text form: a header of letters, then a row per letter."""
    rows = [line.split() for line in lines if line.strip() and not line.startswith("#")]
    return {(row[0], column): int(score) for row in rows[1:] for column, score in zip(rows[0], row[1:])}


def _merged(groups: Sequence[str]) -> Column:
    """The sequence with the first letter of a group for all of them."""
    members = [(c, members[0]) for members in groups for c in members]
    return F.translate("seq", "".join(a for a, _ in members), "".join(b for _, b in members)) if groups else F.col("seq")


def _placed_words(df: DataFrame, k: int, groups: Sequence[str]) -> DataFrame:
    """(word, id, at) for every k letters in a row; letters of a group count as the same."""
    return df.select("id", F.posexplode(kmers(_merged(groups), k)).alias("at", "word")).select("word", "id", F.col("at").cast("long").alias("at"))


def _packed(text: str, size: int) -> np.ndarray:
    """Every run of ``size`` (at most eight) letters of an ASCII text as a number, in order."""
    letters = np.frombuffer(text.encode("ascii"), np.uint8)
    codes = np.zeros(max(len(letters) - size + 1, 0), np.uint64)
    for offset in range(size):
        codes = (codes << np.uint64(8)) | letters[offset : len(codes) + offset]
    return codes


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(codes), bool)
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def _likely_words(df: DataFrame, k: int, groups: Sequence[str], words: list[str] | None) -> DataFrame:
    """(word, id, at) as ``_placed_words`` has them; with ``words`` hardly more than those of these.

    A place stays if the first and the last letters of its word, eight at most, are those of some wanted words.
    """
    size = min(k, 8)
    plain = [word for word in words or () if word.isascii()]
    heads, tails = (np.unique(np.concatenate([np.zeros(0, np.uint64), *(_packed(word[at : at + size], size) for word in plain)])) for at in (0, k - size))
    held = df.sparkSession.sparkContext.broadcast((heads, tails, None if words is None else set(words)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, tails, wanted = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found, rows, places = [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    at = range(len(text) - k + 1)
                    if wanted is not None and text.isascii():
                        codes = _packed(text, size)
                        first = np.flatnonzero(_among(codes[: len(at)], heads))
                        at = first[_among(codes[first + k - size], tails)].tolist()
                    elif wanted is not None:
                        at = [i for i in at if text[i : i + k] in wanted]
                    found += [text[i : i + k] for i in at]
                    rows += [row] * len(at)
                    places += at
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), part.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int64())], names=["word", "id", "at"])

    schema = f"word string, id {df.schema['id'].dataType.simpleString()}, at long"
    return df.where("seq is not null").select("id", _merged(groups).alias("seq")).mapInArrow(read, schema)


def _best_segment(scores: np.ndarray) -> tuple[int, int, int]:
    """(start, end, sum) of the segment with the largest sum: of equals the first to end, then the longest."""
    sums = np.concatenate([[0], np.cumsum(scores)])
    least = np.minimum.accumulate(sums[:-1])
    gains = sums[1:] - least
    end = int(gains.argmax())
    start = int(np.flatnonzero(sums[: end + 1] == least[end])[0])
    return start, end + 1, int(gains[end])


def segments(pairs: DataFrame, scoring: Scoring) -> DataFrame:
    """Rows (query_id, subject_id, score, query_start, query_end, subject_start, subject_end, same) of pairs with diagonals.

    pairs: (query_id, subject_id, query_seq, subject_seq, diagonals), a diagonal being the place in the
    subject less that in the query. Places count from 1, ends are included. One row per diagonal whose
    best segment has a positive score. Letters beyond one byte are like no others.
    """
    kinds = {name: pairs.schema[name].dataType.simpleString() for name in ("query_id", "subject_id")}
    names = ["score", "query_start", "query_end", "subject_start", "subject_end", "same"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = scoring.table
        letters = lambda text: np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
        for batch in batches:
            rows, found = [], []
            for n, (a, b, diagonals) in enumerate(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))):
                x, y = letters(a), letters(b)
                for diagonal in sorted(diagonals):
                    first = max(0, -diagonal)
                    size = min(len(x) - first, len(y) - first - diagonal)
                    p, q = x[first : first + size], y[first + diagonal : first + diagonal + size]
                    start, end, total = _best_segment(table[p, q])
                    if total > 0:
                        rows.append(n)
                        place = first + start
                        found.append((total, place + 1, first + end, place + diagonal + 1, first + end + diagonal, int((p[start:end] == q[start:end]).sum())))
            taken = pa.array(rows, pa.int64())
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), *columns], names=["query_id", "subject_id", *names])

    schema = ", ".join([f"{n} {k}" for n, k in kinds.items()] + [f"{n} long" for n in names])
    return pairs.select("query_id", "subject_id", "query_seq", "subject_seq", "diagonals").mapInArrow(score, schema)


def diagonals(queries: DataFrame, subjects: DataFrame, k: int, least_words: int, groups: Sequence[str] = (), sent: int = SENT) -> DataFrame:
    """(query_id, subject_id, diagonals) of pairs with a diagonal that has ``least_words`` common words.

    Words that no query holds are left out before the join, and where subjects are read when the queries have at most
    ``sent`` letters. The diagonals of a pair are at most as many as its letters.
    """
    if (queries.agg(F.sum(F.length("seq")).alias("n")).first().n or 0) <= sent:
        asked = _likely_words(queries, k, groups, None)
        held = _likely_words(subjects, k, groups, [r.word for r in asked.select("word").distinct().collect()])
    else:
        asked = _placed_words(queries, k, groups)
        held = _placed_words(subjects, k, groups).join(asked.select("word").distinct(), "word", "left_semi")
    x, y = asked.alias("x"), held.alias("y")
    met = x.join(y, F.col("x.word") == F.col("y.word")).groupBy(
        F.col("x.id").alias("query_id"), F.col("y.id").alias("subject_id"), (F.col("y.at") - F.col("x.at")).alias("diagonal")
    )
    lines = met.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_words)
    return lines.groupBy("query_id", "subject_id").agg(F.collect_list("diagonal").alias("diagonals"))


def search(
    queries: DataFrame,
    subjects: DataFrame,
    k: int = 3,
    least_words: int = 2,
    max_subjects: int = 500,
    max_hsps: int = 1,
    max_e_value: float = 10.0,
    scoring: Scoring | None = None,
    groups: Sequence[str] = (),
) -> DataFrame:
    """Hits of ``queries`` (id, seq) in ``subjects`` (id, seq), with the columns of a tabular hit file.

    Only diagonals with ``least_words`` common words of k letters (equal up to ``groups``) are scored.
    E-values count all letters of the subjects. Of a query and a subject the ``max_hsps`` best segments
    stay, of a query the subjects with the ``max_subjects`` best hits; ties go to the smaller subject and
    place. Sequences that are null, empty or shorter than k have no hits; ids are taken as unique.
    """
    scoring = scoring or Scoring()
    asked, there = (df.where("seq is not null").select("id", "seq") for df in (queries, subjects))
    letters = there.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("double").alias("n")).scalar()
    lines = cut(diagonals(asked, there, k, least_words, groups))
    named = lines.join(asked.select(F.col("id").alias("query_id"), F.col("seq").alias("query_seq")), "query_id").join(
        there.select(F.col("id").alias("subject_id"), F.col("seq").alias("subject_seq")), "subject_id"
    )
    sizes = named.select("query_id", "subject_id", F.length("query_seq").cast("long").alias("query_sequence_length"), F.length("subject_seq").cast("long").alias("subject_sequence_length"))
    raw = segments(named, scoring).join(sizes, ["query_id", "subject_id"]).withColumn("__letters", letters)
    bits = (F.col("score") * F.lit(scoring.scale) - F.lit(math.log(scoring.kappa))) / F.lit(math.log(2.0))
    expected = F.lit(scoring.kappa) * F.col("query_sequence_length") * F.col("__letters") * F.exp(F.col("score") * F.lit(-scoring.scale))
    scored = raw.withColumns({"bit_score": bits, "e_value": expected}).where(F.col("e_value") <= max_e_value)
    places = [F.desc("score"), F.asc("query_start"), F.asc("subject_start")]
    best = top_n(scored, ["query_id", "subject_id"], places, max_hsps, "hsp")
    chosen = best.where("hsp = 1").select("query_id", "subject_id", "score")
    kept = top_n(chosen, ["query_id"], [F.desc("score"), F.asc("subject_id")], max_subjects, "place").select("query_id", "subject_id")
    return _hit_columns(best.join(kept, ["query_id", "subject_id"]))


def _hit_columns(best: DataFrame) -> DataFrame:
    """The columns of a tabular hit file; coverages are in per cent of the query, by all its segments and by one."""
    size = F.col("query_end") - F.col("query_start") + 1
    length = F.col("query_sequence_length")
    lists = best.groupBy("query_id", "subject_id").agg(F.collect_list(F.sequence("query_start", "query_end")).alias("parts"))
    covered = lists.select("query_id", "subject_id", F.size(F.array_distinct(F.flatten("parts"))).alias("covered"))
    return best.join(covered, ["query_id", "subject_id"]).select(
        "query_id",
        "subject_id",
        (100.0 * F.col("same") / size).alias("sequence_identity"),
        size.alias("alignment_length"),
        (size - F.col("same")).alias("mismatch"),
        F.lit(0).cast("long").alias("num_gap_openings"),
        F.col("query_start").alias("query_alignment_start"),
        F.col("query_end").alias("query_alignment_end"),
        F.col("subject_start").alias("subject_alignment_start"),
        F.col("subject_end").alias("subject_alignment_end"),
        "e_value",
        "bit_score",
        (100.0 * F.col("covered") / length).alias("query_coverage_per_subject"),
        (100.0 * size / length).alias("query_coverage_per_pair"),
        "query_sequence_length",
        "subject_sequence_length",
    )


def cluster_homologs(
    df: DataFrame, max_e_value: float = 1e-3, min_coverage: float = 0.8, k: int = 5, least_words: int = 2, scoring: Scoring | None = None, groups: Sequence[str] = GROUPS
) -> DataFrame:
    """Add the representative and a dense cluster number, linking sequences by a significant segment.

    A link needs a segment over ``min_coverage`` of the shorter sequence with an E-value (against the
    whole table) of at most ``max_e_value``. Words over a reduced alphabet and two of them on a
    diagonal find relatives whose own words no longer agree. Representatives are the longest, then the
    smallest ids (see ``pick_representatives``). Rows without a sequence keep null.
    """
    bare = df.drop(REPRESENTATIVE, CLUSTER)
    single = spread(cut(distinct_sequences(bare)))
    hits = search(single, single, k, least_words, 2**31 - 1, 1, max_e_value, scoring, groups).where("query_id <> subject_id")
    covers = F.col("alignment_length") >= F.lit(min_coverage) * F.least("query_sequence_length", "subject_sequence_length")
    size, other = F.col("query_sequence_length"), F.col("subject_sequence_length")
    later = (size < other) | ((size == other) & (F.col("query_id") > F.col("subject_id")))
    edges = hits.where(covers & later).select(F.col("query_id").alias("id"), F.col("subject_id").alias("center"), F.col("bit_score").alias("jaccard"))
    found = cut(single.join(pick_representatives(single, edges), "id").select("seq", F.col("representative").alias(REPRESENTATIVE)))
    numbers = dense_ids(found, REPRESENTATIVE, CLUSTER)
    return bare.join(found.join(numbers, REPRESENTATIVE), "seq", "left").select(*bare.columns, REPRESENTATIVE, CLUSTER)
