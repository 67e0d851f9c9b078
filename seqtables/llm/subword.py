"""Likelihood of texts summed over all ways to cut their words into the pieces of a vocabulary.

The pieces and their order are those of an existing vocabulary; it is not changed. Their
probabilities start from its scores and take one step of expectation over all segmentations of the
training words. A piece never spans a gap between words, so the sum over the segmentations of a
text is the product of the sums of its words, each found by a forward recursion in log space.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtables.llm.common import documents

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁".encode()
PRIOR = 10_000.0  # training pieces' worth of the vocabulary's own scores
CHUNK = 16 << 20  # bytes of text that a task scores at once
LONG = 1 << 12  # bytes of a word beyond which its lattice shares nothing with others
LN10 = math.log(10)


@dataclass
class Pieces:
    """trie: nested by byte, -1 holding the piece; logs: natural log-probability of each piece, the end of a text last."""

    trie: dict
    logs: list[float]


def load(path: str = VOCABULARY) -> Pieces:
    """A vocabulary whose scores rank its pieces: the probability falls with the rank as in Zipf's law.

    Every byte has a piece, so no word is impossible; these count as the rarest.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    trie: dict = {}
    weights = []
    for i in range(size):
        if model.is_control(i) or model.is_unknown(i):
            continue
        text = bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).encode()
        node = trie
        for byte in text:
            node = node.setdefault(byte, {})
        weight = 1.0 / (2.7 + (size if model.is_byte(i) else max(0.0, -model.get_score(i))))
        if -1 in node:  # a character that also is a byte piece
            weights[node[-1]] += weight
        else:
            node[-1] = len(weights)
            weights.append(weight)
    weights.append(1.0 / size)
    total = sum(weights)
    return Pieces(trie, [math.log(w / total) for w in weights])


def _edges(word: bytes, trie: dict) -> list[list[tuple[int, int]]]:
    """For every place of the word, the pieces that end there: (where they start, piece)."""
    ends: list[list[tuple[int, int]]] = [[] for _ in range(len(word) + 1)]
    for i in range(len(word)):
        node = trie
        for j in range(i, len(word)):
            node = node.get(word[j])
            if node is None:
                break
            if -1 in node:
                ends[j + 1].append((i, node[-1]))
    return ends


def _forward(ends: list[list[tuple[int, int]]], logs: list[float]) -> list[float]:
    """Log-probability of all segmentations of each beginning of the word."""
    ahead = [0.0]
    for edges in ends[1:]:
        ahead.append(_log_sum([ahead[i] + logs[p] for i, p in edges]))
    return ahead


def _log_sum(terms: list[float]) -> float:
    if len(terms) < 2:
        return terms[0] if terms else -math.inf
    most = max(terms)
    return most + math.log(sum([math.exp(t - most) for t in terms])) if most > -math.inf else most


def word_log(word: bytes, pieces: Pieces) -> float:
    """Natural log of the summed probability of all segmentations of a word."""
    return _forward(_edges(START + word, pieces.trie), pieces.logs)[-1]


def lattices(words: list[bytes], pieces: Pieces) -> Iterator[tuple[int, list[list[tuple[int, int]]], list[float]]]:
    """(place in ``words``, edges, forward logs) of each word, in byte order of the words.

    Neighbours in that order share their beginnings, and with them edges, logs and the pieces that
    are still being read; only what follows is worked out anew. The lists are reused from word to
    word. Words of over ``LONG`` bytes stand alone, so that nothing large is kept.
    """
    trie, logs = pieces.trie, pieces.logs
    ends: list[list[tuple[int, int]]] = [[]]
    open_at: list[list[tuple[int, dict]]] = [[(0, trie)]]
    ahead = [0.0]
    last = b""
    for at in sorted(range(len(words)), key=words.__getitem__):
        word = START + words[at]
        if len(word) > LONG:
            alone = _edges(word, trie)
            yield at, alone, _forward(alone, logs)
            continue
        same = len(os.path.commonprefix((last, word)))
        del ends[same + 1 :], open_at[same + 1 :], ahead[same + 1 :]
        for j in range(same, len(word)):
            byte = word[j]
            going, here, terms = [], [], []
            for i, node in open_at[j]:
                node = node.get(byte)
                if node is not None:
                    going.append((i, node))
                    piece = node.get(-1)
                    if piece is not None:
                        here.append((i, piece))
                        terms.append(ahead[i] + logs[piece])
            going.append((j + 1, trie))
            ends.append(here)
            open_at.append(going)
            ahead.append(_log_sum(terms))
        last = word
        yield at, ends, ahead


def expect(word: bytes, times: float, pieces: Pieces, into: list[float]) -> None:
    """Add how often each piece is expected in ``times`` copies of the word."""
    ends = _edges(START + word, pieces.trie)
    _backward(ends, _forward(ends, pieces.logs), times, pieces.logs, into)


def _backward(ends: list[list[tuple[int, int]]], ahead: list[float], times: float, logs: list[float], into: list[float]) -> None:
    share = [0.0] * len(ends)  # posterior probability that a piece ends here
    share[-1] = times
    for j in range(len(ends) - 1, 0, -1):
        if share[j]:
            edges = ends[j]
            if len(edges) == 1:
                i, p = edges[0]
                into[p] += share[j]
                share[i] += share[j]
                continue
            for i, p in edges:
                part = share[j] * math.exp(ahead[i] + logs[p] - ahead[j])
                into[p] += part
                share[i] += part


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only); bytes split at just the six blank characters that separate words."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _cut(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of texts as ``words_of`` gives them: words per text, distinct words, and each word's place among these."""
    flat = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    plain = pc.fill_null(flat.cast(pa.large_string(), safe=False), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    words = lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)
    owner = pc.list_parent_indices(lists).filter(full).to_numpy()
    coded = words.filter(full).dictionary_encode()
    return np.bincount(owner, minlength=len(flat)), coded.dictionary.cast(pa.large_binary()), coded.indices.to_numpy()


def _training(doc_id: Column) -> Column:
    return ~F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts; the empty word stands for the ends of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, names, codes = _cut(batch.column(0))
            n = np.append(np.bincount(codes, minlength=len(names)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array([*names.to_pylist(), b""], pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn(counts: DataFrame, pieces: Pieces, prior: float = PRIOR) -> tuple[Pieces, int, int]:
    """Pieces with probabilities after one expectation step, the number of training tokens and of distinct ones."""
    shared = counts.sparkSession.sparkContext.broadcast(pieces)
    size = len(pieces.logs)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, tokens, kinds = shared.value, [0.0] * size, 0, 0
        for batch in batches:
            words, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            tokens, kinds = tokens + sum(ns), kinds + len(ns)
            for at, ends, ahead in lattices(words, known):
                if words[at]:
                    _backward(ends, ahead, ns[at], known.logs, sums)
                else:
                    sums[-1] += ns[at]
        found = [i for i, x in enumerate(sums) if x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*found, -1, -2], pa.int64()), pa.array([*(sums[i] for i in found), float(tokens), float(kinds)])], names=["piece", "n"]
        )

    # at most one row per piece
    rows = counts.mapInArrow(step, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).orderBy("piece").collect()
    told = {row.piece: row.n for row in rows}
    tokens, kinds = int(told.pop(-1, 0)), int(told.pop(-2, 0))
    mass = sum(told.values()) + prior
    logs = [math.log((round(told.get(i, 0.0), 6) + prior * math.exp(x)) / mass) for i, x in enumerate(pieces.logs)]
    return Pieces(pieces.trie, logs), tokens, kinds


def score(docs: DataFrame, pieces: Pieces, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the id is 2 modulo 7 are held out, all others (and rows without id)
    are learned from. Tokens are the words and one end. base_score is that of add-one smoothed
    token counts, score the log10-probability of the text under the pieces. Missing and empty
    texts have the end alone. Rows that repeat an id count each.

    Texts are dealt into chunks; a chunk's distinct words travel once to where a word is counted
    and scored, and the scores back, so that shuffles grow with distinct words per chunk.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fitted, tokens, kinds = learn(word_counts(rows.where(_training(F.col("doc_id"))), "text"), pieces)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / CHUNK))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    dealt = dealt.withColumn("learn", _training(F.col("doc_id")))

    def vocabulary(table: pa.Table) -> pa.Table:
        sizes, names, codes = _cut(table.column("text"))
        learned = np.repeat(table.column("learn").to_numpy(), sizes)
        counts = np.bincount(codes[learned.astype(bool)], minlength=len(names))
        order = pc.sort_indices(names)  # the order of the rows of a chunk may differ the next time
        size, chunk = len(names), table.column("chunk")[0].as_py()
        return pa.table(
            {
                "word": names.take(order).cast(pa.binary()),
                "n": pa.array(counts[order.to_numpy()], pa.int64()),
                "chunk": pa.array(np.full(size, chunk, np.int32)),
                "place": pa.array(np.arange(size, dtype=np.int32)),
            }
        )

    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            logs = [0.0] * len(words)
            for at, _, ahead in lattices(words, known):
                logs[at] = ahead[-1] / LN10
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(logs, pa.float64())], names=["n", "places", "log"])

    per_chunk = dealt.groupBy("chunk").applyInArrow(vocabulary, "word binary, n long, chunk int, place int")
    # a word has at most one place per chunk
    grouped = per_chunk.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("chunk", "place")).alias("places"))
    scored = grouped.mapInArrow(lattice, "n long, places array<struct<chunk:int,place:int>>, log double")
    back = scored.select("n", "log", F.inline("places"))
    end = fitted.logs[-1] / LN10
    base_all = math.log10(tokens + kinds + 1)

    def finish(key: tuple, texts: pa.Table, scores: pa.Table) -> pa.Table:
        place = scores.column("place").to_numpy()
        n, log = np.zeros(len(place), np.int64), np.zeros(len(place))
        n[place], log[place] = scores.column("n").to_numpy(), scores.column("log").to_numpy()
        base = np.log10(n + 1.0)
        sizes, names, codes = _cut(texts.column("text"))
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        ids = rank[codes]
        known_at, base_at, log_at = n[ids] > 0, base[ids], log[ids]
        out, begin = [], 0
        for size in sizes.tolist():
            part = slice(begin, begin + size)
            out.append((size + 1, int(known_at[part].sum()), float(base_at[part].sum()), float(log_at[part].sum())))
            begin += size
        a, b, c, d = zip(*out) if out else ((), (), (), ())
        return pa.table({"doc_id": texts.column("doc_id"), "learn": texts.column("learn"), "n_tokens": pa.array(a, pa.int64()), "n_words": pa.array(b, pa.int64()), "base": pa.array(c, pa.float64()), "log": pa.array(d, pa.float64())})

    done = dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        finish, "doc_id long, learn boolean, n_tokens long, n_words long, base double, log double"
    )
    ends = F.lit(_ends(tokens, rows))
    return done.select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        (F.col("n_words") + F.when(ends > 0, 1).otherwise(0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.round(F.col("base") + F.log10(ends + 1.0) - F.col("n_tokens") * F.lit(base_all), 6).alias("base_score"),
        F.round(F.col("log") + F.lit(end), 6).alias("score"),
    )


def _ends(tokens: int, rows: DataFrame) -> int:
    """Ends of texts among the training tokens."""
    return rows.where(_training(F.col("doc_id"))).count() if tokens else 0


def op10_subword_score(spark, folder: str) -> DataFrame:
    return score(documents(spark, folder), load())


