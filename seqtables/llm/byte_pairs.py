"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

The encoding of every prefix of a piece ends in exactly one token, and what comes before that token
is the encoding of the shorter prefix. So one token per prefix is the whole state: the next prefix's
token is the only one of the tokens ending there that may follow the last token of the prefix that
it leaves. Appending extends the table, and an edit recomputes it from the edit on until it agrees
with the old one over the longest token's length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from seqtables.llm.common import documents, fresh
from seqtables.session import spread

NONE, NEVER = -1, 1 << 62
ID = np.dtype("<u4")
HELD = 800_000  # pieces, and pairs of tokens, that a worker remembers
SHORT = 64  # characters of the longest piece that is remembered
WINDOW = 1 << 20  # characters that are split into pieces at a time
ARROW_BYTES = 32 << 20  # of one outgoing batch


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a vocabulary file: one line per token, base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks of tokens, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.lengths = {rank: len(token) for rank, token in self.tokens.items()}
        self.allowed, self.refused, self.answers = self._unknown(), self._unknown(), 0
        self._automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self.merged(token) == [rank]:
                self._automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self._automaton.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """What byte pair merging means: join the neighbours of the lowest rank, the leftmost first."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        joined = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while joined and (lowest := min(joined)) != NEVER:
            i = joined.index(lowest)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i:
                joined[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
            if i < len(joined):
                joined[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
        return [ranks[part] for part in parts]

    def follows(self, first: int, second: int) -> bool:
        """Whether two tokens stay apart when merged together; the answer is remembered."""
        if first == NONE:
            raise ValueError("the vocabulary lacks a token for one of the bytes")
        if first in self.refused[second]:
            return False
        self.answers += 1
        if self.answers > HELD:
            self.allowed, self.refused, self.answers = self._unknown(), self._unknown(), 1
        apart = self.merged(self.tokens[first] + self.tokens[second]) == [first, second]
        (self.allowed if apart else self.refused)[second].add(first)
        return apart

    def _unknown(self) -> dict[int, set[int]]:
        return {rank: set() for rank in self.tokens}

    def extend(self, last: list[int], data: bytes, margin: int = 0) -> None:
        """Lengthen a table of last tokens over ``data``, whose first byte is number ``margin`` of the piece."""
        allowed, follows = self.allowed, self.follows
        done = len(last)  # the first prefix without its token
        stop = margin + len(data)
        last += [NONE] * (stop + 1 - done)
        first = margin + 1
        for end, (length, rank) in self._automaton.iter(data.decode("latin-1")):
            here = end + first
            if here < done:
                continue
            if here != length:
                if here < length:
                    continue
                before = last[here - length]
                if before not in allowed[rank] and not follows(before, rank):
                    allowed = self.allowed
                    continue
            last[here] = rank
            if here > done:
                break  # no token ends at the place before
            done = here + 1
        if done <= stop:
            raise ValueError("the vocabulary lacks a token for one of the bytes")

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of a table, from the last one back."""
        found, place, lengths = [], len(last) - 1, self.lengths
        while place:
            rank = last[place]
            found.append(rank)
            place -= lengths[rank]
        found.reverse()
        return found


class Prefixes:
    """A piece of text and the last token of each of its byte prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last = [NONE]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Encode more bytes; the prefixes so far keep their tokens."""
        self.data += data
        self._extend(len(self.data))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in the place of bytes start to stop; the number of prefixes that were computed again."""
        old, shift = self.last[stop:], len(data) - (stop - start)
        self.data[start:stop] = data
        del self.last[start + 1 :]
        first, agreed, step = start + len(data), 0, max(64, self.vocabulary.longest)
        while len(self.last) <= len(self.data):
            done = len(self.last)
            self._extend(min(len(self.data), done + step - 1))
            for place in range(max(done, first), len(self.last)):
                agreed = agreed + 1 if self.last[place] == old[place - first] else 0
                if agreed > self.vocabulary.longest:
                    # later tokens depend on no earlier prefix than these
                    del self.last[place + 1 :]
                    self.last += old[place + 1 - first :]
                    return place - start
        return len(self.data) - start

    def _extend(self, stop: int) -> None:
        """The tokens of the prefixes up to ``stop`` bytes."""
        begin = len(self.last) - 1
        margin = max(0, begin - self.vocabulary.longest)
        self.vocabulary.extend(self.last, bytes(self.data[margin:stop]), margin)

    def ids(self) -> list[int]:
        """The encoding of the whole piece. A piece that is a token is that token."""
        whole = self.vocabulary.ranks.get(bytes(self.data)) if len(self.data) <= self.vocabulary.longest else None
        return self.vocabulary.walk(self.last) if whole is None else [whole]


class Pieces:
    """Cuts texts into the matches of a pattern.

    The pattern has to match every character, and a match may depend on ``LOOK`` characters behind it.
    """

    LOOK = 3

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)

    def spans(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        return (match.span() for match in self.pattern.finditer(text, start))

    def batches(self, text: str, width: int = WINDOW) -> Iterator[list[str]]:
        """The pieces in order, in lists of about ``width`` characters."""
        start = 0
        while start < len(text):
            stop = min(len(text), start + width)
            found = self.pattern.findall(text[start:stop])
            ends = sum(map(len, found))
            if ends != stop - start:
                raise ValueError("the pattern leaves characters out")
            while stop < len(text) and found and start + ends + self.LOOK > stop:
                ends -= len(found.pop())
            if not found:
                width *= 2  # one piece fills the window
                continue
            yield found
            start += ends


class EditableText:
    """A text with its encoding, which changes of the text update near the change only."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.vocabulary, self.cutter = vocabulary, Pieces(pattern)
        self.text = text
        self.spans = list(self.cutter.spans(text))
        self.tables = [Prefixes(vocabulary, text[a:b].encode()) for a, b in self.spans]

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, text: str) -> None:
        """Put ``text`` in the place of characters start to stop."""
        shift = len(text) - (stop - start)
        self.text = self.text[:start] + text + self.text[stop:]
        kept = sum(1 for _ in self._before(start))
        old = {a + shift: i for i, (a, _) in enumerate(self.spans) if i >= kept and a >= stop}
        spans, tables, rest = self.spans[:kept], self.tables[:kept], len(self.spans)
        for a, b in self.cutter.spans(self.text, spans[-1][1] if spans else 0):
            if a in old:
                rest = old[a]
                break
            data = self.text[a:b].encode()
            changed = len(spans) == kept < len(self.spans) and self.spans[kept][0] == a < stop
            tables.append(self._edited(kept, data) if changed else Prefixes(self.vocabulary, data))
            spans.append((a, b))
        self.spans = spans + [(a + shift, b + shift) for a, b in self.spans[rest:]]
        self.tables = tables + self.tables[rest:]

    def _before(self, start: int) -> Iterator[int]:
        for i, (_, b) in enumerate(self.spans):
            if b + Pieces.LOOK > start:
                return
            yield i

    def _edited(self, i: int, data: bytes) -> Prefixes:
        """The table of the old piece i, changed where the new piece differs from it."""
        table = self.tables[i]
        was = bytes(table.data)
        head = _common(was, data)
        tail = _common(was[head:][::-1], data[head:][::-1])
        table.replace(head, len(was) - tail, data[head : len(data) - tail])
        return table

    def ids(self) -> list[int]:
        return [rank for table in self.tables for rank in table.ids()]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    same = np.frombuffer(a, np.uint8, n) == np.frombuffer(b, np.uint8, n)
    return n if same.all() else int(same.argmin())


class Encoder(dict):
    """The ids of pieces as bytes. Short ones are remembered; those not seen for a while are forgotten first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.vocabulary, self.cutter, self.older = Vocabulary(ranks), Pieces(pattern), {}
        self.packed = {rank: rank.to_bytes(ID.itemsize, "little") for rank in ranks.values()}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            data, words = piece.encode(), self.vocabulary
            whole = words.ranks.get(data) if len(data) <= words.longest else None
            if whole is None:
                last = [NONE]
                words.extend(last, data)
                found = b"".join(map(self.packed.__getitem__, words.walk(last)))
            else:
                found = self.packed[whole]
        if len(piece) <= SHORT:
            if len(self) >= HELD // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        # a getter of two or more pieces returns a tuple
        return b"".join(b"".join(itemgetter("", *pieces)(self)) for pieces in self.cutter.batches(text))


_WORKER: dict[str, tuple[object, Encoder]] = {}


def _encoder(held: Broadcast, pattern: str) -> Encoder:
    """One encoder per worker process, whichever tasks it runs."""
    ranks = held.value
    known = _WORKER.get(pattern)
    if known is None or known[0] != ranks:
        known = _WORKER[pattern] = (ranks, Encoder(ranks, pattern))
    return known[1]


def _sent(batch: pa.RecordBatch, values: list[bytes | None], name: str) -> Iterator[pa.RecordBatch]:
    """The batch with a binary column more, in pieces that Arrow can address."""
    sizes = list(accumulate(len(v or b"") for v in values))
    start = 0
    while start < len(values):
        before = sizes[start - 1] if start else 0
        stop = start + 1
        while stop < len(values) and sizes[stop] - before <= ARROW_BYTES:
            stop += 1
        part = batch.slice(start, stop - start)
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values[start:stop], pa.binary())], names=[*part.schema.names, name])
        start = stop


def _default(vocabulary: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns but the text, and the ids of the whole text in a binary column ``ids``.

    An id takes four bytes, the lowest first. A missing text counts as empty; an empty text has no id.
    Text that looks like a special token is ordinary text. Texts are cut into pieces window by window
    and pieces are encoded byte by byte, so the length of neither is limited but by what a binary value
    may hold (2 GB, half a billion ids). Every row stands for itself, so repeated rows and ids do not
    matter. A column that is called like the result is replaced. The vocabulary is read on the driver
    and broadcast; its size does not depend on the data.
    """
    path, pattern = _default(vocabulary, pattern)
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    place = fresh(docs, "__text")
    rows = spread(docs.drop(ids) if ids != text else docs).select(*[F.col(f"`{c}`") for c in docs.columns if c not in (text, ids)], F.col(text).alias(place))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(held, pattern)
        for batch in batches:
            found = [coder.encode(value.as_py() or "") for value in batch.column(batch.num_columns - 1)]
            kept = batch.select(range(batch.num_columns - 1))
            if batch.num_columns == 1:
                kept = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows)], names=["__row"])
            yield from _sent(kept, found, ids) if batch.num_columns > 1 else (b.select([1]) for b in _sent(kept, found, ids))

    return rows.mapInArrow(work, StructType([*rows.drop(place).schema.fields, StructField(ids, BinaryType())]))


def decode(rows: DataFrame, ids: str = "ids", data: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """All columns and the bytes of the ids in a binary column ``data``.

    Missing ids give missing bytes, no ids no bytes; an id outside the vocabulary and a number of bytes
    that is no multiple of four are errors. A column that is called like the result is replaced.
    """
    path, _ = _default(vocabulary, "")
    held = rows.sparkSession.sparkContext.broadcast(read_ranks(path))
    rows = rows.drop(data)
    at = rows.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held.value
        tokens = np.full(max(ranks.values(), default=-1) + 1, None, object)
        for token, rank in ranks.items():
            tokens[rank] = token
        for batch in batches:
            found = []
            for value in batch.column(at):
                known = value.as_py()
                found.append(None if known is None else b"".join(tokens[np.frombuffer(known, ID)].tolist()))
            yield from _sent(batch, found, data)

    return rows.mapInArrow(work, StructType([*rows.schema.fields, StructField(data, BinaryType())]))


def op13_byte_pairs(spark, folder: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    docs = documents(spark, folder).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return decode(encode(docs)).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
