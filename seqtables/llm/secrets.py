"""Secrets in texts: patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are tagged begin, inside or outside of a secret from their shape, the words next to them and
features of the file. The field is fitted on windows around pattern matches in a bounded sample.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtables.llm.common import documents

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: Every match of ASSIGN has one of these in lower case; looking for them first is far cheaper.
NAMES = ("passw", "secret", "token", "api")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LONG_HEX = re.compile("[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}

TOKEN = re.compile("[A-Za-z0-9+/_.=-]+|[^\\x20\\x09-\\x0DA-Za-z0-9+/_.=-]+")
OUT, BEGIN, IN = 0, 1, 2
SAMPLE = 300  # documents with and as many without a match that the field is fitted on, the first by a hash of the id
WINDOWS = 8  # windows taken from one of them
SIDE = 8  # tokens on either side of a window's middle
STEPS = 60  # of the fit
DECAY = 1e-3
SHORTEST = 12  # characters of a span that the field may add
CACHE = 200_000  # distinct tokens whose scores a task keeps


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the pattern matches that are long enough, in order."""
    lower = text.lower()
    named = ASSIGN.finditer(text) if any(word in lower for word in NAMES) else ()
    found = [(m.start(), 0, m.end(), m.start(2)) for m in named if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), m.start()) for m in LONG_HEX.finditer(text)]  # maximal runs, as HEX finds them
    return sorted(found)


def _entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def shape_features(token: str) -> list[str]:
    """What a token looks like; letters-only tokens differ by length and case alone."""
    size = min(len(token), 40) // 4
    if token.isalpha():
        return [f"alpha={size}{'l' if token.islower() else 'm'}"]
    digits, uppers, lowers = (sum(map(f, token)) for f in (str.isdigit, str.isupper, str.islower))
    kinds = "".join(k for k, n in zip("dul", (digits, uppers, lowers)) if n)
    rest = len(token) - digits - uppers - lowers
    return [
        f"kinds={kinds}{'o' if rest else ''}",
        f"size={size}",
        f"kinds+size={kinds}{size}",
        f"entropy={int(_entropy(token))}",
        f"digits={4 * digits // len(token)}",
        f"hex={all(c in '0123456789abcdefABCDEF' for c in token)}",
    ]


def word_feature(token: str) -> str:
    """A neighbour's identity; long tokens only by shape."""
    return f"w={token.lower()}" if len(token) <= 16 else f"s={shape_features(token)[0]}"


def file_features(text: str, facts: tuple) -> list[str]:
    """Features of the file: its labels, size, and how much of it is not words."""
    marks = sum(text.count(c) for c in "=:{}<>#$&%*|")
    return [*(f"file{i}={x}" for i, x in enumerate(facts)), f"length={len(text).bit_length()}", f"marks={min(9, 100 * marks // max(1, len(text)))}"]


PLACES = ((0, "here"), (-1, "before"), (-2, "before2"), (1, "after"))


@dataclass
class Field:
    """weights: of each feature for each tag; moves[x, y]: from tag x to tag y."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray

    def score(self, names: list[str]) -> np.ndarray:
        found = [self.weights[n] for n in names if n in self.weights]
        return np.sum(found, axis=0) if found else np.zeros(3)


def _names(tokens: list[str], i: int) -> list[str]:
    out = [f"here:{f}" for f in shape_features(tokens[i])]
    for step, place in PLACES:
        j = i + step
        out.append(f"{place}:{word_feature(tokens[j]) if 0 <= j < len(tokens) else 'none'}")
    return out


def fit(windows: list[tuple[list[str], list[int], list[str]]]) -> Field:
    """The field with the largest penalised likelihood: (tokens, tags, file features) by full-batch ascent."""
    moves = np.zeros((3, 3))
    moves[OUT, IN] = -4.0
    if not windows:
        return Field({}, moves)
    place: dict[str, int] = {}
    width = max(len(tokens) for tokens, _, _ in windows)
    rows, cols, feats = [], [], []
    tags = np.zeros((len(windows), width), int)
    inside = np.zeros((len(windows), width), bool)
    for n, (tokens, labels, file) in enumerate(windows):
        for i in range(len(tokens)):
            for name in (*_names(tokens, i), *(f"file:{f}" for f in file)):
                rows.append(n)
                cols.append(i)
                feats.append(place.setdefault(name, len(place)))
        tags[n, : len(labels)], inside[n, : len(labels)] = labels, True
    at, feats = np.array(rows) * width + np.array(cols), np.array(feats)
    flat = lambda values: np.stack([np.bincount(at, values[feats, k], len(windows) * width) for k in range(3)], 1)
    weights = np.zeros((len(place), 3))
    target = np.eye(3)[tags] * inside[..., None]
    pairs = inside[:, 1:, None, None] * target[:, :-1, :, None] * target[:, 1:, None, :]
    moments = [np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, STEPS + 1):
        emit = flat(weights).reshape(len(windows), width, 3)
        marginal, joint = _expected(emit, moves, inside)
        gap = (target - marginal).reshape(-1, 3)
        grad = np.stack([np.bincount(feats, gap[at, k], len(place)) for k in range(3)], 1) / len(windows) - DECAY * weights
        turn = (pairs - joint).sum(axis=(0, 1)) / len(windows) - DECAY * moves
        for i, g in enumerate((grad, turn)):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 2] = 0.99 * moments[i + 2] + 0.01 * g * g
        rate = [0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) for m, v in zip(moments[:2], moments[2:])]
        weights, moves = weights + rate[0], moves + rate[1]
    return Field({name: weights[i] for name, i in place.items()}, moves)


def _expected(emit: np.ndarray, moves: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected tags and moves by the forward and backward recursions, in log space, for all windows at once."""
    n, width, _ = emit.shape
    ahead, back = np.zeros_like(emit), np.zeros_like(emit)
    ahead[:, 0] = emit[:, 0]
    for i in range(1, width):
        new = np.logaddexp.reduce(ahead[:, i - 1, :, None] + moves, axis=1) + emit[:, i]
        ahead[:, i] = np.where(inside[:, i, None], new, ahead[:, i - 1])
    for i in range(width - 2, -1, -1):
        new = np.logaddexp.reduce(moves + (emit[:, i + 1] + back[:, i + 1])[:, None, :], axis=2)
        back[:, i] = np.where(inside[:, i + 1, None], new, 0.0)
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)
    marginal = np.exp(ahead + back - total[:, None, None]) * inside[..., None]
    joint = ahead[:, :-1, :, None] + moves + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
    return marginal, np.exp(np.minimum(joint, 0.0)) * inside[:, 1:, None, None]


def _tagged(text: str) -> tuple[list[str], list[int], list[int]]:
    """Tokens, the tags that the pattern matches give them, and the places of the matches."""
    spans = sorted((value, end) for _, _, end, value in base_spans(text))
    tokens, tags, places = [], [], []
    held, low = None, 0
    for m in TOKEN.finditer(text):
        while low < len(spans) and spans[low][1] <= m.start():
            low += 1  # ended before this token, and so before all later ones
        held = next((k for k in range(low, min(len(spans), low + 3)) if spans[k][0] < m.end() and spans[k][1] > m.start()), None)
        if held is None:
            tags.append(OUT)
        else:
            tags.append(IN if tags and tags[-1] != OUT and m.start() > spans[held][0] else BEGIN)
            places.append(len(tokens))
        tokens.append(m.group())
    return tokens, tags, places


def training_windows(docs: DataFrame, text: str, key: str, facts: tuple[str, ...], sample: int = SAMPLE):
    """At most WINDOWS windows from each of at most 2 * ``sample`` documents."""
    value, lower = F.col(text), F.lower(text)
    named = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(word)) for word in NAMES])
    access = F.contains(value, F.lit("AKIA")) & value.rlike("AKIA[A-Z0-9]{14}")
    pattern = (named & value.rlike(ASSIGN.pattern)) | access | value.rlike("[0-9a-f]{16}")
    told = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"fact{i}") for i, f in enumerate(facts)]
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.xxhash64(key).alias("turn"), pattern.alias("match"), *told)
    chosen = rows.where("match").orderBy("turn").limit(sample).union(rows.where("not match").orderBy("turn").limit(sample))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                tokens, tags, places = _tagged(row["text"])
                file = file_features(row["text"], tuple(row[f"fact{i}"] for i in range(len(facts))))
                middles = (places or list(range(SIDE, len(tokens), max(1, len(tokens) // WINDOWS))))[:WINDOWS]
                for middle in middles or [0]:
                    a, b = max(0, middle - SIDE), middle + SIDE + 1
                    if tokens:
                        out.append({"tokens": tokens[a:b], "tags": tags[a:b], "file": file})
            kind = pa.schema([("tokens", pa.list_(pa.string())), ("tags", pa.list_(pa.int64())), ("file", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    found = chosen.mapInArrow(cut_out, "tokens array<string>, tags array<bigint>, file array<string>").collect()
    return sorted((list(r.tokens), list(r.tags), list(r.file)) for r in found)


class Tagger:
    """Tags whole texts; scores of tokens are kept by token, so that each distinct one is looked at once."""

    def __init__(self, field: Field):
        self.field, self.known = field, {n.split("=", 1)[1] for n in field.weights if ":w=" in n}
        # a token whose best score is for OUT by more than this is OUT on every best path
        spread = float(field.moves.max() - field.moves.min())
        self.margin = 2 * spread
        self.shapes: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.shapes.clear()
        self.table, self.used = np.zeros((1024, len(PLACES), 3)), 0
        self._add(np.stack([self.field.score([f"{p}:none"]) for _, p in PLACES]))
        self.table[0, 0] = 0.0

    def _add(self, row: np.ndarray) -> int:
        """The place of a new row of scores; a full table doubles."""
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = row
        self.used += 1
        return self.used - 1

    def _id(self, token: str) -> int:
        word = token.lower()
        plain = token.isalpha() and len(token) <= 16 and word not in self.known
        name = shape_features(token)[0] if plain else ""
        if plain and name in self.shapes:
            self.ids[token] = self.shapes[name]
            return self.shapes[name]
        own = [f"here:{f}" for f in shape_features(token)]
        word = word_feature(token)
        place = self._add(np.stack([self.field.score([*(own if p == "here" else []), f"{p}:{word}"]) for _, p in PLACES]))
        self.ids[token] = place
        if plain:
            self.shapes[name] = place
        return place

    def tags(self, tokens: list[str], file: list[str]) -> np.ndarray:
        """The best tags of a text's tokens."""
        if len(self.ids) > CACHE:
            self._clear()
        get = self.ids.get
        at = np.array([get(t) or self._id(t) for t in tokens], np.int64)
        padded = np.concatenate(([0, 0], at, [0]))
        emit = self.table[at, 0] + self.table[padded[1:-2], 1] + self.table[padded[:-3], 2] + self.table[padded[3:], 3]
        emit += self.field.score([f"file:{f}" for f in file])
        open_ = np.flatnonzero(emit[:, OUT] - emit[:, 1:].max(axis=1) <= self.margin)
        tags = np.zeros(len(tokens), np.int8)
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            if len(run):
                tags[run] = self._viterbi(emit[run[0] : run[-1] + 1], run[0] > 0, run[-1] + 1 < len(tokens))
        return tags

    def _viterbi(self, emit: np.ndarray, after_out: bool, before_out: bool) -> list[int]:
        moves = self.field.moves.tolist()
        best = [e + (moves[OUT][k] if after_out else 0.0) for k, e in enumerate(emit[0].tolist())]
        came = []
        for row in emit[1:].tolist():
            step = [max(range(3), key=lambda j, k=k: best[j] + moves[j][k]) for k in range(3)]
            best = [best[j] + moves[j][k] + row[k] for k, j in enumerate(step)]
            came.append(step)
        if before_out:
            best = [b + moves[k][OUT] for k, b in enumerate(best)]
        path = [max(range(3), key=best.__getitem__)]
        for step in reversed(came):
            path.append(step[path[-1]])
        return path[::-1]


def field_spans(text: str, tokens: list[str], tags: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of tagged runs in the text."""
    if not tags.any():
        return []
    spans: list[list[int]] = []
    last = -2
    places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    for i in np.flatnonzero(tags).tolist():
        if tags[i] == IN and last == i - 1:
            spans[-1][1] = places[i][1]
        else:
            spans.append(list(places[i]))
        last = i
    return [(a, b) for a, b in spans]


def apart(spans: list[tuple[int, int]], base: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int]]:
    """The spans that touch no pattern match; both lists are walked in step."""
    at, reach = 0, -1  # reach: the furthest end of the matches that start before the span's end
    for a, b in spans:
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= a:
            yield a, b


def find_secrets(docs: DataFrame, field: Field, text: str = "text", doc_id: str = "doc_id", facts: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per document: its pattern matches and all spans.

    spans are kind:start:end in code points, end exclusive, ordered by start, then kind (assign,
    access, hex, crf). The field's spans have SHORTEST characters or more and do not touch a
    pattern match. A missing text is empty; a text without secrets has empty lists. The table
    may lack the columns of ``facts``, which then say nothing.
    """
    named = [F.coalesce(F.col(f).cast("string"), F.lit("")) if f in docs.columns else F.lit("") for f in facts]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[c.alias(f"fact{i}") for i, c in enumerate(named)])
    shared = docs.sparkSession.sparkContext.broadcast(field)
    types = [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_crf", pa.int64())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                whole = row[1] or ""
                base = base_spans(whole)
                tokens = TOKEN.findall(whole)
                spans = [(s, k, e) for s, k, e, _ in base]
                if tokens:
                    tags = tagger.tags(tokens, file_features(whole, row[2:]))
                    spans += [(a, 3, b) for a, b in apart(field_spans(whole, tokens, tags), base) if b - a >= SHORTEST]
                counts = Counter(k for _, k, _, _ in base)
                told = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(x)) for x in ([y[:3] for y in base], spans)]
                out.append((row[0], counts[0], counts[1], counts[2], hashlib.sha256(told[0].encode()).hexdigest(), told[1], len(spans) - len(base)))
            columns = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], names=[n for n, _ in types])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"
    return rows.mapInArrow(scan, schema)


def op2_secrets(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    facts = ("lang", "source")
    field = fit(training_windows(docs, "text", "doc_id", facts))
    return find_secrets(docs, field, facts=facts)
