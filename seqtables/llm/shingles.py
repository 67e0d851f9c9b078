"""Word and shingle hashes of whole texts, computed for many texts at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(7))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STEPS = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PIECE = 1 << 21  # bytes hashed at once
_SPLIT = re.compile(rb"[\x20\x09-\x0d]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word; A-Z count as a-z."""
    data = _FOLD[np.frombuffer(raw, np.uint8)]
    gap = _GAP[data]
    begins = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1]))) if len(data) else np.zeros(0, np.int64)
    if not len(begins):
        return np.zeros(0, np.uint64), begins
    ends = np.flatnonzero(~gap & np.concatenate((gap[1:], [True]))) + 1
    inside = np.flatnonzero(~gap)
    within = inside - np.repeat(begins, ends - begins)
    powers = np.cumprod(np.full(int(within.max()) + 1, _BASE, np.uint64), dtype=np.uint64)
    values = _BYTE[data[inside]] * powers[within]
    firsts = np.concatenate(([0], np.cumsum(ends - begins)[:-1]))
    return mixed(np.add.reduceat(values, firsts) + (ends - begins).astype(np.uint64)), begins


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text in pieces that end at a gap, so that a very long text needs little memory."""
    at = 0
    while at < len(raw):
        stop = at + PIECE
        if stop < len(raw):
            found = _SPLIT.search(raw, stop)
            stop = found.end() if found else len(raw)
        yield raw[at:stop]
        at = stop


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first text, hashes of the words of each text) for runs of texts; a missing text has none."""
    run, first, held = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > PIECE:
            if run:
                yield first, _hash_run(run)
            yield i, [np.concatenate([_hash_piece(piece)[0] for piece in _pieces(raw)])]
            run, first, held = [], i + 1, 0
            continue
        run.append(raw)
        held += len(raw)
        if held > PIECE:
            yield first, _hash_run(run)
            run, first, held = [], i + 1, 0
    if run:
        yield first, _hash_run(run)


def _hash_run(run: list[bytes]) -> list[np.ndarray]:
    hashes, begins = _hash_piece(b" ".join(run))
    starts = np.cumsum([0] + [len(raw) + 1 for raw in run])[1:-1]
    return np.split(hashes, np.searchsorted(begins, starts))


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of fewer words, the one of all of them."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = min(width, n)
    total = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        total += words[i : n - w + 1 + i] * _STEPS[i]
    return np.unique(mixed(total))


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """MinHash signatures, one row per non-empty set, ``count`` columns of 32 bits."""
    factors = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), count), np.uint32)
    sizes = np.array([len(s) for s in sets])
    at = 0
    while at < len(sets):  # runs that stay in the processor's cache
        stop = at + 1
        room = 1 << 15
        held = sizes[at]
        while stop < len(sets) and held + sizes[stop] <= room:
            held += sizes[stop]
            stop += 1
        flat = np.concatenate(sets[at:stop])
        firsts = np.concatenate(([0], np.cumsum(sizes[at:stop])[:-1]))
        for k in range(count):
            out[at:stop, k] = np.minimum.reduceat((flat * factors[k]) >> np.uint64(32), firsts)
        at = stop
    return out
