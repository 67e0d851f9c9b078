"""Whitening of embeddings by spectral divide and conquer.

Exact sums over all vectors give the covariance. Its eigenvectors come from polar decompositions:
the polar factor of the shifted covariance, computed by dynamically weighted Halley iterations, is
+1 on the part of the space above the shift and -1 below, so it yields the projectors on two
invariant subspaces, which are divided in the same way until they have one dimension. Then the
components are broadcast and every vector is projected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtables.session import spread

LARGEST = 4096  # dimensions; the covariance has their square in numbers, on the driver
SCALE, OFFSET = 64, 1_000_000
FAR = 2.0**61  # magnitude at which scaled entries stop
EPS = np.finfo(float).eps
LONG = 2**63


# Spectral divide and conquer


def polar_factor(a: np.ndarray, least: float = 1e-16) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR- and Cholesky-based Halley steps.

    least bounds the smallest singular value relative to the norm; smaller ones may not get to 1.
    """
    n = len(a)
    x = a / np.linalg.norm(a)
    low, unit = least, np.eye(n)
    for _ in range(40):
        spread_ = (4 * (1 - low**2) / low**4) ** (1 / 3)
        root = math.sqrt(1 + spread_)
        wa = root + math.sqrt(8 - 4 * spread_ + 8 * (2 - low**2) / (low**2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, unit]))
            new = wb / wc * x + (wa - wb / wc) / math.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            factor = np.linalg.cholesky(unit + wc * (x.T @ x))
            solved = np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
            new = wb / wc * x + (wa - wb / wc) * solved
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved = np.linalg.norm(new - x)
        x = (new + new.T) / 2
        if moved < EPS ** (1 / 3) and 1 - low < 4 * EPS:
            break
    return x


def _divide(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k vectors span the part of the space above some shift, and k."""
    n = len(a)
    diagonal = np.sort(np.diag(a))
    middle, mean = float(np.median(diagonal)), float(np.trace(a)) / n
    width = np.linalg.norm(a - mean * np.eye(n)) / math.sqrt(n)  # standard deviation of the eigenvalues
    rng = np.random.default_rng(n)
    for shift in [middle, mean, *(mean + t * width for t in (0.11, -0.13, 0.29, -0.31, 0.53, -0.59))]:
        moved = a - shift * np.eye(n)
        if not np.linalg.norm(moved):
            continue
        above = (polar_factor(moved) + np.eye(n)) / 2
        k = int(round(float(np.trace(above))))
        if not 0 < k < n or np.linalg.norm(above @ above - above) > 1e-10 * math.sqrt(n):
            continue  # an eigenvalue lies on the shift, or all on one side of it
        first, _ = np.linalg.qr(above @ rng.standard_normal((n, k)))
        first, _ = np.linalg.qr(above @ first)
        second = rng.standard_normal((n, n - k))
        second -= above @ second
        basis, _ = np.linalg.qr(np.hstack([first, second]))
        return basis, k
    return None


def spectral(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix in falling order, and unit eigenvectors as columns.

    A vector's largest entry in magnitude (the first of equals) is positive.
    """
    n, norm = len(a), np.linalg.norm(a)
    values, vectors = np.zeros(n), np.eye(n)
    open_blocks = [(0, (a + a.T) / 2, np.eye(n))]
    while open_blocks:
        at, block, basis = open_blocks.pop()
        size = len(block)
        apart = np.linalg.norm(block - np.diag(np.diag(block)))
        found = _divide(block) if size > 1 and apart > EPS * norm else None
        if found is None:
            if apart > 1e3 * EPS * norm:
                raise ArithmeticError("a block of the covariance could not be divided")
            values[at : at + size], vectors[:, at : at + size] = np.diag(block), basis
            continue
        turn, k = found
        turned = turn.T @ block @ turn
        for low, high in ((0, k), (k, size)):
            part = turned[low:high, low:high]
            open_blocks.append((at + low, (part + part.T) / 2, basis @ turn[:, low:high]))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)  # the norms of the vectors are 1 to rounding
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    heads = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[heads, np.arange(n)] < 0, -1.0, 1.0)


# Vectors of a table


def _vectors(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows have a whole vector (of the given size), and their entries, scaled, by size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array(column.value_lengths().fill_null(-1), np.int64)
    flat = column.flatten()
    entries = flat.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    usable = lengths > 0 if size is None else lengths == size
    fine = np.isfinite(entries)
    if not fine.all():
        broken = np.concatenate([[0], np.cumsum(~fine)])
        usable &= broken[ends] == broken[ends - np.maximum(lengths, 0)]
    groups = []
    for length in [size] if size is not None else np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == length))
        if len(rows):
            places = (ends[rows] - length)[:, None] + np.arange(length)
            scaled = np.floor(SCALE * entries[places])
            groups.append(np.clip(scaled, -FAR, FAR).astype(np.int64) + OFFSET)
    return usable, groups


def _total(values: np.ndarray) -> list[int]:
    """Exact column sums of integers, whatever their size."""
    high, low = values >> 32, values & 0xFFFFFFFF
    return [int(h) * 2**32 + int(m) for h, m in zip(high.sum(axis=0), low.sum(axis=0))]


@dataclass(frozen=True)
class Whitening:
    """What is known of a table's vectors: exact sums, covariance, components."""

    n: int
    sums: list[int]
    reach: list[int]  # per dimension, the largest distance from the pivot
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def pivots(self) -> list[int]:
        return [s // self.n for s in self.sums]

    @property
    def rank(self) -> int:
        """Components with variance: eigenvalues beyond rounding."""
        return int((self.values > len(self.values) * EPS * max(self.values[0], 0)).sum()) if len(self.values) else 0

    def explained(self) -> list[float | None]:
        total = float(np.trace(self.covariance)) if self.n else 0.0
        return [float(v) / total if total else None for v in self.values]

    def map(self, count: int) -> np.ndarray:
        """Columns that take a centred vector to its first whitened components."""
        k = min(count, self.rank)
        return self.vectors[:, :k] / np.sqrt(self.values[:k])


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - S/n in doubles, through an integer pivot, so that nothing cancels."""
    pivots = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - pivots).astype(np.float64) - rest


def _moments(rows: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """Number, sums, least and largest entries of the vectors of the most frequent size (the larger of equals)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for x in _vectors(batch.column(0))[1]:
                old = held.setdefault(x.shape[1], [0, [0] * x.shape[1], x.min(axis=0), x.max(axis=0)])
                old[0] += len(x)
                old[1] = [a + b for a, b in zip(old[1], _total(x))]
                old[2], old[3] = np.minimum(old[2], x.min(axis=0)), np.maximum(old[3], x.max(axis=0))
        for size, (count, sums, low, high) in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([size] * size, pa.int64()),
                    pa.array(range(size), pa.int64()),
                    pa.array([count] * size, pa.int64()),
                    pa.array(list(map(Decimal, sums)), pa.decimal128(38, 0)),
                    pa.array(low, pa.int64()),
                    pa.array(high, pa.int64()),
                ],
                names=["size", "dim", "n", "total", "low", "high"],
            )

    parts = rows.mapInArrow(add, "size long, dim long, n long, total decimal(38,0), low long, high long")
    by_dim = parts.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    first = by_dim.orderBy(F.desc("n"), F.desc("size"), "dim").limit(LARGEST).collect()
    if not first:
        return 0, [], [], []
    size = first[0]["size"]
    if size > LARGEST:
        raise ValueError(f"vectors have {size} entries, at most {LARGEST} are possible")
    mine = [r for r in first if r["size"] == size]
    return mine[0]["n"], [int(r["total"]) for r in mine], [r["low"] for r in mine], [r["high"] for r in mine]


def _products(rows: DataFrame, size: int, centre, width: int | None = None) -> np.ndarray:
    """Sum over all vectors of the outer product of ``centre(x)`` with itself, added up in the cluster."""
    width = width or size

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for x in _vectors(batch.column(0), size)[1]:
                y = centre(x)
                total += y.T @ y
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i * width + j, pa.int64()), pa.array(total[i, j])], names=["cell", "part"])

    parts = rows.mapInArrow(add, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part"))
    found = np.zeros(width * width)
    for row in parts.collect():  # at most the square of the dimensions, which are bounded
        found[row["cell"]] = row["part"]
    found = found.reshape(width, width)
    return np.triu(found) + np.triu(found, 1).T


def fit(table: DataFrame, vector: str = "embedding") -> Whitening:
    """Moments and components of all whole vectors of the most frequent size.

    Centred products are summed as doubles of integers about a pivot, which is exact up to 2^53.
    """
    rows = spread(table.select(F.col(vector).alias("vector")))
    n, sums, low, high = _moments(rows)
    if not n:
        return Whitening(0, [], [], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    pivots = np.array([s // n for s in sums], np.int64)
    reach = [max(int(h) - int(p), int(p) - int(a)) for a, h, p in zip(low, high, pivots)]
    rest = np.array([(s % n) / n for s in sums])
    products = _products(rows, len(sums), lambda x: (x - pivots).astype(np.float64))
    covariance = products / n - np.outer(rest, rest)
    values, vectors = spectral(covariance)
    return Whitening(n, sums, reach, covariance, values, vectors)


def identity_error(table: DataFrame, model: Whitening, count: int, vector: str = "embedding") -> float | None:
    """The largest entry, in magnitude, of the covariance of the whitened rows less the identity; null without variance."""
    if not model.n or not min(count, model.rank):
        return None
    turn, sums, n = model.map(count), model.sums, model.n
    rows = spread(table.select(F.col(vector).alias("vector")))
    seen = _products(rows, len(sums), lambda x: _centred(x, sums, n) @ turn, turn.shape[1])
    return float(np.abs(seen / n - np.eye(turn.shape[1])).max())


def whiten(table: DataFrame, model: Whitening, count: int = 32, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, deviation, whitened) of every row whose vector has the model's size and no null or non-finite entry.

    whitened has the first ``count`` components, or all if there are fewer dimensions; a component
    without variance (an eigenvalue that is zero to rounding) is null. deviation is null where it
    does not fit a long. Null and repeated keys are rows like others. Entries stop at 2^61 / 64.
    """
    size = len(model.sums)
    shown = min(count, size)
    schema = "vec_id long, deviation long, whitened array<double>"
    if not model.n:
        return table.sparkSession.createDataFrame([], schema)
    turn = table.sparkSession.sparkContext.broadcast(model.map(count))
    n, sums, pivots = model.n, model.sums, np.array(model.pivots, np.int64)
    shift = [s - n * int(p) for s, p in zip(sums, pivots)]
    small = sum((n * r + s) ** 2 for r, s in zip(model.reach, shift)) < LONG

    def deviations(x: np.ndarray) -> list[int | None] | np.ndarray:
        if small:
            return ((n * (x - pivots) - np.array(shift, np.int64)) ** 2).sum(axis=1)
        far = n * (x - pivots).astype(object) - np.array(shift, object)
        return [d if d < LONG else None for d in (far * far).sum(axis=1).tolist()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, groups = _vectors(batch.column(1), size)
            for x in groups:
                y = np.full((len(x), shown), np.nan)
                y[:, : turn.value.shape[1]] = _centred(x, sums, n) @ turn.value
                flat = pa.array(y.ravel(), from_pandas=True)  # no variance: null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * shown, pa.int32()), flat)
                keys = batch.column(0).filter(pa.array(usable))
                yield pa.RecordBatch.from_arrays([keys, pa.array(deviations(x), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    rows = spread(table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")))
    return rows.mapInArrow(work, schema)


def op11_whitening(spark, folder: str) -> DataFrame:
    """All embeddings, whitened: one row per vector and component."""
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    model = fit(table)
    error = identity_error(table, model, 32)
    shares = F.lit([s if s is not None else math.nan for s in model.explained()[:32]] or [0.0])
    return whiten(table, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.nanvl(F.get(shares, "place"), F.lit(None)).cast("double").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
