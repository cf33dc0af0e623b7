"""Embedding whitening from an exact covariance by polarisation.

A vector's entries become whole numbers x = floor(scale * c) + shift. With n vectors and sums S, y = n * x - S is the centred
vector times n, exact. Tasks sum y_i^2 for every dimension and (y_i + y_j)^2 for every pair of dimensions; as
(y_i + y_j)^2 - y_i^2 - y_j^2 = 2 y_i y_j, differences of these sums are the cross-covariances, times 2 n^3, without
any rounding. The driver assembles them (dimensions squared numbers, whatever the table's size) and takes ``eigh``.

Four passes read the table: sums; squares; the covariance of the whitened values, for ``identity_error``; the values. Sums are kept in
Python's integers per task and added as decimals by Spark; squares are summed in 64 bits where that is safe by the
largest entry of a block, else in parts of 21 bits, else in Python's integers.

Defined cases: rows whose vector is NULL or holds NULL, NaN or an infinity are left out; shorter vectors, empty ones too, count as padded
with zeros; repeated rows and ids count each; no vectors give no rows; a component without variance (at most the rounding error of
the largest) has ``whitened`` 0 and is left out of ``identity_error``; an entry with abs(scale * c) of 2^40 or more is an error.
Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
LARGEST = 2.0 ** 40
EXACT = pa.decimal128(38, 0)


def whole_vectors(batch: pa.RecordBatch, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the batch that take part, their vectors padded to the longest, and lengths. Column 1 holds the vectors."""
    column = batch.column(1)
    values = column.values
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # NULL becomes NaN
    wrong = np.append(0, np.cumsum(~np.isfinite(flat)))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(valid & (wrong[offsets[1:]] == wrong[offsets[:-1]]))
    begin, length = offsets[rows], offsets[rows + 1] - offsets[rows]
    out = np.full((len(rows), int(length.max(initial=0))), shift, np.int64)
    inside = np.arange(out.shape[1]) < length[:, None]
    scaled = np.floor(scale * flat[(begin[:, None] + np.arange(out.shape[1]))[inside]])
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError("an embedding's entry is too large for exact whitening")
    out[inside] = scaled.astype(np.int64) + shift
    return rows, out, length


def square_sums(z: np.ndarray) -> list[int]:
    """Exact sums of the squares of each column (whole numbers of 64 bits, or objects)."""
    if z.dtype == object:
        return [int(s) for s in (z * z).sum(axis=0)] if len(z) else [0] * z.shape[1]
    largest = int(np.abs(z).max(initial=0))
    if largest * largest * max(1, len(z)) < 2 ** 63:
        return np.einsum("ij,ij->j", z, z).tolist()
    limbs, rest = [], z
    for _ in range(2):
        limbs.append(rest & 0x1FFFFF)
        rest = rest >> 21
    limbs.append(rest)  # signed
    total = [0] * z.shape[1]
    for a in range(3):
        for b in range(a, 3):
            part = np.einsum("ij,ij->j", limbs[a], limbs[b]).tolist()
            total = [t + ((p << (21 * (a + b))) << (a != b)) for t, p in zip(total, part, strict=True)]
    return total


def centred(x: np.ndarray, n: int, sums: list[int], shift: int) -> np.ndarray:
    """n * x - S, padded to all dimensions; of Python's integers where 64 bits might not hold a sum of two of them."""
    wide = np.full((len(x), len(sums)), shift, np.int64)
    wide[:, :x.shape[1]] = x
    most = n * int(np.abs(wide).max(initial=0)) + max(map(abs, sums), default=0)
    kind = np.int64 if most < 2 ** 61 else object
    return wide.astype(kind) * n - np.array(sums, kind)


def _totals(table: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> dict[tuple[int, int], int]:
    """Exact sums by (i, j) of what the tasks give; as many as pairs of dimensions."""
    sums = table.mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    return {(r["i"], r["j"]): int(r["s"]) for r in sums.collect()}


def _exact_rows(found: dict[tuple[int, int], int]) -> pa.RecordBatch:
    keys = list(found)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([Decimal(found[k]) for k in keys], EXACT)],
        ["i", "j", "s"])


def covariance_sums(table: DataFrame, scale: float = 1024.0, shift: int = 100_000) -> tuple[int, list[int], list[list[int]]]:
    """n, the sum of each dimension, and for each two dimensions the sum of y_i * y_j (the covariance times n^3), all exact."""
    read = table.select("vec_id", "embedding")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (i, 0): sum of dimension i over vectors that have it; (i, 1): their number; (-1, 1): number of vectors
        found: dict[tuple[int, int], int] = {(-1, 1): 0}
        for batch in batches:
            rows, x, length = whole_vectors(batch, scale, shift)
            found[-1, 1] += len(rows)
            here = (x - shift).sum(axis=0).tolist()
            for i, s in enumerate(here):
                k = int((length > i).sum())
                found[i, 0] = found.get((i, 0), 0) + s + k * shift
                found[i, 1] = found.get((i, 1), 0) + k
        yield _exact_rows(found)

    totals = _totals(read, first)
    n = totals.get((-1, 1), 0)
    width = max((i for i, _ in totals), default=-1) + 1
    sums = [totals[i, 0] + (n - totals[i, 1]) * shift for i in range(width)]

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs = [0] * width, [[0] * (width - 1 - i) for i in range(width)]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                _, x, _ = whole_vectors(batch.slice(at, BLOCK), scale, shift)
                y = centred(x, n, sums, shift)
                own = [a + b for a, b in zip(own, square_sums(y), strict=True)]
                for i in range(width - 1):
                    pairs[i] = [a + b for a, b in zip(pairs[i], square_sums(y[:, i:i + 1] + y[:, i + 1:]), strict=True)]
        yield _exact_rows({(i, i): s for i, s in enumerate(own)} | {(i, i + 1 + k): s for i, row in enumerate(pairs) for k, s in enumerate(row)})

    squares = _totals(read, second) if n and width else {}
    cross = [[0] * width for _ in range(width)]
    for (i, j), s in squares.items():
        cross[i][j] = cross[j][i] = s if i == j else (s - squares[i, i] - squares[j, j]) // 2
    return n, sums, cross


def whitened(table: DataFrame, components: int = 8, scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """Per vector and component: vec_id, component (from 1), n, deviation (decimal, exact), whitened, explained, identity_error."""
    id_type = table.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    n, sums, cross = covariance_sums(table, scale, shift)
    width = len(sums)
    k = min(components, width)
    if not n or not k:
        return table.sparkSession.createDataFrame([], schema)
    cubed = n ** 3
    covariance = np.array([[c / cubed for c in row] for row in cross])  # each quotient rounded once
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = sum(cross[i][i] for i in range(width)) / cubed
    live = values[:k] > width * np.finfo(float).eps * max(values[0], 0.0)
    scaled = np.where(live, vectors[:, :k] / np.sqrt(np.where(live, values[:k], 1.0)), 0.0)
    explained = np.where(trace > 0, values[:k] / (trace or 1.0), 0.0)
    read = table.select("vec_id", "embedding")

    def projected(y: np.ndarray) -> np.ndarray:
        return (y / n).astype(np.float64) @ scaled

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, x, _ = whole_vectors(batch, scale, shift)
            w = projected(centred(x, n, sums, shift))
            total += w.sum(axis=0)
            squares += w.T @ w
        every = np.vstack([total, squares])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(-1, k), k).astype(np.int32)), pa.array(np.tile(np.arange(k), k + 1).astype(np.int32)), pa.array(every.ravel())],
            ["i", "j", "s"])

    moments = np.zeros((k + 1, k))
    for r in read.mapInArrow(check, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        moments[r["i"] + 1, r["j"]] = r["s"] / n
    apart = moments[1:] - np.outer(moments[0], moments[0]) - np.eye(k)
    error = float(np.abs(apart[np.ix_(live, live)]).max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows, x, _ = whole_vectors(part, scale, shift)
                y = centred(x, n, sums, shift)
                deviation = [Decimal(s) for s in square_sums(np.ascontiguousarray(y.T))]
                every = len(rows) * k
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1), len(rows)).astype(np.int32)),
                    pa.array(np.full(every, n, np.int64)), pa.array(deviation, EXACT).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    pa.array(projected(y).ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(every, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return read.mapInArrow(run, schema)
