"""Embedding whitening by QDWH spectral divide-and-conquer.

The orthogonal polar factor of a covariance shifted by s maps directions with eigenvalues above s to themselves and the
others to their negatives, so (factor + identity) / 2 projects on the invariant subspace above s. Its range and the rest
split the matrix in two, and so on until single components are left. Polar factors come from dynamically weighted Halley
iterations, which need QR decompositions only.

Vectors stay distributed: tasks add up sums and products of centred vectors, of which one matrix with a side of the
dimension comes to the driver, and the components go back as a broadcast of as many rows. Vectors of different lengths are
whitened each among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardwatch.llm.common import stored, table

COMPONENTS = 4
SCALE = 256  # entries are taken as whole multiples of 1 / SCALE
LEAST = 1e-16  # singular value, as part of the norm, that the polar iteration counts on
SHIFTS = (0.0, 0.1, -0.1, 0.23, -0.23, 0.37, -0.37, 0.55, -0.55)  # from the mean eigenvalue, in standard deviations
EPS = np.finfo(float).eps
LIMB = 31  # bits of the lower part in exact sums


# --- components of one matrix ---------------------------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix."""
    x, low, unit = a / np.linalg.norm(a), LEAST, np.eye(len(a))
    for _ in range(30):  # 7 by theory
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        alpha = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, unit]))[0]
        y = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * q[: len(a)] @ q[len(a) :].T
        y = (y + y.T) / 2
        low = min(1.0, low * (alpha + beta * square) / (1 + gamma * square))
        moved, x = np.linalg.norm(y - x), y
        if moved <= 1e-5 and 1 - low <= 1e-5:  # the convergence is cubic
            break
    return x


def range_of(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthonormal basis of a projector's range: its columns, largest remainder first, made orthogonal."""
    rest, basis = projector.copy(), np.zeros((len(projector), rank))
    for k in range(rank):
        q = rest[:, np.argmax((rest * rest).sum(axis=0))]
        q = q - basis[:, :k] @ (basis[:, :k].T @ q)
        basis[:, k] = q / np.linalg.norm(q)
        rest = rest - np.outer(basis[:, k], basis[:, k] @ rest)
    return np.linalg.qr(projector @ basis)[0]


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; none if no shift tells them apart."""
    unit, mean = np.eye(len(a)), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * unit) / np.sqrt(len(a))
    for shift in SHIFTS:
        projector = (polar(a - (mean + shift * spread) * unit) + unit) / 2
        rank = int(round(np.trace(projector)))
        if 0 < rank < len(a) and np.linalg.norm(projector @ projector - projector) <= 1e-10 * len(a):
            whole = np.linalg.qr(np.hstack([range_of(projector, rank), range_of(unit - projector, len(a) - rank)]))[0]
            return whole[:, :rank], whole[:, rank:]
    return None


def leading(a: np.ndarray, count: int, scale: float) -> np.ndarray:
    """The first ``count`` components of a symmetric matrix, by falling eigenvalue, as columns."""
    off = np.linalg.norm(a - np.trace(a) / len(a) * np.eye(len(a)))
    halves = split(a) if len(a) > 1 and off > len(a) * EPS * scale else None
    if halves is None:  # one eigenvalue: any basis
        return np.eye(len(a))[:, :count]
    out = []
    for basis in halves:
        if count > 0:
            out.append(basis @ leading(basis.T @ a @ basis, count, scale))
            count -= out[-1].shape[1]
    return np.hstack(out)


class Components(NamedTuple):
    values: np.ndarray  # by falling eigenvalue
    axes: np.ndarray  # a column for each, the largest entry positive
    trace: float


def components_of(covariance: np.ndarray, count: int = COMPONENTS) -> Components:
    axes = leading(covariance, min(count, len(covariance)), np.linalg.norm(covariance))
    axes = np.linalg.qr(axes)[0]
    values = np.einsum("ij,ij->j", axes, covariance @ axes)
    order = np.argsort(-values, kind="stable")
    axes, values = axes[:, order], values[order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Components(values, axes, float(np.trace(covariance)))


# --- distributed sums -----------------------------------------------------------------------------------------------


class Fit(NamedTuple):
    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray
    scale: np.ndarray  # 1 / sqrt(eigenvalue); 0 where there is no variance
    explained: np.ndarray
    identity_error: float | None


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, x`` of the vectors without null or non-finite entries. Entries beyond a long are held at its ends."""
    good = vectors.where(usable(F.col("embedding")))
    return good.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long")).alias("x"))


def by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``size``, rows and matrix of the vectors of each length but 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        same = len(rows) == len(sizes)
        yield size, rows, flat.reshape(-1, size) if same else flat[starts[rows][:, None] + np.arange(size)]


def added(fit: DataFrame, part, kind: str) -> dict[int, np.ndarray]:
    """For each length of vector the sum over ``part(size, matrix)``, an array of any shape; tasks add up their own first."""
    number = pa.int64() if kind == "long" else pa.float64()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in by_size(batch.column("x")):
                more = part(size, x)
                sums[size] = sums[size] + more if size in sums else more
        for size, held in sums.items():
            flat = np.ravel(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), size), pa.int32()), pa.array(np.arange(len(flat))), pa.array(flat, number)], names=["size", "cell", "part"]
            )

    cells = fit.select("x").mapInArrow(over, f"size int, cell long, part {kind}")
    total = cells.groupBy("size", "cell").agg(F.sum("part").alias("part")).toArrow()
    out = {}
    for size in np.unique(total["size"].to_numpy()).tolist():
        rows = np.flatnonzero(total["size"].to_numpy() == size)
        values = np.zeros(len(rows), dtype=np.int64 if kind == "long" else float)
        values[total["cell"].to_numpy()[rows]] = total["part"].to_numpy()[rows]
        out[size] = values
    return out


def fitted(rows: DataFrame, count: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of vector, over the distinct vectors of ``rows(x)``. Four arrays of at most length² numbers come here."""
    fit = stored(rows.select("x").distinct(), "fit-list")
    limbs = added(fit, lambda size, x: np.concatenate([[len(x)], (x >> LIMB).sum(axis=0), (x & ((1 << LIMB) - 1)).sum(axis=0)]), "long")
    plain = {}
    for size, held in limbs.items():
        n, *parts = held.tolist()
        sums = [(high << LIMB) + low for high, low in zip(parts[:size], parts[size:])]
        plain[size] = n, sums, np.array([s / n for s in sums])

    def product(size: int, x: np.ndarray) -> np.ndarray:
        centred = x - plain[size][2]
        return centred.T @ centred

    out = {}
    for size, cells in added(fit, product, "double").items():
        n, sums, mean = plain[size]
        matrix = cells.reshape(size, size) / n
        found = components_of((matrix + matrix.T) / 2, count)
        real = found.values > size * EPS * max(found.trace, 0.0)
        scale = np.where(real, 1 / np.sqrt(np.where(real, found.values, 1)), 0)
        explained = found.values / found.trace if found.trace > 0 else np.full(len(real), np.nan)
        out[size] = Fit(n, sums, mean, found.axes, scale, explained, None)

    def moments(size: int, x: np.ndarray) -> np.ndarray:
        w = (x - out[size].mean) @ out[size].axes * out[size].scale
        return np.concatenate([w.sum(axis=0), np.ravel(w.T @ w)])

    for size, cells in added(fit, moments, "double").items():
        real, k = out[size].scale > 0, len(out[size].scale)
        mean = cells[:k] / out[size].n
        covariance = cells[k:].reshape(k, k) / out[size].n - np.outer(mean, mean)
        error = np.abs(covariance - np.eye(k))[np.ix_(real, real)]
        out[size] = out[size]._replace(identity_error=float(error.max()) if error.size else None)
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of (n x - S)² of each row, exactly; null where it does not fit a long."""
    most = n * max(int(x.max()), -int(x.min())) + max(map(abs, sums))
    if most * most * len(sums) < 1 << 63:
        off = x * n - np.array(sums, dtype=np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whitened(vectors: DataFrame, count: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector and component, of ``vectors(vec_id, embedding)``.

    Vectors that are null or hold null or non-finite entries are dropped, and empty ones have no components. The fit
    counts each distinct vector (after scaling and flooring) once, results come for every row, repeated ids and null ids included. A
    component without variance has a null ``whitened``; ``explained`` is null if no component has any, ``deviation`` where it exceeds a long.
    """
    rows = stored(whole_numbers(vectors, scale), "whole-numbers")
    fits = fitted(rows, count)
    shared = rows.sparkSession.sparkContext.broadcast(fits)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in by_size(batch.column("x")):
                fit = shared.value[size]
                k, m = len(fit.scale), len(at)
                scores = ((x - fit.mean) @ fit.axes * fit.scale).ravel()
                columns = [
                    batch.column("vec_id").take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(k * m, fit.n), pa.int64()),
                    pa.array(deviations(x, fit.n, fit.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(scores, pa.float64(), mask=np.tile(fit.scale == 0, m)),
                    pa.array(np.tile(fit.explained, m), pa.float64(), mask=np.tile(np.isnan(fit.explained), m)),
                    pa.array([fit.identity_error] * (k * m), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(
        over, f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(table(spark, folder, "embeddings"))
