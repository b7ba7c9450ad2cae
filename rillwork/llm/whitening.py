"""Whitening by matrix-free block subspace iteration.

A pass over the rows multiplies the covariance by a block Q of vectors: each task adds up X^T(XQ) over its centred rows, and only these sums, one
column of the dimension for each vector of the block, leave it. QR makes the images a new block, and Rayleigh-Ritz takes the best vectors of the span of this
round's blocks, whose images are known, so the span grows without more passes. Once it has `most` vectors, the iteration starts again from its best
block. A pass over the k found vectors measures their residuals; if one is too large, the iteration goes on from them. A last pass measures the covariance of
the whitened rows. The covariance of x itself is never formed, and what reaches the driver is bounded by the dimension and `most`.

Centring is exact: x and the sums S are integers, and with S = n q + r a centred entry is (x - q) - r / n.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries, or entries of 2^50 or more in size, are left out; so are rows whose vector has
another length than the most frequent one (ties: the longest), as no covariance goes with them. Components end where the variance does, so rows that are all alike, a single row
and an empty table give an empty result. deviation is null where it exceeds a long. Rows of a null identifier and repeated rows are rows as any other; other columns don't matter, whatever
their names. Equal variances have any of their bases, the same for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 50
#: Rows that a task centres at once hold about this many entries.
ENTRIES = 1 << 19


def _integers(vectors: pa.Array, length: int) -> np.ndarray:
    """The integer vectors of a batch without nulls."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def usable(rows: DataFrame, vec_col: str) -> DataFrame:
    """The rows whose vectors have entries, all of them numbers of a size that fits."""
    v = F.col(f"`{vec_col}`")
    good = F.size(v) > 0
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST))
    return rows.filter(v.isNotNull() & good & fits)


def _parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, ENTRIES // length)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            b = batch.slice(at, step)
            yield b, _integers(b.column("v"), length)


@dataclass
class Centre:
    """n rows and their sums by dimension, as Python integers."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 of each row, null beyond a long."""
        apart = x - self.whole
        most = self.n * int(np.abs(apart).max(initial=0)) + self.n
        if most * most * x.shape[1] < 1 << 62:
            d = self.n * apart - self.rest
            return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest.tolist(), strict=True)) for row in apart.tolist()]
        return [d if d < 1 << 63 else None for d in exact]


def centre_of(rows: DataFrame, length: int) -> Centre:
    """Exact sums of the integer vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(length, object)
        for _, x in _parts(batches, length):
            n += len(x)
            total += x.sum(axis=0).astype(object) if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]])], names=["n", "sums"])

    found = rows.mapInArrow(run, "n bigint, sums array<string>")
    per = found.select("n", F.posexplode("sums").alias("place", "s")).groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("place").collect()
    return Centre(int(per[0]["n"]), [int(r["s"]) for r in per])


def images(rows: DataFrame, centre: Centre, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass: V Q, Q^T V Q as the rows' own products give it, and the trace of V."""
    length, width = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, small, trace, any_rows = np.zeros((width, length)), np.zeros((width, width)), 0.0, False
        for _, x in _parts(batches, length):
            x = centre.centred(x)
            y = x @ block
            image += y.T @ x
            small += y.T @ y
            trace += float((x * x).sum())
            any_rows = True
        if any_rows:
            values = [*image.tolist(), *small.tolist(), [trace]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.list_(pa.float64()))], names=["at", "values"])

    parts = rows.select("v").mapInArrow(run, "at int, values array<double>")
    cells = parts.select("at", F.posexplode("values").alias("place", "value")).groupBy("at", "place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((2 * width + 1, max(length, width)))
    for at, place, value in cells:
        out[at, place] = value
    out /= centre.n
    return out[:width, :length].T, out[width : 2 * width, :width], float(out[2 * width, 0])


@dataclass
class Components:
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int


def components(rows: DataFrame, centre: Centre, k: int = 8, width: int = 16, most: int = 64, tolerance: float = 1e-12, passes: int = 400) -> Components:
    """The k first components (fewer where the variance ends), certified by residuals of at most `tolerance` of the first eigenvalue."""
    length = len(centre.sums)
    width, most = min(width, length), max(most, 2 * width)
    block = np.linalg.qr(np.random.default_rng(length).standard_normal((length, width)))[0]
    basis, known = np.zeros((length, 0)), np.zeros((length, 0))
    done = 0
    while True:
        image, small, trace = images(rows, centre, block)
        done += 1
        if trace == 0:
            return Components(np.zeros((length, 0)), np.zeros(0), 0.0, done)
        basis, known = np.concatenate([basis, block], axis=1), np.concatenate([known, image], axis=1)
        ritz = basis.T @ known
        value, mix = np.linalg.eigh((ritz + ritz.T) / 2)
        mix = mix[:, ::-1]
        value, best = value[::-1], basis @ mix[:, :width]
        apart = known @ mix[:, :width] - best * value[:width]
        k_now = max(1, min(k, int((value > 1e-13 * trace).sum())))
        worst = float(np.linalg.norm(apart[:, :k_now], axis=0).max()) / value[0]
        fresh = _beyond(basis, apart if basis.shape[1] else image)
        if worst <= tolerance or not fresh.shape[1]:
            found = np.linalg.qr(best[:, :k_now])[0]
            image, small, trace = images(rows, centre, found)
            done += 1
            value, mix = np.linalg.eigh((small + small.T) / 2)
            value, mix = value[::-1], mix[:, ::-1]
            found, image = found @ mix, image @ mix
            worst = float(np.linalg.norm(image - found * value, axis=0).max()) / value[0]
            if worst <= 10 * tolerance:
                return Components(found, value, trace, done)
            # what the longer sum of products has lost comes back from the vectors themselves
            basis, known = found, image
            fresh = _beyond(basis, image - found * value)
        if done >= passes:
            raise ArithmeticError(f"residual {worst} of the first eigenvalue after {done} passes")
        if basis.shape[1] + fresh.shape[1] > max(most, width) and basis.shape[1] > width:
            known, basis = known @ mix[:, :width], best  # begins again with the best block
            fresh = _beyond(basis, apart)
        block = fresh


def _beyond(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to the basis."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    left = left[:, size > 1e-10 * max(1e-300, size.max(initial=0.0))] if len(size) and size.max() > 1e-13 else left[:, :0]
    left = left - basis @ (basis.T @ left)
    return np.linalg.qr(left)[0][:, : basis.shape[0] - basis.shape[1]] if left.shape[1] else left


def whitened(table: DataFrame, k: int = 8, width: int = 16, most: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """WHITENED: a row for each usable vector and component."""
    rows = usable(table, vec_col).select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    none = table.sparkSession.createDataFrame([], WHITENED)
    if lengths is None:
        return none
    length = int(lengths["length"])
    rows = rows.filter(F.size("v") == length)
    centre = centre_of(rows, length)
    found = components(rows, centre, k, width, most)
    count = len(found.values)
    if not count:
        return none
    onto = found.vectors / np.sqrt(found.values)
    _, spread, _ = images(rows, centre, onto)
    explained, error, n = found.values / found.trace, float(np.abs(spread - np.eye(count)).max()), centre.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _parts(batches, length):
            w = centre.centred(x) @ onto
            deviation = pa.array(centre.deviation(x), pa.int64())
            each = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * count, n, np.int64)), deviation.take(each),
                    pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * count, error)),
                ],
                names=[c.split()[0] for c in WHITENED.split(", ")],
            )

    return rows.mapInArrow(run, WHITENED)
