"""A model of the objective over a search's archive: polynomials whose kind and ridge are chosen by cross-validation from sums alone.

The normal equations of each fold are sums over the archive's rows, so Spark adds them up and the driver solves systems of the number of features. A fold's
error under a model that was fit without it follows from the same sums, so the rows aren't read again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5
RIDGES = (1e-10, 1e-6, 1e-3)


def feature_number(dims: int) -> int:
    """Constant, coordinates, squares, products of two: the models take the first 1 + d, 1 + 2 d or all of them."""
    return 1 + 2 * dims + dims * (dims - 1) // 2


def sizes(dims: int) -> tuple[int, ...]:
    return (1 + dims, 1 + 2 * dims, feature_number(dims)) if dims > 1 else (2, 3)


def features(x: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(x.shape[1], 1)
    return np.concatenate([np.ones((len(x), 1)), x, x * x, x[:, i] * x[:, j]], axis=1)


def normal_sums(archive: DataFrame, dims: int) -> np.ndarray:
    """Per fold the sums of all products of two of (features, j) over feasible rows (key string, u array, j), as (FOLDS, p + 1, p + 1)."""
    u = [F.col("u")[k] for k in range(dims)]
    every = [F.lit(1.0), *u, *(x * x for x in u), *(u[i] * u[j] for i in range(dims) for j in range(i + 1, dims)), F.col("j")]
    rows = archive.select(F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int").alias("fold"), F.array(*every).alias("f"))
    products = F.flatten(F.transform("f", lambda a: F.transform("f", lambda b: a * b)))
    cells = rows.select("fold", F.posexplode(products).alias("at", "v")).groupBy("fold", "at").agg(F.sum("v").alias("v"))
    p = len(every)
    out = np.zeros((FOLDS, p * p))
    for fold, at, v in cells.collect():
        out[fold, at] = v
    return out.reshape(FOLDS, p, p)


def sums_of(folds: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same from arrays."""
    f = np.concatenate([features(x), j[:, None]], axis=1)
    return np.stack([f[folds == k].T @ f[folds == k] for k in range(FOLDS)])


@dataclass
class Model:
    size: int
    weights: np.ndarray
    error: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return features(np.asarray(x, float))[:, : self.size] @ self.weights


def _solved(sums: np.ndarray, size: int, ridge: float) -> np.ndarray:
    a, y = sums[:size, :size], sums[:size, -1]
    return np.linalg.lstsq(a + ridge * np.diag(np.maximum(np.diag(a), 1e-30)), y, rcond=None)[0]


def chosen(sums: np.ndarray, dims: int) -> Model | None:
    """The kind and ridge with the least squared error over folds left out; None with too few rows for any (two more than a model has features, in all others)."""
    whole, best = sums.sum(axis=0), None
    for size in sizes(dims):
        if min((whole - s)[0, 0] for s in sums) < size + 2:
            continue
        for ridge in RIDGES:
            error = 0.0
            for s in sums:
                w = _solved(whole - s, size, ridge)
                error += max(0.0, s[-1, -1] - 2 * w @ s[:size, -1] + w @ s[:size, :size] @ w)
            if best is None or error < best.error:
                best = Model(size, _solved(whole, size, ridge), error)
    return best


def steered(share: float, tau: float | None) -> float:
    """The share of a generation that runs next: less while predictions order the results, more where they don't."""
    if tau is None:
        return 1.0
    return max(0.25, 0.7 * share) if tau >= 0.8 else min(1.0, 1.5 * share)


def tau_of(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau of a generation's predictions and results; None of fewer than three."""
    if len(x) < 3:
        return None
    i, j = np.triu_indices(len(x), 1)
    return float((np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])).mean())
