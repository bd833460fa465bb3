"""Principal components of long vectors: a randomised range finder and tall-skinny QR.

With l = k + OVERSAMPLED random directions, a pass adds up per task X'(XR) and the rows' sum, d x l numbers however many rows; centring
follows from the sum. The result, made orthonormal, spans nearly what the components do, the more exactly the
more passes. One last pass projects the rows onto it; each task keeps the triangular factor of its projections, l x l,
and those are stacked and factored again. Neither d x d numbers nor rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directions beyond the components wanted; passes that turn them towards the components; numbers of a row that tasks send.
OVERSAMPLED, PASSES, CHUNK = 10, 2, 1 << 16


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors, without those that are null or hold null or non-finite components."""
    real = batch[0].drop_null()
    if not len(real):
        return np.zeros((0, 0))
    x = real.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(real), -1)
    return x[np.isfinite(x).all(1)]


def _summed(df: DataFrame, vector: str, size: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all batches of add(matrix), an array of `size` numbers; tasks send sums, Spark adds these in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = _matrix(batch)
            if len(x):
                total += add(x)
        for i in range(0, size, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([total[i : i + CHUNK].tobytes()], pa.binary())], names=["i", "x"])

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"i": table["i"][:1].combine_chunks(), "x": pa.array([sum(np.frombuffer(b) for b in table["x"].to_pylist()).tobytes()], pa.binary())})

    parts = df.select(vector).mapInArrow(run, "i int, x binary").groupBy("i").applyInArrow(merge, "i int, x binary")
    return np.concatenate([np.frombuffer(r.x) for r in sorted(parts.toLocalIterator(), key=lambda r: r.i)])


def _factor(df: DataFrame, vector: str, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The triangular factor of the centred rows' projections onto basis."""
    width = basis.shape[1]

    def triangle(x: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(x, mode="r")
        return np.vstack([r, np.zeros((width - len(r), width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            x = _matrix(batch)
            if len(x):
                r = triangle(np.vstack([r, (x - mean) @ basis]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def stack(table: pa.Table) -> pa.Table:
        return pa.table({"r": pa.array([triangle(np.vstack([np.frombuffer(b).reshape(width, width) for b in table["r"].to_pylist()])).tobytes()], pa.binary())})

    parts = df.select(vector).mapInArrow(run, "r binary").groupBy(F.pmod(F.xxhash64("r"), F.lit(64)).alias("g")).applyInArrow(stack, "r binary")
    found = [np.frombuffer(r.r).reshape(width, width) for r in parts.toLocalIterator()]  # 64 of them at most
    return triangle(np.vstack(found)) if found else np.zeros((width, width))


def fit_pca(df: DataFrame, vector: str, k: int, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components as d x k, variances with ddof 1) of df's vectors, all of one length; fewer components if there are fewer. A component's largest entry is positive."""
    first = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).first()
    if first is None:
        raise ValueError("no vectors to fit components on")
    d = first.d
    width = min(d, k + OVERSAMPLED)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    for _ in range(max(1, passes)):
        q = basis
        sums = _summed(df, vector, d * width + d + 1, lambda x, q=q: np.concatenate([(x.T @ (x @ q)).ravel(), x.sum(0), [len(x)]]))
        n, mean = sums[-1], sums[d * width : -1] / max(sums[-1], 1)
        basis = np.linalg.qr(sums[: d * width].reshape(d, width) - n * np.outer(mean, mean @ q))[0]
    _, scale, right = np.linalg.svd(_factor(df, vector, mean, basis))
    axes = basis @ right.T[:, : min(k, width)]
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return mean, axes, scale[: axes.shape[1]] ** 2 / max(n - 1, 1)


def pca_reduce(df: DataFrame, vector: str, k: int, fit_on: DataFrame | None = None, name: str = "reduced", passes: int = PASSES, seed: int = 0) -> DataFrame:
    """Add the centred vector's coordinates on the first k principal components of `fit_on` (a sample, or df). A null vector's are null."""
    mean, axes, _ = fit_pca(fit_on if fit_on is not None else df, vector, k, passes, seed)
    shared = df.sparkSession.sparkContext.broadcast((mean, axes))  # d * (k + 1) numbers

    @F.arrow_udf("array<double>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, a = shared.value
        for batch in batches:
            x = np.array([v if v is not None else m for v in batch.to_pylist()], float).reshape(len(batch), len(m))
            rows = (x - m) @ a
            yield pa.array([r if real else None for real, r in zip(batch.is_valid().to_pylist(), list(rows), strict=True)], pa.list_(pa.float64()))

    return df.withColumn(name, project(F.col(vector)))
