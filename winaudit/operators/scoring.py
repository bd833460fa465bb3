"""Window scores: deviations from reference rows, normalisation and fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the first score in the fused one.
ALPHA = 0.24


def minmax_norm(df: DataFrame, scores: dict[str, str], reference: Column, group: Sequence[str] = (), zero_if_flat: bool = False) -> DataFrame:
    """Add clip((x - lo) / max(hi - lo, 1e-12), 0, 1) per {score: new name}; lo and hi over the group's reference rows.

    zero_if_flat: all zeros where hi <= lo.
    """
    bounds = df.where(reference).groupBy(*group).agg(*[f(c).alias(f"__{n}_{c}") for c in scores for n, f in (("lo", F.min), ("hi", F.max))])
    if group:
        df = df.join(bounds, list(group), "left")
    else:
        row = bounds.first()
        df = df.withColumns({k: F.lit(row[k]).cast("double") for k in row.asDict()})
    out = {}
    for c, name in scores.items():
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - lo) / F.greatest(hi - lo, F.lit(1e-12))))
        out[name] = F.when(hi > lo, x).otherwise(0.0) if zero_if_flat else x
    return df.withColumns(out).drop(*[f"__{n}_{c}" for c in scores for n in ("lo", "hi")])


def minmax_from_train(df: DataFrame, scores: dict[str, str], reference: Column, group: Sequence[str] = ()) -> DataFrame:
    return minmax_norm(df, scores, reference, group, zero_if_flat=True)


def fuse(sd: Column, sf: Column, alpha: float | Column = ALPHA) -> Column:
    alpha = alpha if isinstance(alpha, Column) else F.lit(alpha)
    return alpha * sd + (1 - alpha) * sf


def score_mode(mode: str, prob: Column, l2: Column, mahal: Column, alpha: float = ALPHA) -> Column:
    """prob, feat_l2, feat_mahal, or fused: prob with l2."""
    modes = {"prob": prob, "feat_l2": l2, "feat_mahal": mahal, "fused": fuse(prob, l2, alpha)}
    return modes[mode]


def mean_embedding(df: DataFrame, vector: str, reference: Column) -> list[float]:
    """Per-component mean over reference rows; sums are combined before they move."""
    parts = df.where(reference).select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    return [r.m for r in parts.orderBy("i").collect()]  # one number a component


def feature_deviation_l2(df: DataFrame, vector: str, reference: Column, name: str = "sf_raw") -> DataFrame:
    """Distance of each vector to the reference rows' mean."""
    mean = F.array(*[F.lit(float(m)) for m in mean_embedding(df, vector, reference)])
    return df.withColumn(name, F.sqrt(F.aggregate(F.zip_with(F.col(vector), mean, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)))


def feature_deviation_mahal(df: DataFrame, vector: str, reference: Column, dim: int, name: str = "sf_mahal", ridge: float = 1e-6) -> DataFrame:
    """Mahalanobis distance to the reference rows: ddof 1 covariance plus ridge, pseudo-inverse.

    Each task adds up its rows' sums and products; dim x dim numbers a task are added by Spark.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = b[0].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        cells = np.concatenate([[n], s, p.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells)], names=["i", "x"])

    sums = df.where(reference).select(vector).mapInArrow(moments, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    cells = np.array([r.x for r in sums.orderBy("i").collect()])
    n, mean = cells[0], cells[1 : dim + 1] / cells[0]
    cov = (cells[dim + 1 :].reshape(dim, dim) - n * np.outer(mean, mean)) / max(n - 1, 1)
    inverse = np.linalg.pinv(cov + ridge * np.eye(dim))

    @F.arrow_udf("double")
    def distance(v: pa.Array) -> pa.Array:
        d = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim) - mean
        return pa.array(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, inverse, d), 0)))

    return df.withColumn(name, distance(F.col(vector)))


def reconstruction_error(given: Column, rebuilt: Column) -> Column:
    """Mean squared difference of two arrays."""
    return F.aggregate(F.zip_with(given, rebuilt, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(given)


def unified_scores(frames: dict[str, DataFrame], test: str = "test") -> DataFrame:
    """One long table over detectors. Frames: split, y_true, raw_score, score_norm, threshold_calibration, threshold_oracle and keys."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("detector", F.lit(n)) for n, f in frames.items()])
    alarm = F.col("score_norm") >= F.col("threshold_calibration")
    out = both.withColumns({"y_pred_calibration": alarm.cast("int"), "y_pred_oracle": (F.col("score_norm") >= F.col("threshold_oracle")).cast("int"), "threshold_distance": F.col("score_norm") - F.col("threshold_calibration")})
    in_test, y, p = F.col("split") == test, F.col("y_true") == 1, F.col("y_pred_calibration") == 1
    kinds = {"is_tp": y & p, "is_fp": ~y & p, "is_tn": ~y & ~p, "is_fn": y & ~p}
    return out.withColumns({k: F.when(in_test, c.cast("int")) for k, c in kinds.items()})

