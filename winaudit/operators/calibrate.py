"""Thresholds from benign calibration scores; exact quantiles only.

Scores are 32-bit floats, and so are thresholds: an alarm at a tie depends on that. A quantile is
interpolated in doubles between two such scores, then rounded. Null scores are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winaudit.functions.clean import finite
from winaudit.functions.radix import quantiles

EMPTY = "no calibration scores to take a threshold from"


def _share(fpr: float) -> float:
    return min(max(1.0 - fpr, 0.0), 1.0)


def _ready(scores: DataFrame, group: Sequence[str], score: str, finite_only: bool, groups: DataFrame | None) -> DataFrame:
    s = F.col(score).cast("float")
    ready = scores.select(*group, (finite(s) if finite_only else s).alias("score"))
    return ready if groups is None else ready.unionByName(groups.select(*group, F.lit(None).cast("float").alias("score")))


def threshold_from_benign_fpr(scores: DataFrame, fpr: float, group: Sequence[str] = (), score: str = "score", finite_only: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """(group, threshold): the (1 - fpr) quantile, linearly interpolated; fpr is clipped to [0, 1].

    Running it is an error if a group of scores, or of `groups` where given, has no score. finite_only: NaN and infinite scores
    are no scores. Without it they count, NaN above all.
    """
    found = quantiles(_ready(scores, group, score, finite_only, groups), group, "score", {"threshold": _share(fpr)}, EMPTY)
    return found.withColumn("threshold", F.col("threshold").cast("float"))


def threshold_of(scores: DataFrame, fpr: float, score: str = "score", finite_only: bool = False) -> float:
    if scores.select((finite(F.col(score)) if finite_only else F.col(score)).alias("s")).where("s is not null").isEmpty():
        raise ValueError(EMPTY)
    return float(threshold_from_benign_fpr(scores, fpr, score=score, finite_only=finite_only).first().threshold)


def target_fpr_grid(scores: DataFrame, targets: Sequence[float], group: Sequence[str] = (), score: str = "score", finite_only: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """(group, target_fpr, threshold), one row per distinct target in the order given; all quantiles from the same readings. Targets are clipped to [0, 1] for their quantile; empty groups are an error."""
    targets = list(dict.fromkeys(float(t) for t in targets))
    grid = quantiles(_ready(scores, group, score, finite_only, groups), group, "score", {f"t{i}": _share(t) for i, t in enumerate(targets)}, EMPTY)
    rows = F.array(*[F.struct(F.lit(t).alias("target_fpr"), F.col(f"t{i}").cast("float").alias("threshold")) for i, t in enumerate(targets)])
    return grid.select(*group, F.explode(rows).alias("r")).select(*group, "r.target_fpr", "r.threshold")


def apply_threshold(df: DataFrame, score: str = "score", threshold: Column | None = None) -> DataFrame:
    """prediction: score >= threshold; threshold_margin: score - threshold. Both are null for a null score."""
    t = F.col("threshold") if threshold is None else threshold
    return df.withColumns({"prediction": (F.col(score) >= t).cast("int"), "threshold_margin": F.col(score) - t})
