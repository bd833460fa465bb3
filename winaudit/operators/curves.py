"""Exact curves from distinct scores: ROC and PR points, AUC, average precision, best F1.

Points come from one sweep over the scores' digits (functions/radix.py), so no group has to fit in a task, whatever its number
of scores. What is made of the points are sums and maxima that tasks combine before they are shuffled.
Null scores take no part; a null label counts for neither class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winaudit.functions.radix import swept


def curve_points(df: DataFrame, group: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """(group, score, tp, fp, pos, neg, p, n): alarms at each distinct score (those at or above it), anomalies and benign rows there, and the class totals."""
    y = F.coalesce(F.col(label).cast("long"), F.lit(0))
    points = swept(df, group, score, {"pos": y, "neg": F.when(F.col(label).isNotNull(), 1 - y).otherwise(0)})
    return points.select(*group, score, *[(F.col(f"{c}_all") - F.col(f"{c}_upto") + F.col(c)).alias(n) for c, n in (("pos", "tp"), ("neg", "fp"))], "pos", "neg", F.col("pos_all").alias("p"), F.col("neg_all").alias("n"))


def roc_points(points: DataFrame, group: Sequence[str] = (), score: str = "score") -> DataFrame:
    """fpr and tpr at each distinct score; null for a class that is absent."""
    return points.select(*group, score, F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr"))


def pr_points(points: DataFrame, group: Sequence[str] = (), score: str = "score") -> DataFrame:
    return points.select(*group, score, F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "p").alias("recall"))


def auc() -> Column:
    """Aggregate of points: the share of (anomaly, benign) pairs in order, ties half; null for one class."""
    return F.try_divide(F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2)), F.max("p") * F.max("n"))


def ap() -> Column:
    """Aggregate of points: recall steps times precision, no interpolation; 0 without anomalies."""
    return F.coalesce(F.try_divide(F.sum(F.col("pos") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))), F.max("p")), F.lit(0.0))


def roc_auc(points: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*group).agg(auc().alias("auc"))


def average_precision(points: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*group).agg(ap().alias("ap"))


def oracle_f1_threshold(points: DataFrame, group: Sequence[str] = (), score: str = "score", tie: str = "lowest") -> DataFrame:
    """(group, oracle_threshold, oracle_f1): the score with the best F1 (to 12 digits); a tie goes to the lowest or highest."""
    f1 = F.round(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")), 12)
    key = F.struct(f1.alias("f1"), (-F.col(score) if tie == "lowest" else F.col(score)).alias("s"))
    best = points.groupBy(*group).agg(F.max(key).alias("b"))
    return best.select(*group, (-F.col("b.s") if tie == "lowest" else F.col("b.s")).alias("oracle_threshold"), F.col("b.f1").alias("oracle_f1"))
