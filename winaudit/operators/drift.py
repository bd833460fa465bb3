"""Drift between calibration and test scores, over time and between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winaudit.functions.radix import located, quantiles, selected, swept
from winaudit.functions.scratch import materialize
from winaudit.operators import curves
from winaudit.operators.calibrate import threshold_from_benign_fpr
from winaudit.operators.evaluate import confusion_at_threshold, with_rates


def _gap(first: str, second: str) -> Column:
    """Difference of two samples' shares at or below a swept value."""
    share = lambda c: F.try_divide(f"{c}_upto", f"{c}_all")
    return F.abs(share(first) - share(second))


def _step(score: str) -> Column:
    return F.coalesce(F.col("next_value").cast("double") - F.col(score).cast("double"), F.lit(0.0))


def two_sample_distances(df: DataFrame, group: Sequence[str], first: Column, second: Column, score: str = "score") -> DataFrame:
    """(group, wasserstein, ks): distances of the score distributions of two subsets; null where one is empty.

    One sweep over the distinct scores has both shares beside each other; a bucket's last score takes its successor from the next bucket.
    """
    counts = {"first_n": F.when(first, 1).otherwise(0), "second_n": F.when(second, 1).otherwise(0)}
    points = swept(df.where(first | second), group, score, counts)
    return points.groupBy(*group).agg(F.sum(_gap("first_n", "second_n") * _step(score)).alias("wasserstein"), F.max(_gap("first_n", "second_n")).alias("ks"))


def calibration_stability(df: DataFrame, group: Sequence[str], target_fpr: float, calibration: Column, test: Column, score: str = "score") -> DataFrame:
    """Shift of mean and deviation, |test FPR - target| and distances, calibration against benign test windows. df: prediction."""
    benign = test & (F.col("label") == 0)
    moments = df.groupBy(*group).agg(
        F.avg(F.when(calibration, F.col(score))).alias("calibration_mean"), F.stddev_samp(F.when(calibration, F.col(score))).alias("calibration_std"),
        F.avg(F.when(benign, F.col(score))).alias("test_mean"), F.stddev_samp(F.when(benign, F.col(score))).alias("test_std"), F.avg(F.when(benign, F.col("prediction").cast("double"))).alias("test_fpr"),
    )
    out = moments.withColumns({"mean_shift": F.col("test_mean") - F.col("calibration_mean"), "std_shift": F.col("test_std") - F.col("calibration_std"), "fpr_gap": F.abs(F.col("test_fpr") - F.lit(target_fpr))})
    return out.join(two_sample_distances(df.where(calibration | benign), group, calibration, benign, score), list(group))


def stability_summary(stability: DataFrame, thresholds: DataFrame, keys: Sequence[str], model: str = "model") -> DataFrame:
    """Per model mean and deviation of the distances, and the thresholds' coefficient of variation."""
    joined = stability.join(thresholds, list(keys))
    measures = ("fpr_gap", "wasserstein", "ks", "threshold")
    per = joined.groupBy(model).agg(*[f(c).alias(f"{c}_{n}") for c in measures for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    return per.withColumn("threshold_cv", F.try_divide("threshold_std", "threshold_mean"))


def temporal_blocks(df: DataFrame, group: Sequence[str], order: str, calibration: DataFrame, blocks: int = 10, score: str = "score") -> DataFrame:
    """Equal-count blocks of the test windows in order, the first ones a window larger: counts, scores, rates, and distance of benign scores to calibration's.

    df: label, prediction, threshold and `order`, a whole number that differs between a group's rows (null: in no block); calibration: group,
    score. Blocks are told by the order of their first windows, which are selected by rank; the windows themselves stay where they are.
    """
    start = lambda n, k: F.lit(k) * F.floor(n / blocks) + F.least(F.lit(k).cast("long"), n % blocks)
    ranks = lambda n: F.array(*[F.struct(F.lit(k).alias("item"), start(n, k).alias("rank")) for k in range(blocks)])
    firsts = selected(df, group, order, ranks).groupBy(*group).agg(F.array_sort(F.collect_list("found")).alias("__firsts"))  # as many as blocks
    block = F.size(F.filter("__firsts", lambda x: x <= F.col(order))).cast("long")
    placed = (df.join(firsts, list(group)) if group else df.join(F.broadcast(firsts))).where(F.col(order).isNotNull()).withColumn("block", block).drop("__firsts")
    keys = [*group, "block"]
    y, a = F.col("label") == 1, F.col("prediction") == 1
    stats = placed.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.count(F.when(F.col("label") == 0, 1)).alias("benign"), F.avg(score).alias("score_mean"), F.stddev_samp(score).alias("score_std"), F.avg(F.col(score) - F.col("threshold")).alias("margin_mean"),
        *[F.count(F.when(c, 1)).alias(n) for n, c in (("tp", y & a), ("fp", ~y & a), ("tn", ~y & ~a), ("fn", y & ~a))],
    )
    stats = with_rates(stats).drop("tp", "fp", "tn", "fn")
    # Each block's benign scores against all calibration scores: counts of these are repeated per block, not rows.
    none = F.lit(0).cast("long")
    known = calibration.groupBy(*group, score).agg(F.count("*").alias("c")).withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(blocks).cast("long"))))
    both = placed.where("label = 0").groupBy(*keys, score).agg(F.count("*").alias("b")).select(*keys, score, "b", none.alias("c")).unionByName(known.select(*keys, score, none.alias("b"), "c"))
    gaps = swept(both, keys, score, {"b": F.col("b"), "c": F.col("c")}).groupBy(*keys).agg(F.sum(_gap("b", "c") * _step(score)).alias("wasserstein"))
    return stats.join(gaps, keys, "left")


def file_blocks(df: DataFrame, group: Sequence[str], file: str = "source_file", score: str = "score") -> DataFrame:
    keys = [*group, file]
    stats = df.groupBy(*keys).agg(F.count("*").alias("windows"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("label") == 1, F.col("family")))), ",").alias("families"), F.avg(score).alias("score_mean"))
    return stats.join(confusion_at_threshold(df, keys).select(*keys, "precision", "recall", "f1", "fpr"), keys)


def operating_point(df: DataFrame, group: Sequence[str], calibration: Column, test: Column, score: str = "score") -> DataFrame:
    """Share of scores below the threshold in test and calibration, and the F1 given up against the oracle. df: prediction, threshold."""
    out = df.groupBy(*group).agg(F.avg(F.when(test, (F.col(score) < F.col("threshold")).cast("double"))).alias("percentile_test"), F.avg(F.when(calibration, (F.col(score) < F.col("threshold")).cast("double"))).alias("percentile_calibration"))
    tested = df.where(test)
    f1 = confusion_at_threshold(tested, group).select(*group, "f1")
    best = curves.oracle_f1_threshold(curves.curve_points(tested, group, score), group, score)
    return out.join(f1, list(group)).join(best, list(group)).withColumn("f1_regret", F.col("oracle_f1") - F.col("f1"))


def fpr_transfer(calibration: DataFrame, benign_test: DataFrame, group: Sequence[str], ident: str, fractions: Sequence[float] = (0.05, 0.1, 0.2, 0.4, 1.0), targets: Sequence[float] = (0.01, 0.05, 0.1, 0.15, 0.25), repeats: int = 20, score: str = "score", key: Column | None = None) -> DataFrame:
    """How observed test FPR follows the target when the threshold comes from a part of the calibration scores.

    A row's `key` is a whole number drawn per (row, repeat), by default a 64-bit hash of the id; fraction f takes the first round(f * n)
    keys, equal keys together. Nothing is sorted: the keys to stop at are selected by rank, the quantiles of each draw by counts of its
    scores' digits, and the shares of test scores that reach a threshold come from one sweep over the test scores.
    """
    key = key if key is not None else F.xxhash64(ident, "repeat")
    drawn = calibration.select(*group, ident, F.col(score).cast("float").alias("__s")).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("__key", key)
    last = lambda n, f: F.greatest(F.floor(F.lit(f) * n + 0.5), F.lit(1)) - 1
    ranks = lambda n: F.array(*[F.struct(F.lit(float(f)).alias("item"), last(n, float(f)).alias("rank")) for f in fractions])
    cuts = selected(drawn, [*group, "repeat"], "__key", ranks).select(*group, "repeat", F.col("item").alias("fraction"), F.col("found").alias("__cut"))
    cuts = materialize(cuts, "cuts")
    parts = drawn.join(cuts, [*group, "repeat"]).where(F.col("__key") <= F.col("__cut"))
    keys = [*group, "repeat", "fraction"]
    targets = [float(t) for t in targets]
    grid = quantiles(parts.select(*keys, "__s"), keys, "__s", {f"t{i}": min(max(1.0 - t, 0.0), 1.0) for i, t in enumerate(targets)})
    rows = F.array(*[F.struct(F.lit(t).alias("target_fpr"), F.col(f"t{i}").cast("float").alias("threshold")) for i, t in enumerate(targets)])
    thresholds = materialize(grid.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.target_fpr", "r.threshold"), "thresholds")
    # Thresholds take their places among the test scores without being counted; scores below one are no alarms.
    seen = benign_test.select(*group, F.col(score).cast("float").alias("__s"), F.lit(1).cast("long").alias("__c"))
    points = swept(seen.unionByName(thresholds.select(*group, F.col("threshold").alias("__s"), F.lit(0).cast("long").alias("__c"))), group, "__s", {"c": F.col("__c")})
    hit = located(points, group, "__s", thresholds, "threshold").where("c_all > 0").withColumn("observed", 1 - (F.col("c_upto") - F.col("c")) / F.col("c_all"))
    out = hit.groupBy("fraction", "target_fpr").agg(F.avg("observed").alias("mean_fpr"), F.stddev_samp("observed").alias("std_fpr"), F.count("*").alias("runs"))
    bias = F.col("mean_fpr") - F.col("target_fpr")
    return out.withColumns({"bias": bias, "relative_bias": bias / F.col("target_fpr")})


def component_agreement(df: DataFrame, group: Sequence[str], families: Sequence[str], fpr: float, calibration: Column, test: Column) -> DataFrame:
    """Per family with the benign windows: correlation of both components, their AUCs, and where they agree on being high.

    High is at or above the component's own calibrated threshold. df: sd, sf, fused, label, family.
    """
    kept = df.where(test)
    for c in ("sd", "sf"):
        kept = kept.join(threshold_from_benign_fpr(df.where(calibration), fpr, group, c).withColumnRenamed("threshold", f"t_{c}"), list(group))
    kept = kept.withColumn("of_family", F.explode(F.array(*[F.lit(f) for f in families])))
    kept = kept.where((F.col("family") == F.col("of_family")) & (F.col("label") == 1) | (F.col("label") == 0))
    keys = [*group, "of_family"]
    a, b = F.col("sd") >= F.col("t_sd"), F.col("sf") >= F.col("t_sf")
    out = kept.groupBy(*keys).agg(F.sum("label").alias("support"), F.corr("sd", "sf").alias("correlation"), *[F.count(F.when(c, 1)).alias(n) for n, c in (("both_high", a & b), ("both_low", ~a & ~b), ("sd_only", a & ~b), ("sf_only", ~a & b))])
    for c in ("sd", "sf", "fused"):
        points = curves.curve_points(kept.select(*keys, F.col(c).alias("score"), "label"), keys)
        out = out.join(curves.roc_auc(points, keys).withColumnRenamed("auc", f"{c}_auc"), keys)
    return out

