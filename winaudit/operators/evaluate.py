"""Metrics at thresholds, per-family results, sweeps and audits of saved results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winaudit.functions.radix import quantiles, swept
from winaudit.functions.scratch import materialize
from winaudit.operators import curves
from winaudit.operators.calibrate import threshold_from_benign_fpr
from winaudit.operators.scoring import fuse


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and fpr from tp, fp, tn, fn; 0 where nothing is divided by."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn)})


def confusion_at_threshold(df: DataFrame, group: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, a = F.col(label) == 1, F.col(prediction) == 1
    return with_rates(df.groupBy(*group).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("tp", y & a), ("fp", ~y & a), ("tn", ~y & ~a), ("fn", y & ~a))]))


def benign_fpr_at_threshold(df: DataFrame, group: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(*group).agg(F.avg(F.when(F.col(label) == 0, F.col(prediction).cast("double"))).alias("benign_fpr"))


def calibration_empirical_fpr(calibration: DataFrame, stored: DataFrame, fpr: float, group: Sequence[str], score: str = "score") -> DataFrame:
    """Per group the share of calibration scores at or above the stored threshold, and whether it can be recomputed within 1e-8."""
    again = threshold_from_benign_fpr(calibration, fpr, group, score).withColumnRenamed("threshold", "recomputed")
    seen = calibration.join(stored, list(group)).groupBy(*group).agg(F.avg((F.col(score) >= F.col("threshold")).cast("double")).alias("empirical_fpr"), F.max("threshold").alias("threshold"))
    return seen.join(again, list(group)).select(*group, "empirical_fpr", "threshold", (F.abs(F.col("threshold") - F.col("recomputed")) <= 1e-8).alias("threshold_ok"))


def calibration_vs_oracle(test: DataFrame, thresholds: DataFrame, group: Sequence[str], score: str = "score") -> DataFrame:
    """(group, strategy, threshold, tp...f1, fpr) for the calibrated and the oracle threshold."""
    best = curves.oracle_f1_threshold(curves.curve_points(test, group, score), group, score).select(*group, F.lit("oracle").alias("strategy"), F.col("oracle_threshold").alias("threshold"))
    both = thresholds.select(*group, F.lit("calibrated").alias("strategy"), "threshold").unionByName(best)
    at = test.join(both, list(group)).withColumn("prediction", (F.col(score) >= F.col("threshold")).cast("int"))
    return confusion_at_threshold(at, [*group, "strategy", "threshold"])


def strategy_summary(results: DataFrame) -> DataFrame:
    """Mean metrics per strategy, and the F1 each gives up against the oracle."""
    per = results.groupBy("strategy").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "fpr")])
    top = per.where("strategy = 'oracle'").first()
    return per.withColumn("f1_gap", F.lit(top.f1 if top else None).cast("double") - F.col("f1"))


def alpha_grid() -> list[float]:
    return sorted({round(0.05 * i, 2) for i in range(21)} | {0.24})


def alpha_sweep(scores: DataFrame, fpr: float, group: Sequence[str], calibration: Column, test: Column, grid: Sequence[float] | None = None, digits: int = 6, curve: bool = True) -> DataFrame:
    """Per group and alpha: fuse again, calibrate again; threshold, the confusion metrics, and auc and ap unless `curve` is off. scores: sd, sf, label.

    Rows are counted per distinct (sd, sf) once; only counts are fused with each alpha. Thresholds are selected by the digits of calibration scores,
    and alarms counted in the tasks that fuse; only the curve moves distinct test scores.
    """
    y = F.coalesce(F.col("label"), F.lit(0)) == 1
    tallies = {"cal": calibration, "pos": test & y, "neg": test & ~y}
    pairs = scores.where(calibration | test).groupBy(*group, "sd", "sf").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in tallies.items()])
    pairs = materialize(pairs, "pairs")
    keys = [*group, "alpha"]

    def fused(some: Column, *counts: str) -> DataFrame:
        wide = pairs.where(some).select(*group, "sd", "sf", *counts, F.explode(F.array(*[F.lit(a) for a in (grid or alpha_grid())])).alias("alpha"))
        return wide.select(*keys, *counts, F.round(fuse(F.col("sd"), F.col("sf"), F.col("alpha")), digits).cast("float").alias("score"))

    thresholds = quantiles(fused(F.col("cal") > 0, "cal"), keys, "score", {"threshold": min(max(1.0 - fpr, 0.0), 1.0)}, count="cal")
    thresholds = materialize(thresholds.withColumn("threshold", F.col("threshold").cast("float")), "sweep_thresholds")  # a row per group and alpha
    judged = fused(F.col("pos") + F.col("neg") > 0, "pos", "neg")
    alarm = F.col("score") >= F.col("threshold")
    sums = {"tp": F.when(alarm, F.col("pos")).otherwise(0), "fp": F.when(alarm, F.col("neg")).otherwise(0), "p": F.col("pos"), "n": F.col("neg")}
    at = judged.where("score is not null").join(F.broadcast(thresholds), keys).groupBy(*keys, "threshold").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    rates = with_rates(at.select(*keys, "threshold", F.col("__tp").alias("tp"), F.col("__fp").alias("fp"), (F.col("__n") - F.col("__fp")).alias("tn"), (F.col("__p") - F.col("__tp")).alias("fn")))
    if not curve:
        return rates
    points = swept(judged, keys, "score", {n: F.col(n) for n in ("pos", "neg")})
    above = {n: F.col(f"{n}_all") - F.col(f"{n}_upto") + F.col(n) for n in ("pos", "neg")}
    points = points.withColumns({"tp": above["pos"], "fp": above["neg"], "p": F.col("pos_all"), "n": F.col("neg_all")})
    return rates.join(points.groupBy(*keys).agg(curves.auc().alias("auc"), curves.ap().alias("ap")), keys)


def best_alpha(sweep: DataFrame, metric: str = "f1", k: int = 3) -> DataFrame:
    """The k alphas with the best mean metric, ties to the smaller alpha."""
    means = sweep.groupBy("alpha").agg(F.avg(metric).alias(metric))
    return means.orderBy(F.desc(F.round(metric, 9)), "alpha").limit(k)


def broad_peak(sweep: DataFrame, metric: str = "f1", within: float = 0.01, least: int = 4) -> DataFrame:
    """One row: alphas within `within` of the best mean, and whether they are at least `least`."""
    means = sweep.groupBy("alpha").agg(F.avg(metric).alias("m"))
    top = means.agg(F.max("m")).first()[0]
    return means.agg(F.count(F.when(F.col("m") >= F.lit(top) - within - 1e-12, 1)).alias("near_best")).withColumn("broad", F.col("near_best") >= least)


def family_recall(df: DataFrame, group: Sequence[str] = (), family: str = "family") -> DataFrame:
    return df.where("label = 1").groupBy(*group, family).agg(F.count("*").alias("support"), F.avg(F.col("prediction").cast("double")).alias("recall"))


def _with_quantiles(stats: DataFrame, rows: DataFrame, keys: Sequence[str], score: str, shares: dict[str, float]) -> DataFrame:
    """stats with exact quantiles of its groups' scores (null where a group has none)."""
    found = quantiles(rows.select(*keys, score), keys, score, shares)
    return stats.join(found, list(keys), "left")


def family_stats(df: DataFrame, group: Sequence[str] = (), family: str = "family", score: str = "score") -> DataFrame:
    """Support, recall and the scores' mean, quartiles and mean margin per anomaly family (not null). df: prediction, threshold. Null scores count in the support only."""
    s, keys = F.col(score), [*group, family]
    rows = df.where((F.col("label") == 1) & F.col(family).isNotNull())
    stats = rows.groupBy(*keys).agg(F.count("*").alias("support"), F.avg(F.col("prediction").cast("double")).alias("recall"), F.avg(s).alias("mean_score"), F.avg(s - F.col("threshold")).alias("mean_margin"))
    out = _with_quantiles(stats, rows, keys, score, {"q25": 0.25, "median_score": 0.5, "q75": 0.75})
    return out.select(*keys, "support", "recall", "mean_score", "q25", "median_score", "q75", "mean_margin")


def family_precision_fnr(df: DataFrame, group: Sequence[str], family: str = "family", score: str = "score") -> DataFrame:
    """Family hits over all alarms, false-negative rate, deviation (ddof 1) and 5 % and 95 % quantiles of scores."""
    keys = [*group, family]
    alarms = df.groupBy(*group).agg(F.sum("prediction").alias("alarms"))
    rows = df.where((F.col("label") == 1) & F.col(family).isNotNull())
    per = rows.groupBy(*keys).agg(F.sum("prediction").alias("hits"), F.count("*").alias("support"), F.stddev_samp(score).alias("std_score"))
    joined = _with_quantiles(per, rows, keys, score, {"q05": 0.05, "q95": 0.95}).join(alarms, list(group))
    return joined.select(*keys, _ratio(F.col("hits"), F.col("alarms")).alias("family_precision"), (1 - F.col("hits") / F.col("support")).alias("fnr"), "std_score", "q05", "q95")


def class_score_stats(df: DataFrame, group: Sequence[str], families: Sequence[str], family: str = "family", score: str = "score") -> DataFrame:
    """Score statistics of some families against benign windows."""
    keys = [*group, "class"]
    kept = df.where(F.col(family).isin(*families) | (F.col("label") == 0)).withColumn("class", F.when(F.col("label") == 0, "BENIGN").otherwise(F.col(family)))
    shares = {f"q{round(q * 100):02d}": q for q in (0.05, 0.25, 0.5, 0.75, 0.95)}
    stats = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.avg(F.col(score) - F.col("threshold")).alias("mean_margin"))
    return _with_quantiles(stats, kept, keys, score, shares).select(*keys, "n", "mean", "std", *shares, "mean_margin")


def separation_summary(df: DataFrame, group: Sequence[str], calibration: Column, test: Column, score: str = "score") -> DataFrame:
    """Mean test scores of both classes, deviations, and flags of a degenerate run. df: prediction."""
    s = F.col(score)
    out = df.groupBy(*group).agg(
        F.avg(F.when(test & (F.col("label") == 0), s)).alias("mean_benign"), F.avg(F.when(test & (F.col("label") == 1), s)).alias("mean_anomaly"),
        F.stddev_pop(F.when(calibration, s)).alias("std_calibration"), F.stddev_pop(F.when(test, s)).alias("std_test"),
        F.max(F.when(s.isNull() | F.isnan(s), 1).otherwise(0)).alias("__nan"), F.min(F.when(test, F.col("prediction"))).alias("__lo"), F.max(F.when(test, F.col("prediction"))).alias("__hi"),
    )
    flags = {"has_nan": F.col("__nan") == 1, "one_prediction": F.col("__lo") == F.col("__hi"), "flat_scores": F.col("std_test") < 1e-8}
    return out.withColumns(flags).withColumn("degenerate", F.col("has_nan") | F.col("one_prediction") | F.col("flat_scores")).drop("__nan", "__lo", "__hi")


def fusion_consistency(df: DataFrame, group: Sequence[str], alpha: float | Column, sd: str = "sd", sf: str = "sf", fused: str = "fused") -> DataFrame:
    return df.groupBy(*group).agg(F.max(F.abs(fuse(F.col(sd), F.col(sf), alpha) - F.col(fused))).alias("max_abs_diff"))


def metric_recheck(again: DataFrame, saved: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Per key the largest difference of recomputed and saved metrics, and whether it is within tolerance; missing ones fail."""
    a, b = again.select(*keys, *[F.col(m).alias(f"__a_{m}") for m in metrics]), saved.select(*keys, *[F.col(m).alias(f"__b_{m}") for m in metrics])
    diffs = [F.abs(F.col(f"__a_{m}") - F.col(f"__b_{m}")) for m in metrics]
    worst = F.greatest(*diffs) if len(diffs) > 1 else diffs[0]
    known = [d.isNotNull() for d in diffs]
    ok = known[0]
    for k in known[1:]:
        ok = ok & k
    return a.join(b, list(keys), "full_outer").select(*keys, worst.alias("max_abs_error"), F.coalesce(ok & (worst <= tolerance), F.lit(False)).alias("passed"))


def threshold_ties(df: DataFrame, group: Sequence[str], score: str = "score") -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.when(F.col(score) == F.col("threshold"), 1)).alias("ties"))


def outcome(label: str = "label", prediction: str = "prediction") -> Column:
    y, a = F.col(label) == 1, F.col(prediction) == 1
    return F.when(y & a, "TP").when(~y & a, "FP").when(~y & ~a, "TN").otherwise("FN")


def evidence_cases(df: DataFrame, group: Sequence[str], ident: str = "window_id", score: str = "score") -> DataFrame:
    """One window per outcome: the TP furthest above the threshold; of FP, FN, TN the one nearest to it. Ties go to the smaller id."""
    kind = outcome()
    margin = F.col(score) - F.col("threshold")
    far = F.when(kind == "TP", -margin).otherwise(F.abs(margin))
    best = df.groupBy(*group, kind.alias("outcome")).agg(F.min(F.struct(F.round(far.cast("double"), 9).alias("d"), F.col(ident).alias("id"))).alias("b"))
    return best.select(*group, "outcome", F.col("b.id").alias(ident))


def first_evidence(df: DataFrame, group: Sequence[str], order: Sequence[str], ident: str = "window_id") -> DataFrame:
    """The first TN and the first TP in file order."""
    best = df.withColumn("outcome", outcome()).where("outcome in ('TN', 'TP')").groupBy(*group, "outcome").agg(F.min(F.struct(*order, ident)).alias("b"))
    return best.select(*group, "outcome", F.col(f"b.{ident}").alias(ident))


def throughput(runs: DataFrame, windows: str = "windows", seconds: str = "inference_time_seconds") -> DataFrame:
    return runs.withColumn("windows_per_second", F.try_divide(windows, seconds))

