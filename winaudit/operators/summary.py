"""Summaries over runs: models, families, paired differences, recommendations, result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two-sided 95 % quantiles of Student's t by degrees of freedom; beyond them 1.96.
T95 = {
    1: 12.706204736432095, 2: 4.302652729696142, 3: 3.182446305284263, 4: 2.7764451051977987, 5: 2.5705818366147395, 6: 2.4469118511449692, 7: 2.3646242515927844, 8: 2.306004135204166, 9: 2.2621571628540993,
}


def _long(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return runs.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.metric", "c.value")


def model_summary(runs: DataFrame, metrics: Sequence[str], failed: Column | None = None, model: str = "model") -> DataFrame:
    """Per (model, metric): n, mean, std (ddof 1; 0 for one run), median, min, max, t-based 95 % interval, failures, and 'mean±std'."""
    runs = runs.withColumn("__failed", (failed if failed is not None else F.lit(False)).cast("int"))
    per = _long(runs, [model, "__failed"], metrics).groupBy(model, "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.expr("percentile(value, 0.5)").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("__failed").alias("failures")
    )
    table = F.create_map(*[F.lit(x) for kv in T95.items() for x in kv])
    half = F.when(F.col("n") > 1, F.coalesce(F.try_element_at(table, (F.col("n") - 1).cast("int")), F.lit(1.96)) * F.col("std") / F.sqrt("n")).otherwise(0.0)
    text = F.concat(F.format_string("%.4f", "mean"), F.lit("±"), F.format_string("%.4f", "std"))
    return per.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half, "text": text})


def family_summary(stats: DataFrame, metrics: Sequence[str] = ("recall", "mean_score", "mean_margin"), keys: Sequence[str] = ("model", "family")) -> DataFrame:
    return stats.groupBy(*keys).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def paired_differences(runs: DataFrame, metrics: Sequence[str], first: str, second: str, model: str = "model", seed: str = "seed") -> DataFrame:
    """Per seed the metrics of `second` minus those of `first`."""
    a = runs.where(F.col(model) == first).select(seed, *[F.col(m).alias(f"__{m}") for m in metrics])
    b = runs.where(F.col(model) == second).select(seed, *metrics)
    return b.join(a, seed).select(seed, *[(F.col(m) - F.col(f"__{m}")).alias(f"delta_{m}") for m in metrics])


def paired_stats(deltas: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per metric: mean, std, median, min, max, mean ± 1.96 std / sqrt(n), t statistic and wins of the second model."""
    per = _long(deltas, [], [f"delta_{m}" for m in metrics]).groupBy("metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.expr("percentile(value, 0.5)").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.when(F.col("value") > 0, 1)).alias("wins")
    )
    error = F.col("std") / F.sqrt("n")
    return per.withColumns({"ci_low": F.col("mean") - 1.96 * error, "ci_high": F.col("mean") + 1.96 * error, "t_statistic": F.try_divide(F.col("mean"), error)})


def model_recommendation(deltas: DataFrame, families: DataFrame, first: str, second: str, failures: Column | None = None, model: str = "model") -> DataFrame:
    """One row: A (second is better), B (no clear difference) or C (it depends on the family), with the gains and wins it follows from.

    deltas: delta_f1 and delta_auc, one row a seed. families: model, family, recall; and `failures`, a count over
    its rows of second's failed runs (none if not given). A: no failure, both mean gains above 0.01 and wins in all seeds but
    one at most. Else B: both gains within 0.01. Else C: a family gains more than 0.05 recall and another
    loses more. Else A if both gains are positive, B if not.
    """
    s = deltas.agg(
        F.avg("delta_f1").alias("f1_gain"), F.avg("delta_auc").alias("auc_gain"), F.count(F.when(F.col("delta_f1") > 0, 1)).alias("f1_wins"), F.count(F.when(F.col("delta_auc") > 0, 1)).alias("auc_wins"), F.count("*").alias("pairs"),
    )
    means = lambda m: F.avg(F.when(F.col(model) == m, F.col("recall")))
    per = families.groupBy("family").agg((means(second) - means(first)).alias("gain"))
    f = per.agg(F.coalesce(F.max("gain") > 0.05, F.lit(False)).alias("some_gain"), F.coalesce(F.min("gain") < -0.05, F.lit(False)).alias("some_lose"))
    failed = families.agg(F.coalesce(F.sum(failures), F.lit(0)).alias("failures")) if failures is not None else families.agg(F.lit(0).alias("failures"))
    both = s.join(f).join(failed)  # three rows of one
    enough = F.greatest(F.greatest("pairs", F.lit(1)) - 1, F.lit(1))
    clear = (F.col("failures") == 0) & (F.col("auc_gain") > 0.01) & (F.col("f1_gain") > 0.01) & (F.col("f1_wins") >= enough) & (F.col("auc_wins") >= enough)
    close = (F.abs("auc_gain") <= 0.01) & (F.abs("f1_gain") <= 0.01)
    choice = F.when(clear, "A").when(close, "B").when(F.col("some_gain") & F.col("some_lose"), "C").when((F.col("f1_gain") > 0) & (F.col("auc_gain") > 0), "A").otherwise("B")
    return both.select(choice.alias("recommended"), "f1_gain", "auc_gain", "f1_wins", "auc_wins", "pairs")


def upsert_results(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("dataset", "method", "target_fpr")) -> DataFrame:
    """New rows replace existing ones of the same key; target_fpr counts to 12 significant digits."""
    norm = lambda df: df.withColumn("target_fpr", F.format_string("%.12g", "target_fpr").cast("double"))
    old, fresh = norm(existing), norm(new)
    return old.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)

