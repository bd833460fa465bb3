"""Runs of consecutive anomaly windows and the delay until the first alarm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winaudit.functions.ordering import ranged
from winaudit.functions.radix import quantiles


def anomaly_segments(df: DataFrame, file: Sequence[str], order: str, score: str = "score") -> DataFrame:
    """One row per run of label 1 in a file, by window order. df: label, prediction, family, window_id. A null label is benign.

    Rows are sorted in range partitions; each part of a file there finds its runs by itself and reports whether it begins and ends
    inside one. The table of these reports, a row per part, says which first runs go on from the part before, and how many
    runs and windows come before; pieces of a run then get one number and are merged. Neither files nor runs have to fit in a task.
    """
    keys = list(file)
    rows = ranged(df.select(*keys, order, (F.coalesce("label", F.lit(0)) == 1).alias("__on"), "prediction", "family", "window_id", F.col(score).alias("__score")), keys, [order])
    w = Window.partitionBy(*keys, "__pid").orderBy("__row")
    begin = (F.col("__on") & ~F.coalesce(F.lag("__on").over(w), F.lit(False))).cast("long")
    placed = rows.select("*", (F.row_number().over(w) - 1).alias("__at"), begin.alias("__begin")).withColumn("__run", F.sum("__begin").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*keys, "__pid").agg(F.min_by("__on", "__row").alias("starts_on"), F.max_by("__on", "__row").alias("ends_on"), F.count("*").alias("n"))
    begun = placed.groupBy(*keys, "__pid").agg(F.max("__run").alias("runs"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in (*keys, "__pid")]
    parts = parts.alias("a").join(begun.alias("b"), same("a", "b")).select("a.*", "b.runs")
    in_file = Window.partitionBy(*keys).orderBy("__pid")  # a row per part of the file
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = (F.col("starts_on") & F.coalesce(F.lag("ends_on").over(in_file), F.lit(False))).cast("long")
    parts = parts.withColumn("goes_on", goes_on).select(
        *keys, "__pid", "goes_on", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("windows_before"), F.coalesce(F.sum(F.col("runs") - F.col("goes_on")).over(before), F.lit(0)).alias("runs_before")
    )
    pieces = placed.where("__on").groupBy(*keys, "__pid", "__run").agg(
        F.min(F.struct("__at", "window_id", "family")).alias("first"), F.max(F.struct("__at", "window_id")).alias("last"), F.count("*").alias("length"), F.max("prediction").alias("detected"),
        F.min(F.when(F.col("prediction") == 1, F.col("__at"))).alias("alarm"), F.max("__score").alias("max_score"), F.sum(F.col("__score").cast("double")).alias("total"), F.count("__score").alias("scored"),
    )
    told = pieces.alias("a").join(parts.alias("b"), same("a", "b")).select("a.*", (F.col("runs_before") + F.col("__run") - F.col("goes_on")).alias("segment"), "windows_before")
    runs = told.groupBy(*keys, "segment").agg(
        F.min_by("first", "__pid").alias("first"), F.max_by("last", "__pid").alias("last"), F.sum("length").alias("length"), F.max("detected").alias("detected"), F.min(F.col("first.__at") + F.col("windows_before")).alias("start"),
        F.min(F.col("alarm") + F.col("windows_before")).alias("alarm"), F.max("max_score").alias("max_score"), (F.sum("total") / F.sum("scored")).alias("mean_score"),
    )
    return runs.select(
        *keys, "segment", F.col("first.family").alias("family"), F.col("first.window_id").alias("start_window_id"), F.col("last.window_id").alias("end_window_id"),
        "length", "detected", (F.col("alarm") - F.col("start")).alias("delay"), "max_score", "mean_score",
    )


def delay_summary(segments: DataFrame, group: Sequence[str]) -> DataFrame:
    """Segments, detected ones, their share, and mean and median delay over detected ones (null if none is)."""
    out = segments.groupBy(*group).agg(F.count("*").alias("segments"), F.sum("detected").alias("detected"), F.avg(F.col("detected").cast("double")).alias("detection_rate"), F.avg("delay").alias("mean_delay"))
    median = quantiles(segments.select(*group, "delay"), group, "delay", {"median_delay": 0.5})
    return out.join(median, list(group), "left") if group else out.join(median, how="left")
