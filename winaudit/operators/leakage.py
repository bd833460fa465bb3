"""Split validation and leakage statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winaudit.functions.clean import MISSING


def split_validation(records: DataFrame, windows: DataFrame, role: str = "split_role", file: str = "source_file", ts: str = "ts_s") -> DataFrame:
    """Per role: records, windows, its files in order, and the time range."""
    per = records.groupBy(role).agg(F.count("*").alias("records"), F.array_join(F.array_sort(F.collect_set(file)), ",").alias("files"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
    return per.join(windows.groupBy(role).agg(F.count("*").alias("windows")), role, "left").withColumn("windows", F.coalesce("windows", F.lit(0)))


def roles_disjoint(records: DataFrame, train: str, calibration: str, test: str, role: str = "split_role", file: str = "source_file", row: str = "row_index") -> DataFrame:
    """Per file: last train and first calibration row, and whether train precedes calibration and test shares no row with them."""
    is_, r = (lambda v: F.col(role) == v), F.col(row)
    per = records.groupBy(file).agg(
        F.max(F.when(is_(train), r)).alias("last_train"), F.min(F.when(is_(calibration), r)).alias("first_calibration"),
        F.min(F.when(is_(test), r)).alias("first_test"), F.max(F.when(is_(train) | is_(calibration), r)).alias("last_fit"),
    )
    ok = F.coalesce(F.col("last_train") < F.col("first_calibration"), F.lit(True)) & F.coalesce(F.col("last_fit") < F.col("first_test"), F.lit(True))
    return per.withColumn("disjoint", ok)


def entity_overlap(records: DataFrame, entities: Sequence[str], role: str = "split_role") -> DataFrame:
    """(role_a, role_b, shared): entities seen in both roles. One shuffle of distinct pairs, then role sets per entity."""
    seen = records.select(role, F.explode(F.array(*[F.col(e).cast("string") for e in entities])).alias("entity")).where("entity is not null").distinct()
    sets = seen.groupBy("entity").agg(F.array_sort(F.collect_list(role)).alias("roles"))  # as many as there are roles
    pairs = F.flatten(F.transform("roles", lambda a: F.transform(F.filter("roles", lambda b: b > a), lambda b: F.struct(a.alias("role_a"), b.alias("role_b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.role_a", "p.role_b").agg(F.count("*").alias("shared"))


def leakage_stats(records: DataFrame, fields: Sequence[str], kind: str = "anomaly_type", role: str = "split_role", test: str = "test", least: int = 50, hours: Column | None = None) -> DataFrame:
    """Per (field, value): rows, anomaly rate, dominant type and its purity, benign-role and test rows.

    Rows are counted per (field, value, type, in test) before they meet, so a value that most rows
    share is no hot key. Values with fewer than `least` rows go, but hour buckets all stay.
    """
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    if hours is not None:
        pairs.append(F.struct(F.lit("hour").alias("field"), hours.cast("string").alias("value")))
    long = records.select(F.explode(F.array(*pairs)).alias("p"), F.col(kind).alias("kind"), "label", (F.col(role) == test).alias("t"))
    small = long.groupBy("p.field", "p.value", "kind", "t").agg(F.count("*").alias("n"), F.sum("label").alias("anomalies"))
    by_kind = small.groupBy("field", "value", "kind").agg(F.sum("n").alias("n"), F.sum("anomalies").alias("anomalies"), F.sum(F.when(F.col("t"), F.col("n")).otherwise(0)).alias("in_test"))
    out = by_kind.groupBy("field", "value").agg(F.sum("n").alias("rows"), F.sum("anomalies").alias("a"), F.sum("in_test").alias("test_rows"), F.min(F.struct((-F.col("n")).alias("m"), "kind")).alias("d"))
    out = out.where((F.col("rows") >= least) | (F.col("field") == "hour"))
    return out.select("field", "value", "rows", (F.col("a") / F.col("rows")).alias("anomaly_rate"), F.col("d.kind").alias("dominant_type"), (-F.col("d.m") / F.col("rows")).alias("purity"), (F.col("rows") - F.col("test_rows")).alias("benign_role_rows"), "test_rows")


def feature_inventory(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Per column its role group, distinct values (null counts as one) and share of missing-like values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("role_group"), F.col(c).cast("string").alias("v")) for c, r in roles.items()])).alias("p")).select("p.*")
    counts = long.groupBy("column", "role_group", "v").agg(F.count("*").alias("n"))
    missing = F.col("v").isNull() | F.lower(F.trim("v")).isin(*MISSING)
    return counts.groupBy("column", "role_group").agg(F.count("*").alias("distinct_values"), (F.sum(F.when(missing, F.col("n")).otherwise(0)) / F.sum("n")).alias("missing_ratio"))


def anomaly_mix(windows: DataFrame, test: str = "test", role: str = "split_role", family: str = "family") -> DataFrame:
    return windows.where(F.col(role) == test).groupBy(family).agg(F.count("*").alias("windows"))
