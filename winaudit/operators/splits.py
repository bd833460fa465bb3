"""Role-separated splits. Rows keep their order through `pos` columns; counts decide the cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winaudit.functions.ordering import with_position
from winaudit.functions.ranges import meeting_ranges

TRAIN, REFERENCE, CALIBRATION, TEST = "model_train_benign", "reference_benign", "independent_calibration_benign", "test"


def split_by_ts_ranges(df: DataFrame, ranges: DataFrame, ts: str = "ts_s") -> DataFrame:
    """A row for every closed [lo, hi] of ranges (split_role, lo, hi), however many, that holds its ts; none for a null ts."""
    return meeting_ranges(df, ranges, ts, ts).drop("lo", "hi")


def stable_order(df: DataFrame, keys: Sequence[str] = ("ts_s", "file_order", "row_index")) -> DataFrame:
    """Add order_pos, the place in the total order by keys."""
    return with_position(df, [], list(keys), "order_pos")


def _clamp(x: Column, lo: Column | int, hi: Column | int) -> Column:
    cast = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.greatest(cast(lo), F.least(x, cast(hi)))


def split_benign_calibration(df: DataFrame, ratio: float, order: Sequence[str], label: str = "label") -> DataFrame:
    """Benign rows in order: the last clamp(int(n * ratio), 1, n - 1) are for calibration. Adds benign_pos and split_role."""
    placed = with_position(df.where(F.col(label) == 0), [], list(order), "benign_pos", count="__n")
    n = F.col("__n")
    train = n - _clamp(F.floor(n * F.lit(ratio)), 1, n - 1)
    return placed.withColumn("split_role", F.when(F.col("benign_pos") < train, TRAIN).otherwise(CALIBRATION)).drop("__n")


def _refused(why: str, strict: bool) -> Column:
    """The role of rows in a group too short to cut: an error, or null."""
    return F.raise_error(F.lit(why)).cast("string") if strict else F.lit(None).cast("string")


def split_chrono(df: DataFrame, train: float, calibration: float, window: int, order: Sequence[str], group: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Cut each group's rows in order at int(n * share), train and test leaving room for a window. Adds pos and split_role.

    Where nothing is left for calibration, groups of up to two windows and a short train part, running the
    plan raises an error; with strict off their rows get the role null.
    """
    placed = with_position(df, list(group), list(order), "pos", count="__n")
    n, w = F.col("__n"), window
    first = F.greatest(F.floor(n * F.lit(train)), F.lit(w))
    second = F.least(F.greatest(F.floor(n * F.lit(train + calibration)), first + w), n - w)
    short = second <= first
    role = F.when(short, _refused("too few rows for train, calibration and test", strict)).when(F.col("pos") < first, TRAIN).when(F.col("pos") < second, CALIBRATION).otherwise(TEST)
    return placed.withColumn("split_role", role).drop("__n")


def split_benign_anomaly(benign: DataFrame, anomaly: DataFrame, window: int, order: Sequence[str], train: float = 0.6, calibration: float = 0.2, strict: bool = True) -> DataFrame:
    """Benign rows are cut in order, the anomaly rows all join the last part."""
    cut = split_chrono(benign, train, calibration, window, order, strict=strict)
    return cut.unionByName(anomaly.withColumns({"split_role": F.lit(TEST), "pos": F.lit(None).cast("long")}).select(*cut.columns))


def split_mixed(df: DataFrame, share: float, window: int, order: Sequence[str], file: str = "source_file", strict: bool = True) -> DataFrame:
    """Each file is cut at min(max(int(n * share), W), n - W): first part train, rest test.

    A file of no more than W rows has no cut: running the plan raises an error; with strict off its rows get the role null.
    """
    placed = with_position(df, [file], list(order), "pos", count="__n")
    n = F.col("__n")
    cut = F.least(F.greatest(F.floor(n * F.lit(share)), F.lit(window)), n - window)
    short = cut <= 0
    role = F.when(short, _refused("a file is too short for train and test", strict)).when(F.col("pos") < cut, TRAIN).otherwise(TEST)
    return placed.withColumn("split_role", role).drop("__n")


def draw_key(id_col: str, seed: int) -> Column:
    """A repeatable pseudo-random key of an integer id, the same in any SQL engine."""
    return F.pmod(F.pmod(F.col(id_col), F.lit(1 << 31)) * F.lit(2654435761) + F.lit(seed * 40503), F.lit(4294967296))


def split_random_benign(windows: DataFrame, share: float, seed: int, id_col: str, label: str = "label") -> DataFrame:
    """int(n * share) benign windows drawn by draw_key join all anomaly windows in the test part."""
    benign = windows.where(F.col(label) == 0).withColumn("__key", draw_key(id_col, seed))
    placed = with_position(benign, [], ["__key", id_col], "__at", count="__n")
    role = F.when(F.col("__at") < F.floor(F.col("__n") * F.lit(share)), TEST).otherwise(TRAIN)
    return placed.withColumn("split_role", role).drop("__key", "__at", "__n").unionByName(windows.where(F.col(label) != 0).withColumn("split_role", F.lit(TEST)))


def sample_rows(df: DataFrame, most: int, seed: int, id_col: str) -> DataFrame:
    """At most so many rows, drawn without replacement by draw_key."""
    return df.orderBy(draw_key(id_col, seed), id_col).limit(most)


def subset_prefix(windows: DataFrame, most: int, order: Sequence[str]) -> DataFrame:
    return windows.orderBy(*order).limit(most)


def subset_balanced(windows: DataFrame, most: int, order: Sequence[str], label: str = "label") -> DataFrame:
    """Half benign, half anomaly windows, the first of each; if one runs short the other fills up."""
    placed = with_position(windows, [label], list(order), "__at", count="__n")
    half = most // 2
    counts = F.col("__n")
    per = placed.groupBy(label).agg(F.first("__n").alias("__n")).agg(*[F.coalesce(F.max(F.when(F.col(label) == v, counts)), F.lit(0)).alias(f"n{v}") for v in (0, 1)]).first()
    zero = min(per.n0, half) + max(0, min(per.n0 - half, most - half - per.n1))
    one = min(per.n1, most - min(per.n0, half))
    return placed.where(F.col("__at") < F.when(F.col(label) == 0, zero).otherwise(one)).drop("__at", "__n")

