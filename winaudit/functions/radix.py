"""Order statistics and running sums by the digits of values, for all groups at once.

A value becomes an integer key in the same order (for floats: their bits, by exact arithmetic); its leading digits
name a bucket. Counts per bucket are combined before the shuffle, a running sum over a group's buckets
places each bucket, and only then are values inside a bucket looked at. Whatever the rows of a group, no
window holds more than the buckets of one digit: 65,536 for 32-bit floats, 4,194,304 for others.
Null values take no part; NaN is above all numbers; -0.0 equals 0.0. Groups may be null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winaudit.functions.scratch import discard, materialize

#: By how many bits a key is shifted to give each level's bucket.
_SHIFTS = {"float": (16, 0), "other": (44, 22, 0)}


def with_key(df: DataFrame, value: str, name: str = "__k") -> DataFrame:
    """df with a long in the values' order, equal for equal values only; null for null.

    A float's key is its bits, negative for negative ones: the exponent is found by a logarithm, set right by
    comparison, and taken out; powers of two, and products and quotients by them, are exact. Each step is a projection of its own,
    so that what it uses several times is computed once.
    """
    kind = df.schema[value].dataType
    x = F.col(f"`{value}`")
    if isinstance(kind, T.IntegralType):
        return df.withColumn(name, x.cast("long"))
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        raise TypeError(f"{kind.simpleString()} values have no digits")
    mantissa, least = (23, -126) if isinstance(kind, T.FloatType) else (52, -1022)
    step = df.withColumn("__size", F.abs(x.cast("double")))
    size, power = F.col("__size"), F.col("__power")
    step = step.withColumn("__exponent", F.greatest(F.least(F.floor(F.coalesce(F.log2(size), F.lit(float(least)))), F.lit(1023)), F.lit(least)))
    step = step.withColumn("__power", F.pow(F.lit(2.0), F.col("__exponent")))
    off = F.when((size < power) & (F.col("__exponent") > least), -1).when(size / power >= 2, 1).otherwise(0)
    step = step.withColumn("__off", off)
    step = step.withColumns({"__exponent": F.col("__exponent") + F.col("__off"), "__power": power * F.when(F.col("__off") == 0, 1.0).when(F.col("__off") == 1, 2.0).otherwise(0.5)})
    normal = (F.col("__exponent") - (least - 1)) * F.lit(1 << mantissa) + ((size / power - 1) * F.lit(float(1 << mantissa))).cast("long")
    small = mantissa - least
    tiny = (size * F.lit(2.0 ** (small // 2)) * F.lit(2.0 ** (small - small // 2))).cast("long")
    infinite = F.lit((2 - 2 * least + 1) << mantissa)
    bits = F.when(F.isnan("__size"), infinite + 1).when(size == float("inf"), infinite).when(size < F.lit(2.0**least), tiny).otherwise(normal)
    step = step.withColumn("__bits", bits)
    return step.select(*[F.col(f"`{c}`") for c in df.columns], F.when(x < 0, -F.col("__bits")).otherwise(F.col("__bits")).alias(name))


def _shifts(df: DataFrame, value: str) -> tuple[int, ...]:
    return _SHIFTS["float" if isinstance(df.schema[value].dataType, T.FloatType) else "other"]


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """a joined with b's further columns where all keys agree, null ones too."""
    renamed = b.select(*[F.col(f"`{k}`").alias(f"__r{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in b.columns if c not in keys])
    cond = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)], F.lit(True))
    return a.join(renamed, cond, how).drop(*[f"__r{i}" for i in range(len(keys))])


def swept(df: DataFrame, group: Sequence[str], value: str, sums: Mapping[str, Column]) -> DataFrame:
    """One row per group and distinct value: the sums there; name_upto, their running sums in ascending order (this value included); name_all, the group's; next_value."""
    shifts = _shifts(df, value)
    narrow = df.where(F.col(f"`{value}`").isNotNull()).select(*group, value, *[c.alias(f"__s_{n}") for n, c in sums.items()])
    leaf = with_key(narrow, value).groupBy(*group, "__k").agg(F.min(value).alias(value), *[F.sum(f"__s_{n}").alias(n) for n in sums])
    above: DataFrame | None = None  # buckets of the level above: sums before them, totals, the next bucket's first value
    for level, shift in enumerate(shifts):
        last = level == len(shifts) - 1
        bucket = F.shiftright("__k", shift)
        rows = leaf if last else leaf.groupBy(*group, bucket.alias("__bucket")).agg(F.min(value).alias(value), *[F.sum(n).alias(n) for n in sums])
        rows = rows.withColumn("__bucket", bucket) if last else rows
        parent = [*group] if level == 0 else [*group, "__parent"]
        rows = rows if level == 0 else rows.withColumn("__parent", F.shiftright("__bucket", shifts[level - 1] - shift))
        part = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        order = part.orderBy("__bucket")
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.select("*", *[F.sum(n).over(upto).alias(f"__u_{n}") for n in sums], *([] if level else [F.sum(n).over(part).alias(f"{n}_all") for n in sums]), F.lead(value).over(order).alias("__next"))
        if above is not None:
            rows = _same(rows, above, parent).withColumns({**{f"__u_{n}": F.col(f"__u_{n}") + F.col(f"__o_{n}") for n in sums}, "__next": F.coalesce("__next", "__onext")})
        if last:
            return rows.select(*group, value, *sums, *[F.col(f"__u_{n}").alias(f"{n}_upto") for n in sums], *[f"{n}_all" for n in sums], F.col("__next").alias("next_value"))
        above = rows.select(*group, F.col("__bucket").alias("__parent"), *[(F.col(f"__u_{n}") - F.col(n)).alias(f"__o_{n}") for n in sums], *[f"{n}_all" for n in sums], F.col("__next").alias("__onext"))
    raise AssertionError


def selected(df: DataFrame, group: Sequence[str], value: str, ranks: Callable[[Column], Column], empty: str | None = None, count: str | None = None) -> DataFrame:
    """(group, item, n, found): the values at some 0-based ranks of each group's n values in ascending order, each as often as `count` says, if given.

    ranks gives, from n, an array of structs (item, rank). Rows are read once a digit, for all groups and ranks at
    once: the first reading counts all buckets, a further one those that hold a wanted rank. A group whose values are
    all null, or no row at all where there are no groups, has no row; with `empty` it is an error of that text.
    """
    shifts = _shifts(df, value)
    often = F.lit(1) if count is None else F.col(f"`{count}`")
    rows = with_key(df.select(*group, F.col(f"`{value}`").alias("__v"), often.cast("long").alias("__often")), "__v")
    if empty is None:
        rows = rows.where("__v is not null")
    elif not group:
        rows = rows.unionAll(df.sparkSession.range(1).select(F.lit(None).cast(rows.schema["__v"].dataType).alias("__v"), F.lit(0).cast("long").alias("__often"), F.lit(None).cast("long").alias("__k")))
    times = F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__often"))), F.lit(0)).alias("c")
    asked_in: DataFrame | None = None
    wanted: DataFrame | None = None  # (group, __bucketucket, w: array of (item, rank in the bucket), n)
    for level, shift in enumerate(shifts):
        bucket = F.shiftright("__k", shift).alias("__bucket")
        if wanted is None:
            counts = rows.groupBy(*group, bucket).agg(times, F.min("__v").alias("__v"))
            part = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
            n = F.sum("c").over(part)
            want = ranks(F.col("n"))
            counts = counts.withColumn("n", n)
            asked = want if empty is None else F.when(F.col("n") > 0, want).otherwise(F.raise_error(F.lit(empty)))
            counts = counts.withColumn("w", asked)
        else:
            upper = F.shiftright("__k", shifts[level - 1]).alias("__up")
            inside = _same(rows.select("*", upper), wanted.select(*group, F.col("__bucket").alias("__up")), [*group, "__up"])
            counts = inside.groupBy(*group, "__up", bucket).agg(times, F.min("__v").alias("__v"))
            part = Window.partitionBy(*group, "__up")
            counts = _same(counts, wanted.withColumnRenamed("__bucket", "__up"), [*group, "__up"]).drop("__up")
        # Buckets come with the ranks that are asked in what they are part of; each keeps those that fall in it.
        parts = [*group] if level == 0 else [*group, "__p"]
        counts = counts if level == 0 else counts.withColumn("__p", F.shiftright("__bucket", shifts[level - 1] - shift))
        part = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
        before = F.coalesce(F.sum("c").over(part.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", before)
        mine = F.filter("w", lambda x: (x["rank"] >= F.col("before")) & (x["rank"] < F.col("before") + F.col("c")))
        wanted = counts.withColumn("w", mine).where(F.size("w") > 0)
        wanted = wanted.withColumn("w", F.transform("w", lambda x: F.struct(x["item"].alias("item"), (x["rank"] - F.col("before")).alias("rank"))))
        if level == len(shifts) - 1:
            return wanted.select(*group, F.explode("w").alias("x"), "n", F.col("__v").alias("found")).select(*group, F.col("x.item").alias("item"), "n", "found")
        before_ = asked_in
        asked_in = wanted = materialize(wanted.select(*group, "__bucket", "w", "n"), "wanted")  # as many rows as ranks at most; Spark knows its size
        discard(before_)
    raise AssertionError


def quantiles(df: DataFrame, group: Sequence[str], value: str, shares: Mapping[str, float], empty: str | None = None, count: str | None = None) -> DataFrame:
    """(group and one column per name): linearly interpolated quantiles as doubles, exact. Values come as often as `count` says, if given.

    Groups without values have no row, or are an error of the text `empty`.
    """
    names = list(shares)
    h = lambda n, i: (n - 1) * F.lit(float(shares[names[i]]))

    def ranks(n: Column) -> Column:
        ends = [F.struct(F.lit(2 * i + up).alias("item"), f(h(n, i)).cast("long").alias("rank")) for i in range(len(names)) for up, f in ((0, F.floor), (1, F.ceil))]
        return F.array(*ends)

    found = selected(df, group, value, ranks, empty, count)
    at = lambda k: F.max(F.when(F.col("item") == k, F.col("found").cast("double")))
    ends = found.groupBy(*group).agg(F.max("n").alias("__n"), *[at(k).alias(f"__e{k}") for k in range(2 * len(names))])
    if not group:
        ends = ends.where("__n is not null")
    between = [(F.col(f"__e{2 * i}") + (F.col(f"__e{2 * i + 1}") - F.col(f"__e{2 * i}")) * (h(F.col("__n"), i) - F.floor(h(F.col("__n"), i)))).alias(name) for i, name in enumerate(names)]
    return ends.select(*group, *between)


def located(points: DataFrame, group: Sequence[str], value: str, asked: DataFrame, at: str) -> DataFrame:
    """asked's rows with the columns of the swept() row of their group whose value equals `at`. asked's values must have been among the swept ones."""
    return _same(asked.withColumnRenamed(at, value), points, [*group, value]).withColumnRenamed(value, at)
