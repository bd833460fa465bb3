"""Positions in a total order without a single-task window.

The rows are range-partitioned by (group, order) and sorted inside each
partition; a partition's rows are numbered locally, and the small table of
per-(group, partition) totals gives each its offset. No group, however large,
has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winaudit.functions.scratch import materialize

#: The condition of a counter that counts every row.
EVERY: Column = None  # type: ignore[assignment]
_LOCAL_BITS = 33  # monotonically_increasing_id(): partition above, row below


def ranged(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """df sorted over range partitions, with __pid and __row; written, so both stay as they are."""
    keys = [F.col(g).asc() for g in group] + [F.col(o).asc() if isinstance(o, str) else o for o in order]
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ident = F.monotonically_increasing_id()
    numbered = dealt.sortWithinPartitions(*keys).withColumn("__id", ident)
    return materialize(
        numbered.withColumn("__pid", F.shiftright("__id", _LOCAL_BITS)).withColumn("__row", F.col("__id").bitwiseAND((1 << _LOCAL_BITS) - 1)).drop("__id"),
        "ranged",
    )


def _same(group: Sequence[str]) -> Column:
    cond = F.col("a.__pid") == F.col("b.__pid")
    for g in group:
        cond = cond & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return cond


def with_positions(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], counters: Mapping[str, Column], totals: Mapping[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """Add, per counter, how many of its group's rows before this one fulfil its condition; totals maps counters to names for the group's whole number.

    Rows that tie in `order` come in an arbitrary order. An empty frame gives an empty frame.
    """
    totals = totals or {}
    r = ranged(df, group, order, partitions)
    local = Window.partitionBy(*group, "__pid").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    plain = {n for n, c in counters.items() if c is EVERY}  # these follow from the rows' numbers
    run = r if len(plain) == len(counters) else r.select("*", *[F.count(F.when(c, 1)).over(local).alias(f"__run_{n}") for n, c in counters.items() if n not in plain])
    per = r.groupBy(*group, "__pid").agg(F.min("__row").alias("__first"), *[(F.count("*") if n in plain else F.count(F.when(c, 1))).alias(f"__n_{n}") for n, c in counters.items()])
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = w.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*group, "__pid", "__first", *[F.coalesce(F.sum(f"__n_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in counters], *[F.sum(f"__n_{n}").over(w).alias(f"__tot_{n}") for n in totals])
    per = materialize(per, "offsets")  # a row per group and partition; Spark knows its size and broadcasts it if it is small
    out = run.alias("a").join(per.alias("b"), _same(group))
    at = {n: F.col("a.__row") - F.col("b.__first") if n in plain else F.col(f"a.__run_{n}") for n in counters}
    return out.select(*[F.col(f"a.`{c}`") for c in df.columns], *[(at[n] + F.col(f"b.__off_{n}")).alias(n) for n in counters], *[F.col(f"b.__tot_{n}").alias(name) for n, name in totals.items()])


def with_position(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "pos", count: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in its group, and the group's row count if `count` names a column.

    Rows that tie in `order` get distinct positions in an arbitrary order.
    An empty frame gives an empty frame.
    """
    return with_positions(df, group, order, {name: EVERY}, {name: count} if count else None, partitions)
