"""Joins of rows with closed ranges [lo, hi].

Few ranges are broadcast. More become an interval index: one sweep over all ends gives every value a coordinate,
the number of ranges begun by then and of those over before, so a value lies in a range just if its coordinate lies
between those of the range's ends. Whether a row meets a range is then a difference of two look-ups. For the pairs,
coordinates are cut into aligned blocks of 1, 16, 256, ...: a range is a few blocks, a value lies in one of each size, and
they meet in exactly one. Costs don't depend on how long rows or ranges are, and no row is merged with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winaudit.functions.radix import located, swept

#: Ranges that are broadcast at most.
MOST_BROADCAST = 1_000
_FAN_BITS = 4


def _named(level: int, numbers: Column) -> Column:
    return F.transform(numbers, lambda x: F.struct(F.lit(level).alias("level"), x.alias("number")))


def _blocks(low: Column, high: Column, levels: int) -> Column:
    """The aligned blocks (level, number) that make up the coordinates from low to high; none if low > high."""
    out = []
    end = high + 1
    for level in range(levels):
        up, down = F.shiftright(low + (1 << _FAN_BITS) - 1, _FAN_BITS), F.shiftright(end, _FAN_BITS)
        inner = up < down if level < levels - 1 else F.lit(False)
        first = F.when(inner, F.shiftleft(up, _FAN_BITS)).otherwise(end)
        second = F.when(inner, F.shiftleft(down, _FAN_BITS)).otherwise(end)
        some = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        out.append(_named(level, F.concat(some(low, first), some(second, end))))
        low, end = F.when(inner, up).otherwise(F.lit(0).cast("bigint")), F.when(inner, down).otherwise(F.lit(0).cast("bigint"))
    return F.concat(*out)


def _around(at: Column, levels: int) -> Column:
    """The block of each size that holds a coordinate."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(at, _FAN_BITS * k).alias("number")) for k in range(levels)])


def meeting_ranges(df: DataFrame, ranges: DataFrame, since: str, until: str, how: str = "inner", most: int = MOST_BROADCAST) -> DataFrame:
    """Join df's rows with every one of ranges (lo, hi and more) that [since, until] meets; or, left_semi, keep the rows that meet any.

    Null ends meet nothing, nor do ranges with lo > hi or rows with since > until. Ends are whole numbers or floats, all of a kind. Up to `most` ranges are broadcast.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError(f"{how} joins with ranges aren't known")
    known = ranges.where("lo <= hi")
    rows = df.where(F.col(since) <= F.col(until))
    n = known.limit(most + 1).count()
    if n <= most:
        return rows.join(F.broadcast(known), (F.col(until) >= F.col("lo")) & (F.col(since) <= F.col("hi")), how)
    n = known.count()
    wrapped = rows.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(since).alias("__a"), F.col(until).alias("__b"))
    held = known.select(F.struct(*[F.col(f"`{c}`") for c in ranges.columns]).alias("range"), F.col("lo").alias("__a"), F.col("hi").alias("__b"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = known.select(F.col("lo").alias("v"), one.alias("l"), none.alias("h")).unionAll(known.select("hi", none, one))
    ends = ends.unionAll(wrapped.select("__a", none, none).distinct()) if since == until else ends.unionAll(wrapped.select(F.explode(F.array("__a", "__b")), none, none).distinct())
    points = swept(ends, [], "v", {"l": F.col("l"), "h": F.col("h")}).select("v", F.col("l_upto").alias("begun"), (F.col("h_upto") - F.col("h")).alias("over"))

    def placed(side: DataFrame, name: str) -> DataFrame:
        """side with the coordinates x and y of its ends, and begun and over there."""
        at = located(points, [], "v", side, "__a").withColumnsRenamed({"begun": "begun_a", "over": "over_a"})
        at = at.withColumns({"begun_b": F.col("begun_a"), "over_b": F.col("over_a")}) if since == until and name == "row" else located(points, [], "v", at, "__b").withColumnsRenamed({"begun": "begun_b", "over": "over_b"})
        return at.select(name, (F.col("begun_a") + F.col("over_a")).alias("x"), (F.col("begun_b") + F.col("over_b")).alias("y"), "over_a", "begun_b")

    at = placed(wrapped, "row")
    if how == "left_semi":
        return at.where("begun_b > over_a").select("row.*")
    levels = max(1, -(-(2 * n).bit_length() // _FAN_BITS))
    of = placed(held, "range")

    def pairs(points: DataFrame, spans: DataFrame) -> DataFrame:
        return points.join(spans, (points["k.level"] == spans["s.level"]) & (points["k.number"] == spans["s.number"])).select("row", "range")

    found = pairs(at.select("row", F.explode(_around(F.col("x"), levels)).alias("k")), of.select("range", F.explode(_blocks(F.col("x"), F.col("y"), levels)).alias("s")))
    if since != until:  # ranges that begin later in the row
        later = at.where("x < y").select("row", F.explode(_blocks(F.col("x") + 1, F.col("y"), levels)).alias("s"))
        found = found.unionAll(pairs(of.select("range", F.explode(_around(F.col("x"), levels)).alias("k")), later).select("row", "range"))
    return found.select("row.*", "range.*")
