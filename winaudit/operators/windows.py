"""Fixed-length sliding windows over ordered segments.

Rows are summed into blocks of g = gcd(window, stride) rows; a block is then
handed to the at most window / stride windows that hold it. What is shuffled
after the first aggregation is one row in g, and no segment has to fit in a task.
A segment shorter than the window has none, and the last partial window is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winaudit.functions.ordering import with_position
from winaudit.functions.scratch import materialize

#: Rows of a piece of a segment whose windows a task cuts.
PIECE_ROWS = 4096


def segment_positions(df: DataFrame, segment: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add pos, 0-based in the segment, and seg_rows, its length."""
    return with_position(df, list(segment), list(order), "pos", count="seg_rows")


def _spread(blocks: DataFrame, window: int, stride: int, g: int) -> DataFrame:
    """blocks (block, seg_rows) -> the same with w, one row per window that holds the block."""
    per_window, step = window // g, stride // g
    first = F.greatest(F.ceil((F.col("block") - (per_window - 1)) / step), F.lit(0))
    last = F.least(F.floor(F.col("block") / step), F.floor((F.col("seg_rows") - window) / stride))
    held = blocks.withColumn("__ws", F.when(first <= last, F.sequence(first, last)))
    return held.withColumn("w", F.explode("__ws")).drop("__ws")


def sliding_windows(df: DataFrame, segment: Sequence[str], window: int, stride: int, sums: Mapping[str, Column] | None = None, mins: Mapping[str, Column] | None = None, maxs: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per window: segment, w, start_pos, end_pos and the given aggregates. df: segment, pos, seg_rows.

    Minima and maxima may be of structs, so the first or last row's values are
    the minimum or maximum of a struct that begins with pos.
    """
    sums, mins, maxs = sums or {}, mins or {}, maxs or {}
    g = math.gcd(window, stride)
    block = F.floor(F.col("pos") / g).alias("block")
    aggs = [F.sum(c).alias(n) for n, c in sums.items()] + [F.min(c).alias(n) for n, c in mins.items()] + [F.max(c).alias(n) for n, c in maxs.items()]
    blocks = df.groupBy(*segment, block).agg(F.max("seg_rows").alias("seg_rows"), *aggs)
    joined = _spread(blocks, window, stride, g).groupBy(*segment, "w")
    out = joined.agg(F.count("*").alias("__blocks"), *[F.sum(n).alias(n) for n in sums], *[F.min(n).alias(n) for n in mins], *[F.max(n).alias(n) for n in maxs])
    start = F.col("w") * stride
    return out.select(*segment, "w", start.alias("start_pos"), (start + window - 1).alias("end_pos"), *sums, *mins, *maxs)


def with_label(windows: DataFrame, window: int, ratio: float, anomalies: str = "n_anomaly") -> DataFrame:
    """anomaly_ratio = anomalies / window; label 1 where it is at least `ratio`."""
    share = F.col(anomalies) / F.lit(float(window))
    return windows.withColumns({"anomaly_ratio": share, "label": (share >= F.lit(ratio)).cast("int")})


def benign_windows_only(windows: DataFrame) -> DataFrame:
    return windows.where(F.col("label") == 0)


def value_counts(df: DataFrame, segment: Sequence[str], window: int, stride: int, value: str) -> DataFrame:
    """(segment, w, value, n): how often each value occurs in each window; counts are handed on, not rows."""
    g = math.gcd(window, stride)
    blocks = df.groupBy(*segment, F.floor(F.col("pos") / g).alias("block"), value).agg(F.max("seg_rows").alias("seg_rows"), F.count("*").alias("n"))
    return _spread(blocks, window, stride, g).groupBy(*segment, "w", value).agg(F.sum("n").alias("n"))


def dominant_family(df: DataFrame, segment: Sequence[str], window: int, stride: int, family: str = "anomaly_type") -> DataFrame:
    """(segment, w, family): the most frequent family other than BENIGN; a tie goes to the smallest name. Windows without one are left out."""
    counts = value_counts(df.where(F.col(family) != "BENIGN"), segment, window, stride, family)
    best = counts.groupBy(*segment, "w").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(family).alias("family"))).alias("b"))
    return best.select(*segment, "w", F.col("b.family").alias("family"))


def entity_summary(df: DataFrame, segment: Sequence[str], window: int, stride: int, entity: str, k: int = 3) -> DataFrame:
    """(segment, w, summary): 'value(count),...' of the k most frequent, ties to the smaller value, then '+Nmore'."""
    counts = value_counts(df, segment, window, stride, entity)
    order = Window.partitionBy(*segment, "w").orderBy(F.desc("n"), F.col(entity).asc())  # a window's values at most
    top = counts.withColumn("__r", F.row_number().over(order)).groupBy(*segment, "w").agg(
        F.array_sort(F.collect_list(F.when(F.col("__r") <= k, F.struct("__r", F.concat(F.col(entity).cast("string"), F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("t"))))).alias("t"),
        F.greatest(F.count("*") - k, F.lit(0)).alias("more"),
    )
    text = F.array_join(F.transform("t", lambda x: x["t"]), ",")
    return top.select(*segment, "w", F.when(F.col("more") > 0, F.concat(text, F.lit(",+"), F.col("more").cast("string"), F.lit("more"))).otherwise(text).alias("summary"))


def short_segment_drops(df: DataFrame, segment: Sequence[str], window: int) -> DataFrame:
    """One row: segments shorter than the window, and their rows."""
    return df.groupBy(*segment).agg(F.count("*").alias("n")).where(F.col("n") < window).agg(F.count("*").alias("segments"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def numbered(df: DataFrame, role: str, roles: Sequence[str], file: str, index: str, name: str, prefix: str = "", width: int = 6) -> DataFrame:
    """Add name_index in the role and name_id 'role:prefix%0wd', a counter over all rows, roles in the given order, then files.

    `index` counts from 0 in each (role, file) without gaps, so only the segments are put in order: a row each, a role's at a time.
    """
    place = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col(role))
    sizes = df.groupBy(role, file).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(role).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    segments = sizes.select(role, file, "__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    segments = materialize(segments, "segments")
    totals = {r[role]: r.n for r in segments.groupBy(role).agg(F.sum("__n").alias("n"), F.first(place).alias("p")).orderBy("p").collect()}  # a row a role
    known, firsts = 0, []
    for r, n in totals.items():
        firsts += [F.lit(r), F.lit(known).cast("long")]
        known += n
    if not firsts:
        firsts = [F.lit(""), F.lit(0).cast("long")]
    out = df.join(segments.select(role, file, "__before"), [role, file])
    at = F.col("__before") + F.col(index)
    ident = F.concat(F.col(role), F.lit(f":{prefix}"), F.format_string(f"%0{width}d", F.element_at(F.create_map(*firsts), F.col(role)) + at))
    return out.withColumns({f"{name}_id": ident, f"{name}_index": at}).drop("__before")


def window_manifest(df: DataFrame, window: int, stride: int, ratio: float, roles: Sequence[str], segment: Sequence[str] = ("split_role", "source_file"), test: str = "test") -> DataFrame:
    """df: segment, pos, seg_rows, row_index, label, anomaly_type, ts_s. Outside the test role label, family and ratio are benign by definition."""
    row = F.struct("pos", "row_index", "ts_s")
    wins = sliding_windows(df, segment, window, stride, {"n_anomaly": F.col("label")}, {"__first": row}, {"__last": row})
    wins = with_label(wins, window, ratio).join(dominant_family(df, segment, window, stride), [*segment, "w"], "left")
    is_test = F.col("split_role") == test
    wins = wins.select(
        *segment, "w", "start_pos", "end_pos", F.col("__first.row_index").alias("start_row"), F.col("__last.row_index").alias("end_row"), F.col("__first.ts_s").alias("start_ts"), F.col("__last.ts_s").alias("end_ts"),
        F.when(is_test, F.col("label")).otherwise(0).alias("label"), F.when(is_test & (F.col("label") == 1), F.coalesce("family", F.lit("BENIGN"))).otherwise(F.lit("BENIGN")).alias("anomaly_family"),
        F.when(is_test, F.col("anomaly_ratio")).otherwise(0.0).alias("anomaly_ratio"), ((F.col("n_anomaly") > 0) & (F.col("n_anomaly") < window)).alias("mixed_label_window"),
    )
    wins = wins.withColumns({"start_line": F.col("start_row") + 2, "end_line": F.col("end_row") + 2, "benign_flag": F.col("label") == 0})
    wins = wins.withColumn("source_rows", F.concat(F.col("source_file"), F.lit(":"), F.col("start_row").cast("string"), F.lit("-"), F.col("end_row").cast("string")))
    return numbered(wins, "split_role", roles, "source_file", "w", "window")


def record_manifest(df: DataFrame, roles: Sequence[str]) -> DataFrame:
    """df: split_role, source_file and pos, as segment_positions() gives it."""
    out = numbered(df, "split_role", roles, "source_file", "pos", "record", "record:", 7)
    return out.withColumn("benign_flag", F.col("label") == 0)


def window_map(df: DataFrame, segment: Sequence[str], window: int, stride: int, cols: Sequence[str], work: Callable[[np.ndarray], dict[str, pa.Array]], schema: str, only: DataFrame | None = None, rows: int = PIECE_ROWS) -> DataFrame:
    """(segment, w and schema's columns): `work` on the windows' vectors, row after row of the window, as float32 matrices of one window a row.

    Segments are cut into pieces of about `rows` rows; a piece gets the window - 1 rows after its end once more, and its windows are cut
    inside the task, a few megabytes at a time. So a row moves 1 + window / rows times, not window / stride times, and vectors don't move.
    only (segment, w): the windows wanted. df: segment, pos, seg_rows as segment_positions() gives them; null features are NaN.
    """
    length = stride * math.ceil(max(rows, 2 * window) / stride)
    piece = F.floor(F.col("pos") / length)
    held = F.when((F.col("pos") % length < window - 1) & (piece > 0), F.array(piece - 1, piece)).otherwise(F.array(piece))
    x = F.array(*[F.col(f"`{c}`").cast("float") for c in cols])
    read = df.select(*segment, "pos", "seg_rows", x.alias("__x"))
    if only is None:
        read = read.withColumn("__wanted", F.lit(True))
    else:
        wanted = only.select(*segment, (F.col("w") * stride).alias("pos"), F.lit(True).alias("__wanted")).distinct()
        read = read.join(wanted, [*segment, "pos"], "left")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in segment)

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        pos, n = table["pos"].to_numpy(), table.num_rows
        if pos[-1] - pos[0] + 1 != n:
            raise ValueError("positions in a segment must count on from 0 without gaps")
        flat = table["__x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, len(cols))
        begin = table["piece"][0].as_py() * length - int(pos[0])  # 0, or later where a segment's piece begins inside the table
        starts = np.arange(begin, min(begin + length, n - window + 1), stride)
        starts = starts[table["__wanted"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)[starts]]
        step = max(1, (1 << 21) // (window * len(cols)))
        out = []
        for s in range(0, max(len(starts), 1), step):
            few = starts[s : s + step]
            made = work(np.stack([flat[i : i + window].ravel() for i in few]) if len(few) else np.zeros((0, window * len(cols)), np.float32))
            keys = {c: table[c].combine_chunks().take(pa.array(np.zeros(len(few), np.int64))) for c in segment}
            out.append(pa.table({**keys, "w": pa.array((pos[few] // stride).astype(np.int64)), **made}))
        return pa.concat_tables(out)

    pieces = read.withColumn("piece", F.explode(held))
    return pieces.groupBy(*segment, "piece").applyInArrow(cut, f"{kinds}, w long, {schema}")


def window_features(df: DataFrame, segment: Sequence[str], window: int, stride: int, cols: Sequence[str], only: DataFrame | None = None, rows: int = PIECE_ROWS) -> DataFrame:
    """(segment, w, features): the window's rows in order, flattened; for a job that needs the vectors themselves. A detector scores them in window_map()."""

    def vectors(x: np.ndarray) -> dict[str, pa.Array]:
        return {"features": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))}

    return window_map(df, segment, window, stride, cols, vectors, "features array<float>", only, rows)


def window_keys(df: DataFrame, segment: Sequence[str], window: int, stride: int) -> DataFrame:
    """(segment, w) of all windows; from the segments' lengths alone."""
    last = F.floor((F.col("n") - window) / stride)
    sizes = df.groupBy(*segment).agg(F.count("*").alias("n")).where(F.col("n") >= window)
    return sizes.select(*segment, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("w"))


def window_size_sweep(df: DataFrame, segment: Sequence[str], sizes: Sequence[int], stride: int, ratio: float) -> DataFrame:
    """Per window size and role-like segment: windows and anomaly windows."""
    out = None
    for size in sizes:
        one = with_label(sliding_windows(df, segment, size, stride, {"n_anomaly": F.col("label")}), size, ratio).withColumn("window_size", F.lit(size))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("window_size", segment[0]).agg(F.count("*").alias("windows"), F.sum("label").alias("anomaly_windows"))
