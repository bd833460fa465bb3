"""Hard-negative mining by slots between the positives' upper limits.

An anchor's positives are its k_pos best rows of the same label. A positive of score p takes
negatives (other labels) of scores from low * p to high * p. The positives' upper limits cut the
score axis into disjoint slots; each cell keeps the k best negatives a slot, and so does
the merge of all cells. The k best below any one upper limit are among the k best of the slots
below it, so going down the slots from a positive's own, merging, answers all windows,
which overlap, from one pass; the lower limit cuts off the answer's end.

Rows with a null label or a null, empty or non-finite vector take no part. Anchors are rows, and
so are others: repeated ids count each, null ids (never anchors) come last in ties. An anchor
without positives, or whose windows are empty (a negative score's are), has no rows.
Vectors of different lengths don't meet. An empty table gives none; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winaudit.functions.scratch import discard, materialize
from winaudit.llm.cells import HELD, NONE, QUERIES, ROWS, best, by_id, components, in_cells, products, same_length, sound


def _read(rows: pa.Table, anchors: pa.Table, scale: int) -> tuple[pa.Table, np.ndarray, np.ndarray, list[slice]]:
    """Rows by id, both sides' components, and the anchors in chunks."""
    rows = by_id(rows)
    step = max(1, HELD // rows.num_rows)
    return rows, components(rows["vector"], scale), components(anchors["vector"], scale), [slice(s, min(anchors.num_rows, s + step)) for s in range(0, anchors.num_rows, step)]


def _columns(out: list[tuple], names: tuple[str, ...]) -> pa.Table:
    cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * len(names)
    return pa.table(dict(zip(names, map(pa.array, cols), strict=True)))


def nearest_positives(rows: pa.Table, anchors: pa.Table, k: int, scale: int) -> pa.Table:
    """In a cell: each anchor's k best other rows of its label."""
    out = []
    if rows.num_rows and anchors.num_rows:
        rows, x, q, chunks = _read(rows, anchors, scale)
        own, label, mine, want = rows["row"].to_numpy(), rows["label"].to_numpy(), anchors["row"].to_numpy(), anchors["label"].to_numpy()
        for some in chunks:
            scores = products(q[some], x)
            scores[(want[some, None] != label[None, :]) | (mine[some, None] == own[None, :])] = NONE
            at, to = best(scores, k)
            out.append((mine[some][at], own[to], scores[at, to]))
    return _columns(out, ("anchor", "row", "score"))


def slotted(rows: pa.Table, anchors: pa.Table, k: int, scale: int) -> pa.Table:
    """In a cell: each anchor's k best negatives in each slot (previous upper limit, upper limit], none below its least lower limit."""
    out = []
    if rows.num_rows and anchors.num_rows:
        rows, x, q, chunks = _read(rows, anchors, scale)
        own, label, mine, want = rows["row"].to_numpy(), rows["label"].to_numpy(), anchors["row"].to_numpy(), anchors["label"].to_numpy()
        least, uppers = anchors["least"].to_numpy(), anchors["uppers"].to_pylist()  # a few upper limits, ascending
        for some in chunks:
            scores = products(q[some], x)
            scores[(want[some, None] == label[None, :]) | (scores < least[some, None])] = NONE
            for slot in range(max((len(u) for u in uppers[some]), default=0)):
                have = np.array([i for i, u in enumerate(uppers[some]) if len(u) > slot])
                upper = np.array([uppers[some][i][slot] for i in have])
                above = np.array([uppers[some][i][slot - 1] if slot else NONE for i in have])
                part = scores[have]
                part[(part > upper[:, None]) | (part <= above[:, None])] = NONE
                at, to = best(part, k)
                out.append((mine[some][have[at]], upper[at], own[to], part[at, to]))
    return _columns(out, ("anchor", "upper", "row", "score"))


def hard_negatives(table: DataFrame, is_anchor: Column, label: Column, scale: int, k_pos: int = 5, k_neg: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", block: int = ROWS, query_block: int = QUERIES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); low and high are per cent of the positive's score."""
    v = F.col(f"`{vector_col}`")
    read = table.where(sound(v)).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("query"), v.alias("vector"))
    rows = materialize(read.where("label is not null"), "vectors")
    names = rows.select("row", "id")
    answers = None
    for dim, n, q in same_length(rows):
        ours = rows.where(F.size("vector") == dim).drop("query")
        anchors = rows.where((F.size("vector") == dim) & F.col("query")).select("row", "label", "vector")
        near = in_cells(ours, anchors, lambda a, b: nearest_positives(a, b, k_pos, scale), "anchor long, row long, score long", n, q, block, query_block)
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        near = near.join(names, "row").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k_pos)
        # Positive scores only, whose windows aren't empty: the least score with 100 * score >= low * p, the greatest with 100 * score <= high * p.
        limits = [F.expr(f"(score * {low}L + 99) div 100").alias("lower"), F.expr(f"score * {high}L div 100").alias("upper")]
        positives = near.where("score >= 0").select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), *limits)
        positives = materialize(positives, "positives")
        limits = positives.groupBy(F.col("anchor").alias("row")).agg(F.min("lower").alias("least"), F.array_sort(F.collect_set("upper")).alias("uppers"))  # k_pos upper limits at most
        found = in_cells(ours, anchors.join(limits, "row"), lambda a, b: slotted(a, b, k_neg, scale), "anchor long, upper long, row long, score long", n, q, block, query_block)
        in_slot = Window.partitionBy("anchor", "upper").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        slots = found.join(names, "row").withColumn("place", F.row_number().over(in_slot)).where(F.col("place") <= k_neg)
        slots = materialize(slots.select("anchor", F.col("upper").alias("slot"), F.col("row").alias("negative"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "slots")
        # From a positive's own slot downwards: at most k_pos slots of k_neg rows each.
        down = Window.partitionBy("anchor", "place").orderBy(F.desc("slot"), F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative")
        merged = positives.join(slots, "anchor").where(F.col("slot") <= F.col("upper")).withColumn("rank", F.row_number().over(down))
        some = merged.where((F.col("rank") <= k_neg) & (F.col("negative_score") >= F.col("lower")))
        some = materialize(some.select("anchor", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
        discard(positives, slots)
        answers = some if answers is None else answers.unionAll(some)
    if answers is None:
        return table.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    named = answers.join(names.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
