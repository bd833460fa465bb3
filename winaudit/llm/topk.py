"""Exact top-k search by three phases with a uniform threshold.

A vector's components are dealt to SLICES lists; a row's score is the sum of its local scores.
1. Each cell gathers, per query and slice, the k best local scores; the k best over all
   cells are resolved exactly, and the k-th best of their sums is the query's cutoff: no
   row of its final k scores less.
2. The cutoff goes back to all cells. A row that reaches it has a local score of at least
   cutoff / SLICES somewhere, so each slice's list is collected down to there, ties included.
3. What a row lacks of the other slices is looked up for the collected ones only, and the k best
   of each cell that reach the cutoff are merged.

Candidates of a query are all rows but its own; rows that repeat an id, or have none (null,
never a query, last in ties), are rows of their own. Vectors that are null, empty or hold
null or non-finite components take no part, and vectors of different lengths don't meet.
An empty table gives none; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winaudit.functions.scratch import discard, materialize
from winaudit.llm.cells import HELD, NONE, QUERIES, ROWS, best, by_id, components, in_cells, products, same_length, sound

#: Lists that a vector's components are dealt to.
SLICES = 2


def _slices(dim: int, slices: int) -> list[slice]:
    bounds = np.linspace(0, dim, min(slices, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _chunks(n: int, width: int) -> list[slice]:
    step = max(1, HELD // max(1, width))
    return [slice(s, min(n, s + step)) for s in range(0, n, step)]


def local_lists(rows: pa.Table, queries: pa.Table, k: int, scale: int, slices: int) -> pa.Table:
    """Phase 1 in a cell: the rows with the k best local scores of each query and slice."""
    out = []
    if rows.num_rows and queries.num_rows:
        rows = by_id(rows)
        x, q = components(rows["vector"], scale), components(queries["vector"], scale)
        own, mine = rows["row"].to_numpy(), queries["row"].to_numpy()
        for part, some in ((p, s) for p in range(len(_slices(x.shape[1], slices))) for s in _chunks(len(q), len(x))):
            cut = _slices(x.shape[1], slices)[part]
            scores = products(q[some, cut], x[:, cut])
            scores[mine[some, None] == own[None, :]] = NONE
            at, to = best(scores, k)
            out.append((mine[some][at], np.full(len(at), part), own[to], scores[at, to]))
    cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table(dict(zip(("query", "slice", "row", "local"), map(pa.array, cols), strict=True)))


def above_cutoff(rows: pa.Table, queries: pa.Table, k: int, scale: int, slices: int) -> pa.Table:
    """Phases 2 and 3 in a cell: of each query's rows that reach its cutoff, the k best with their scores."""
    out = []
    if rows.num_rows and queries.num_rows:
        rows = by_id(rows)
        x, q = components(rows["vector"], scale), components(queries["vector"], scale)
        own, mine, cutoff = rows["row"].to_numpy(), queries["row"].to_numpy(), queries["cutoff"].to_numpy()
        cuts = _slices(x.shape[1], slices)
        for some in _chunks(len(q), len(x)):
            least = -(-cutoff[some] // len(cuts))
            known = np.zeros((some.stop - some.start, len(x)), np.uint8)  # bits: lists that have the entry
            total = np.zeros(known.shape, np.int64)
            for part, cut in enumerate(cuts):
                local = products(q[some, cut], x[:, cut])
                listed = local >= least[:, None]
                known[listed] |= np.uint8(1 << part)
                total[listed] += local[listed]
            known[mine[some, None] == own[None, :]] = 0
            at, to = np.nonzero(known)
            score = total[at, to]
            for part, cut in enumerate(cuts):
                lacks = np.flatnonzero(~known[at, to] & (1 << part))
                for s in range(0, len(lacks), 1 << 16):
                    few = lacks[s : s + (1 << 16)]
                    a, b = q[some][at[few], cut], x[to[few], cut]
                    exact = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 1 << 53
                    a, b = (a, b) if exact else (a.astype(np.int64), b.astype(np.int64))
                    score[few] += (a * b).sum(1).astype(np.int64)
            reach = score >= cutoff[some][at]
            at, to, score = at[reach], to[reach], score[reach]
            order = np.lexsort((to, -score, at))
            at, to, score = at[order], to[order], score[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            keep = place < k
            out.append((mine[some][at[keep]], own[to[keep]], score[keep]))
    cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("query", "row", "score"), map(pa.array, cols), strict=True)))


def top_k(table: DataFrame, is_query: Column, k: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", slices: int = SLICES, block: int = ROWS, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, id, score): each query row's k best of all other rows by integer inner product, all if fewer."""
    if not 1 <= slices <= 8:
        raise ValueError("1 to 8 slices")
    v = F.col(f"`{vector_col}`")
    read = table.where(sound(v)).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), v.alias("vector"))
    rows = materialize(read, "vectors")
    answers = None
    for dim, n, q in same_length(rows):
        ours = rows.where(F.size("vector") == dim).drop("query")
        queries = rows.where((F.size("vector") == dim) & F.col("query")).select("row", "vector")
        lists = in_cells(ours, queries, lambda a, b: local_lists(a, b, k, scale, slices), "query long, slice long, row long, local long", n, q, block, query_block)
        # The k best local scores over all cells, and the exact sums of their rows.
        ranked = lists.withColumn("place", F.row_number().over(Window.partitionBy("query", "slice").orderBy(F.desc("local"), "row"))).where(F.col("place") <= k)
        pairs = ranked.select("query", "row").distinct()
        theirs = queries.select(F.col("row").alias("query"), F.col("vector").alias("of_query"))
        whole = lambda c: F.transform(c, lambda x: F.floor(x.cast("double") * scale).cast("double"))
        sums = F.aggregate(F.zip_with(whole(F.col("vector")), whole(F.col("of_query")), lambda a, b: (a.cast("decimal(20,0)") * b.cast("decimal(20,0)")).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
        resolved = pairs.join(ours.select("row", "vector"), "row").join(theirs, "query").select("query", "row", sums.alias("score"))
        kth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row"))
        cutoffs = materialize(resolved.withColumn("place", kth).where(F.col("place") == k).select(F.col("query").alias("row"), F.col("score").alias("cutoff")), "cutoffs")
        told = queries.join(cutoffs, "row", "left").select("row", "vector", F.coalesce("cutoff", F.lit(-(1 << 61))).alias("cutoff"))
        found = in_cells(ours, told, lambda a, b: above_cutoff(a, b, k, scale, slices), "query long, row long, score long", n, q, block, query_block)
        some = materialize(found, "above_cutoff")
        discard(cutoffs)
        answers = some if answers is None else answers.unionAll(some)
    if answers is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    names = rows.select("row", "id")
    named = answers.join(names, "row").select("query", "row", "id", "score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    final = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return final.join(names.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query").select("query_id", "rank", "id", "score")
