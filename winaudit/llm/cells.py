"""All rows against a stated set of query rows, in cells of one block of rows and one of queries.

Blocks have a bounded number of rows, dealt by a hash; a cell's task holds one block of each
and gives back what a combiner would keep, so nothing grows with the table but the number of cells.
Scores are integers: inner products of components that are floors of scaled ones. They are taken
in doubles where these are exact, else in 64-bit integers; beyond those it is an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and queries of a cell, about; scores that are held at once.
ROWS, QUERIES, HELD = 8192, 4096, 1 << 20
#: Below any score: what is masked out.
NONE = -(1 << 62)


def sound(vector: Column) -> Column:
    """Neither null nor empty, without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def in_cells(rows: DataFrame, queries: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, n_rows: int, n_queries: int, block: int = ROWS, query_block: int = QUERIES) -> DataFrame:
    """work's rows over all cells; both frames have a unique `row`."""
    nb, nq = max(1, -(-n_rows // block)), max(1, -(-n_queries // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = rows.select("*", at(nb).alias("block"), every(nq).alias("part"))
    right = queries.select("*", at(nq).alias("part"), every(nb).alias("block"))
    names = right.columns
    right = right.toDF(*[f"__{c}" for c in names])  # both may come from one table; Spark tells their columns apart by name

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return work(a, b.rename_columns(names))

    return left.groupBy("block", "part").cogroup(right.groupBy("__block", "__part")).applyInArrow(cell, schema)


def components(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """floor(scale * x) of equally long vectors, as doubles."""
    flat = column.combine_chunks()
    dim = len(flat[0]) if len(flat) else 0
    return np.floor(scale * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(flat), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of a's rows with b's, as 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if most >= 1 << 62:
        raise OverflowError("these vectors' scores don't fit in 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest of each row that aren't NONE; a tie goes to the smaller column."""
    width = scores.shape[1]
    if not scores.size:
        return np.zeros(0, int), np.zeros(0, int)
    fits = np.abs(scores, where=scores != NONE, out=np.zeros_like(scores)).max() < 1 << 61 - width.bit_length()
    if fits and k < width:
        keyed = np.where(scores == NONE, NONE, scores * width + (width - 1 - np.arange(width)))
        top = np.argpartition(keyed, width - k, axis=1)[:, width - k :]
    else:
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    row, column = np.repeat(np.arange(len(scores)), top.shape[1]), top.ravel()
    real = scores[row, column] != NONE
    return row[real], column[real]


def by_id(table: pa.Table) -> pa.Table:
    """Rows by id, null last, then by row, so that a smaller place wins a tie."""
    return table.sort_by([("id", "ascending"), ("row", "ascending")])


def same_length(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(dim, rows, queries) for each length of `vector`; rows: vector, query."""
    found = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.count(F.when(F.col("query"), 1)).alias("q"))
    return sorted((r.dim, r.n, r.q) for r in found.toLocalIterator() if r.q)

