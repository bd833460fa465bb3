"""Connected components of an edge table by alternating star contractions.

Each round hangs every node on the smallest node it knows of; a logarithmic
number of rounds leaves stars. Minima are aggregated before the shuffle and
written, so that joining them to a hub's many edges can be split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winaudit.functions.scratch import discard, materialize


def _hang(edges: DataFrame, both: bool) -> DataFrame:
    """edges (u > v). Large star if both: larger neighbours hang on the minimum; else small star: smaller ones and the node itself."""
    seen = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if both:
        seen = seen.unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = materialize(seen.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "least")
    joined = seen.join(least, "x")
    if both:
        out = joined.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("y").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    hung = materialize(out.where("u <> v").distinct(), "edges")
    discard(least)
    return hung


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component: the smallest node reachable) for the nodes of edges, except those that are components' smallest.

    Null ends and loops are ignored; repeated and reversed edges are one. No edges give no rows.
    """
    e = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        large = _hang(e, True)
        small = _hang(large, False)
        discard(e, large)
        e = small
