"""Detectors that score window vectors: isolation forest, random forest, and Spark ML's perceptron."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winaudit.functions.scratch import discard, materialize
from winaudit.operators.forest import forest_score
from winaudit.operators.windows import window_features, window_keys, window_map

#: Rows that an isolation tree is grown on.
TREE_ROWS = 256


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int, nodes: list[tuple[int, float, int, int]]) -> int:
    """Append the tree over x; a node is (feature, cut, left, right), a leaf (-1, path length still expected, 0, 0)."""
    at = len(nodes)
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 and limit else np.zeros(0, int)
    if not len(spread):
        nodes.append((-1, _expected(len(x)), 0, 0))
        return at
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    nodes.append((f, cut, 0, 0))
    low = x[:, f] < cut
    left, right = _grow(x[low], rng, limit - 1, nodes), _grow(x[~low], rng, limit - 1, nodes)
    nodes[at] = (f, cut, left, right)
    return at


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def draw_for_trees(keys: DataFrame, ident: Sequence[str], trees: int = 100, seed: int = 0, rows: int = TREE_ROWS) -> DataFrame:
    """(ident, tree, at): for each tree the `rows` keys with the smallest hashes among those dealt to it, all if fewer.

    Keys are dealt by a hash, each to as many trees as it takes for all of them to get enough; tasks keep their own smallest before anything is shuffled.
    """
    n = keys.count()
    times = min(trees, max(1, -(-2 * trees * rows // max(n, 1))))
    dealt = keys.select(*ident, F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("__j"))
    tree = F.pmod(F.xxhash64(*ident, F.lit(seed)) + F.col("__j"), F.lit(trees)).cast("int")
    dealt = dealt.select(*ident, tree.alias("tree")).withColumn("at", F.xxhash64(*ident, "tree", F.lit(seed)))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("at", *ident))
    return dealt.withColumn("__place", place).where(F.col("__place") <= rows).drop("__place")


def grow_forest(samples: DataFrame, vector: str, seed: int = 0) -> tuple[list[np.ndarray], int]:
    """Trees over samples (tree, at, vector), each grown in a task from its own rows; and the most rows a tree got. Only nodes reach the driver, fewer than two a row."""

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        x = np.array(table[vector].to_pylist(), float).reshape(table.num_rows, -1)
        tree = table["tree"][0].as_py()
        nodes: list[tuple[int, float, int, int]] = []
        _grow(x, np.random.default_rng([seed, tree]), max(1, int(np.ceil(np.log2(max(len(x), 2))))), nodes)
        return pa.table({"tree": pa.array([tree], pa.int32()), "rows": pa.array([len(x)], pa.int64()), "nodes": pa.array([np.array(nodes, float).ravel()], pa.list_(pa.float64()))})

    grown = samples.where(F.col(vector).isNotNull()).select("tree", "at", vector).groupBy("tree").applyInArrow(grow, "tree int, rows long, nodes array<double>")
    found = sorted(grown.collect(), key=lambda r: r.tree)
    return [np.array(r.nodes).reshape(-1, 4) for r in found], max((r.rows for r in found), default=0)


def fit_iforest(df: DataFrame, vector: str, ident: str, trees: int = 100, seed: int = 0, rows: int = TREE_ROWS) -> tuple[list[np.ndarray], int]:
    """A forest over df's rows with a vector, told apart by ident."""
    drawn = draw_for_trees(df.where(F.col(vector).isNotNull()).select(ident).distinct(), [ident], trees, seed, rows)
    return grow_forest(df.select(ident, vector).join(drawn, ident), vector, seed)


def fit_window_iforest(df: DataFrame, segment: Sequence[str], window: int, stride: int, cols: Sequence[str], trees: int = 100, seed: int = 0, rows: int = TREE_ROWS) -> tuple[list[np.ndarray], int]:
    """A forest over flattened windows: they are drawn by their keys, and only the drawn ones' vectors are made."""
    keys = [*segment, "w"]
    drawn = materialize(draw_for_trees(window_keys(df, segment, window, stride), keys, trees, seed, rows), "drawn")
    vectors = window_features(df, segment, window, stride, cols, only=drawn)
    forest = grow_forest(vectors.join(drawn, keys), "features", seed)
    discard(drawn)
    return forest


def _paths(x: np.ndarray, trees: list[np.ndarray]) -> np.ndarray:
    """Summed path lengths of x's rows. NaN goes right."""
    path = np.zeros(len(x))
    for tree in trees:
        at, depth, feature = np.zeros(len(x), int), np.zeros(len(x)), tree[:, 0].astype(int)
        live = feature[at] >= 0
        while live.any():
            rows_ = np.flatnonzero(live)
            node = at[rows_]
            low = x[rows_, feature[node]] < tree[node, 1]
            at[rows_] = np.where(low, tree[node, 2], tree[node, 3]).astype(int)
            depth[rows_] += 1
            live = feature[at] >= 0
        path += depth + tree[at, 1]
    return path


def _anomaly(x: np.ndarray, forest: tuple[list[np.ndarray], int]) -> np.ndarray:
    trees, rows = forest
    return 2.0 ** (-_paths(x, trees) / max(len(trees), 1) / max(_expected(rows), 1e-9))


def iforest_score(df: DataFrame, vector: str, forest: tuple[list[np.ndarray], int], name: str = "score") -> DataFrame:
    """2 ** (-mean path / expected path): higher is more anomalous; null for a null vector."""
    shared = df.sparkSession.sparkContext.broadcast(forest)  # trees of fewer than 2 * rows nodes

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            real = batch.drop_null()
            out = np.full(len(batch), np.nan)
            there = batch.is_valid().to_numpy(zero_copy_only=False)
            if len(real):
                out[there] = _anomaly(np.array(real.to_pylist(), float).reshape(len(real), -1), shared.value)
            yield pa.array(out, mask=~there)

    return df.withColumn(name, score(F.col(vector)))


def iforest_window_score(df: DataFrame, segment: Sequence[str], window: int, stride: int, cols: Sequence[str], forest: tuple[list[np.ndarray], int], name: str = "score") -> DataFrame:
    """(segment, w, score) of all flattened windows, scored where they are cut."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    return window_map(df, segment, window, stride, cols, lambda x: {name: pa.array(_anomaly(x.astype(float), shared.value))}, f"{name} double")


def _supervised(df: DataFrame, fit_on: DataFrame, vector: str, label: str, name: str, model) -> DataFrame:
    ready = lambda d: d.withColumn("__v", array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))))
    fitted = model.fit(ready(fit_on).withColumn("__y", F.col(label).cast("double")))
    return fitted.transform(ready(df)).withColumn(name, vector_to_array("__p")[1]).drop("__v", "__p", "__raw", "__out")


def rf_window_score(df: DataFrame, fit_on: DataFrame, vector: str, label: str = "label", trees: int = 100, depth: int = 20, seed: int = 0, name: str = "score") -> DataFrame:
    """Probability of an anomaly by a random forest."""
    return forest_score(df, fit_on, vector, label, trees, depth, seed, name)


def mlp_window_score(df: DataFrame, fit_on: DataFrame, vector: str, dim: int, label: str = "label", layers: tuple[int, ...] = (256, 128, 64), steps: int = 100, seed: int = 0, name: str = "score") -> DataFrame:
    """Probability of an anomaly by a multilayer perceptron."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    model = MultilayerPerceptronClassifier(featuresCol="__v", labelCol="__y", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__out", layers=[dim, *layers, 2], maxIter=steps, seed=seed)
    return _supervised(df, fit_on, vector, label, name, model)
