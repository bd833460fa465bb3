"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

A rotation of the principal directions is learnt so that signs lose little (ITQ);
several rotations give a code of balanced bits. The code is cut into substrings,
one per table; vectors that agree in a whole substring meet in that table's
bucket and are compared by cosine of the original vectors. Substrings widen with the
number of vectors, and tables and rotations are added with them until pairs at the
threshold meet with the probability RECALL: by the angle, and of pairs planted
about the sample. A pair counts in the first table where it meets, so no list of pairs
has to be deduplicated. Buckets are
worked in cells of two blocks of bounded size, however large they are.

Equal vectors form one class with a weight; counts weigh it, pairs don't
expand it. Vectors that are null, empty, zero or hold null or non-finite
components link with nothing, nor do rows with a null id (component null);
vectors of different lengths aren't compared. Rows that repeat an id count as
vectors of their own. The rotations are learnt from at most SAMPLE classes, those
with the smallest hash of their id; all vectors are indexed. An empty table
gives none; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winaudit.functions.scratch import materialize
from winaudit.llm.components import connected_components
from winaudit.llm.jaccard import arrow_batches

#: Vectors that rotations are learnt from, at most; rotations at least; components kept; steps of learning.
SAMPLE, ROTATIONS, COMPONENTS, STEPS = 20_000, 3, 64, 30
#: Vectors that a bucket holds on average, about; tables at least; vectors of a block.
OCCUPANCY, TABLES, BLOCK = 48, 16, 1024
#: Share of the pairs at the threshold that meet, at any number of vectors; pairs planted to measure it.
RECALL, PLANTED = 0.98, 4000
#: More tables than this aren't made: substrings are shortened instead, which only costs.
MOST_TABLES = 512


def learn(sample: np.ndarray, rotations: int = ROTATIONS, components: int = COMPONENTS, steps: int = STEPS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection of dim x (rotations * components)) whose signs are the code."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    mean = sample.mean(0) if len(sample) else np.zeros(dim)
    x = sample - mean
    _, _, axes = np.linalg.svd(x.T @ x)
    axes = axes[: min(components, dim)].T
    v = x @ axes
    out = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
        for _ in range(steps if len(v) else 0):
            code = np.where(v @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(v.T @ code)
            r = left @ right
        out.append(axes @ r)
    return mean, np.hstack(out)


def table_keys(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray, width: int, tables: int) -> np.ndarray:
    """One key per vector and table: the substring's bits under the table's number."""
    bits = (unit - mean) @ projection >= 0
    keys = np.empty((len(unit), tables), np.int64)
    place = 1 << np.arange(width, dtype=np.int64)
    for t in range(tables):
        keys[:, t] = bits[:, [(t * width + j) % bits.shape[1] for j in range(width)]] @ place + (np.int64(t) << 48)
    return keys


def tables_needed(width: int, threshold: float, recall: float = RECALL) -> int:
    """Tables in one of which a pair at cosine `threshold` agrees in all `width` bits with probability `recall`."""
    meet = (1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi) ** width
    return 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log1p(-meet)) if meet > 1e-9 else 1 << 40


def planted_recall(sample: np.ndarray, model: tuple[np.ndarray, np.ndarray], width: int, tables: int, threshold: float, seed: int = 7) -> float:
    """Share of pairs at cosine `threshold` that meet; the lesser of partners turned any way and towards other vectors of the sample."""
    rng = np.random.default_rng(seed)
    x = sample[rng.integers(0, len(sample), PLANTED)]
    met = []
    for towards in (rng.standard_normal(x.shape), sample[rng.integers(0, len(sample), PLANTED)]):
        aside = towards - (towards * x).sum(1, keepdims=True) * x
        length = np.sqrt((aside * aside).sum(1))
        some = length > 1e-6
        if some.any():
            y = threshold * x[some] + math.sqrt(max(0.0, 1 - threshold**2)) * aside[some] / length[some, None]
            met.append(float((table_keys(x[some], *model, width, tables) == table_keys(y, *model, width, tables)).any(1).mean()))
    return min(met, default=1.0)


def fit(sample: np.ndarray, n: int, threshold: float) -> tuple[tuple[np.ndarray, np.ndarray], int, int]:
    """(model, width, tables) for n vectors: pairs at the threshold meet with probability RECALL, whatever n."""
    width = min(max(8, math.ceil(math.log2(max(n, 2) / OCCUPANCY))), 40)
    while tables_needed(width, threshold) > MOST_TABLES:
        width -= 1
    tables = max(TABLES, tables_needed(width, threshold))
    per = max(1, min(COMPONENTS, sample.shape[1]))
    while True:
        model = learn(sample, max(ROTATIONS, math.ceil(tables * width / per)))
        if not width or planted_recall(sample, model, width, tables, threshold) >= RECALL:
            return model, width, tables
        if tables < 2 * max(TABLES, tables_needed(width, threshold)):
            tables += max(1, tables // 4)
        else:
            width -= 1
            tables = max(TABLES, tables_needed(width, threshold)) if width else 1


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim) if dim else flat.reshape(len(column), 0)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _cell(table: pa.Table, threshold: float) -> pa.Table:
    """Links of a cell's pairs: per class the weight of its partners, and a member of the component it has here."""
    n = table.num_rows
    ids, weight, block = (table[c].to_numpy() for c in ("class_id", "weight", "block"))
    vectors = table["vector"].combine_chunks()
    unit = _unit(_vectors(vectors, len(vectors[0]))) if n else np.zeros((0, 1))
    code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(n, -1)
    t, width = (int(table[c][0].as_py()) if n else 0 for c in ("at", "width"))
    low, high = (int(table[c][0].as_py()) if n else 0 for c in ("low", "high"))
    a = np.flatnonzero(block == low)
    b = a if low == high else np.flatnonzero(block == high)
    p, q = np.nonzero(unit[a] @ unit[b].T >= threshold)
    p, q = a[p], b[q]
    once = p < q if low == high else np.ones(len(p), bool)
    p, q = p[once], q[once]
    new = np.ones(len(p), bool)
    for s in range(0, len(p), 1 << 14):
        differ = np.unpackbits(code[p[s : s + (1 << 14)]] ^ code[q[s : s + (1 << 14)]], axis=1, count=t * width, bitorder="little")
        new[s : s + (1 << 14)] = differ.reshape(len(differ), t, width).any(2).all(1)
    p, q = p[new], q[new]
    links = np.bincount(p, weight[q], n) + np.bincount(q, weight[p], n)
    root = np.arange(n)
    while True:  # each sweep carries the smallest index one link further, and along the chain
        was = root.copy()
        np.minimum.at(root, p, root[q])
        np.minimum.at(root, q, root[p])
        root = root[root]
        if (root == was).all():
            break
    hit = links > 0
    return pa.table({"class_id": pa.array(ids[hit]), "links": pa.array(links[hit].astype(np.int64)), "root": pa.array(ids[root[hit]])})


def _links(classes: DataFrame, dim: int, threshold: float, block: int) -> DataFrame:
    """(class_id, links, root) of classes whose vectors have `dim` components."""
    spark = classes.sparkSession
    n = classes.count()
    picked = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    model, width, tables = fit(_unit(_vectors(picked, dim)), n, threshold)
    shared = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = table_keys(_unit(_vectors(batch["vector"], dim)), *shared.value, width, tables)
                bits = (keys[:, :, None] >> np.arange(width, dtype=np.int64) & 1).astype(np.uint8).reshape(len(keys), -1)
                code = [x.tobytes() for x in np.packbits(bits, axis=1, bitorder="little")]
                yield pa.RecordBatch.from_arrays([batch["class_id"], batch["weight"], batch["vector"], pa.array(list(keys), pa.list_(pa.int64())), pa.array(code, pa.binary())], names=["class_id", "weight", "vector", "keys", "code"])

    kind = classes.schema["vector"].dataType.simpleString()
    coded = materialize(classes.select("class_id", "weight", "vector").mapInArrow(encode, f"class_id long, weight long, vector {kind}, keys array<long>, code binary"), "codes")
    crowded = coded.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > block)
    crowded = materialize(crowded.select("key", F.ceil(F.col("count") / block).alias("blocks")), "crowded")
    placed = coded.select("class_id", "weight", "vector", "code", F.posexplode("keys").alias("at", "key")).join(crowded, "key", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("class_id"), blocks))
    cells = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    cells = cells.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "at", F.lit(width).alias("width"), "block", "class_id", "weight", "vector", "code")
    return materialize(cells.groupBy("key", "low", "high").applyInArrow(lambda t: _cell(t, threshold), "class_id long, links long, root long"), "links")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """Per row: id, n_links, component_id and kept."""
    v = F.col(vector_col)
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = materialize(table.select(F.col(id_col).cast("long").alias("id"), F.when(fine, v).alias("vector")), "vectors")
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("class_id"), F.count("*").alias("weight"))
    classes = materialize(classes.withColumn("dim", F.size("vector")), "vector_classes")
    found = None
    with arrow_batches(table.sparkSession, 2000, "16m"):
        for dim in sorted(r.dim for r in classes.select("dim").distinct().toLocalIterator()):
            some = _links(classes.where(F.col("dim") == dim), dim, threshold, block)
            found = some if found is None else found.unionAll(some)
    if found is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    counts = materialize(found.groupBy("class_id").agg(F.sum("links").alias("links")), "link_counts")
    parts = materialize(connected_components(found.select("class_id", "root"), "class_id", "root"), "components")
    named = classes.join(counts, "class_id", "left").join(parts, F.col("class_id") == F.col("node"), "left")
    named = named.select("vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    out = rows.join(materialize(named, "named_classes"), "vector", "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
