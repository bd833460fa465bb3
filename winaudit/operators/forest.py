"""A random forest over any number of vectors, whose deep nodes are grown where their rows are.

Features are cut into bins at quantiles. The upper levels of all trees are grown together, from counts per bin that tasks sum up before they
are shuffled. A node with few rows is grown to its end by one task, which gets that node's rows, and judges the rows that fall there; so
the trees below never leave their tasks, and a task holds NODE_ROWS or a NODE_SHARE-th of the rows for a node. Rows travel packed, many to a record.
Draws are hashes of a row and a tree, and features are drawn by tree and node; only Spark's approximate quantiles, that bins are cut at, may depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winaudit.functions.scratch import discard, materialize

#: Bins of a feature.
BINS = 32
#: Rows that a node is grown on by one task: this many, or this share of all rows if that is more (so upper levels have few nodes).
NODE_ROWS, NODE_SHARE = 32_768, 256
#: Rows to judge that a task gets for one node; a node with more is grown by several tasks.
JUDGED_ROWS = 1 << 21
#: Rows of a block, whose scores are summed together; by how many bits their ids are shifted.
_BLOCK = 14
_RESTS = {"tree": "int", "node": "int", "piece": "int", "rows": "int", "block": "long", "meta": "binary", "bins": "binary"}


@dataclass
class _Top:
    """The upper part of a tree; feature -1 ends it: at a leaf, or (local) where a task goes on, or (open) until the next level."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    share: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])
    local: list[bool] = field(default_factory=lambda: [False])

    def add(self, share: float, depth: int, local: bool) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.share, share), (self.depth, depth), (self.local, local)):
            column.append(x)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c, np.int64) for c in (self.feature, self.cut, self.left, self.right))


def _descend(bins: np.ndarray, tree: Sequence[np.ndarray]) -> np.ndarray:
    """The node at which each row ends."""
    feature, cut, left, right = tree
    at = np.zeros(len(bins), np.int64)
    live = np.arange(len(bins)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(live):
        node = at[live]
        node = np.where(bins[live, feature[node]] <= cut[node], left[node], right[node])
        at[live] = node
        live = live[feature[node] >= 0]
    return at


def _weights(ident: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often the tree draws each row: Poisson with mean 1, at most 15, from a hash (splitmix64)."""
    z = ident.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed * 1_000_003 + tree + 1)) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53
    return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(15)]), u, side="right")


def _purity(tot: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (pos * pos + (tot - pos) * (tot - pos)) / np.maximum(tot, 1)


def _best(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """counts (node, feature, bin, class) -> per node the feature's place (-1: no split gains), cut, sums, and sums of the left child."""
    upto = counts.cumsum(2).astype(float)
    pos, tot = upto[..., 1], upto.sum(-1)
    all_pos, all_tot = pos[:, :, -1:], tot[:, :, -1:]
    gain = _purity(tot, pos) + _purity(all_tot - tot, all_pos - pos) - _purity(all_tot, all_pos)
    gain[(tot == 0) | (tot == all_tot)] = 0
    flat = gain.reshape(len(counts), -1)
    at = flat.argmax(1)
    k = np.arange(len(counts))
    place, cut = np.divmod(at, counts.shape[2])
    place_or_none = np.where(flat[k, at] > 1e-9 * all_tot[:, 0, 0], place, -1)
    return place_or_none, cut, all_tot[:, 0, 0], all_pos[:, 0, 0], tot[k, place, cut], pos[k, place, cut]


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int, tries: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(feature, cut, left, right, share): the tree over these rows, a level at a time; each node tries `tries` features. Rows' order doesn't matter."""
    levels: list[tuple[np.ndarray, ...]] = []
    node, count, known = np.zeros(len(y), np.int64), 1, 1
    while count:
        tot = np.bincount(node, weight, count)
        pos = np.bincount(node, weight * y, count)
        feature, cut = np.full(count, -1), np.zeros(count, np.int64)
        left, right = np.zeros(count, np.int64), np.zeros(count, np.int64)
        levels.append((feature, cut, left, right, pos / np.maximum(tot, 1)))
        mixed = (pos > 0) & (pos < tot)
        count = 0
        if not depth or not mixed.any():
            break
        depth -= 1
        there = mixed[node]
        bins, y, weight, node = bins[there], y[there], weight[there], node[there]
        tried = np.sort(rng.random((len(mixed), bins.shape[1])).argpartition(tries - 1, 1)[:, :tries], 1)
        key = node[:, None] * tries + np.arange(tries)
        key = (key * BINS + bins[np.arange(len(y))[:, None], tried[node]]) * 2 + y[:, None]
        key = np.sort((key * 16 + weight[:, None]).ravel())
        w = key & 15
        up, up_pos = np.cumsum(w), np.cumsum(w * ((key >> 4) & 1))
        ends = np.flatnonzero(np.append(key[1:] >> 5 != key[:-1] >> 5, True))  # each bin's last row
        key, up, up_pos = key[ends] >> 5, up[ends], up_pos[ends]
        run = key // BINS  # a node's feature
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        size = np.diff(np.append(first, len(run)))
        before = np.where(first > 0, up[first - 1], 0), np.where(first > 0, up_pos[first - 1], 0)
        own = run // tries
        l_tot, l_pos = (up - np.repeat(before[0], size)).astype(float), (up_pos - np.repeat(before[1], size)).astype(float)
        gain = _purity(l_tot, l_pos) + _purity(tot[own] - l_tot, pos[own] - l_pos) - _purity(tot[own], pos[own])
        gain[l_tot == tot[own]] = 0
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        top = np.maximum.reduceat(gain, first)
        at = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(first, len(own)))))
        at = at[np.append(True, own[at[1:]] != own[at[:-1]])]  # the first of equals
        at = at[gain[at] > 1e-9 * tot[own[at]]]
        split = own[at]
        count = 2 * len(split)
        feature[split], cut[split] = tried[split, run[at] % tries], key[at] % BINS
        left[split], right[split] = known + np.arange(0, count, 2), known + np.arange(1, count, 2)
        there = feature[node] >= 0
        bins, y, weight, node = bins[there], y[there], weight[there], node[there]
        low = bins[np.arange(len(y)), feature[node]] <= cut[node]
        node = np.where(low, left[node], right[node]) - known
        known += count
    return tuple(np.concatenate(c) for c in zip(*levels, strict=True))


def _cuts(fit: DataFrame, vector: str, width: int) -> list[np.ndarray]:
    """Per feature up to BINS - 1 values; a row's bin is the number of those below its value. NaN comes last."""
    values = fit.select(F.posexplode(vector).alias("j", "x")).where("x is not null and not isnan(x)")
    fine = 32 * BINS
    found = {r.j: np.array(r.q, float) for r in values.groupBy("j").agg(F.percentile_approx("x", [i / fine for i in range(1, fine)], 10_000).alias("q")).collect()}
    out = []
    for j in range(width):
        q = found.get(j, np.zeros(0))
        few = np.unique(q)
        out.append(few if len(few) < BINS else np.unique(q[31::32]))
    return out


def _packed(x: np.ndarray) -> pa.Array:
    """A binary value a row."""
    n, width = x.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(x))])


def _binned(df: DataFrame, vector: str, cuts: list[np.ndarray]) -> DataFrame:
    """df: ident, y and the vector -> ident, y, bins."""
    width = len(cuts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b[vector]
            if b.num_rows and (np.diff(v.offsets.to_numpy()) != width).any():
                raise ValueError("vectors must be of one length")
            x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, width)
            bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b["ident"], b["y"], _packed(bins)], ["ident", "y", "bins"])

    return df.select("ident", "y", vector).mapInArrow(work, "ident long, y int, bins binary")


def _chunks(batches: Iterator[pa.RecordBatch], width: int, rows: int = 1 << _BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ident, y, bins) of some rows at a time, whatever the batches' size."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield _arrays(held, width)
            held, n = [], 0
    if n:
        yield _arrays(held, width)


def _arrays(batches: list[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(batches)
    return t["ident"].to_numpy(), t["y"].to_numpy(), _matrix(t["bins"], width)


def _matrix(packed: pa.ChunkedArray, width: int, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), kind).reshape(-1, width)


def _upper(fit: DataFrame, tops: list[_Top], width: int, tries: int, depth: int, limit: int, seed: int) -> None:
    """Grow all trees, a level at a time, until each node is a leaf or has at most `limit` rows. fit is read once a level."""
    todo = {t: [0] for t in range(len(tops))}
    while todo:
        tried = {t: np.sort(np.stack([np.random.default_rng([seed, t, n]).permutation(width)[:tries] for n in nodes]), 1) for t, nodes in todo.items()}
        shared = fit.sparkSession.sparkContext.broadcast([(t, tops[t].arrays(), np.array(nodes), tried[t]) for t, nodes in todo.items()])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {t: np.zeros((len(nodes), tries, BINS, 2), np.int64) for t, _, nodes, _ in shared.value}
            for ident, y, bins in _chunks(batches, width):
                for t, tree, nodes, features in shared.value:
                    w = _weights(ident, t, seed)
                    place = np.full(len(tree[0]), -1)
                    place[nodes] = np.arange(len(nodes))
                    mine = np.flatnonzero(w)
                    at = place[_descend(bins[mine], tree)]
                    mine, at = mine[at >= 0], at[at >= 0]
                    for j in range(tries):
                        key = ((at * tries + j) * BINS + bins[mine, features[at, j]]) * 2 + y[mine]
                        sums[t] += np.bincount(key, w[mine], sums[t].size).astype(np.int64).reshape(sums[t].shape)
            for t, s in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["tree", "counts"])

        def choose(table: pa.Table) -> pa.Table:
            t = table["tree"][0].as_py()
            nodes, features = next((n, f) for u, _, n, f in shared.value if u == t)
            total = np.zeros((len(nodes), tries, BINS, 2), np.int64)
            for c in table["counts"]:
                total += np.frombuffer(c.as_py(), np.int64).reshape(total.shape)
            place, cut, *sums = _best(total)
            feature = np.where(place < 0, -1, features[np.arange(len(nodes)), place])
            return pa.table({"tree": pa.array(np.full(len(nodes), t), pa.int32()), "node": pa.array(nodes, pa.int32()), "feature": pa.array(feature, pa.int32()), "cut": pa.array(cut, pa.int32()), "sums": pa.array(np.stack(sums, 1).tolist(), pa.list_(pa.float64()))})

        counted = fit.mapInArrow(count, "tree int, counts binary").groupBy("tree").applyInArrow(choose, "tree int, node int, feature int, cut int, sums array<double>")
        found = sorted(counted.collect(), key=lambda r: (r.tree, r.node))  # a row per node of the level
        shared.unpersist()
        todo = {}
        for r in found:
            top, (tot, pos, l_tot, l_pos) = tops[r.tree], r.sums
            top.share[r.node] = pos / max(tot, 1)
            if r.feature < 0:
                continue
            top.feature[r.node], top.cut[r.node] = r.feature, r.cut
            for side, (n, p) in ((top.left, (l_tot, l_pos)), (top.right, (tot - l_tot, pos - l_pos))):
                grows = 0 < p < n and top.depth[r.node] + 1 < depth
                child = top.add(p / n, top.depth[r.node] + 1, grows and n <= limit)
                side[r.node] = child
                if grows and n > limit:
                    todo.setdefault(r.tree, []).append(child)


def _spread(binned: DataFrame, tops, width: int, seed: int, judged: bool) -> DataFrame:
    """Rows packed by the tree and node where they end: with their draws and classes, or, those to judge, with their places in their block."""
    names = list(_RESTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ident, y, bins in _chunks(batches, width):
            blocks = ident >> _BLOCK if judged else np.zeros(len(ident), np.int64)
            for block in np.unique(blocks):
                its = np.flatnonzero(blocks == block)
                for t, (tree, local) in enumerate(tops.value):
                    if judged:
                        mine, meta = its, (ident[its] & ((1 << _BLOCK) - 1)).astype(np.uint16)
                        at = _descend(bins[mine], tree)
                    else:
                        w = _weights(ident, t, seed)
                        mine = np.flatnonzero(w)
                        at = _descend(bins[mine], tree)
                        mine, at = mine[local[at]], at[local[at]]
                        meta = (w[mine] * 2 + y[mine]).astype(np.uint8)
                    if not len(mine):
                        continue
                    order = at.argsort(kind="stable")
                    mine, at, meta = mine[order], at[order], meta[order]
                    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                    ends = [*first[1:], len(at)]
                    n = len(first)
                    packs = [[x[a:b].tobytes() for a, b in zip(first, ends, strict=True)] for x in (meta, bins[mine])]
                    same = lambda v, kind: pa.array(np.full(n, v), kind)
                    columns = [same(t, pa.int32()), pa.array(at[first], pa.int32()), same(0, pa.int32()), pa.array(np.diff(np.append(first, len(at))), pa.int32()), same(block if judged else -1, pa.int64()), *[pa.array(p, pa.binary()) for p in packs]]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return binned.mapInArrow(work, ", ".join(f"{n} {k}" for n, k in _RESTS.items()))


def forest_score(df: DataFrame, fit_on: DataFrame, vector: str, label: str, trees: int, depth: int, seed: int, name: str) -> DataFrame:
    """df with the mean share of label 1 in the leaves that a row ends in; null for a null vector.

    Each tree draws fit_on's rows with a Poisson of mean 1 (rows equal in all columns alike), a node tries the root of the number of features, rounded
    up, and is split by Gini impurity as long as that gains. Rows without label or vector aren't fitted on.
    """
    spark = df.sparkSession
    parallel = spark.sparkContext.defaultParallelism
    there = F.col(vector).isNotNull()
    known = fit_on.where(there & F.col(label).isNotNull()).select(F.xxhash64(*fit_on.columns).alias("ident"), (F.col(label) == 1).cast("int").alias("y"), vector)
    size = known.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first()
    if not size.n:
        raise ValueError("no rows to fit a forest on")
    cuts = _cuts(known, vector, size.width)
    fit = materialize(_binned(known.repartition(2 * parallel), vector, cuts), "forest_fit")
    tries, limit = math.ceil(math.sqrt(size.width)), max(NODE_ROWS, size.n // NODE_SHARE)
    tops = [_Top(local=[size.n <= limit]) for _ in range(trees)]
    if size.n > limit:
        _upper(fit, tops, size.width, tries, depth, limit, seed)

    rows = materialize(df.repartition(2 * parallel).withColumn("__ident", F.monotonically_increasing_id()), "forest_rows")
    judged = _binned(rows.where(there).select(F.col("__ident").alias("ident"), F.lit(0).alias("y"), vector), vector, cuts)
    width = size.width
    shared = spark.sparkContext.broadcast([(top.arrays(), np.array(top.local)) for top in tops])
    ends = spark.sparkContext.broadcast([(np.array(top.share), np.array(top.depth)) for top in tops])
    asked = materialize(_spread(judged, shared, width, seed, True), "forest_asked")
    taught = _spread(fit, shared, width, seed, False)
    many = asked.groupBy("tree", "node").agg(F.sum("rows").alias("n")).where(F.col("n") > JUDGED_ROWS)
    many = materialize(many.select("tree", "node", F.ceil(F.col("n") / JUDGED_ROWS).cast("int").alias("pieces")), "forest_pieces")
    pieces = {(r.tree, r.node): r.pieces for r in many.collect()}  # at most a node per tree and JUDGED_ROWS rows
    if pieces:
        asked_, taught_ = asked.join(F.broadcast(many), ["tree", "node"], "left"), taught.join(F.broadcast(many), ["tree", "node"], "left")
        asked_ = asked_.withColumn("piece", F.pmod(F.col("block"), F.coalesce("pieces", F.lit(1))).cast("int"))
        taught_ = taught_.withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
    else:
        asked_, taught_ = asked, taught

    def judge(table: pa.Table) -> pa.Table:
        t, at = table["tree"][0].as_py(), table["node"][0].as_py()
        block = table["block"].to_numpy()
        mine = table.filter(pa.array(block >= 0))
        shares, depths = ends.value[t]
        lesson = table.filter(pa.array(block < 0))
        out = []
        if mine.num_rows:
            if lesson.num_rows:
                meta = _matrix(lesson["meta"], 1)[:, 0].astype(np.int64)
                *tree, share = grow(_matrix(lesson["bins"], width), meta & 1, meta >> 1, depth - int(depths[at]), tries, np.random.default_rng([seed, t, at, 1]))
            else:
                tree, share = [np.full(1, -1), *[np.zeros(1, np.int64)] * 3], shares[at : at + 1]
            # Scores are 32-bit, so their sums are exact in doubles, in any order.
            out = [share[_descend(_matrix(b, width), tree)].astype(np.float32).tobytes() for b in (mine["bins"].slice(i, 1) for i in range(mine.num_rows))]
        return pa.table({"block": mine["block"], "meta": mine["meta"], "shares": pa.array(out, pa.binary())})

    tasks = max(8 * parallel, math.ceil(trees * size.n * (width + 1) / (1 << 27)))
    both = asked_.select(*_RESTS).unionByName(taught_.select(*_RESTS)).repartition(tasks, "tree", "node", "piece")
    votes = both.groupBy("tree", "node", "piece").applyInArrow(judge, "block long, meta binary, shares binary")

    def total(table: pa.Table) -> pa.Table:
        sums, seen = np.zeros(1 << _BLOCK), np.zeros(1 << _BLOCK, bool)
        for meta, shares in zip(table["meta"], table["shares"], strict=True):
            place = np.frombuffer(meta.as_py(), np.uint16)  # each once
            sums[place] += np.frombuffer(shares.as_py(), np.float32)
            seen[place] = True
        place = np.flatnonzero(seen)
        return pa.table({"__ident": pa.array((table["block"][0].as_py() << _BLOCK) + place, pa.int64()), name: pa.array(sums[place] / trees)})

    scores = materialize(votes.groupBy("block").applyInArrow(total, f"__ident long, `{name}` double"), "forest_scores")
    discard(fit, asked, many)
    return rows.join(scores, "__ident", "left").drop("__ident")
