"""N-gram Jaccard join: exact pairs of similarity t or more by universe partition.

Sets whose similarity is at least 80 % differ in at most H = (r + s) / 9 shingles.
Shingles are dealt to m segments by hash. If the segments that a set uses
count for more than H, one of them must be (nearly) the same in any partner:
- a segment indexed by its subset counts one,
- a segment indexed also by its one-deletion neighbours counts two.
m and the kind are allotted to each size band by cost; a set is indexed in its own band
and, if partners may be larger than it, in the next. Shingles of high document
frequency make costly segments, so they are left out of the universe; a set with
too little left is indexed by its rarest shingles instead, each a segment of its
own. Either member of a pair being well covered suffices, and the rest meet there.

Sets that are equal form one class, a node of the join, named by 64 bits of its digest;
sets that share a name and differ, which a second digest tells, are named by another
seed. Each node has a sketch, a bitmap that every shingle flips a bit of: the bits in
which two sketches differ never outnumber the shingles in which the sets do, so pairs
that differ in too many bits are ruled out exactly, without moving sets. Crowded groups
of nodes that share an index key are linked to a leader first; of the rest, members of
the largest component there aren't compared with each other. Of the pairs left, each
component's most similar one is compared first; then those whose ends are still in
different components. Comparisons are exact, on 64-bit hashes of shingles.

Null text counts as empty; a text without words links with nothing. Rows that
repeat an id are rows like others; a null id never names a component that has
another. An empty table gives none; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winaudit.functions.scratch import discard, materialize
from winaudit.llm.components import connected_components
from winaudit.llm.words import mix, shingle_sets
from winaudit.llm.workers import tidy

#: Similarity in percent.
PERCENT = 80
#: A shingle in more documents than this is costly; so many of the costliest are left out at most (8 bytes each, broadcast).
COSTLY, MAX_COSTLY = 16, 1_000_000
#: Shingles or keys that one bucket gathers, about.
BUCKET = 500_000
#: Shingles or keys that a task holds before it sends them.
HELD = 500_000
#: Bits of the filter that keeps most sets that are no candidates from being shuffled; fixed size, false positives only cost.
FILTER_BITS = 1 << 25
#: Costs: of a row of the index, and of a false candidate group; chance that a shingle is shared by chance.
ROW, FALSE, SHARED = 1.0, 64.0, 0.2
#: Shingles a segment in bands indexed by subset alone.
LOAD = 3
#: Bits of a shingle by which its frequency is counted, at most; collisions cost, they don't err.
_FREQUENCY_BITS = 40
#: Members of a group that are compared in one block; rows of a task's share of blocks, about.
BLOCK, CELL_ROWS = 1024, 20_000
#: Members of a group from which it gets a leader; members of a cell whose pairs are listed for all cells at once.
CROWDED, SMALL = 2048, 64
#: Pairs that a cell lists per member at most; a cell with more gives those that span it, and is worked again.
LINEAR = 4
#: Pairs that are broadcast to the sets (16 bytes each) at most.
MANY_PAIRS = 100_000


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: str) -> Iterator[None]:
    """Bound the batches that Python workers get while jobs run inside."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@lru_cache
def _similarity(percent: int) -> tuple[int, int]:
    """|difference| <= (r + s) * a // b."""
    return 100 - percent, 100 + percent


def most_different(size: int, most: int, percent: int) -> int:
    """The largest difference that a set of `size` may have to a partner of at most `most` shingles."""
    a, b = _similarity(percent)
    return (size + min(most, size * 100 // percent)) * a // b


@lru_cache(maxsize=None)
def allot(top: int, percent: int) -> tuple[int, bool]:
    """Segments of the band of sizes up to `top`, and whether one-deletion neighbours are indexed: the cheaper way."""
    units = most_different(top, top, percent) + 1
    mean = 0.75 * top
    by_subset = math.ceil(top / LOAD)
    subset = units * (ROW + FALSE * SHARED ** (mean / by_subset))
    pairs = math.ceil(units / 2)
    near = pairs * ROW * (1 + mean / pairs) + pairs * FALSE * SHARED ** (mean / pairs)
    return (pairs, True) if near < subset else (by_subset, False)


def bands(size: int, percent: int) -> list[int]:
    """Tops of the bands in which a set is indexed; none if only an equal set can be a partner."""
    if most_different(size, size * 2, percent) < 1:
        return []
    top = 1 << max(size - 1, 1).bit_length()
    return [top, 2 * top] if size * 100 // percent > top else [top]


def index_keys(shingles: np.ndarray, costly: np.ndarray, rank: np.ndarray, percent: int = PERCENT, bits: int = _FREQUENCY_BITS) -> np.ndarray:
    """The index keys of one set. costly: sorted shingle prefixes of so many bits left out of the universe, rank: their frequencies."""
    tops = bands(len(shingles), percent)
    if not tops:
        return np.zeros(0, np.uint64)
    scattered = mix(shingles)
    short = shingles >> np.uint64(64 - bits)
    at = np.minimum(np.searchsorted(costly, short), max(len(costly) - 1, 0))
    heavy = costly[at] == short if len(costly) else np.zeros(len(shingles), bool)
    plain, out, lacking = scattered[~heavy], [], False
    for top in tops:
        need = most_different(len(shingles), top, percent) + 1
        m, near = allot(top, percent)
        segment = ((plain >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(segment, kind="stable")
        segment, own = segment[order], plain[order]
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(own) else np.zeros(0, np.int64)
        if len(first) == 0:
            lacking = True
            continue
        sums, counts, name = np.add.reduceat(own, first), np.diff(np.append(first, len(own))), segment[first] + np.uint64(top << 32)
        if near:
            lacking |= 2 * int((counts >= 2).sum()) < need
            each = np.repeat(np.arange(len(first)), counts)
            wide = counts[each] >= 2
            out += [mix(sums ^ mix(name)), mix((sums[each] - own)[wide] ^ mix(name[each][wide]))]
        else:
            lacking |= len(first) < need
            out.append(mix(sums[:need] ^ mix(name[:need])))
    if lacking:
        need = most_different(len(shingles), 2 * len(shingles), percent) + 1
        weight = np.where(heavy, rank[at] if len(costly) else 0, 0)
        rarest = np.lexsort((scattered, weight))[:need]
        out.append(mix(scattered[rarest] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return np.unique(np.concatenate(out))


class Naming:
    """Names of sets: the first seed's digest that no two different sets share. bits: of the first seed's digest, fewer in tests."""

    def __init__(self, shared: frozenset[int] = frozenset(), bits: int = 64):
        self.shared, self.bits = shared, bits

    def __call__(self, data: bytes) -> int:
        for seed in count():
            name = xxhash.xxh3_64_intdigest(data, seed)
            name = name >> (64 - self.bits) if not seed else name
            if name not in self.shared:
                return name


def _nodes(texts: pa.Array, seen: set[int], naming: Naming) -> Iterator[tuple[int, np.ndarray]]:
    """(node, set) of each distinct set that this task meets first."""
    for s in shingle_sets(texts):
        if len(s):
            node = naming(s.tobytes())
            if node not in seen:
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(node)
                yield node, s


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Bitmap of 64 bits or the power of two from the set's size on; each shingle flips one."""
    size = 1 << max(6, (len(shingles) - 1).bit_length())
    at = (mix(shingles) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketches of fewer bits that the same sets would have."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def document_sets(docs: DataFrame, id_col: str, text_col: str, naming: Naming) -> DataFrame:
    """id, text_hash, n (set size), node (the set's name), check (63 bits of another digest) and sketch."""
    schema = pa.schema([("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("sketch", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, check, bits = [], [], [], []
            for s in shingle_sets(batch["text"]):
                data = s.tobytes()
                n.append(len(s))
                node.append(_signed(naming(data)) if len(s) else None)
                check.append(xxhash.xxh3_64_intdigest(data, 1 << 40) >> 1)
                bits.append(sketch(s).tobytes() if len(s) else None)
            cols = [pa.array(c, f.type) for c, f in zip((n, node, check, bits), schema, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["text_hash"], *cols], names=["id", "text_hash", *schema.names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(tidy(sets), f"id {kind}, text_hash long, n long, node long, check long, sketch binary"), "sets")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted integers as their differences, byte by byte place, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return pa.compress(np.ascontiguousarray(steps.T), codec="zstd", asbytes=True)


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


def _by_bucket(values: np.ndarray, bits: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of sorted values of so many bits, and where each begins and ends."""
    place = ((values >> np.uint64(max(bits - 32, 0))) * np.uint64(buckets)) >> np.uint64(min(bits, 32))
    cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(values) else np.zeros(0, np.int64)
    return place[cuts].astype(np.int64), cuts, np.append(cuts[1:], len(values))


def pack_plain(values: np.ndarray, width: int) -> bytes:
    """The integers' lowest bytes, byte place by byte place, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T), codec="zstd", asbytes=True)


def unpack_plain(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data, decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def costly_shingles(docs: DataFrame, text_col: str, naming: Naming, total: int, buckets: int, more_than: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted shingle prefixes in more than so many distinct sets, their counts, and the prefixes' bits; the `most` most frequent.

    Tasks send their sets' prefixes counted and sorted, as packed differences, so a passage that
    all sets share is an entry a part. Any choice gives the right result, so the bound drops nothing.
    """
    bits = min(_FREQUENCY_BITS, max(24, total.bit_length() + 4))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            x, times = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
            held.clear()
            place, cuts, ends = _by_bucket(x, bits, buckets)
            spans = list(zip(cuts.tolist(), ends.tolist(), strict=True))
            packed = [pa.array([f(v[a:b]) for a, b in spans], pa.binary()) for f, v in ((pack_sorted, x), (lambda v: pack_plain(v, 4), times))]
            return pa.RecordBatch.from_arrays([pa.array(place), pa.array(ends - cuts), *packed], names=["bucket", "n", "packed", "times"])

        n = 0
        for batch in batches:
            for _, s in _nodes(batch["text"], seen, naming):
                held.append(s)
                n += len(s)
                if n >= HELD:
                    n = 0
                    yield flush()
        if held:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        values, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if table.num_rows:
            sizes = table["n"].to_pylist()
            all_ = np.concatenate([unpack_sorted(x, n) for x, n in zip(table["packed"].to_pylist(), sizes, strict=True)])
            each = np.concatenate([unpack_plain(x, n, 4) for x, n in zip(table["times"].to_pylist(), sizes, strict=True)]).astype(np.int64)
            order = np.argsort(all_)
            all_, each = all_[order], each[order]
            first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
            values, times = all_[first], np.add.reduceat(each, first)
            keep = times > more_than
            values, times = values[keep], times[keep]
        return pa.table({"shingle": pa.array(values.astype(np.int64)), "times": pa.array(times)})

    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(send), "bucket long, n long, packed binary, times binary")
    found = materialize(sent.groupBy("bucket").applyInArrow(add, "shingle long, times long"), "costly")
    top = found.orderBy(F.desc("times"), "shingle").limit(most).toArrow()  # at most 16 bytes each
    discard(found)
    shingle, times = top["shingle"].to_numpy().astype(np.uint64), top["times"].to_numpy()
    order = np.argsort(shingle)
    return shingle[order], times[order], bits


def index_groups(docs: DataFrame, text_col: str, naming: Naming, costly: tuple[np.ndarray, np.ndarray, int], total: int, nodes: int, buckets: int, percent: int) -> tuple[DataFrame, int]:
    """(gid, prefix): nodes that share an index key, known by so many first bits (returned too); groups with the same members are one.

    Keys and nodes are sent with as many bits as their number asks for: chance meetings only cost.
    """
    key_bits, node_bits = min(56, max(32, total.bit_length() + 12)), min(64, max(16, nodes.bit_length() + 10))
    width = -(-node_bits // 8)
    shared = docs.sparkSession.sparkContext.broadcast(costly)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            key, node = np.concatenate(keys) >> np.uint64(64 - key_bits), np.concatenate(held)
            keys.clear(), held.clear()
            order = np.argsort(key)
            key, node = key[order], node[order]
            place, cuts, ends = _by_bucket(key, key_bits, buckets)
            spans = list(zip(cuts.tolist(), ends.tolist(), strict=True))
            packed = [pa.array([f(v[a:b]) for a, b in spans], pa.binary()) for f, v in ((pack_sorted, key), (lambda v: pack_plain(v, width), node))]
            return pa.RecordBatch.from_arrays([pa.array(place), pa.array(ends - cuts), *packed], names=["bucket", "n", "keys", "nodes"])

        n = 0
        prefixes, times, bits = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                for node, s in _nodes(batch["text"], seen, naming):
                    k = index_keys(s, prefixes, times, percent, bits)
                    keys.append(k)
                    held.append(np.full(len(k), node >> (64 - node_bits), np.uint64))
                    n += len(k)
                    if n >= HELD:
                        yield flush()
                        n = 0
            if n:
                yield flush()

    def gather(table: pa.Table) -> pa.Table:
        gids, members = [], []
        if table.num_rows:
            sizes = table["n"].to_pylist()
            node = np.concatenate([unpack_plain(x, n, width) for x, n in zip(table["nodes"].to_pylist(), sizes, strict=True)])
            key = np.concatenate([unpack_sorted(x, n) for x, n in zip(table["keys"].to_pylist(), sizes, strict=True)])
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            keep = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            key, node = key[keep], node[keep]
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(cuts[1:], len(key))
            known: set[int] = set()
            for a, b in zip(cuts[ends - cuts > 1].tolist(), ends[ends - cuts > 1].tolist(), strict=True):
                gid = xxhash.xxh3_64_intdigest(node[a:b].tobytes())
                if gid not in known:
                    known.add(gid)
                    gids.append(np.full(b - a, gid, np.uint64))
                    members.append(node[a:b])
        g, m = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (gids, members))
        return pa.table({"gid": pa.array(g), "prefix": pa.array(m)})

    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(send), "bucket long, n long, keys binary, nodes binary")
    found = materialize(sent.groupBy("bucket").applyInArrow(gather, "gid long, prefix long"), "found")
    groups = materialize(found.distinct(), "groups")
    discard(found)
    return groups, node_bits


def candidate_sets(docs: DataFrame, text_col: str, naming: Naming, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the given nodes. A fixed-size filter keeps most other sets from the shuffle."""
    word = F.expr(f"pmod(node, {FILTER_BITS}) div 64")
    words = nodes.groupBy(word.alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(node, 64) as int)))").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        filter_ = shared.value
        for batch in batches:
            ids, sets, held = [], [], 0
            for node, s in _nodes(batch["text"], seen, naming):
                at = node % FILTER_BITS
                if int(filter_[at // 64]) >> (at % 64) & 1:
                    ids.append(node)
                    sets.append(s.tobytes())
                    held += len(s)
                if held >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.uint64).astype(np.int64)), pa.array(sets, pa.binary())], names=["node", "shingles"])
                    ids, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.uint64).astype(np.int64)), pa.array(sets, pa.binary())], names=["node", "shingles"])

    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(send), "node long, shingles binary")
    return materialize(sent.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "candidates")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with `linked`: 100 * |a & b| >= percent * |a | b|."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    few = F.broadcast if pairs.count() <= MANY_PAIRS else lambda df: df
    left = few(pairs).join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).join(few(pairs.select("b").distinct()), "b", "left_semi")
    return materialize(left.join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(compare), "a long, b long, linked boolean"), "verified")


class Members:
    """Nodes of a task's cells: names, set sizes, components and sketches of 2 ** k words."""

    def __init__(self, node: np.ndarray, n: np.ndarray, comp: np.ndarray, sketches: pa.Array, percent: int):
        self.node, self.n, self.comp, self.percent = node, n, comp, percent
        bounds = np.frombuffer(sketches.buffers()[1], np.int64 if pa.types.is_large_binary(sketches.type) else np.int32)[sketches.offset : sketches.offset + len(sketches) + 1].astype(np.int64) // 8
        self.words = np.diff(bounds)
        self.sketches = {int(w): np.frombuffer(sketches.buffers()[2], "<u8")[bounds[:-1][self.words == w][:, None] + np.arange(w)] for w in np.unique(self.words)}
        self.place = np.zeros(len(node), np.int64)
        for w in self.sketches:
            self.place[self.words == w] = np.arange((self.words == w).sum())

    def bits(self, rows: np.ndarray, w: int) -> np.ndarray:
        """The sketches of rows, which have w or 2 w words, as w words."""
        v = int(self.words[rows[0]])
        return folded(self.sketches[v][self.place[rows]], w)

    def may_link(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """By sizes and components, sketches aside."""
        return (self.comp[p] != self.comp[q]) & (self.n[p] * 100 >= self.n[q] * self.percent) & (self.n[q] * 100 >= self.n[p] * self.percent)

    def near(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs (p, q), the places of those that sketches allow, and how far they are apart."""
        a_, b_ = _similarity(self.percent)
        at, far = [np.zeros(0, np.int64)], [np.zeros(0)]
        for w in self.sketches:
            for v, u in ((w, w), (w, 2 * w), (2 * w, w)):
                of = np.flatnonzero((self.words[p] == v) & (self.words[q] == u))
                step = max(1, (1 << 19) // w)
                for k in range(0, len(of), step):
                    i = of[k : k + step]
                    bits = np.bitwise_count(self.bits(p[i], w) ^ self.bits(q[i], w)).sum(1, dtype=np.int64)
                    total = self.n[p[i]] + self.n[q[i]]
                    ok = bits * b_ <= total * a_
                    at.append(i[ok])
                    far.append((bits / total)[ok])
        return np.concatenate(at), np.concatenate(far)

    def near_blocks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of left with right that may link, and how far they are apart."""
        a_, b_ = _similarity(self.percent)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for w in self.sketches:
            for v, u in ((w, w), (w, 2 * w), (2 * w, w)):
                one, two = left[self.words[left] == v], right[self.words[right] == u]
                if not len(one) or not len(two):
                    continue
                x, y = self.bits(one, w), self.bits(two, w)
                step = max(1, (1 << 19) // (len(two) * w))
                for k in range(0, len(one), step):
                    p = one[k : k + step]
                    total = self.n[p][:, None] + self.n[two][None, :]
                    bits = np.bitwise_count(x[k : k + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
                    i, j = np.nonzero((bits * b_ <= total * a_) & self.may_link(p[:, None], two[None, :]))
                    found.append((p[i], two[j], bits[i, j] / total[i, j]))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    def spanning(self, p: np.ndarray, q: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Places of the nearest pairs that connect what the pairs connect."""
        parent = {int(c): int(c) for c in np.unique(self.comp[np.concatenate([p, q])])}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        keep = []
        for k in np.argsort(far, kind="stable").tolist():
            x, y = root(int(self.comp[p[k]])), root(int(self.comp[q[k]]))
            if x != y:
                parent[x] = y
                keep.append(k)
        return np.array(keep, np.int64)


def cell_pairs(table: pa.Table, percent: int, most: int | None) -> pa.Table:
    """(a, b, far) of the cells' pairs in different components that sizes and sketches allow, and (open) the groups of which pairs are left out.

    A cell (gid, low, high) is the pairs of its block `low` with its block `high`. most: pairs a
    member that a cell lists; where there are more only a spanning forest is. None: all are.
    """
    gid, low, high, mine, node, n, comp = (table[c].to_numpy() for c in ("gid", "low", "high", "block", "node", "n", "comp"))
    order = np.lexsort((node, high, low, gid))
    gid, low, high, mine = (x[order] for x in (gid, low, high, mine))
    sketches = table["sketch"].combine_chunks() if table.num_rows else pa.array([], pa.binary())
    m = Members(node[order], n[order], comp[order], sketches.take(pa.array(order)), percent)
    new = np.ones(len(gid), bool)
    new[1:] = (gid[1:] != gid[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    cuts = np.flatnonzero(new)
    sizes = np.diff(np.append(cuts, len(gid)))
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    small = np.flatnonzero((sizes <= SMALL) & (low[cuts] == high[cuts])) if len(cuts) else cuts
    for k in np.split(small, np.flatnonzero(np.diff(np.cumsum(sizes[small] ** 2) // (1 << 21))) + 1) if len(small) else []:
        c = np.repeat(k, sizes[k] ** 2)  # every ordered pair of each cell's rows
        within = np.arange(len(c)) - np.repeat(np.cumsum(sizes[k] ** 2) - sizes[k] ** 2, sizes[k] ** 2)
        p, q = cuts[c] + within // sizes[c], cuts[c] + within % sizes[c]
        some = np.flatnonzero(p < q)
        some = some[m.may_link(p[some], q[some])]
        at, far = m.near(p[some], q[some])
        parts.append((p[some[at]], q[some[at]], far, c[some[at]]))
    for k in np.setdiff1d(np.arange(len(cuts)), small).tolist():
        rows = np.arange(cuts[k], cuts[k] + sizes[k])
        p, q, far = m.near_blocks(rows[mine[rows] == low[cuts[k]]], rows[mine[rows] == high[cuts[k]]])
        once = p < q if low[cuts[k]] == high[cuts[k]] else np.ones(len(p), bool)
        parts.append((p[once], q[once], far[once], np.full(int(once.sum()), k)))
    p, q, far, cell = (np.concatenate([x[i] for x in parts]) for i in range(4))
    open_ = np.zeros(0, np.int64)
    if most is not None:
        per = np.bincount(cell, minlength=len(cuts))
        dense = np.flatnonzero(per > most * sizes)
        keep = ~np.isin(cell, dense)
        for k in dense.tolist():
            mine_ = np.flatnonzero(cell == k)
            keep[mine_[m.spanning(p[mine_], q[mine_], far[mine_])]] = True
        open_ = np.unique(gid[cuts[dense]])
        p, q, far = p[keep], q[keep], far[keep]
    a, b = np.minimum(m.node[p], m.node[q]), np.maximum(m.node[p], m.node[q])
    order = np.lexsort((b, a))
    a, b, far = a[order], b[order], far[order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    pad = lambda x, k, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(k, kind)])
    pairs = [pad(x[once], len(open_), kind) for x, kind in ((a, pa.int64()), (b, pa.int64()), (far, pa.float64()))]
    return pa.table([*pairs, pa.concat_arrays([pa.nulls(int(once.sum()), pa.int64()), pa.array(open_, pa.int64())])], names=["a", "b", "far", "open"])


def _worker(percent: int, most: int | None) -> Callable[[pa.Table], pa.Table]:
    return lambda table: cell_pairs(table, percent, most)


def _cells(members: DataFrame, classes: DataFrame, labels: DataFrame | None, block: int) -> DataFrame:
    """Rows of the groups' cells of two blocks: gid, low, high, block, node, n, comp, sketch, share.

    Groups that are one component are left out. The members of a group's largest component fill blocks
    of their own, which meet the other blocks but not each other.
    """
    if labels is None:
        per = members.groupBy("gid").agg(F.lit(None).cast("long").alias("top"), F.lit(0).cast("long").alias("d"), F.ceil(F.count("*") / block).alias("o"))
        named = members.withColumn("comp", F.col("node"))
    else:
        named = members.join(labels, "node", "left").select("gid", "node", F.coalesce("component", "node").alias("comp"))
        named = materialize(named, "named")
        counts = named.groupBy("gid", "comp").agg(F.count("*").alias("n")).groupBy("gid").agg(F.max(F.struct("n", "comp")).alias("t"), F.sum("n").alias("n"))
        per = counts.where(F.col("n") > F.col("t.n")).select("gid", F.col("t.comp").alias("top"), F.ceil(F.col("t.n") / block).alias("d"), F.ceil((F.col("n") - F.col("t.n")) / block).alias("o"))
    per = materialize(per, "blocks")
    inside = F.coalesce(F.col("comp") == F.col("top"), F.lit(False))
    hash_ = F.xxhash64("node")
    placed = named.join(per, "gid").withColumn("block", F.when(inside, F.pmod(hash_, F.greatest("d", F.lit(1)))).otherwise(F.col("d") + F.pmod(hash_, F.greatest("o", F.lit(1)))))
    placed = placed.withColumn("others", F.sequence(F.when(inside, F.col("d")).otherwise(0), F.col("d") + F.col("o") - 1)).select("gid", "node", "comp", "block", "others")
    cells = placed.join(classes.select("node", "n", "sketch"), "node").select("*", F.explode("others").alias("other"))
    shares = max(256, math.ceil(members.count() / CELL_ROWS))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return cells.select("gid", low.alias("low"), high.alias("high"), "block", "node", "n", "comp", "sketch", F.pmod(F.xxhash64("gid", low, high), F.lit(shares)).alias("share"))


def _stars(members: DataFrame, classes: DataFrame, percent: int, crowded: int) -> DataFrame:
    """(a, b, far): crowded groups' members with the group's leader, its smallest node, where sizes and sketches allow a link."""
    led = materialize(members.groupBy("gid").agg(F.count("*").alias("size"), F.min("node").alias("a")).where(F.col("size") > crowded).select("gid", "a"), "leaders")
    pairs = materialize(members.join(led, "gid").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "stars")

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            node, n = (np.concatenate([batch[c].to_numpy() for c in two]) for two in (("a", "b"), ("na", "nb")))
            m = Members(node, n, node, pa.concat_arrays([batch["sa"], batch["sb"]]), percent)
            p, q = np.arange(k), np.arange(k, 2 * k)
            some = np.flatnonzero(m.may_link(p, q))
            at, far = m.near(p[some], q[some])
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(some[at])), batch["b"].take(pa.array(some[at])), pa.array(far)], names=["a", "b", "far"])

    one, two = (classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in ("a", "b"))
    near = materialize(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(allowed), "a long, b long, far double"), "similar")
    discard(led, pairs)
    return near


def link_components(docs: DataFrame, text_col: str, naming: Naming, groups: DataFrame, node_bits: int, classes: DataFrame, percent: int = PERCENT, block: int = BLOCK, crowded: int = CROWDED, most: int = LINEAR) -> DataFrame:
    """(node, component) over linked nodes. groups: gid, prefix; classes: node, n, sketch.

    Three steps list pairs that may link: leaders with their crowded groups; the cells' pairs, spanning
    ones where a cell has too many; all pairs of those cells whose ends are still apart. In each, each
    component's nearest pair is compared first, twice, then what is left. Only compared pairs' sets move.
    """
    spark = docs.sparkSession
    prefix = F.expr(f"shiftrightunsigned(node, {64 - node_bits})")
    members = materialize(groups.join(classes.select("node", prefix.alias("prefix")), "prefix").select("gid", "node"), "members")
    labels = done = store = None
    for step in ("leaders", "spanning", "all"):
        if step == "leaders":
            similar = _stars(members, classes, percent, crowded)
        else:
            cells = _cells(members, classes, labels, block)
            bound = most if step == "spanning" else None
            found = materialize(cells.groupBy("share").applyInArrow(_worker(percent, bound), "a long, b long, far double, open long"), "found")
            similar = materialize(found.where("a is not null").select("a", "b", "far").distinct(), "similar")
            left = materialize(members.join(found.where("open is not null").select(F.col("open").alias("gid")).distinct(), "gid", "left_semi"), "members")
            discard(found, members)
            members = left
        if not similar.isEmpty():
            labels, done, store = _compared(docs, text_col, naming, similar, labels, done, store, percent)
        discard(similar)
    discard(members, done, store)
    return labels if labels is not None else spark.createDataFrame([], "node long, component long")


def _compared(docs: DataFrame, text_col: str, naming: Naming, similar: DataFrame, labels: DataFrame | None, done: DataFrame | None, store: DataFrame | None, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """labels (node, component), done (compared pairs a, b) and store (node, shingles) after comparing similar's pairs as far as they are apart."""
    spark = docs.sparkSession
    labels = labels if labels is not None else materialize(spark.createDataFrame([], "node long, component long"), "labels")
    done = done if done is not None else materialize(spark.createDataFrame([], "a long, b long"), "done")
    wanted = similar.select(F.col("a").alias("node")).unionAll(similar.select("b")).distinct()
    wanted = materialize(wanted if store is None else wanted.join(store.select("node"), "node", "left_anti"), "wanted")
    if store is None:
        store = candidate_sets(docs, text_col, naming, wanted)
    elif not wanted.isEmpty():
        more = candidate_sets(docs, text_col, naming, wanted)
        both = materialize(store.unionAll(more), "candidates")
        discard(store, more)
        store = both
    discard(wanted)
    for nearest in (True, True, False):
        pairs = materialize(_apart(similar, labels, nearest).join(done, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            discard(pairs)
            break
        checked = _verified(pairs, store, percent)
        now = materialize(done.unionAll(checked.select("a", "b")), "done")
        links = checked.where("linked").select("a", "b").unionAll(labels.select("node", "component"))
        named = materialize(connected_components(links), "labels")
        discard(pairs, checked, done, labels)
        done, labels = now, named
    return labels, done, store


def _apart(similar: DataFrame, labels: DataFrame, nearest: bool) -> DataFrame:
    """The pairs (a, b) whose ends are in different components; nearest: of each component the nearest pair only."""
    ends = similar
    for end in ("a", "b"):
        names = labels.select(F.col("node").alias(end), F.col("component").alias("__c"))
        ends = ends.join(names, end, "left").withColumn(f"c{end}", F.coalesce("__c", end)).drop("__c")
    ends = ends.where("ca <> cb")
    if not nearest:
        return ends.select("a", "b")
    pair = F.struct("far", "a", "b").alias("p")
    sides = ends.select(F.col("ca").alias("c"), pair).unionAll(ends.select(F.col("cb").alias("c"), pair))
    return sides.groupBy("c").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, costly: int = COSTLY, bucket: int = BUCKET, block: int = BLOCK, crowded: int = CROWDED, most: int = LINEAR, name_bits: int = 64) -> DataFrame:
    """Per row: id, text_hash, n_shingles, node (class of equal sets), component (of nodes) and component_id, the smallest id reachable by links.

    component tells components apart whose ids are null or repeated; it is null for texts without words.
    """
    spark = docs.sparkSession
    naming = Naming(bits=name_bits)
    with arrow_batches(spark, 1000, "4m"):
        while True:
            sets = document_sets(docs, id_col, text_col, naming)
            classes = sets.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.first("sketch").alias("sketch"), (F.min("check") == F.max("check")).alias("verified"))
            classes = materialize(classes, "classes")
            shared = [r.node for r in classes.where("not verified").select("node").toLocalIterator()]  # by chance one set in 2 ** 64 / n
            if not shared:
                break
            naming = Naming(naming.shared | {x % (1 << 64) for x in shared}, name_bits)
            discard(sets, classes)
        total, nodes = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], classes.count()
        buckets = max(256, math.ceil(total / bucket))
        heavy = costly_shingles(docs, text_col, naming, total, buckets, costly, MAX_COSTLY)
        groups, node_bits = index_groups(docs, text_col, naming, heavy, total, nodes, buckets, percent)
        labels = link_components(docs, text_col, naming, groups, node_bits, classes.select("node", "n", "sketch"), percent, block, crowded, most)
        named = classes.join(labels, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("comp"))
        named = materialize(named, "named")
        discard(groups, classes, labels)
        least = materialize(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "least")
        final = materialize(named.join(least, "comp").select("node", F.col("comp").alias("component"), "component_id"), "components")
        slim = materialize(sets.select("id", "text_hash", F.col("n").alias("n_shingles"), "node"), "sizes")
        discard(named, least, sets)
    out = slim.where("n_shingles > 0").join(final, "node").select("id", "text_hash", "n_shingles", "node", "component", "component_id")
    return out.unionByName(slim.where("n_shingles = 0").select("id", "text_hash", "n_shingles", "node", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id")))
