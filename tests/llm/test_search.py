"""Periodic runs, exact top-k and hard negatives against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from winaudit.llm import cells, lce, negatives, periodic, queries, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24, times=3):
    found, seen = [], set()
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - s + p >= max(least, times * p) and (s, i - s + p) not in seen:
                seen.add((s, i - s + p))
                found.append((s, i - s + p, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_cover_meets_every_difference():
    assert len(lce.COVER) == 9
    assert {(a - b) % lce.MODULUS for a in lce.COVER.tolist() for b in lce.COVER.tolist()} == set(range(lce.MODULUS))


@pytest.mark.parametrize("letters", [1, 2, 50])
def test_extensions(letters):
    rng = np.random.default_rng(letters)
    x = np.concatenate([rng.integers(0, letters, 700), [90], rng.integers(0, letters, 300), [91]]).astype(np.uint32)
    ext = lce.Extensions(x)
    i, j = rng.integers(0, len(x), 2000), rng.integers(0, len(x), 2000)
    i, j = i[i != j], j[i != j]

    def plain(a, b):
        n = 0
        while max(a, b) + n < len(x) and x[a + n] == x[b + n]:
            n += 1
        return n

    assert ext(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def some_text(rng):
    n = rng.randrange(0, 300)
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [rng.randrange(500) for _ in range(n)]
    if kind == 2:
        block = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
        return [block[i % len(block)] for i in range(n)]
    if kind == 3:
        return [0] * n
    out = []
    while len(out) < n:
        out += [rng.randrange(2) for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 20)
    return out[:n]


def test_runs_of_texts_together(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(periodic, "POINTS", 500)
    for _ in range(60):
        texts = [some_text(rng) for _ in range(rng.randrange(1, 6))]
        got = periodic.runs_of([np.array(t, np.int64) for t in texts])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t) for t in texts]


def plain_result(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = None if top[0] is None else 1000 * top[1] // top[2]
    return (doc_id, len(runs), *top, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_query(spark, tmp_path):
    rng = random.Random(4)
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = [(i, " ".join(f"w{x}" for x in some_text(rng))) for i in range(60)]
    docs += [(i, " ".join(f"é{rng.randrange(300)}" for _ in range(rng.randrange(1, 500)))) for i in planted]
    docs += [(500, None), (501, ""), (502, " \n\t "), (503, "a b " * 30), (503, "a b " * 30), (None, "x y " * 40), (None, None), (planted[0], ""), (504, "A a " * 12), (505, "Spam\t\x0bspam\n" * 20)]
    docs += [(506, " ".join(f"word{i % 977}x{i}" for i in range(20_000)) + " tick tock" * 9000), (507, "one " * 23), (508, "one " * 24)]
    frame = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, runs int, id string")
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(plain_result(*d)) for d in docs)
    assert periodic.with_runs(frame.where("false")).count() == 0
    texts = {r.id: r.collapsed for r in periodic.with_runs(frame).where("id in (504, 508)").collect()}
    assert texts == {504: "A a", 508: "one"}
    with pytest.raises(ValueError, match="matches"):
        periodic.with_runs(frame, least=10)


def vectors(seed, dim=6):
    rng = random.Random(seed)
    v = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(90)]
    v += [v[3]] * 25 + [[float("nan")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [float("inf")] * dim, None, [], [0.0] * dim, [1.0] * (dim + 1), [2.0] * (dim + 1)]
    ids = [4 * i for i in range(90)] + [200 + i for i in range(25)] + list(range(1000, 1800, 100))
    rows = [(i, x, rng.choice([0, 1, 2, None])) for i, x in zip(ids, v, strict=True)]
    return [*rows, (100, v[7], 1), (100, v[8], 2), (None, v[9], 1), (None, v[3], 0)]


def floors(v, scale):
    if not v or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


def last(i):
    return (i is None, i or 0)


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 5, "x", 0.5) for i, v, y in rows], "vec_id long, embedding array<double>, label int, row int, vector string, score double").repartition(4)


@pytest.mark.parametrize(("slices", "block", "query_block"), [(2, 8192, 4096), (3, 60, 3)])
def test_top_k(spark, slices, block, query_block):
    rows = vectors(5)
    sound = [(n, i, floors(v, 1024)) for n, (i, v, _) in enumerate(rows) if floors(v, 1024)]
    want = []
    for n, i, v in sound:
        if i is not None and i % 100 == 0:
            others = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), last(j), j) for m, j, w in sound if m != n and len(w) == len(v))
            want += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(others[:10])]
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 100 == 0, 10, 1024, slices=slices, block=block, query_block=query_block)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_top_k_of_few_and_none(spark):
    rows = [(0, [1.0, 2.0], 1), (7, [0.5, -1.0], 1), (8, [0.5, -1.0], 1)]
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 100 == 0, 10, 1024)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 7, 1024 * 512 - 2048 * 1024), (0, 2, 8, 1024 * 512 - 2048 * 1024)]
    assert topk.top_k(table(spark, rows[:1]), F.col("vec_id") % 100 == 0, 10, 1024).count() == 0
    assert topk.top_k(table(spark, rows).where("false"), F.col("vec_id") % 100 == 0, 10, 1024).count() == 0
    assert topk.top_k(table(spark, rows), F.col("vec_id") < 0, 10, 1024).count() == 0


@pytest.mark.parametrize(("block", "query_block"), [(8192, 4096), (60, 3)])
def test_hard_negatives(spark, block, query_block):
    rows = vectors(6)
    relabelled = [(n, i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, floors(v, 256)) for n, (i, v, y) in enumerate(rows) if y is not None and floors(v, 256)]
    want = []
    for n, i, y, v in relabelled:
        if i is not None and i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), last(j), j, z == y) for m, j, z, w in relabelled if m != n and len(w) == len(v))
            for s, _, j, _ in [x for x in scored if x[3]][:5]:
                inside = [x for x in scored if not x[3] and 30 * -s <= 100 * -x[0] <= 90 * -s]
                want += [(i, j, r + 1, x[2], -s, -x[0]) for r, x in enumerate(inside[:10])]
    assert len(want) > 50
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, label, 256, block=block, query_block=query_block)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert negatives.hard_negatives(table(spark, rows).where("false"), F.col("vec_id") % 100 == 0, label, 256).count() == 0
    assert negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, F.lit(None), 256).count() == 0


def test_scores_beyond_doubles():
    big = np.array([[2.0**29, 3.0], [2.0**29 + 1, 2.0]])
    assert cells.products(big, big)[0, 1] == 2**29 * (2**29 + 1) + 6
    with pytest.raises(OverflowError):
        cells.products(big * 2.0**10, big)
    scores = np.array([[5, 5 + (1 << 60), cells.NONE, 5 + (1 << 60)], [1, 1, 1, cells.NONE]])
    assert [list(map(int, x)) for x in cells.best(scores, 2)] == [[0, 0, 1, 1], [1, 3, 0, 1]]
    assert cells.by_id(pa.table({"id": pa.array([None, 2, 2], pa.int64()), "row": [0, 2, 1]}))["row"].to_pylist() == [1, 2, 0]
