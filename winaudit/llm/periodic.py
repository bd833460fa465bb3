"""Periodic run detection: maximal repetitions of words, and texts with them collapsed.

A run is a stretch of words with smallest period q, as long as it stays periodic with q on
either side, of at least `times` * q and `least` words. Its matches (words equal to those p
later) are at least max(least, times * p) - p in a row, so some lie on the grid of that width:
for each period p only grid points are asked, n / 1 + n / 2 + ... questions in all. Points whose
neighbours don't match are ruled out by comparing a few words. The others' documents get
their cover-sampled suffixes sorted (lce.py), forwards and backwards, and each point's run is the
common extension both ways. The smallest period of those that give a stretch is the run's.

Documents are independent: a map over the table without any shuffle, in groups of documents of
bounded size; a document that is larger is worked alone, in memory of a few hundred bytes a word.
Null and empty texts have no words and no runs; repeated rows and ids, null ones
too, each stand for themselves. An empty table gives none; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winaudit.llm.lce import Extensions
from winaudit.llm.workers import tidy

#: A run's least words, and least periods.
LEAST, TIMES = 24, 3
#: Words of documents that are worked together; grid points that are asked together.
GROUP, POINTS = 1 << 18, 1 << 20
#: Matches in a row, on one side of a point at least, without which it has no run: half of least * (1 - 1 / times), less one.
_BESIDE = 7


def _grid(lengths: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, place in it) of all grid points, some POINTS at a time."""
    of = np.repeat(np.arange(len(lengths)), lengths // times)
    period = np.arange(len(of)) - np.repeat(np.cumsum(lengths // times) - lengths // times, lengths // times) + 1
    width = np.maximum(least, times * period) - period
    points = (lengths[of] - period - 1) // width + 1
    ends = np.cumsum(points)
    done = 0
    while done < len(of):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + POINTS)))
        some = slice(done, upto)
        n = points[some]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(of[some], n), np.repeat(period[some], n), k * np.repeat(width[some], n)
        done = upto


def _joined(texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(all words behind each other, a word of its own before, between and after; where each text begins)."""
    top = max((int(t.max()) + 1 for t in texts if len(t)), default=0)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    out = np.empty(bounds[-1] + 1, np.int64)
    out[bounds] = top + np.arange(len(bounds))
    for t, at in zip(texts, bounds, strict=False):
        out[at + 1 : at + 1 + len(t)] = t
    return out.astype(np.uint32), bounds[:-1] + 1


def runs_of(texts: Sequence[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Per text (words as numbers below 2^31) its runs' rows (start, length, period), by start, then period."""
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    held = [k for k, t in enumerate(texts) if len(t) >= least]
    if not held:
        return out
    x, begin = _joined([texts[k] for k in held])
    margin = np.arange(1, _BESIDE + 1, dtype=np.uint32) + x.max()
    wide = np.concatenate([margin, x, margin + np.uint32(_BESIDE)])
    found = []
    for of, period, k in _grid(np.array([len(texts[t]) for t in held]), least, times):
        at = begin[of] + k + _BESIDE
        some = np.flatnonzero(wide[at] == wide[at + period])
        at, step = at[some], period[some]
        beside = np.zeros(len(some), bool)
        for side in (1, -1):
            live = np.flatnonzero(~beside)
            for t in range(1, _BESIDE + 1):
                live = live[wide[at[live] + side * t] == wide[at[live] + side * t + step[live]]]
            beside[live] = True
        some = some[beside]
        found.append(np.column_stack([of[some], period[some], k[some]]))
    points = np.concatenate(found)
    if not len(points):
        return out
    ours, of = np.unique(points[:, 0], return_inverse=True)
    x, begin = _joined([texts[held[t]] for t in ours])
    i, period = begin[of] + points[:, 2], points[:, 1]
    after = Extensions(x)(i, i + period)
    last = len(x) - 1
    before = Extensions(x[::-1].copy())(last - (i - 1), last - (i + period - 1))
    start, length = points[:, 2] - before, before + after + period
    enough = length >= np.maximum(least, times * period)
    rows = np.column_stack([of, start, length, period])[enough]
    rows = rows[np.lexsort(rows.T[::-1])]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)  # of equal stretches the smallest period
    rows = rows[first]
    bounds = np.searchsorted(rows[:, 0], np.arange(len(ours) + 1))
    for t, k in enumerate(ours):
        own = rows[bounds[t] : bounds[t + 1], 1:]
        out[held[k]] = own[np.lexsort((own[:, 2], own[:, 0]))]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def with_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row: id, n_words, runs (array of start, length, period; words count from 0) and collapsed, the text without repeats.

    Words are [^\\x20\\x09-\\x0D]+; case counts. rewrite changes a document's words beforehand.
    """
    if times < 2 or least * (times - 1) < (2 * _BESIDE + 1) * times:
        raise ValueError(f"runs must have 2 periods and {2 * _BESIDE + 1} matches at least")

    def flush(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
        numbered = []
        for own in words:
            number = dict(zip(dict.fromkeys(own), range(len(own)), strict=False))
            numbered.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
        runs = runs_of(numbered, least, times)
        rows = np.concatenate(runs)
        kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        flat = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(kind))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in runs]), pa.int32()), flat)
        texts = pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), lists, texts.cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, n = [], [], 0
        for batch in batches:
            for ident, text in zip(batch["id"], batch["text"], strict=True):
                ident = ident.as_py()
                own = (text.as_py() or b"").split()  # bytes split at \x20 and \x09-\x0D
                own = rewrite(ident, own) if rewrite else own
                if words and n + len(own) > GROUP:
                    yield flush(ids, words)
                    ids, words, n = [], [], 0
                ids.append(ident)
                words.append(own)
                n += len(own)
        if words:
            yield flush(ids, words)

    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return read.mapInArrow(tidy(task), "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as fractions; ties go to the smallest start, then period. Null without runs."""
    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when((y > x) | ((y == x) & (F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"]))), b).otherwise(a)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)
