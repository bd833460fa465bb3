"""Words and shingles of whole Arrow columns as 64-bit hashes, without a Python object per word.

A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D.
A word's hash is that of its length, then mixed with eight of its bytes after
eight, for all words of a column at once; longer words than LONG bytes are
hashed one by one. It depends on the word alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes up to which words are hashed together.
LONG = 256
#: Words that are worked on at once, so that they stay in the processor's cache.
_CACHED = 1 << 14
#: Bytes of text whose shingles are made together.
_SLICE = 1 << 21
#: Masks of the first 0 to 8 bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters its input."""
    x = x.astype(np.uint64, copy=True)
    x += _STEP
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 bounds of its texts in them; null counts as empty."""
    texts = (texts if pa.types.is_large_string(texts.type) else texts.cast(pa.large_string())).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def word_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n + 1 bounds of each text's words among them."""
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(raw))]
    starts[cuts] = solid[cuts]
    ends[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(low) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), _CACHED):
        since, size = starts[a : a + _CACHED], ends[a : a + _CACHED] - starts[a : a + _CACHED]
        h = _step(size.astype(np.uint64) * _STEP, eight[since] & _FIRST[np.minimum(size, 8)])
        live, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(live):
            left = size[live] - at
            h[live] = _step(h[live], eight[since[live] + at] & _FIRST[np.minimum(left, 8)])
            live, at = live[left > 8], at + 8
        out[a : a + _CACHED] = mix(h)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(low[starts[i] : ends[i]].tobytes(), LONG)
    return out


def _step(h: np.ndarray, eight: np.ndarray) -> np.ndarray:
    """A bijection of h for any eight bytes."""
    h ^= eight
    h *= _STEP
    h ^= h >> np.uint64(29)
    return h


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 bounds of each text's among them."""
    raw, bounds = buffer_of(texts)
    low = lowered(raw)
    starts, ends, per = word_bounds(low, bounds)
    with np.errstate(over="ignore"):
        return hash_spans(low, starts, ends), per


def _combine(parts: list[np.ndarray], width: int) -> np.ndarray:
    out = np.full(len(parts[0]), width, np.uint64)
    for p in parts:
        out = out * np.uint64(0x2545F4914F6CDD1D) + p
    return mix(out)


def slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """The texts, so many bytes at a time, or one longer text."""
    _, ends = buffer_of(texts)
    at = 0
    while at < len(texts):
        till = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
        yield texts.slice(at, till - at)
        at = till


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted; with fewer words the whole sequence is one, without words none."""
    for part in slices(texts, _SLICE):
        w, per = words(part)
        with np.errstate(over="ignore"):
            full = _combine([w[i : len(w) - width + 1 + i] for i in range(width)], width) if len(w) >= width else np.zeros(0, np.uint64)
            for a, b in zip(per[:-1].tolist(), per[1:].tolist(), strict=True):
                if b - a >= width:
                    yield np.unique(full[a : b - width + 1])
                elif b > a:
                    yield _combine([w[i : i + 1] for i in range(a, b)], b - a)
                else:
                    yield np.zeros(0, np.uint64)
