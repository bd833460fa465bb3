"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece there is exactly one token that can end its encoding.
Storing that token for every prefix makes the table of a text a chain: the
encoding is read off backwards, appending bytes extends the table, and an edit
recomputes it only until the piece bounds fall in step with the old ones.

A token fits behind another exactly if no merge would cross their bound; whether
one would is read from the two tokens' own merge histories (their spines).

Null text counts as empty and encodes to no ids; special tokens are plain text.
Repeated rows each give a row; an empty table gives none; other columns pass, those named like the results are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from winaudit.llm.workers import tidy

_FOREVER = 1 << 60
_SHORT = (2, 1)
#: Entries of a worker's tables of known pieces, words and token pairs. A full table of pieces or words becomes the old one, from which what recurs is taken over.
MAX_PIECES, MAX_PAIRS = 250_000, 250_000
#: Beginnings of pieces whose prefix tables are kept, and their bytes.
MAX_HEADS, HEAD = 100_000, 8
#: Texts whose words are looked up together; characters of them at most, about, and for each piece that small tables hold: what
#: one part of a batch brings may exceed the tables by so much.
BATCH, BATCH_CHARS, CHARS_A_PIECE = 1024, 4 << 20, 16
#: Characters of context beyond a piece's end on which its extent can depend ("'re" and its like).
LOOKAHEAD = 3


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Ranks with what the dynamic programme needs: spines of tokens and the fit of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) >= 3:
                ends.setdefault(token[-3:], set()).add(len(token))
        #: Lengths of the tokens that end in three given bytes, longest first; shorter tokens are always tried.
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in ends.items()}
        self._right: dict[int, list[tuple[bytes, int]]] = {}
        self._left: dict[int, list[tuple[bytes, int]]] = {}
        self._halves: dict[bytes, tuple[bytes, bytes]] = {}
        self._fits: dict[int, bool] = {}

    def _split(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge makes the token: what merging its bytes leaves just before."""
        if token not in self._halves:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], _FOREVER), i) for i in range(len(parts) - 1))
                if rank == _FOREVER:
                    raise ValueError(f"no merges lead to {token!r}")
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[token] = tuple(self.tokens[self.ranks[p]] for p in parts)  # the vocabulary's own objects
        return self._halves[token]

    def _spine(self, rank: int, side: int) -> list[tuple[bytes, int]]:
        """The tokens that stand at one end of this token while it is being merged, each with the rank that consumes it."""
        known = self._right if side else self._left
        if rank not in known:
            token = self.tokens[rank]
            out = [(token, _FOREVER)]
            if len(token) > 1:
                half = self._split(token)[side]
                out += [(half, rank), *self._spine(self.ranks[half], side)[1:]]  # one spine's entries serve all that end in it
            known[rank] = out
        return known[rank]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, stay as they are.

        A merge crosses their bound if it comes before either part is consumed
        on its own side; at equal rank the leftmost pair merges first.
        """
        key = left << 32 | right
        got = self._fits.get(key)
        if got is None:
            ranks = self.ranks
            got = True
            for a, a_until in self._spine(left, 1):
                for b, b_until in self._spine(right, 0):
                    c = ranks.get(a + b)
                    if c is not None and c < a_until and c <= b_until:
                        got = False
                        break
                if not got:
                    break
            if len(self._fits) >= MAX_PAIRS:
                self._fits.clear()
            self._fits[key] = got
        return got

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Fill `last` (last token of each prefix of 1, 2, ... bytes) up to the whole piece."""
        rank_of, known, lengths = self.ranks.get, self._fits.get, self.lengths
        for end in range(len(last) + 1, len(piece) + 1):
            for size in lengths.get(piece[end - 3 : end], _SHORT) if end > 2 else _SHORT:
                start = end - size
                if start < 0:
                    continue
                token = rank_of(piece[start:end])
                if token is None:
                    continue
                if start:
                    fit = known(last[start - 1] << 32 | token)
                    if not (self.fits(last[start - 1], token) if fit is None else fit):
                        continue
                last.append(token)
                break
        return last

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.read_back(self.extend(piece, []))

    def read_back(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int | None = None):
        self.vocabulary, self.most = Vocabulary(ranks), most or MAX_PIECES
        self.part_chars = min(BATCH_CHARS, CHARS_A_PIECE * self.most)
        self.pieces = regex.compile(pattern)
        self._packed: dict[str, bytes] = {}  # piece -> ids as little-endian 32-bit integers
        self._words: dict[str, bytes | None] = {}  # the same for a space and the word behind it; None: it can't stand alone
        self._old_packed: dict[str, bytes] = {}
        self._old_words: dict[str, bytes | None] = {}
        self._heads: dict[bytes, list[int]] = {}

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Their ids. New pieces are encoded in byte order: each continues the prefix table of the one before it."""
        if len(self._packed) > self.most:
            self._packed, self._old_packed = {}, self._packed
        known, old = self._packed, self._old_packed
        fresh = []
        for p in pieces:
            if p not in known:
                if p in old:
                    known[p] = old[p]
                else:
                    fresh.append((p.encode(), p))
        before, last, heads, extend = b"", [], self._heads, self.vocabulary.extend
        if len(heads) > min(MAX_HEADS, self.most):
            heads.clear()
        for data, piece in sorted(fresh):
            same, head = 0, data[:HEAD]
            for x, y in zip(data, before, strict=False):
                if x != y:
                    break
                same += 1
            if same < len(head):
                last = heads.get(head)
                if last is None:
                    last = heads[head] = extend(head, [])
                last = last[:]
            else:
                del last[same:]
            extend(data, last)
            before = data
            whole = self.vocabulary.ranks.get(data)
            known[piece] = np.array([whole] if whole is not None else self.vocabulary.read_back(last), "<u4").tobytes()
        return known

    def _encode_pieces(self, pieces: list[str]) -> bytes:
        return b"".join(map(self._learn(set(pieces)).__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode() of each text; what is new to this worker is learnt together.

        A space with what stands between it and the next one is cut by the pattern
        independently of its surroundings, unless white space follows the
        space; texts with such a place are cut as a whole.
        """
        cut = [t.split(" ") for t in texts]
        new: set[str] = set()
        for words in cut:
            new.update(words[1:])
        if len(self._words) > self.most:
            self._words, self._old_words = {}, self._words
        known, old = self._words, self._old_words
        parts: dict[str, list[str]] = {}
        for w in new.difference(known):
            if w in old:
                known[w] = old[w]
            elif not w or w[0].isspace():
                known[w] = None
            else:
                parts[w] = self.pieces.findall(" " + w)
        packed = self._learn({p for found in parts.values() for p in found})
        for w, found in parts.items():
            known[w] = b"".join(map(packed.__getitem__, found))
        out = []
        for text, words in zip(texts, cut, strict=True):
            try:
                out.append(self._encode_pieces(self.pieces.findall(words[0])) + b"".join(map(known.__getitem__, words[1:])))
            except TypeError:
                out.append(self._encode_pieces(self.pieces.findall(text)))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class EncodedText:
    """A text with its prefix tables; append() and replace() re-encode only what they touch."""

    def __init__(self, tokenizer: Tokenizer, text: str = ""):
        self.tokenizer, self.text, self.recomputed = tokenizer, "", 0
        self._cut: list[tuple[int, str, list[int]]] = []  # start, piece, last token of each prefix
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put `new` in place of text[start:end]."""
        old = self._cut
        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        keep = 0
        while keep < len(old) and old[keep][0] + len(old[keep][1]) + LOOKAHEAD <= start:
            keep += 1
        out, at = old[:keep], sum(map(len, (old[keep - 1][1],))) + old[keep - 1][0] if keep else 0
        old_starts = {s + shift: i for i, (s, _, _) in enumerate(old) if s >= end}
        self.recomputed = 0
        for m in self.tokenizer.pieces.finditer(text, at):
            if m.start() in old_starts and m.start() >= start + len(new):
                out += [(s + shift, p, last) for s, p, last in old[old_starts[m.start()] :]]
                break
            piece = m.group()
            out.append((m.start(), piece, self._table(piece, old[len(out)] if len(out) < len(old) else None)))
        self.text, self._cut = text, out

    def _table(self, piece: str, before: tuple[int, str, list[int]] | None) -> list[int]:
        """The prefix table, continuing that of the piece which stood here as far as the two agree."""
        data, last = piece.encode(), []
        if before is not None:
            was = before[1].encode()
            same = next((i for i, (x, y) in enumerate(zip(data, was, strict=False)) if x != y), min(len(data), len(was)))
            last = before[2][:same]
        self.recomputed += len(data) - len(last)
        return self.tokenizer.vocabulary.extend(data, list(last))

    @property
    def ids(self) -> list[int]:
        out: list[int] = []
        for _, piece, last in self._cut:
            whole = self.tokenizer.vocabulary.ranks.get(piece.encode())
            out += [whole] if whole is not None else self.tokenizer.vocabulary.read_back(last)
        return out


_loaded: dict[tuple[str, str, int | None], Tokenizer] = {}


def tokenizer(path: str, pattern: str, most: int | None = None) -> Tokenizer:
    """One per Python worker; path is a rank file that every executor has. most: pieces that its tables hold."""
    if (path, pattern, most) not in _loaded:
        _loaded[path, pattern, most] = Tokenizer(read_ranks(path), pattern, most)
    return _loaded[path, pattern, most]


def _slices(batch: pa.RecordBatch, text: str, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of texts and, but for a longer single one, of characters."""
    sizes = batch.column(text).cast(pa.large_string()) if not pa.types.is_binary(batch.column(text).type) else batch.column(text)
    ends = np.cumsum(pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        till = min(at + BATCH, max(at + 1, int(np.searchsorted(ends, before + chars, side="right"))))
        yield batch.slice(at, till - at)
        at = till


def with_ids(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, most: int | None = None, same: str | None = None) -> DataFrame:
    """Add the column `ids`: each whole text's token ids, packed as little-endian 32-bit integers.

    decoded: also add what the ids decode to, bytes, in the same pass. same: instead of the text itself there is only
    a column that tells whether the ids decode to it; so no text comes back from the worker. most: pieces that a worker's tables hold
    between tasks, fewer for workers that other stages share. The columns go through the Python
    worker in small parts, so what a task holds doesn't grow with its texts.
    """
    df = df.drop(ids, *[c for c in (decoded, same) if c])
    more = [(ids, pa.binary(), T.BinaryType())] + [(decoded, pa.binary(), T.BinaryType())] * bool(decoded) + [(same, pa.bool_(), T.BooleanType())] * bool(same)
    passed = [f.name for f in df.schema.fields if not (same and f.name == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern, most)
        for batch in batches:
            for part in _slices(batch, text, own.part_chars):
                texts = [x or "" for x in part.column(text).to_pylist()]
                coded = own.encode_all(texts)
                new = [pa.array(coded, pa.binary())]
                if decoded:
                    new.append(pa.array([own.decode(x) for x in coded], pa.binary()))
                if same:
                    new.append(pa.array([own.decode(x) == t.encode() for x, t in zip(coded, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in passed], *new], names=[*passed, *[n for n, _, _ in more]])

    kept = [df.schema[c] for c in passed]
    return df.mapInArrow(tidy(run), T.StructType([*kept, *[T.StructField(n, kind) for n, _, kind in more]]))


def with_decoded(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the column `decoded`: the bytes that the packed ids stand for."""

    df = df.drop(decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            for part in _slices(batch, ids):
                out = pa.array([own.decode(x or b"") for x in part.column(ids).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], schema=pa.schema([*part.schema, pa.field(decoded, pa.binary())]))

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())]))
