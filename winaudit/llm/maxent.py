"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

P(token | context) = P(group | context) * P(class | group, context) * P(token | class).
The classes are the most frequent tokens, one each, bands of the other frequent
ones, and hashed shares of the rest; neighbours in that order form a group; within a
class tokens follow their training counts. Both softmaxes are over hashed features of
the context: the word before, the two before, and words skipped to. They are trained by
distributed gradient updates. Words and classes of the training texts are looked up
once, into a packed table that is dealt to slices. A round takes one slice: each task
runs Adagrad over its part from the common weights, and what it changed is averaged, by
tokens, in a tree of bounded groups. The rounds of a pass grow with the square root of
the training tokens, and so, up to MOST_ROWS, do the hashed rows.

Counts cover all training tokens and are exact (words are known by 64-bit hashes);
they are shuffled packed. The FREQUENT most frequent words are broadcast, a fixed
size; each other word of a document meets its count in a join. A word without
training count stands for its class's unknown word, of count 0, so the
probabilities over known words and the unknown ones sum to one.

Null text counts as empty: one end token. A document is held out if crc32 of its id
as text, mod 10, is 0; a null id counts as ''. Rows that repeat an id are
documents of their own. Without training tokens every token is unknown and the
scores are those of an untrained model. An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winaudit.functions.scratch import discard, materialize
from winaudit.llm.jaccard import arrow_batches
from winaudit.llm.words import words

#: The end of a text, a token like the words.
END = np.uint64(0xE0D0F0A0B0C0D0E1)
#: Count added to each word's, known or not.
SMOOTH = 0.1
#: Frequent words (16 bytes each, broadcast); classes: single words, bands of frequent words, hashed shares of the rest (a power of two).
FREQUENT, SINGLES, BANDS, SHARES = 1 << 17, 64, 16, 16
CLASSES = SINGLES + BANDS + SHARES
#: Groups of classes, and classes of a group.
GROUPS = 8
WITHIN = CLASSES // GROUPS
#: Hashed features (rows of GROUPS + CLASSES floats, broadcast) of up to so many training tokens; four times the tokens double them, up to MOST_ROWS.
ROWS, ROWS_TOKENS, MOST_ROWS = 1 << 14, 1 << 26, 1 << 16
#: Words that a feature tells apart, by rank; a packed word has 15 bits, and one that tells that it ends the text.
TOLD_APART, ENDS = 1 << 14, np.uint16(1 << 15)
#: Training: passes, step, tokens of an update, tokens a task trains on, about.
EPOCHS, STEP, UPDATE, TASK_TOKENS = 2, 0.15, 8192, 2_000_000
#: Factors of the features' hashes.
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Tokens of a packed row that are unpacked at once.
PIECE = 1 << 18
#: Weights averaged in one group at most.
FAN = 32
_SHARE_BITS = SHARES.bit_length() - 1


class Vocabulary:
    """The frequent tokens sorted by hash, their counts, classes and the classes' weights."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, share_mass: np.ndarray):
        by_rank = np.lexsort((hashes, -counts))
        hashes, counts = hashes[by_rank], counts[by_rank]
        n = len(hashes)
        classes = np.arange(n)
        rest = counts[SINGLES:].astype(float)
        if len(rest):  # bands of about equal mass
            done = (np.cumsum(rest) - rest / 2) / rest.sum()
            classes[SINGLES:] = SINGLES + np.minimum((done * BANDS).astype(int), BANDS - 1)
        mass = np.zeros(CLASSES)
        np.add.at(mass, classes, counts + SMOOTH)
        mass[SINGLES + BANDS :] = share_mass + SMOOTH  # and the share's unknown word
        order = np.argsort(hashes)
        self.hashes, self.counts, self.classes, self.mass = hashes[order], counts[order], classes[order], mass
        #: Number of each word in contexts: by rank from 1; the rest are one; 0 stands before the text.
        self.numbers = (np.minimum(order, TOLD_APART) + 1).astype(np.uint16)
        self.slot_bits = max(1, (2 * max(n, 1) - 1).bit_length())
        self.first = np.searchsorted(self.hashes, np.arange(1 << self.slot_bits, dtype=np.uint64) << np.uint64(64 - self.slot_bits)).astype(np.int32)

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the frequent tokens, and whether it is one."""
        if not len(self.hashes):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        last = len(self.hashes) - 1
        at = np.minimum(self.first[(tokens >> np.uint64(64 - self.slot_bits)).astype(np.int64)], last)
        found = self.hashes[at] == tokens
        live = np.flatnonzero(~found)
        while len(live):  # on, while the place's hash is smaller
            live = live[(self.hashes[at[live]] < tokens[live]) & (at[live] < last)]
            at[live] += 1
            found[live] = self.hashes[at[live]] == tokens[live]
            live = live[~found[live]]
        return at, found

    def classes_of(self, tokens: np.ndarray, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        share = (tokens >> np.uint64(64 - _SHARE_BITS)).astype(np.int64) + SINGLES + BANDS
        return np.where(found, self.classes[at], share) if len(self.hashes) else share

    def numbers_of(self, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        other = np.uint16(TOLD_APART + 1)
        return np.where(found, self.numbers[at], other) if len(self.hashes) else np.full(len(at), other)

    def start(self, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
        """Weights (of groups, of classes in groups) of a model that knows no context: row 0, the bias, holds the log shares."""
        groups, classes = np.zeros((rows, GROUPS), np.float32), np.zeros((rows * GROUPS, WITHIN), np.float32)
        log = lambda x, whole: np.where(x > 0, np.log(np.maximum(x, 1e-30) / np.maximum(whole, 1e-30)), -60)
        per = self.mass.reshape(GROUPS, WITHIN)
        groups[0] = log(per.sum(1), self.mass.sum())
        classes[:GROUPS] = log(per, per.sum(1, keepdims=True))
        return groups, classes


def hashed_rows(tokens: int) -> int:
    """Rows of the weights for so many training tokens."""
    return min(MOST_ROWS, ROWS << max(0, (max(1, tokens // ROWS_TOKENS).bit_length() - 1) // 2))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in order, each text's closed by END, and the n + 1 bounds."""
    w, per = words(texts)
    n = len(per) - 1
    out = np.empty(len(w) + n, np.uint64)
    ends = per[1:] + np.arange(n)
    place = np.ones(len(out), bool)
    place[ends] = False
    out[place] = w
    out[ends] = END
    return out, per + np.arange(n + 1)


def features(numbers: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Rows of the weights (of `size`) that each token's context fires: bias, word before, two before, skips of one and of two."""
    n = len(numbers)
    since = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))

    def back(k: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        out[k:] = numbers[:-k] if k < n else 0
        out[since < k] = 0
        return out

    one, two, three = back(1), back(2), back(3)
    shift = np.uint64(64 - size.bit_length() + 1)
    out = np.zeros((n, 5), np.int32)
    with np.errstate(over="ignore"):
        for k, key in enumerate((one, (one << np.uint64(16)) + two, two, three)):
            out[:, k + 1] = np.maximum(((key + np.uint64(1)) * _FACTORS[k]) >> shift, 1)
    return out


def _logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights.take(rows[:, 0], 0)
    for k in range(1, rows.shape[1]):
        out += weights.take(rows[:, k], 0)
    out -= out.max(1, keepdims=True)
    return out


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log probabilities of the columns for a sparse batch: the rows that fire are added up."""
    out = _logits(weights, rows)
    out -= np.log(np.exp(out).sum(1, keepdims=True))
    return out


def log_class(weights: tuple[np.ndarray, np.ndarray], rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log probability of each row's class."""
    groups, within = classes // WITHIN, classes % WITHIN
    at = np.arange(len(rows))
    return log_softmax(weights[0], rows)[at, groups] + log_softmax(weights[1], rows * GROUPS + groups[:, None].astype(np.int32))[at, within]


def _firsts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))


def _move(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    """Adagrad's move of distinct rows along their gradients."""
    power = squares.take(rows, 0)
    power += g * g
    squares[rows] = power
    power += 1
    np.sqrt(power, power)
    g /= power
    g *= np.float32(STEP)
    g += weights.take(rows, 0)
    weights[rows] = g


def _step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, columns: np.ndarray, sorted_: np.ndarray, token: np.ndarray) -> None:
    """One Adagrad step on a batch's log likelihood of its columns. The first of rows, the bias, ascends; sorted_: all other rows, sorted, with their tokens."""
    gradient = _logits(weights, rows)
    np.exp(gradient, gradient)
    gradient /= -gradient.sum(1, keepdims=True)
    gradient[np.arange(len(rows)), columns] += 1
    first = _firsts(sorted_)
    _move(weights, squares, sorted_[first], np.add.reduceat(gradient.take(token, 0), first))
    first = _firsts(rows[:, 0])
    _move(weights, squares, rows[first, 0], np.add.reduceat(gradient, first))


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows but the bias, sorted, and their tokens, which ascend in equal ones."""
    flat = rows[:, 1:].ravel()
    order = np.argsort(flat.astype(np.uint16), kind="stable")  # 16 bits are sorted by counting
    return flat[order], order // (rows.shape[1] - 1)


def _update(weights: tuple[np.ndarray, np.ndarray], squares: tuple[np.ndarray, np.ndarray], rows: np.ndarray, classes: np.ndarray) -> None:
    """One step of the groups and one of the classes in the tokens' own groups; tokens in order of their groups, so one sort serves both."""
    groups = classes // WITHIN
    by = np.argsort(groups.astype(np.uint8), kind="stable")
    rows, groups, within = rows[by], groups[by].astype(np.int32), (classes % WITHIN)[by]
    sorted_, token = _sorted(rows)
    _step(weights[0], squares[0], rows, groups, sorted_, token)
    _step(weights[1], squares[1], rows * GROUPS + groups[:, None], within, sorted_ * GROUPS + groups[token], token)


def count_words(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """(word, count) over all tokens of docs; word is the hash as a signed integer. Counts go packed and pre-summed."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            word, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            place = ((word >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            ends = np.append(cuts[1:], len(word))
            parts = [[x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)] for x in (word, count.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array(place[cuts].astype(np.int64)), pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.binary())], names=["bucket", "words", "counts"])

        for batch in batches:
            tokens, _ = tokens_of(batch["text"])
            if len(tokens):
                held.append(tokens)
                n += len(tokens)
            if n >= TASK_TOKENS:
                n = 0
                yield flush()
        if held:
            yield flush()

    def gather(table: pa.Table) -> pa.Table:
        word = np.frombuffer(b"".join(table["words"].to_pylist()), np.uint64)
        count = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32)
        order = np.argsort(word)
        word, count = word[order], count[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        return pa.table({"word": pa.array(word[first].astype(np.int64)), "count": pa.array(np.add.reduceat(count, first) if len(word) else count)})

    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(send, "bucket long, words binary, counts binary")
    return materialize(sent.groupBy("bucket").applyInArrow(gather, "word long, count long"), "word_counts")


_PARTS = "part long, block int, tokens long, changes binary"


def _averaged(parts: DataFrame) -> np.ndarray:
    """Token-weighted mean of what the tasks changed; parts: part, block, tokens, changes (float16). A group holds FAN blocks at most, added in the parts' order."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("was")
        tokens = table["tokens"].to_numpy()
        total = sum(np.frombuffer(w, np.float16).astype(np.float32) * np.float32(t / max(tokens.sum(), 1)) for w, t in zip(table["changes"].to_pylist(), tokens, strict=True))
        return pa.table({"part": table["part"][:1].combine_chunks(), "block": table["block"][:1].combine_chunks(), "tokens": pa.array([int(tokens.sum())]), "changes": pa.array([np.asarray(total, np.float16).tobytes()], pa.binary())})

    while parts.agg(F.max("part")).first()[0]:
        fewer = materialize(parts.withColumn("was", F.col("part")).withColumn("part", F.expr(f"was div {FAN}")).groupBy("part", "block").applyInArrow(add, _PARTS), "averaged")
        discard(parts)
        parts = fewer
    rows = sorted(parts.toLocalIterator(), key=lambda r: r.block)  # one set of weights
    discard(parts)
    return np.concatenate([np.frombuffer(r.changes, np.float16) for r in rows]).astype(np.float32)


def packed_tokens(docs: DataFrame, id_col: str, text_col: str, vocabulary: Broadcast, slices: int, parts: int) -> DataFrame:
    """(slice, part, at, tokens, numbers, classes), a row per text, written: 2 bytes and 1 a token. Hashes of id and text deal rows to slices and parts, and order them there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            if batch.num_rows:
                t, bounds = tokens_of(batch["text"])
                at, found = known.look_up(t)
                numbers = known.numbers_of(at, found)
                numbers[bounds[1:] - 1] |= ENDS
                classes = known.classes_of(t, at, found).astype(np.uint8)
                cut = [[x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for x in (numbers, classes)]
                cols = [batch["slice"], batch["part"], batch["at"], pa.array(np.diff(bounds).astype(np.int64)), pa.array(cut[0], pa.binary()), pa.array(cut[1], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["slice", "part", "at", "tokens", "numbers", "classes"])

    key, text = F.col(id_col), F.col(text_col)
    dealt = docs.select(F.pmod(F.xxhash64(key, text), F.lit(slices)).alias("slice"), F.pmod(F.xxhash64(text, key), F.lit(parts)).alias("part"), F.xxhash64(key, text, key).alias("at"), text.alias("text"))
    packed = dealt.mapInArrow(run, "slice long, part long, at long, tokens long, numbers binary, classes binary")
    return materialize(packed, "packed", by=["slice"])


def unpacked(numbers: bytes, classes: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A packed row's features and classes."""
    words_ = np.frombuffer(numbers, np.uint16)
    bounds = np.unique(np.concatenate([[0], np.flatnonzero(words_ & ENDS) + 1, [len(words_)]]))
    return features(words_ & ~ENDS, bounds, size), np.frombuffer(classes, np.uint8).astype(np.int64)


def _trainer(shared: Broadcast, size: int, blocks: int = 64) -> Callable[[pa.Table], pa.Table]:
    """What one part's texts, in their order, change of the weights, in blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        own = tuple(w.copy() for w in shared.value)
        squares = tuple(np.zeros_like(w) for w in own)
        numbers, classes = (b"".join(table[c].to_pylist()) for c in ("numbers", "classes"))
        for a in range(0, len(classes), PIECE):  # texts cut here lose a context of three words
            rows, c = unpacked(numbers[2 * a : 2 * (a + PIECE)], classes[a : a + PIECE], size)
            for b in range(0, len(c), UPDATE):
                _update(own, squares, rows[b : b + UPDATE], c[b : b + UPDATE])
        changes = np.concatenate([(x - y).ravel() for x, y in zip(own, shared.value, strict=True)]).astype(np.float16)
        cut = [x.tobytes() for x in np.split(changes, blocks)]
        return pa.table({"part": pa.array([table["part"][0].as_py()] * blocks, pa.int64()), "block": pa.array(range(blocks), pa.int32()), "tokens": pa.array([len(classes)] * blocks, pa.int64()), "changes": pa.array(cut, pa.binary())})

    return run


def train(docs: DataFrame, id_col: str, text_col: str, vocabulary: Broadcast, tokens: int, epochs: int = EPOCHS, task_tokens: int = TASK_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Weights after `epochs` passes over all of docs, a slice a round, whose parts of about task_tokens are worked by a task each; the same however docs is partitioned."""
    size = hashed_rows(tokens)
    weights = vocabulary.value.start(size)
    if not tokens:
        return weights
    task_tokens *= size // ROWS
    slices = max(1, round(math.sqrt(tokens / task_tokens / 2)))
    packed = packed_tokens(docs, id_col, text_col, vocabulary, slices, max(1, math.ceil(tokens / slices / task_tokens)))
    full = sorted(r.slice for r in packed.select("slice").distinct().collect())  # a row a round
    spark = docs.sparkSession
    for k in full * epochs:
        shared = spark.sparkContext.broadcast(weights)

        parts = packed.where(F.col("slice") == k).select("part", "at", "numbers", "classes").groupBy("part")
        change = _averaged(materialize(parts.applyInArrow(_trainer(shared, size), _PARTS), "changes"))
        cut = weights[0].size
        weights = weights[0] + change[:cut].reshape(weights[0].shape), weights[1] + change[cut:].reshape(weights[1].shape)
        shared.destroy()
    discard(packed)
    return weights


_SCORED = "row_id long, id {}, held_out boolean, n_tokens long, n_frequent long, log_frequent double, log_classes double, rare array<struct<word: long, times: int>>"


def _score(docs: DataFrame, id_col: str, text_col: str, vocabulary: Broadcast, weights: Broadcast) -> DataFrame:
    """Per row: what the broadcast tables tell of its tokens, and its rare words, to be joined."""
    kind = pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = vocabulary.value, weights.value
        log_count = np.log10(known.counts + SMOOTH)
        log_mass = np.log10(np.maximum(known.mass, 1e-300))
        for batch in batches:
            t, bounds = tokens_of(batch["text"])
            at, found = known.look_up(t)
            classes = known.classes_of(t, at, found)
            rows = features(known.numbers_of(at, found), bounds, len(w[0]))
            of_class = np.empty(len(t))
            for a in range(0, len(t), UPDATE):
                of_class[a : a + UPDATE] = log_class(w, rows[a : a + UPDATE], classes[a : a + UPDATE])
            of_class = of_class / math.log(10) - log_mass[classes]
            frequent = np.where(found, log_count[at], 0.0) if len(log_count) else np.zeros(len(t))
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            d, r = doc[~found], t[~found]
            order = np.lexsort((r, d))
            d, r = d[order], r[order]
            first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])])) if len(d) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(d))).astype(np.int32)
            offsets = np.searchsorted(d[first], np.arange(len(bounds))).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(r[first].astype(np.int64)), pa.array(times)], names=["word", "times"]))
            per = lambda x: np.add.reduceat(x, bounds[:-1]) if len(x) else np.zeros(0)  # noqa: E731  no text is without tokens
            yield pa.RecordBatch.from_arrays([batch["row_id"], batch["id"], batch["held_out"], pa.array(np.diff(bounds)), pa.array(per(found.astype(np.int64)).astype(np.int64)), pa.array(per(frequent)), pa.array(per(of_class)), rare.cast(kind)], names=["row_id", "id", "held_out", "n_tokens", "n_frequent", "log_frequent", "log_classes", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _SCORED.format(docs.schema[id_col].dataType.simpleString()))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score, log10 probabilities of whole texts."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col), F.col(text_col))
    with arrow_batches(spark, 1000, "8m"):
        training = docs.where(~held_out(id_col))
        rough = training.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        counts = count_words(training, text_col, max(256, math.ceil(rough / (6 * TASK_TOKENS))))
        total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
        top = counts.orderBy(F.desc("count"), "word").limit(FREQUENT).toArrow()  # 16 bytes each
        hashes, times = top["word"].to_numpy().astype(np.uint64), top["count"].to_numpy()
        last = (int(times[-1]), int(top["word"][-1].as_py())) if len(times) else (0, 0)
        rare = materialize(counts.where((F.col("count") < last[0]) | ((F.col("count") == last[0]) & (F.col("word") > last[1]))), "rare_words") if distinct > len(times) else counts.limit(0)
        share = F.expr(f"shiftrightunsigned(word, {64 - _SHARE_BITS})").cast("int")
        mass = np.zeros(SHARES)
        for r in rare.groupBy(share.alias("share")).agg(F.sum(F.col("count") + F.lit(SMOOTH)).alias("mass")).toLocalIterator():
            mass[r.share] = r.mass
        vocabulary = spark.sparkContext.broadcast(Vocabulary(hashes, times, mass))
        weights = spark.sparkContext.broadcast(train(training, id_col, text_col, vocabulary, total))
        scored = materialize(_score(docs, id_col, text_col, vocabulary, weights), "scored")
        met = scored.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.times").join(rare, "word", "left")
        times_, count = F.col("times"), F.coalesce("count", F.lit(0))
        met = met.groupBy("row_id").agg(F.sum(times_ * F.log10(count + SMOOTH)).alias("log_rare"), F.sum(F.when(count > 0, times_).otherwise(0)).alias("n_rare"))
        met = materialize(met, "rare_scores")
        basics = materialize(scored.drop("rare"), "basics")
        discard(counts, rare, scored)
    norm = math.log10(total + SMOOTH * (distinct + 1))
    out = basics.join(met, "row_id", "left")
    logs = F.col("log_frequent") + F.coalesce("log_rare", F.lit(0.0))
    return out.select(
        "id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (logs + F.col("log_classes")).alias("score"),
    )
