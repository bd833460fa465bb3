"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is a logistic model of text statistics and of the mean
log-odds of its hashed words and word pairs, which are counted in good and bad texts.
Each half of the labelled rows gets its log-odds from the other half's counts while
the model is fitted, so words are not trusted for having been seen.
Hosts and the paths under them get posteriors of their mean quality: a path is
shrunk toward its host, a host toward the global mean, the more the fewer
documents it has; the strength of either prior is estimated from the spread
between sites beyond sampling noise (method of moments). A document is judged by its
own log-odds plus the log-odds its path adds over the global mean, with the
document itself left out of its path's and host's sums.

The model is fitted on at most `max_rows` labelled rows, those with the smallest
hash of their id; everything else covers all documents. Null or empty text has
statistics of zeros; null hosts and paths are sites of their own. Repeated rows each
count and are each judged; labels that contradict each other are all used. Without
labels of both classes the model is flat at the labelled mean (0.5 if none) and all
documents stay. An empty table gives none; extra columns are
not read by judged() and pass kept() as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winaudit.functions.scratch import discard, materialize
from winaudit.llm.rows import without_rows
from winaudit.llm.words import buffer_of, mix, slices
from winaudit.llm.words import words as words_of
from winaudit.llm.workers import tidy

#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 20_000
#: Bytes of text whose statistics are taken together.
SLICE = 1 << 20
FEATURES = ("length", "upper", "digit", "mark", "bar", "bang", "dash", "accent", "line", "word_length", "repeat", "again")
#: Buckets (a power of two) that words and pairs of words are hashed to; count added to each.
BUCKETS, SMOOTH = 1 << 15, 0.5
_MARKS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{}~", np.uint8)


def _share(mask: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]) / n


def buckets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of neighbours, word by word, and the n + 1 bounds of each text's among them."""
    hashes, per = words_of(texts)
    with np.errstate(over="ignore"):
        pairs = mix(np.concatenate([np.zeros(min(1, len(hashes)), np.uint64), hashes[:-1]]) * np.uint64(3) + hashes)
    pairs[per[:-1][per[:-1] < len(pairs)]] = 0  # no pair ends with a text's first word
    both = np.column_stack([hashes, pairs]).ravel()
    return (both >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), 2 * per


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Per bucket the log of its share in good texts over that in bad ones; counts: bad and good, by bucket."""
    share = (counts + SMOOTH) / (counts + SMOOTH).sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def mean_odds(texts: pa.Array, odds: np.ndarray) -> np.ndarray:
    """Each text's mean log-odds over its words and pairs; 0 without words."""
    out = [np.zeros(0)]
    for part in slices(texts, SLICE):
        buckets, per = buckets_of(part)
        sums = np.concatenate([[0], np.cumsum(odds[buckets])])
        out.append((sums[per[1:]] - sums[per[:-1]]) / np.maximum(np.diff(per), 1))
    return np.concatenate(out)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, counted over whole texts."""
    return np.concatenate([np.zeros((0, len(FEATURES))), *(_statistics(part) for part in slices(texts, SLICE))])


def _statistics(texts: pa.Array) -> np.ndarray:
    raw, bounds = buffer_of(texts)
    size = np.diff(bounds)
    n = np.maximum(size, 1)
    upper = (raw >= 65) & (raw <= 90)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = ~space & np.concatenate([[True], space[:-1]]) if len(raw) else space
    words = np.maximum(_share(starts, bounds, np.ones(len(n))), 1)
    letters = np.maximum(_share(upper | ((raw >= 97) & (raw <= 122)), bounds, np.ones(len(n))), 1)
    marks = np.zeros(256, bool)
    marks[_MARKS] = True
    repeat = np.fromiter((_repeats(x.as_py() or "") for x in texts), float, len(texts))
    hashes, per = words_of(texts)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[per[:-1][per[:-1] < len(hashes)]] = False
    again = _share(again, per, np.maximum(np.diff(per), 1))
    return np.column_stack([
        np.log1p(size), _share(upper, bounds, letters), _share((raw >= 48) & (raw <= 57), bounds, n), _share(marks[raw], bounds, words), _share(raw == 124, bounds, words),
        _share(raw == 33, bounds, words), _share((raw == 45) | (raw == 59) | (raw == 58), bounds, words), _share(raw >= 192, bounds, n), _share(raw == 10, bounds, words),
        np.minimum((size - _share(space, bounds, np.ones(len(n)))) / words, 40) * (size > 0), repeat, again,
    ])


def _repeats(text: str) -> float:
    """Share of lines that repeat an earlier one."""
    lines = text.split("\n")
    return 1 - len(set(lines)) / len(lines)


class Model:
    """Logistic regression on standardised columns: the statistics and the mean log-odds of words by `odds`."""

    def __init__(self, rows: np.ndarray, good: np.ndarray, odds: np.ndarray, ridge: float = 1.0):
        self.odds = odds
        width = len(FEATURES) + 1
        self.mean, self.scale = (rows.mean(0), np.maximum(rows.std(0), 1e-9)) if len(rows) else (np.zeros(width), np.ones(width))
        self.weights = np.zeros(width + 1)
        base = float(np.clip(good.mean(), 0.02, 0.98)) if len(good) else 0.5
        self.weights[0] = np.log(base / (1 - base))
        self.fitted = len(good) > 0 and 0 < good.mean() < 1
        if not self.fitted:
            return
        x = self._design(rows)
        penalty = ridge * np.diag([0.0] + [1.0] * width)
        for _ in range(25):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (good - p) - penalty @ self.weights)
            self.weights = self.weights + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(rows)), np.clip((rows - self.mean) / self.scale, -8, 8)])

    def probability(self, texts: pa.Array) -> np.ndarray:
        rows = np.column_stack([statistics(texts), mean_odds(texts, self.odds)])
        return 1 / (1 + np.exp(-np.clip(self._design(rows) @ self.weights, -12, 12)))


def _word_counts(texts: DataFrame) -> np.ndarray:
    """Counts of each (half, class, bucket) over texts' rows: text, good, half. Tasks send sums; 4 * BUCKETS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(4 * BUCKETS, np.int64)
        for batch in batches:
            kind = batch["half"].to_numpy() * 2 + batch["good"].to_numpy().astype(np.int64)
            for k in range(4):
                for part in slices(batch["text"].filter(pa.array(kind == k)), SLICE):
                    sums[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(buckets_of(part)[0], minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["at", "n"])

    got = texts.select("text", "good", "half").mapInArrow(tidy(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 * BUCKETS)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(2, 2, BUCKETS)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """labels: id_col and label_col, 1 good or 0 bad; other values are ignored."""
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("good"))
    some = materialize(some.orderBy(F.xxhash64("id"), "id", "good").limit(max_rows), "labelled")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")  # at most max_rows rows
    texts = texts.orderBy(F.xxhash64("id", "good")).limit(max_rows).withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)))
    texts = materialize(texts, "labelled_texts")
    counts = _word_counts(texts)
    halves = np.stack([log_odds(counts[1]), log_odds(counts[0])])  # for each half the other's

    @F.arrow_udf("array<double>")
    def rows(texts: pa.Array, half: pa.Array) -> pa.Array:
        odds = np.where(half.to_numpy() == 0, mean_odds(texts, halves[0]), mean_odds(texts, halves[1]))
        return pa.array(list(np.column_stack([statistics(texts), odds])), pa.list_(pa.float64()))

    got = texts.select("id", "good", rows("text", "half").alias("x")).collect()
    discard(some, texts)
    got.sort(key=lambda r: (r.id, r.good, r.x))
    return Model(np.array([r.x for r in got]).reshape(len(got), len(FEATURES) + 1), np.array([r.good for r in got]), log_odds(counts.sum(0)))


def _strength(sites: DataFrame) -> float:
    """Prior documents of a site's beta prior, from the sites' n, mean and the mean m above them."""
    row = sites.agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("m"), 2)).alias("between"), F.count("*").alias("sites"),
        F.sum("within").alias("within"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("top"),
    ).first()
    if not row.n:
        return 1.0
    noise = row.within / row.n  # variance of one document's probability in its site
    spread = max((row.between - row.sites * noise) / row.n, 1e-9)
    return float(np.clip(noise / spread, 5.0, 1e6))


def _log_odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """scored: host, path, p. Returns (host, path, n, s, host_n, host_s, host_mean, path_mean), and top, the global mean, with the priors' documents, host and path."""
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("s2")]
    paths = materialize(scored.groupBy("host", "path").agg(*sums), "paths")
    within = F.col("s2") - F.col("s") * F.col("s") / F.col("n")
    top = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    top = 0.5 if top is None else float(top)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    hosts = hosts.select("host", "n", "s", (F.col("s") / F.col("n")).alias("mean"), within.alias("within"), F.lit(top).alias("m"))
    of_host = _strength(hosts)
    hosts = materialize(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + of_host * top) / (F.col("n") + of_host)).alias("host_mean")), "hosts")
    joined = paths.alias("a").join(hosts.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host"))).select("a.*", "host_n", "host_s", "host_mean")
    of_path = _strength(joined.select("n", (F.col("s") / F.col("n")).alias("mean"), within.alias("within"), F.col("host_mean").alias("m")))
    sites = joined.select("host", "path", "n", "s", "host_n", "host_s", "host_mean", ((F.col("s") + of_path * F.col("host_mean")) / (F.col("n") + of_path)).alias("path_mean"))
    return sites, {"top": top, "host": of_host, "path": of_path}


def judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_rows: int = MAX_ROWS, threshold: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: id, key (a hash of text, host and path), p_text, host_mean, path_mean (both without the document itself), p_quality and keep.

    Texts are scored once; what is written, joined and decided on are ids, keys and numbers. Rows equal in id, text, host and path are judged alike.
    """
    model = fit(docs, labels, max_rows, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], batch["key"], batch["host"], batch["path"], pa.array(model.probability(batch["text"]))], names=["id", "key", "host", "path", "p"])

    read = docs.select(F.col(id_col).alias("id"), judged_key(F.col(text_col), host, path).alias("key"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    scored = read.mapInArrow(tidy(score), f"id {read.schema['id'].dataType.simpleString()}, key long, host string, path string, p double")
    scored = materialize(scored, "judged")
    sites, prior = site_posteriors(scored)
    sites = materialize(sites.drop("host_mean", "path_mean"), "sites")  # broadcast by Spark if it is small, else joined by shuffling numbers
    same = F.col("a.host").eqNullSafe(F.col("b.host")) & F.col("a.path").eqNullSafe(F.col("b.path"))
    out = scored.alias("a").join(sites.alias("b"), same).select("a.id", "a.key", F.col("a.p").alias("p_text"), "b.n", "b.s", "b.host_n", "b.host_s")
    others = lambda s, n, k, m: (F.col(s) - F.col("p_text") + F.lit(prior[k]) * m) / (F.col(n) - 1 + F.lit(prior[k]))
    out = out.withColumn("host_mean", others("host_s", "host_n", "host", F.lit(prior["top"])))
    out = out.withColumn("path_mean", others("s", "n", "path", F.col("host_mean")))
    odds = _log_odds(F.col("p_text")) + _log_odds(F.col("path_mean")) - _log_odds(F.lit(prior["top"]))
    out = out.withColumn("p_quality", 1 / (1 + F.exp(-odds)))
    return out.select("id", "key", "p_text", "host_mean", "path_mean", "p_quality", ((F.col("p_quality") >= threshold) | F.lit(not model.fitted)).alias("keep"))


def judged_key(text: Column, host: Column, path: Column) -> Column:
    return F.xxhash64(text, host, path)


def kept(docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_rows: int = MAX_ROWS, threshold: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs' rows that judged() keeps, all columns as they are, whatever their names; texts that stay aren't moved."""
    verdicts = materialize(judged(docs, labels, host, path, max_rows, threshold, text_col, id_col).where("not keep").select("id", "key").distinct(), "rejected")
    return without_rows(docs, verdicts, id_col, judged_key(F.col(text_col), host, path))
