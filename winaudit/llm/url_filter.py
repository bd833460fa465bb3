"""URL filters by Bloom filter cascades, in DataFrame functions only.

A url's candidate keys are (host suffix, path prefix) strings; a rule fits the
url exactly if the rule's key is among them. Which candidates are listed is
answered by a cascade: level 1 encodes the listed keys, level 2 the corpus keys
that level 1 wrongly admits, level 3 the listed keys that level 2 wrongly
admits, and so on until a level admits no wrong key. Over the key universe for
which it was built the answer is exact, and asking it needs no join.

Nulls and urls without "://" give host '' and path '', which no rule fits.
Rules with a null host, path or verdict are ignored; of repeated rules with
both verdicts, block wins. Of rules of equal length the one with the longer host
wins. An empty table gives an empty table, extra columns pass through.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winaudit.functions.scratch import discard, materialize
from winaudit.llm.text import LOWER, UPPER

#: Bits a key and hash functions of level 1, and of the levels above it.
FIRST, LATER = (10, 4), (4, 2)
#: A cascade may hold so many bytes; it travels with each task, like a broadcast. Parts that keys are dealt to where one can't hold them.
MAX_FILTER_BYTES, PARTS = 16 << 20, 4096


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Host suffixes at label bounds, longest first, each with the path prefixes of the lengths that rules have."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in sorted(path_lengths, reverse=True)]), lambda n: n <= F.length(path))
    prefixes = F.transform(lengths, lambda n: F.substr(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


@dataclass(frozen=True)
class Level:
    bits: bytes  # 8 bits a byte, low bit first
    size: int
    hashes: int
    seed: int

    def has(self, key: Column) -> Column:
        out = F.lit(True)
        for i in range(self.hashes):
            at = _slot(key, self.seed, i, self.size)
            byte = F.conv(F.hex(F.substr(F.lit(self.bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & F.getbit(byte, (at % 8).cast("int")).cast("boolean")
        return out


def _slot(key: Column, seed: int, i: int, size: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(size))


def _level(keys: DataFrame, n: int, seed: int) -> Level:
    """The set bits are or-ed into words by Spark; only the filter's own words reach the driver."""
    per_key, hashes = FIRST if seed == 1 else LATER
    size = 64 * max(1, math.ceil(n * per_key / 64))
    slots = keys.select(F.explode(F.array(*[_slot(F.col("key"), seed, i, size) for i in range(hashes)])).alias("at"))
    words = slots.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    out = bytearray(size // 8)
    for word, bits in words.toLocalIterator():
        out[8 * word : 8 * word + 8] = (bits & (2**64 - 1)).to_bytes(8, "little")
    return Level(bytes(out), size, hashes, seed)


class FilterTooLarge(ValueError):
    """The cascade would exceed its size bound."""


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> list[Level]:
    """Levels for `listed` (column key) that answer exactly for each key of `listed` and `universe`."""
    ins = materialize(listed.select("key").where("key is not null").distinct(), "listed")
    n, total, levels, outs = ins.count(), 0, [], None
    while n:
        seed = len(levels) + 1
        total += n * (FIRST if seed == 1 else LATER)[0] // 8
        if total > max_bytes:
            raise FilterTooLarge(f"{total} bytes of filters for {n} keys at level {seed}; the bound is {max_bytes}")
        level = _level(ins, n, seed)
        levels.append(level)
        if outs is None:  # the only pass over the corpus keys: few pass level 1
            passed = universe.where(level.has(F.col("key"))).distinct().join(ins, "key", "left_anti")
        else:
            passed = outs.where(level.has(F.col("key")))
        ins, outs = materialize(passed.select("key"), "admitted"), ins
        n = ins.count()
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """The first level that lacks the key decides: an odd one says no, an even one yes."""
    out = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(~level.has(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Add host, path, rule and verdict to pages. rules: host, path, verdict ('allow' or 'block').

    Without a fitting rule the cascades answer "not listed": rule null, verdict allow.
    Lists beyond max_bytes of filters are dealt to several cascades, which are asked one after the other.
    """
    rules = rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
    keyed = materialize(rules.groupBy(F.concat(F.translate("host", UPPER, LOWER), "path").alias("key")).agg(F.max("verdict").alias("verdict"), F.max(F.length("path")).alias("n")), "rules")
    lengths = [r.n for r in keyed.select("n").distinct().toLocalIterator()]
    base = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    keys = candidate_keys(F.col("host"), F.col("path"), lengths or [0])
    universe = base.select("host", "path").distinct().select(F.explode(keys).alias("key"))
    try:
        blocked, allowed = (build_cascade(keyed.where(F.col("verdict") == v), universe, max_bytes) for v in ("block", "allow"))
    except FilterTooLarge:
        return _by_parts(base, keys, keyed, max_bytes)
    longest = lambda found: F.aggregate(found, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))
    named = base.withColumn("rule", longest(F.filter(keys, lambda k: is_listed(k, blocked) | is_listed(k, allowed))))
    return named.withColumn("verdict", F.when(F.col("rule").isNotNull() & is_listed(F.col("rule"), blocked), "block").otherwise("allow"))


def _by_parts(base: DataFrame, keys: Column, keyed: DataFrame, max_bytes: int) -> DataFrame:
    """The same for lists whose filters are too large for one cascade: a hash deals keys to parts, each with cascades of its own.

    The corpus' distinct (host, path) pairs are asked part by part, one part's filters at a time; what fits a pair best is then joined to its pages.
    """
    asked = base.select("host", "path").distinct().select("host", "path", F.posexplode(keys).alias("at", "key"))
    asked = materialize(asked.withColumn("part", _part(F.col("key"))), "asked")
    dealt = materialize(keyed.withColumn("part", _part(F.col("key"))), "dealt")
    hits = None
    for low, high in _ranges(dealt, max_bytes):
        mine = F.col("part").between(low, high)
        some, universe = dealt.where(mine), asked.where(mine)
        blocked, allowed = (build_cascade(some.where(F.col("verdict") == v), universe.select("key"), sys.maxsize) for v in ("block", "allow"))
        fits = universe.where(is_listed(F.col("key"), blocked) | is_listed(F.col("key"), allowed))
        fits = materialize(fits.select("host", "path", "at", "key", F.when(is_listed(F.col("key"), blocked), "block").otherwise("allow").alias("verdict")), "fits")
        hits = fits if hits is None else hits.unionAll(fits)
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), -F.col("at"))).alias("best"))
    best = materialize(best.select("host", "path", F.col("best.key").alias("rule"), F.col("best.verdict").alias("verdict")), "fitting")
    discard(asked, dealt)
    return base.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).select(*base.columns, "rule", "verdict")


def _part(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(PARTS), key), F.lit(PARTS)).cast("int")


def _ranges(dealt: DataFrame, max_bytes: int) -> list[tuple[int, int]]:
    """Ranges of parts whose keys' filters come to about half of max_bytes at level 1; one part at least."""
    most = max(1, max_bytes * 8 // FIRST[0] // 2)
    counts = {r.part: r["count"] for r in dealt.groupBy("part").count().collect()}  # PARTS rows at most
    out, low, n = [], 0, 0
    for part in range(PARTS):
        here = counts.get(part, 0)
        if n and n + here > most:
            out.append((low, part - 1))
            low, n = part, 0
        n += here
    return [*out, (low, PARTS - 1)]
