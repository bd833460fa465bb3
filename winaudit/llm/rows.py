"""Taking rows out of a table of texts by key, without shuffling the texts that stay.

Keys are (id, key) pairs, null-safe in id. A few are broadcast. More set the bits of a
filter of bounded size, which is broadcast: rows that it rules out stay where they
are, and only the others, those to go and some by chance, are shuffled to the keys.
Columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most; 64-bit words of the filter at most (16 bytes each, broadcast).
FEW, MOST_WORDS = 100_000, 1 << 20


def _keyed(docs: DataFrame, id_col: str, key: Column) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), key.alias("key"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))


def _joined(keyed: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    return keyed.alias("a").join(keys.alias("b"), _same("a", "b"), how)


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, key: Column, few: int = FEW) -> DataFrame:
    """docs' rows whose (id, key) is not in gone (id, key), stored. A null key matches nothing."""
    keyed = _keyed(docs, id_col, key)
    n = gone.count()
    if n <= few:
        return _joined(keyed, F.broadcast(gone), "left_anti").select("row.*")
    words = min(MOST_WORDS, 1 << (n // 4).bit_length())
    word, bit = F.pmod(F.xxhash64("id", "key"), F.lit(words)), F.pmod(F.xxhash64("key", "id"), F.lit(64)).cast("int")
    filter_ = gone.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(xxhash64(key, id), 64) as int)))").alias("bits"))
    known = keyed.withColumns({"word": word, "bit": bit}).join(F.broadcast(filter_), "word", "left")  # at most MOST_WORDS rows
    maybe = F.coalesce(F.getbit("bits", "bit") == 1, F.lit(False))
    stays = known.where(~maybe).select("row")
    return stays.unionAll(_joined(known.where(maybe).select("row", "id", "key"), gone, "left_anti").select("row")).select("row.*")


def one_of_each(docs: DataFrame, keys: DataFrame, id_col: str, key: Column) -> DataFrame:
    """One of docs' rows for each of keys (id, key) that it has; aggregated before the shuffle, so equal rows, however many, don't meet in a task."""
    found = _joined(_keyed(docs, id_col, key), keys, "left_semi")
    return found.groupBy("id", "key").agg(F.first("row").alias("row")).select("row.*")
