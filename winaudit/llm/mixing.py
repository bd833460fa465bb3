"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets in words are set by weight, stopped at a multiple of the source's
size, and the excess is shared again. They are paid in equal blocks of words:
blocks go to sources, and each source's blocks to its shards, by the highest
quotients weight / (2 s - 1), so quotas are integers that add up. A shard's
documents lie in seeded order, cut into blocks; whole passes over the shard come
first and the rest is the run of blocks that starts at a seeded one.

Sources are ordered by code point, null last. Null text has size 0; a document of
size 0 gives no words and is not laid out. Null ids and repeated rows are rows like others. Which of
two wholly equal rows takes more is open, the rest is the same in each run. An
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winaudit.functions.ordering import with_position
from winaudit.functions.scratch import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; words of a shard, about, as long as they make no more shards than MOST_SHARDS, and larger beyond.
BLOCK, SHARD, MOST_SHARDS = 32, 1 << 16, 1 << 17
#: Rows of a plan's table that is broadcast, at most.
FEW = 300_000


def sainte_lague(items: DataFrame, group: Sequence[str], key: str, weight: str, seats: str) -> DataFrame:
    """items with `quota`: the group's `seats` (same in each of its rows) dealt by highest quotients, ties to the smaller key.

    With W and n a group's weight and size, an item surely gets round(w (2 seats - n) / 2W) seats and
    never more than round(w (2 seats + n) / 2W); only quotients between, two an item on average, are ranked.
    Groups without weight, and items without, get none.
    """
    per = items.where(F.col(weight) > 0).groupBy(*group).agg(F.sum(weight).alias("__w"), F.count("*").alias("__n"), F.max(seats).alias("__k"))
    live = items.where(F.col(weight) > 0)
    if group:
        live = live.join(materialize(per, "apportion"), list(group))
    else:
        row = per.first()  # no groups: one row, of nulls if no item has weight
        kinds = {"__w": "double", "__n": "long", "__k": "long"}
        live = live.withColumns({c: F.lit(row[c]).cast(kind) for c, kind in kinds.items()})
    bound = lambda n: F.floor(F.col(weight) * F.greatest(2 * F.col("__k") + n, F.lit(0)) / (2 * F.col("__w")) + 0.5)
    live = live.select(*group, key, weight, "__k", F.greatest(bound(-F.col("__n")) - 1, F.lit(0)).alias("__low"), (bound(F.col("__n")) + 1).alias("__high"))
    live = materialize(live, "bounds")
    sure = live.groupBy(*group).agg((F.max("__k") - F.sum("__low")).alias("__left"))
    open_ = live.select(*group, key, F.explode(F.sequence(F.col("__low") + 1, F.col("__high"))).alias("__s"), weight).withColumn("__q", -F.col(weight) / (2 * F.col("__s") - 1))
    ranked = with_position(open_.drop(weight), list(group), ["__q", key], "__at")
    ranked = ranked.join(materialize(sure, "left"), list(group)) if group else ranked.withColumn("__left", F.lit(sure.first()["__left"]))
    won = ranked.where("__at < __left").groupBy(*group, key).agg(F.count("*").alias("__won"))
    got = live.join(materialize(won, "won"), [*group, key], "left").select(*group, key, (F.col("__low") + F.coalesce("__won", F.lit(0))).alias("quota"))
    return items.join(materialize(got, "quota"), [*group, key], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_no, source_size, target from sized's (source, size); only sums reach the driver."""
    per = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    per = with_position(per, [], [F.col("source").asc_nulls_last()], "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    per = materialize(per.select("*", weight.alias("weight"), (F.col("source_size") * F.lit(cap)).alias("most")), "weighted")
    budget = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:  # each round stops at least one more source, or none and ends
        over = (F.col("weight") * F.lit(level) > F.col("most")) if stopped >= 0 else F.lit(False)
        row = per.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("most")).otherwise(0.0)).alias("paid"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if row.n == stopped or not row.open:
            break
        stopped, level = row.n, (budget - row.paid) / row.open
    return per.select("source", "source_no", "source_size", F.least(F.col("weight") * F.lit(level), "most").alias("target"))


def laid_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = BLOCK, shard: int = SHARD, seed: int = 17) -> DataFrame:
    """Per document: id, text_hash, source, at (place in the seeded order), size, source_size, target, shards (of its source), shard, passes and taken, the words that the mix takes of it, repeats counted."""
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(source_col).alias("source"), word_count(text).alias("size"))
    sized = materialize(sized.withColumn("at", F.xxhash64("id", "text_hash", F.lit(seed))), "sized")
    targets = materialize(source_targets(sized, weights, share, cap), "targets")
    words, total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    shard = max(shard, words // MOST_SHARDS)
    seats = sainte_lague(targets.withColumn("seats", F.lit(round(total / block)).cast("long")), [], "source_no", "target", "seats")
    seats = materialize(seats.select("source", "source_no", "source_size", "target", F.col("quota").alias("blocks"), F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard).alias("shards")), "seats")
    dealt = sized.alias("d").join(seats.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("id", "text_hash", "d.source", "at", "size", "source_no", "source_size", "target", "blocks", "shards", F.pmod("at", F.col("shards")).alias("shard"))
    dealt = materialize(dealt, "dealt")
    discard(sized)
    shards = dealt.where("size > 0").groupBy("source_no", "shard").agg(F.sum("size").alias("words"), F.max("blocks").alias("blocks"))
    shards = shards.withColumn("words", F.col("words").cast("double"))
    quotas = sainte_lague(shards, ["source_no"], "shard", "words", "blocks")
    n = F.ceil(F.col("words") / block)
    quotas = quotas.select("source_no", "shard", F.col("words").cast("long").alias("words"), n.alias("n"), F.least("quota", F.floor(n * F.lit(cap))).alias("quota"))
    quotas = quotas.withColumn("first", F.pmod(F.xxhash64("source_no", "shard", F.lit(seed)), F.greatest("n", F.lit(1))))
    quotas = materialize(quotas, "quotas")
    order = Window.partitionBy("source_no", "shard").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.where("size > 0").withColumn("until", F.sum("size").over(order)).join(quotas, ["source_no", "shard"])
    since, until = F.col("until") - F.col("size"), F.col("until")
    rest = F.when(F.col("n") > 0, F.col("quota") % F.greatest("n", F.lit(1))).otherwise(0)
    inside = lambda a, b: F.greatest(F.least(until, b) - F.greatest(since, a), F.lit(0))
    run = inside(F.col("first") * block, F.least((F.col("first") + rest) * block, "words")) + inside(F.lit(0), (F.col("first") + rest - F.col("n")) * block)
    passes = F.when(F.col("n") > 0, F.floor(F.col("quota") / F.greatest("n", F.lit(1)))).otherwise(0)
    names = ["id", "text_hash", "source", "at", "size", "source_size", "target", "shards", "shard"]
    some = laid.select(*names, passes.cast("long").alias("passes"), (passes * F.col("size") + run).cast("long").alias("taken"))
    return some.unionAll(dealt.where("size = 0").select(*names, F.lit(0).cast("long"), F.lit(0).cast("long")))


def mix(docs: DataFrame, **how) -> DataFrame:
    """Per document: id, text_hash, size, source_size, target and taken. how: see laid_out()."""
    return laid_out(docs, **how).select("id", "text_hash", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **how) -> DataFrame:
    """docs' rows, each as often as the mix takes it: its words taken over its size, rounded half up; without words not at all.

    The documents that a shard's run takes once more are neighbours in the seeded order, so a shard's plan is
    its passes and the ends of one or two spans. These few rows are looked up; texts stay where they
    are. Rows equal in id and text come equally often.
    """
    laid = materialize(laid_out(docs, id_col, text_col, source_col, seed=seed, **how).where("size > 0"), "laid")
    more = F.floor(F.col("taken") / F.col("size") + 0.5) > F.col("passes")
    order = Window.partitionBy("source", "shard").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = laid.select("source", "shard", "shards", "passes", "at", more.alias("more"), F.count(F.when(~more, 1)).over(order).alias("island"))
    spans = marked.groupBy("source", "shard", "shards", "passes", "island").agg(F.min(F.when(F.col("more"), F.col("at"))).alias("low"), F.max(F.when(F.col("more"), F.col("at"))).alias("high"))
    span = F.when(F.col("low").isNotNull(), F.struct("low", "high"))
    plan = materialize(spans.groupBy("source", "shard", "shards", "passes").agg(F.collect_list(span).alias("spans")), "mix_plan")
    sources = materialize(plan.groupBy("source").agg(F.max("shards").alias("shards")), "mix_sources")
    discard(laid)
    small = F.broadcast if plan.count() <= FEW else lambda df: df
    text = F.col(f"`{text_col}`")
    at = F.xxhash64(F.col(f"`{id_col}`"), F.xxhash64(text), F.lit(seed))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.where(F.coalesce(F.rlike(text, F.lit(WORD)), F.lit(False))).select(row, F.col(f"`{source_col}`").alias("source"), at.alias("at"))
    placed = rows.alias("d").join(small(sources.alias("s")), F.col("d.source").eqNullSafe(F.col("s.source"))).select("row", "d.source", "at", F.pmod("at", F.col("shards")).alias("shard"))
    found = placed.alias("d").join(small(plan.alias("p")), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.shard") == F.col("p.shard")))
    copies = F.col("passes") + F.exists("spans", lambda s: F.col("at").between(s["low"], s["high"])).cast("long")
    return found.select("row", copies.alias("copies")).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
