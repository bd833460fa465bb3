"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

Each text is cut at content-defined bounds into chunks; a document's recipe is
the ordered list of its chunks' identifiers. The identifiers are 64-bit hashes
that the chunk dictionary verifies: where two chunks of different SHA-256
share one, the recipes are compared by SHA-256 instead. Texts are then equal
exactly if their recipes are, and only recipes, about a hundredth of the text,
are shuffled.

Null text counts as empty (recipe of no chunks). A null id ranks below all
others, so it stays only in a group of null ids; of rows that repeat both id and
text one is kept. Extra columns don't matter. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winaudit.functions.scratch import materialize
from winaudit.llm.rows import one_of_each, without_rows
from winaudit.llm.text import ascii_lower

#: Chunk lengths in characters: at least, and at most if no bound comes.
MIN_CHUNK, MAX_CHUNK = 1024, 8192
#: A bound follows two characters of these; about one place in a hundred of running text.
BOUND = r"(?<=[\s.,;:!?][b-df-hj-np-tv-z])"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The text's chunks in order; joined they are the text. Short texts, most of them, are one chunk."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?{BOUND}|.{{1,{most}}}"), F.lit(0))
    return F.when(F.octet_length(text) == 0, F.array().cast("array<string>")).when(F.octet_length(text) <= least, F.array(text)).otherwise(cut)


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row_id, id, text_sha256, n_bytes and the recipe (ids: 64 bits, strong: SHA-256), written.

    row_id names a row while this table lives; being written, it stays.
    """
    norm = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    cut = norm.select("id", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), chunks(F.col("norm")).alias("parts"))
    out = cut.select(
        F.monotonically_increasing_id().alias("row_id"), "id", "text_sha256", "n_bytes",
        F.transform("parts", lambda c: F.xxhash64(c)).alias("ids"),
        F.transform("parts", lambda c: F.unhex(F.sha2(c, 256))).alias("strong"),
    )
    return materialize(out, "recipes")


def chunk_dictionary(recipe: DataFrame) -> DataFrame:
    """One row per distinct chunk identifier: id, documents' uses of it, and verified (one SHA-256 only)."""
    used = recipe.select(F.explode(F.arrays_zip("ids", "strong")).alias("c")).select("c.ids", "c.strong")
    return used.groupBy(F.col("ids").alias("chunk_id")).agg(F.count("*").alias("uses"), (F.min("strong") == F.max("strong")).alias("verified"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: row_id, id, keep_id, group_size, kept, text_sha256, n_chunks. The largest id of a group stays.

    The groups are aggregated before the shuffle and written, so the join back
    is one whose large partitions Spark can split: a hot group is no hot task.
    """
    recipe = recipes(docs, id_col, text_col)
    verified = not chunk_dictionary(recipe).where("not verified").limit(1).count()
    key = F.col("ids") if verified else F.col("strong")
    keyed = recipe.select("row_id", "id", "text_sha256", F.size("ids").alias("n_chunks"), key.alias("recipe"))
    top = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "row_id"))
    groups = keyed.groupBy("recipe").agg(top.alias("top"), F.count("*").alias("group_size"))
    groups = materialize(groups.select("recipe", F.col("top.id").alias("keep_id"), F.col("top.row_id").alias("keep_row"), "group_size"), "groups")
    return keyed.join(groups, "recipe").select("row_id", "id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256", "n_chunks")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows that stay, with docs' columns.

    The rows to drop, the few, are matched by (id, text digest), without shuffling the others. Where the
    table repeats the (id, digest) of a row that stays, one row of those is taken.
    """
    decided = exact_groups(docs, id_col, text_col)
    found = materialize(decided.where("group_size > 1").groupBy("id", F.col("text_sha256").alias("key")).agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "decided")
    again = found.where("kept and n > 1").select("id", "key")
    digest = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    out = without_rows(docs, found.where("not kept or n > 1").select("id", "key"), id_col, digest)
    return out if again.isEmpty() else out.unionAll(one_of_each(docs, again, id_col, digest))
