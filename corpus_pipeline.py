"""The corpus pipeline: quality, exact duplicates, near duplicates, mix, tokens.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return docs' columns. Each stage applies its
operator's decisions to every row that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winaudit.functions.scratch import materialize
from winaudit.llm import bpe, exact_dedup, jaccard, mixing, quality, rows

#: Pieces that the token stage's tables hold in a Python worker, which it shares with the other stages.
PIECES = 25_000
#: Rows and bytes that Python workers get at a time.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so workers get few at a time. The session keeps the setting: a stage's rows are made after it returns."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Labels of documents that aren't in docs are not used.

    Null and empty texts are judged by their site; without labels of both classes all stay; of an empty table
    nothing does. Rows equal in id, text, source and language are judged alike. Null sources and languages are sites. Columns of any name stay as they are.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept(docs, labels, F.col("source"), F.col("lang"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null counts as the empty text, null ids come last, of repeated rows one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id stays; texts without words all do.

    Ids that are null come last, then the text's hash decides. Rows are told apart by id and text, so documents
    whose id is null or repeated stand for themselves; of rows equal in both one stays. Very long texts are
    documents like others; of an empty table nothing stays.
    """
    found = materialize(jaccard.jaccard_components(docs), "near").where("n_shingles > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_hash")).alias("first")
    kept = materialize(found.groupBy("component").agg(first).select("component", "first.id", "first.text_hash"), "near_kept")
    here = F.col("k.id").eqNullSafe(F.col("f.id")) & (F.col("k.text_hash") == F.col("f.text_hash"))
    keys = found.groupBy("component", "id", "text_hash").agg(F.count("*").alias("n")).alias("f").join(kept.alias("k"), "component")
    keys = materialize(keys.select("f.id", F.col("f.text_hash").alias("key"), "n", here.alias("kept")), "near_keys")
    again = keys.where("kept and n > 1").select("id", "key")
    text_hash = F.xxhash64("text")
    out = rows.without_rows(docs, keys.where("not kept or n > 1").select("id", "key"), "doc_id", text_hash)
    return out if again.isEmpty() else out.unionAll(rows.one_of_each(docs, again, "doc_id", text_hash))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it: its words taken over its size, rounded half up; 0 to 2 times.

    Documents without words (null and empty texts) are not taken. Null sources are a source; rows equal in id and
    text come equally often; ties of the seeded order don't matter. An empty table gives none.
    """
    return mixing.repeated(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with its token ids (packed, little-endian 32-bit), their number, and whether decoding gives back the text.

    A row for every row, repeated ones too; null counts as the empty text, which has no ids.
    """
    small_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.with_ids(docs.select("doc_id", "source", "text"), path, pattern, most=PIECES, same="round_trip")
    return coded.select("doc_id", "source", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard", near_stage),
    ("mixing", mix_stage),
    ("byte_bpe", tokens_stage),
]

#: SQL can't express the classifier's fit, the near-duplicate components at scale, or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
