"""Readers and writers of flow records, with provenance and integrity checks."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winaudit.functions.clean import clean_names, dataset_name
from winaudit.functions.ordering import with_position
from winaudit.functions.ranges import meeting_ranges

# Where the data sets keep their flow files, below their folder.
LAYOUTS = {
    "swat": ("*_data/*.csv",),
    "ton_iot": ("Processed_datasets/Processed_IoT_dataset/*.csv", "Processed_datasets/Processed_Linux_dataset/*.csv", "__Train_Test_datasets/**/*.csv"),
    "unsw_nb15": ("Training and Testing Sets/*.csv", "*.csv"),
    "generic": ("**/*.csv",),
}


def glob_pattern(glob: str) -> str:
    """The glob as a regular expression: * stays in a folder, **/ spans any number of them."""
    return "".join({"**/": "(?:.*/)?", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part)) for part in re.split(r"(\*\*/|\*|\?)", glob))


def _below(folder: str) -> Column:
    """A file's path below the folder."""
    bare = lambda c: F.regexp_replace(c, r"^\w+:/*", "")
    top = re.sub(r"^\w+:/*", "", folder).strip("/")
    return F.regexp_replace(F.ltrim(bare(F.col("path")), F.lit("/")), "^" + re.escape(top) + "/*", "")


def list_dataset_files(spark: SparkSession, folder: str, dataset: str = "generic", globs: Sequence[str] | None = None) -> DataFrame:
    """(path, length) of a data set's files, sorted; path is below folder, contents are not read. globs replace the data set's layout."""
    wanted = globs or LAYOUTS.get(dataset_name(dataset), LAYOUTS["generic"])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(_below(folder).alias("path"), "length")
    return files.where(F.col("path").rlike("^(?:" + "|".join(glob_pattern(g) for g in wanted) + ")$")).distinct().orderBy("path")


def read_flow_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; names lose padding and byte order mark, values their leading blanks. gz files are read too, unsplit."""
    reader = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(list(paths) if not isinstance(paths, str) else paths)
    return df.toDF(*clean_names(df.columns))


def with_provenance(df: DataFrame) -> DataFrame:
    """Add source_file, 0-based row_index in it and its line (header first). For frames read from files.

    Rows are ordered by block start and place in the read; no file has to fit in a task.
    """
    tagged = df.select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    return with_position(tagged, ["source_file"], ["__block", "__at"], "row_index").withColumn("line", F.col("row_index") + 2).drop("__block", "__at")


def file_ts_ranges(df: DataFrame, file: str = "source_file", ts: str = "ts_s") -> DataFrame:
    """Per file min_ts, max_ts and file_order, its rank by (min_ts, file). One row per file; the window sees these only."""
    per = df.groupBy(file).agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
    return with_position(per, [], ["min_ts", file], "file_order")


def prune_files_by_ranges(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Files whose [min_ts, max_ts] overlaps any closed [lo, hi] of ranges, however many these are."""
    return meeting_ranges(files, ranges.select("lo", "hi"), "min_ts", "max_ts", "left_semi")


def write_table(df: DataFrame, path: str, by: Sequence[str] = ("split_role",), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_summary_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.coalesce(1).write.mode(mode).option("header", "true").csv(path)


#: Bytes of a file that a hashing task holds at a time.
PIECE_BYTES = 1 << 20


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """path below folder, sha256, and uncompressed_sha256 of .gz files (null if one can't be unpacked).

    Tasks get paths, not contents, and read each file once in pieces, hashing it and what it unpacks to together; so neither size matters.
    Where Python has no file system for the folder's scheme, files come through Spark's binary reader, which takes up to 2 GB each.
    Empty files aren't listed, as Spark's readers pass them over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    listed = files.select(_below(folder).alias("path"), F.col("path").alias("at"), "length").withColumn("gz", F.col("path").endswith(".gz"))
    if re.match(r"(?:file:)?/", folder):
        listed = listed.select("path", "at", "length", "gz").repartition(max(1, spark.sparkContext.defaultParallelism), "path")
        return listed.mapInArrow(_hash_paths, "path string, sha256 string, uncompressed_sha256 string")
    contents = files.select(_below(folder).alias("path"), "content").withColumn("gz", F.col("path").endswith(".gz"))
    return contents.mapInArrow(_hash_contents, "path string, sha256 string, uncompressed_sha256 string")


def _hashes(pieces: Iterator[bytes], gz: bool) -> tuple[str, str | None]:
    """SHA-256 of the joined pieces, and of what they unpack to, however many gzip members they are."""
    whole, inner, unpack = hashlib.sha256(), hashlib.sha256(), zlib.decompressobj(31)
    fine, rest = gz, b""
    for piece in pieces:
        whole.update(piece)
        rest = piece if fine else b""
        while rest and fine:
            try:
                inner.update(unpack.decompress(rest, PIECE_BYTES))
                if unpack.eof:
                    rest, unpack = unpack.unused_data, zlib.decompressobj(31)
                else:
                    rest = unpack.unconsumed_tail
            except zlib.error:
                fine = False
    while fine and not unpack.eof and (more := unpack.decompress(unpack.unconsumed_tail, PIECE_BYTES)):
        inner.update(more)
    return whole.hexdigest(), inner.hexdigest() if fine else None


def _found(names: list, results: list[tuple[str, str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([a for a, _ in results], pa.string()), pa.array([b for _, b in results], pa.string())], names=["path", "sha256", "uncompressed_sha256"])


def _hash_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces(at: str) -> Iterator[bytes]:
        with open(unquote(re.sub("^file:/*", "/", at)), "rb") as f:
            while piece := f.read(PIECE_BYTES):
                yield piece

    for batch in batches:
        for path, at, gz in zip(*(batch[c].to_pylist() for c in ("path", "at", "gz")), strict=True):
            yield _found([path], [_hashes(pieces(at), gz)])


def _hash_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content, gz in zip(batch["path"].to_pylist(), batch["content"], batch["gz"].to_pylist(), strict=True):
            view = memoryview(content.as_buffer())
            yield _found([path], [_hashes((bytes(view[i : i + PIECE_BYTES]) for i in range(0, len(view), PIECE_BYTES)), gz)])


def file_hash_check(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """found and manifest: path, sha256 and perhaps uncompressed_sha256. Per path a status: ok, mismatch, uncompressed mismatch, missing (not found) or unlisted."""
    inner = lambda df, n: (F.col("uncompressed_sha256") if "uncompressed_sha256" in df.columns else F.lit(None).cast("string")).alias(n)
    both = manifest.select("path", F.col("sha256").alias("want"), inner(manifest, "want_inner")).join(found.select("path", F.col("sha256").alias("have"), inner(found, "have_inner")), "path", "full_outer")
    status: Column = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") != F.col("want"), "mismatch")
    return both.select("path", status.when(F.col("have_inner") != F.col("want_inner"), "uncompressed mismatch").otherwise("ok").alias("status"))

