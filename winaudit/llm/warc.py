"""WARC archives, read through their index.

Index first: writing an archive returns, per record, its file, offset, length,
url and digest; reading selects index rows, sorts them by place and fetches
neighbours with one byte-range read. Each record is a gzip member of its own, so
any range of members is readable alone. Of records with equal payloads the one
with the largest id is the response, the others are revisits that refer to it.

Files go to a folder that executors share. Each task attempt writes names of its own,
and only the index rows that Spark commits name files, so a lost or repeated
task leaves at most files that nothing refers to.

Null payloads count as empty, a null url as ''; white space in urls is percent-encoded. Null ids are records too, urn
"null"; rows that repeat an id and payload share the record type. An empty table
gives an empty index. Extra columns don't matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winaudit.functions.scratch import materialize

#: Bytes of an archive file after which a task begins the next; of one coalesced read; of a gap that is read over.
FILE_BYTES, READ_BYTES, GAP_BYTES = 256 << 20, 8 << 20, 64 << 10
#: Bytes of records that a task reads, about: offsets are dealt in stretches of so many bytes; longer ones beyond so many tasks.
STRETCH, MOST_TASKS = 16 << 20, 1 << 16
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a binary's SHA-1: 20 bits, five hex digits, at a time."""
    digest = F.sha1(payload)
    quad = lambda i: F.lpad(F.conv(F.substr(digest, F.lit(5 * i + 1), F.lit(5)), 16, 32), 4, "0")
    return F.translate(F.concat(*[quad(i) for i in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """id, url, payload, payload_digest, payload_bytes, record_type, refers_to of each row.

    The largest ids per digest are aggregated before the shuffle and written: the join
    that brings them back is one whose large partitions Spark can split.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    base = base.withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    strong = F.unhex(F.sha2("payload", 256)).alias("strong")  # SHA-1 alone may be made to collide
    first = base.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", strong).agg(F.max("id").alias("first"), F.count("*").alias("n"))
    shared = materialize(first.where("n > 1").select("payload_digest", "strong", "first"), "shared_payloads")
    out = base.withColumn("strong", strong).join(shared, ["payload_digest", "strong"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.col("payload_bytes") >= min_bytes)
    return out.select(*base.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def _urn(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(row: dict) -> bytes:
    """One WARC/1.1 record. The HTTP header names the full payload's length; a revisit ends with it."""
    body = b"" if row["record_type"] == "revisit" else row["payload"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    url = re.sub(r"\s", lambda m: quote(m[0]), row["url"])
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['id'])}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http; msgtype=response", f"X-Page-Id: {'' if row['id'] is None else row['id']}",
    ]
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(row['refers_to'])}", f"X-Refers-To-Page: {row['refers_to']}"]
    head.append(f"Content-Length: {len(http) + len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The headers, HTTP length and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return {"fields": fields, "payload": payload, "length": length}


def write_archives(typed: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write record_types() rows as .warc.gz files in folder (a uri that executors share); returns the index, stored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = gzip.compress(record(r), 6, mtime=0)
                out.write(data)
                rows.append({"file": name, "offset": at, "length": len(data), **{k: v for k, v in r.items() if k != "payload"}})
                at += len(data)
            yield pa.RecordBatch.from_pylist(rows, schema=_INDEX_SCHEMA)
        if out is not None:
            out.close()

    return materialize(typed.select("id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to").mapInArrow(write, INDEX), "warc_index")


_INDEX_SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_READ = "id long, url string, record_type string, declared_digest string, declared_bytes long, refers_to long, payload binary"
_READ_SCHEMA = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def coalesced(places: list[tuple[str, int, int]], read_bytes: int = READ_BYTES, gap: int = GAP_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) -> (file, start, end, members): one read per run of near neighbours."""
    run: list[tuple[int, int]] = []
    file, start, end = "", 0, 0
    for f, offset, length in places:
        if run and (f != file or offset - end > gap or offset + length - start > read_bytes):
            yield file, start, end, run
            run = []
        if not run:
            file, start, end = f, offset, offset
        run.append((offset, length))
        end = max(end, offset + length)
    if run:
        yield file, start, end, run


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Fetch and parse the index rows' records. Places are dealt in stretches of a file and read in order.

    The number of tasks follows the bytes to read, which the few bytes of the index rows don't show.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            places = list(zip(batch["file"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True))
            file, handle = None, None
            for f, start, end, members in coalesced(places):
                if f != file:
                    file, handle = f, fs.open_input_file(f"{base}/{f}")
                data = handle.read_at(end - start, start)
                rows = []
                for offset, length in members:
                    got = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    h = got["fields"]
                    rows.append({
                        "id": int(h["X-Page-Id"]) if h["X-Page-Id"] else None, "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "declared_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"),
                        "declared_bytes": got["length"], "refers_to": int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None, "payload": got["payload"],
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=_READ_SCHEMA)

    total = index.agg(F.sum("length")).first()[0] or 1
    stretch = max(STRETCH, total // MOST_TASKS)
    dealt = index.select("file", "offset", "length").repartition(math.ceil(total / stretch), "file", F.expr(f"offset div {stretch}")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, _READ)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_pages(index: DataFrame, folder: str) -> DataFrame:
    """Per record: id, payload_bytes, payload_digest, record_type, refers_to; of revisits, those of the payload referred to.

    Lengths and digests are taken from the payloads read; revisits get them from their response
    by id, and a record whose header says otherwise fails the read.
    """
    got = read_records(index, folder).select("id", "record_type", "refers_to", "declared_digest", "declared_bytes", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    got = materialize(got, "read")
    responses = got.where("record_type = 'response' and id is not null").groupBy(F.col("id").alias("refers_to"), F.col("digest").alias("declared_digest")).agg(F.max("bytes").alias("full_bytes"))
    responses = materialize(responses, "responses")
    whole = got.join(responses, ["refers_to", "declared_digest"], "left")
    digest = F.when(F.col("record_type") == "response", F.col("digest")).when(F.col("full_bytes").isNotNull(), F.col("declared_digest"))
    size = F.when(F.col("record_type") == "response", F.col("bytes")).otherwise(F.col("full_bytes"))
    checked = whole.select("id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", (digest.eqNullSafe(F.col("declared_digest")) & size.eqNullSafe(F.col("declared_bytes"))).alias("ok"))
    return checked.where(F.when(F.col("ok"), True).otherwise(F.raise_error(F.lit("a record's payload differs from its header")).cast("boolean"))).drop("ok")
