"""WARC archives with records compressed one by one under an embedded Zstandard dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, trained from records to be
archived; then comes one Zstandard frame for each record. Any WARC reader that knows this layout can start at any frame.

Of pages with equal payloads of at least ``least`` bytes, the one with the smallest page_id is a response record, the
others are revisit records that refer to it and carry the HTTP head alone. The smallest page_id of each payload digest is
found by one aggregation with partial minima.

Tasks write archives to the shared folder under names of their own attempt. The manifest that Spark commits names, for
runs of frames of about ``run_bytes``, the archive and the byte range; reading back deals out these ranges.

Defined cases: a null html is an empty payload; a null url is written as an empty one; rows that repeat the smallest
page_id of a payload are all responses; a page with a null page_id is a response unless another page has its payload and
a page_id, and is read back with a null; an empty table gives no archives; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .storage import filesystem, new_file, saved, shared_dir, trained_dictionary

SKIPPABLE = 0x184D2A5D
#: Upper halves of the record ids of pages with and without a page_id.
PAGE, NO_PAGE = 0x8C6A3F0E5B7D4A11, 0x8C6A3F0E5B7D4A12
MASK = (1 << 64) - 1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, lower: int = 0) -> str:
    number = NO_PAGE << 64 | lower & MASK if page_id is None else PAGE << 64 | page_id & MASK
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(record: str) -> int | None:
    number = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = number & MASK
    return None if number >> 64 == NO_PAGE else low - (1 << 64) if low >> 63 else low


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A revisit record where first, the page that has the payload, is another page."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = first is not None and first != page_id
    url = "".join((url or "").split())
    fields = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", record_id(page_id, int.from_bytes(hashlib.sha1(payload + url.encode()).digest()[:8], "big"))),
        ("WARC-Target-URI", url),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if again:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first))]
    return record(fields, http if again else http + payload)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def with_first(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, html, first): the smallest page_id of the pages with this payload, null where that is this one."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    # Short payloads stay apart: their key is null, which joins nothing. Keys alone are brought together, and what is found
    # goes back to the pages by their ids, so that a payload of many pages burdens no task with their html.
    key = F.when(F.octet_length("html") >= least, F.sha1("html"))
    keys = pages.select("page_id", key.alias("sha"))
    same = keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND sha IS NOT NULL")
    same = saved(same.select(F.col("sha").alias("k"), "first"), "same")
    again = keys.join(same, F.col("sha") == F.col("k")).where("NOT first <=> page_id").select(F.col("page_id").alias("a_id"), F.col("sha").alias("a_sha"), "first").distinct()
    found = pages.withColumn("sha", key).join(saved(again, "again"), F.col("page_id").eqNullSafe(F.col("a_id")) & (F.col("sha") == F.col("a_sha")), "left")
    return found.select("page_id", "url", "html", "first")


def trained(pages: DataFrame, sample_pages: int, sample_chars: int, size: int) -> bytes:
    """A dictionary from the records of `sample_pages` pages, those with the smallest hash of the ones of up to `sample_chars` characters; only where there are fewer, longer ones are cut to that length."""
    keys = pages.where(F.length("html") > 0).select("page_id", (F.length("html") > sample_chars).alias("long"), F.xxhash64("page_id", "html").alias("h"))
    chosen = keys.orderBy("long", "h", "page_id").limit(sample_pages).select(F.col("page_id").alias("s_id"), F.col("h").alias("s_h")).distinct()
    sample = pages.join(F.broadcast(chosen), F.col("page_id").eqNullSafe(F.col("s_id")) & (F.xxhash64("page_id", "html") == F.col("s_h")))
    rows = sample.select("page_id", "url", F.substring("html", 1, sample_chars).alias("html")).limit(sample_pages).collect()
    return trained_dictionary([page_record(r.page_id, r.url, r.html.encode(), None) for r in rows], size)


MANIFEST = "archive string, start long, end long, records int"


def write_archives(
    pages: DataFrame,
    folder: str,
    least: int = 0,
    archive_bytes: int = 256 << 20,
    run_bytes: int = 8 << 20,
    sample_pages: int = 256,
    sample_chars: int = 20_000,
    dictionary_bytes: int = 64 << 10,
    level: int = 3,
) -> DataFrame:
    """Writes the archives of (page_id, url, html) to folder and returns their committed manifest."""
    dictionary = trained(pages, sample_pages, sample_chars, dictionary_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained_ = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=trained_, write_content_size=True)
        out, uri, at, start, count = None, "", 0, 0, 0

        def row() -> pa.RecordBatch:
            values = zip(([uri], [start], [at], [count]), (pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in values], ["archive", "start", "end", "records"])

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                columns = [part.column(c).to_pylist() for c in ("page_id", "url", "first")]
                for page_id, url, first, payload in zip(*columns, T.texts(part.column("html")), strict=True):
                    if out is None:
                        uri, system, path = new_file(folder, ".warc.zst")
                        out = system.open_output_stream(path, compression=None)
                        head = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary
                        info = record(
                            [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")],
                            b"format: WARC File Format 1.1\r\n",
                        )
                        head += zip_.compress(info)
                        out.write(head)
                        at = start = len(head)
                    frame = zip_.compress(page_record(page_id, url, payload, first))
                    out.write(frame)
                    at, count = at + len(frame), count + 1
                    if at - start >= run_bytes or at >= archive_bytes:
                        done = at >= archive_bytes
                        if done:
                            out.close()
                            out = None
                        yield row()
                        start, count = at, 0
        if out is not None:
            out.close()
            if count:
                yield row()

    return saved(with_first(pages, least).mapInArrow(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload) of each record but warcinfo; a revisit has no payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                system, path = filesystem(m["archive"])
                with system.open_input_file(path) as f:
                    magic, size = struct.unpack("<II", f.read_at(8, 0))
                    if magic != SKIPPABLE:
                        raise ValueError(f"{m['archive']} does not start with a dictionary frame")
                    dictionary = f.read_at(size, 8)
                    data = f.read_at(m["end"] - m["start"], m["start"])
                unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
                rows, at, held = [], 0, 0
                while at < len(data):
                    one = unzip.decompressobj()
                    raw = one.decompress(data[at : at + (1 << 20)])
                    at += min(1 << 20, len(data) - at)
                    while not one.eof:
                        raw += one.decompress(data[at : at + (1 << 20)])
                        at += min(1 << 20, len(data) - at)
                    at -= len(one.unused_data)
                    fields, block = parsed(raw)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.decode().lower().partition("content-length:")[2].split("\r\n")[0])
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{m['archive']}: the payload of {fields['warc-record-id']} does not match its digest")
                    refers = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], kind, digest, size, refers, payload if kind == "response" else None))
                    held += len(raw)
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    ranges = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism, 100_000))
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    return manifest.repartition(ranges, "archive", "start").mapInArrow(read, schema)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS f FROM p GROUP BY h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to
FROM p JOIN f USING (h)
"""
