"""Media columns: 8-bit images in archive files, read by a data source that plans byte ranges.

``write_media`` stores each payload as a lossless 8-bit greyscale PNG, a member of an archive file. An archive is its
members back to back, then its directory (id, unpadded size, offset, length and CRC-32 of each member), then a trailer
that says where the directory is. Tasks write archives to the shared folder under names of their own attempt; the manifest
that Spark commits names the ones that count.

``MemberSource`` is a Spark data source over such a folder. Its plan is one partition for each range of ``rangeBytes`` of
each archive in the manifest, or of more where these would be over ``mostRanges``; a task reads the directory and the members that start in its range, in runs of about
``batchBytes``, and hands them on as Arrow batches. A member that cannot be read or fails its CRC is read again by itself
from its offset, with the archive opened anew, up to ``retries`` times; then the task fails, and Spark runs it again.

Payload: the UTF-8 bytes of a text, with bytes 255 up to a positive multiple of ``row_bytes``; an image has rows of that
many samples.

Defined cases: a null or empty text is one row of 255; repeated rows are members of their own; a null doc_id is kept;
an empty table gives an empty result; further columns are ignored; a folder without archives is empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import text as T
from .storage import filesystem, new_file, shared_dir

MAGIC = b"MEMBERS1"
ENTRY = np.dtype([("id", "<i8"), ("null", "<i8"), ("bytes", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("crc", "<u4")])
PNG = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG of rows of `width` samples, none of them filtered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    plain = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(plain, level)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples, a row for each row of the image; of an image as to_png writes it."""
    at, packed, width, height = len(PNG), [], 0, 0
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only images without row filters are read")
    return rows[:, 1:]


def padded(text: bytes, row_bytes: int) -> bytes:
    return text + b"\xff" * (-len(text) % row_bytes or (0 if text else row_bytes))


def write_media(docs: DataFrame, folder: str, row_bytes: int = 576, archive_bytes: int = 128 << 20) -> None:
    """Stores every whole text of (doc_id, text) as an image in archives under folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at, entries = None, "", 0, []

        def closed() -> pa.RecordBatch:
            out.write(np.array(entries, ENTRY).tobytes() + struct.pack("<QQ", at, len(entries)) + MAGIC)
            out.close()
            values = zip(([uri], [at], [len(entries)]), (pa.string(), pa.int64(), pa.int64()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in values], ["archive", "data_bytes", "members"])

        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                for i, t in zip(part.column("doc_id").to_pylist(), T.texts(part.column("text")), strict=True):
                    if out is None:
                        uri, system, path = new_file(f"{folder}/archives", ".members")
                        out, at, entries = system.open_output_stream(path, compression=None), 0, []
                    image = to_png(padded(t, row_bytes), row_bytes)
                    out.write(image)
                    entries.append((i or 0, i is None, len(t), at, len(image), zlib.crc32(image)))
                    at += len(image)
                    if at >= archive_bytes:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim.mapInArrow(write, "archive string, data_bytes long, members long").write.parquet(f"{folder}/manifest")


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 16 << 20))
        self.most_ranges = int(options.get("mostRanges", 100_000))
        self.batch_bytes = int(options.get("batchBytes", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[InputPartition]:
        import pyarrow.dataset as ds

        system, path = filesystem(f"{self.folder}/manifest")
        table = ds.dataset(path, filesystem=system, format="parquet").to_table(["archive", "data_bytes"])
        archives = list(zip(table["archive"].to_pylist(), table["data_bytes"].to_pylist(), strict=True))
        # The plan is the driver's: ranges grow with the archives, so that their number does not.
        step = max(self.range_bytes, -(-sum(size for _, size in archives) // self.most_ranges))
        return [Range(archive, a, min(size, a + step)) for archive, size in archives for a in range(0, size, step)]

    def directory(self, system, path: str) -> np.ndarray:
        with system.open_input_file(path) as f:
            size = f.size()
            at, n = struct.unpack("<QQ", (end := f.read_at(24, size - 24))[:16])
            if end[16:] != MAGIC:
                raise ValueError(f"{path} has no directory")
            return np.frombuffer(f.read_at(n * ENTRY.itemsize, at), ENTRY)

    def alone(self, system, path: str, member: np.void) -> bytes:
        """One member, from its offset, with new attempts."""
        error: Exception | None = None
        for _ in range(self.retries):
            try:
                with system.open_input_file(path) as f:
                    data = f.read_at(int(member["length"]), int(member["offset"]))
                if zlib.crc32(data) == member["crc"]:
                    return data
                error = ValueError("CRC mismatch")
            except OSError as e:
                error = e
        raise OSError(f"{path}: member at {member['offset']} can't be read: {error}")

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition where there is none
            return
        system, path = filesystem(partition.archive)
        members = self.directory(system, path)
        members = members[(members["offset"] >= partition.start) & (members["offset"] < partition.end)]
        first = 0
        while first < len(members):
            last = first + 1
            while last < len(members) and members["offset"][last] + members["length"][last] - members["offset"][first] <= self.batch_bytes:
                last += 1
            run = members[first:last]
            begin = int(run["offset"][0])
            try:
                with system.open_input_file(path) as f:
                    data = f.read_at(int(run["offset"][-1] + run["length"][-1]) - begin, begin)
            except OSError:
                data = b""
            media = []
            for m in run:
                part = data[int(m["offset"]) - begin : int(m["offset"]) - begin + int(m["length"])]
                media.append(part if zlib.crc32(part) == m["crc"] else self.alone(system, path, m))
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array([None if m["null"] else int(m["id"]) for m in run], pa.int64()),
                    "n_bytes": pa.array(run["bytes"], pa.int64()),
                    "media": pa.array(media, pa.binary()),
                }
            )
            first = last


class MemberSource(DataSource):
    """``spark.read.format("member_archive").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "member_archive"

    def schema(self) -> str:
        return "id long, n_bytes long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MemberReader(self.options)


def read_media(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(id, n_bytes, media) of every stored member."""
    spark.dataSource.register(MemberSource)
    return spark.read.format("member_archive").options(**options).load(folder)


def feature(samples: np.ndarray) -> str:
    """Rows, mean, standard deviation and a 16-step histogram in thousandths of the samples."""
    of = np.bincount(samples.ravel(), minlength=256)
    n, v = of.sum(), np.arange(256)
    mean = (of * v).sum() / n
    spread = np.sqrt((of * np.square(v - mean)).sum() / n)
    steps = (of.reshape(16, 16).sum(axis=1) * 1000 // n).tolist()
    return f"{len(samples)}|{mean:.4f}|{spread:.4f}|{'.'.join(map(str, steps))}"


def media_digest(media: DataFrame) -> DataFrame:
    """Digests and features of (id, n_bytes, media), decoded again."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        stored = batch.column("media").to_pylist()
        images = [from_png(m) for m in stored]
        payloads = [i.tobytes() for i in images]
        text, long = pa.string(), pa.int64()
        return {
            "doc_id": batch.column("id"),
            "n_bytes": batch.column("n_bytes"),
            "payload_bytes": pa.array([len(p) for p in payloads], long),
            "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in payloads], text),
            "tail_crc32": pa.array([zlib.crc32(p[-32:]) for p in payloads], long),
            "media_bytes": pa.array([len(m) for m in stored], long),
            "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in stored], text),
            "feature": pa.array([feature(i) for i in images], text),
        }

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return T.per_batch(media, run, schema, rows=500)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return media_digest(read_media(spark, folder))
