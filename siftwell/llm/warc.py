"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with some records, and a skippable frame at its end
that lists every frame's two sizes. The index maps each record to its bundle, frame and offset in that frame, so
one record costs one seek and one frame. Executors write bundles to a folder that all machines share, under
names of their own; only bundles in the index, which is written once the task ended well, count.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, utf8_size

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 25, 3
#: Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, bundle string, frame long, frame_start long, at long, length long"
READ = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A WARC 1.1 record; a revisit has no block but the digest and length of the payload it repeats."""
    kind, block = ("response", payload) if refers_to is None else ("revisit", b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id or ''}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join((url or "").split())), ("Content-Type", "text/html; charset=utf-8"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", len(payload))]
    if refers_to is not None:
        head.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    lines = "".join(f"{k}: {v}\r\n" for k, v in (*head, ("Content-Length", len(block))))
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[str | None, int, str, str, str | None]:
    """A READ row of one record; a response's digest and length are those of its block, and must be as stated."""
    head, _, rest = data.partition(b"\r\n\r\n")
    got = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    name = lambda x: x[len("<urn:page:") : -1] or None
    stated, length, block = got["WARC-Payload-Digest"].removeprefix("sha1:"), int(got["X-Payload-Length"]), rest[: int(got["Content-Length"])]
    if got["WARC-Type"] == "response" and (digest(block), len(block)) != (stated, length):
        raise ValueError(f"record {got['WARC-Record-ID']}: its block is not what its head states")
    return name(got["WARC-Record-ID"]), length, stated, got["WARC-Type"], name(got["WARC-Refers-To"]) if "WARC-Refers-To" in got else None


class Bundle:
    """Frames gathered in memory up to a bundle's size, then written at once under a name that no other attempt has."""

    def __init__(self, folder: str, frame_bytes: int, level: int):
        self.folder, self.frame_bytes, self.compressor = folder, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.clear()

    def clear(self) -> None:
        self.name, self.frames, self.sizes, self.open, self.rows, self.start = f"{self.folder}/{uuid.uuid4().hex}.warc.zst", [], [], bytearray(), [], 0

    def add(self, record_id: str | None, data: bytes) -> None:
        self.rows.append((record_id, self.name, len(self.frames), self.start, len(self.open), len(data)))
        self.open += data
        if len(self.open) >= self.frame_bytes:
            self.seal()

    def seal(self) -> None:
        if self.open:
            frame = self.compressor.compress(bytes(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), len(self.open)))
            self.start += len(frame)
            self.open = bytearray()

    def close(self) -> pd.DataFrame:
        self.seal()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        store, path = fs.FileSystem.from_uri(self.name)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path, compression=None) as out:
            out.write(b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(table)), table]))
        rows = pd.DataFrame(self.rows, columns=["record_id", "bundle", "frame", "frame_start", "at", "length"])
        self.clear()
        return rows


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the footer of an open bundle."""
    end = file.size()
    file.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * n)
    out, at = [], 0
    for packed, size in struct.iter_unpack("<II", file.read(8 * n)):
        out.append((at, packed, size))
        at += packed
    return out


def uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def write(pages: DataFrame, folder: str, *, least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """Archives pages (page_id, url, html) in folder; returns its index (INDEX), which also stands in folder/index.

    Of equal payloads of `least` bytes or more the one with the smallest page_id is a response and the others
    revisit it. A null html is an empty payload; a record without page_id is a response, unless one with the same payload has an id. Repeated
    rows are records of their own, very long payloads count whole, other columns are not read, no pages make an empty index. Only digests are gathered
    to find the repeats. These are joined back to the pages: while they are small Spark broadcasts them, beyond that payloads are exchanged by digest.
    """
    spark, folder = pages.sparkSession, uri(folder)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"), utf8_size(F.col("html")).alias("n"))
    repeats = rows.where(F.col("n") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").select("sha1", "first")
    refers = F.when((F.col("n") >= least) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    known = rows.join(repeats, "sha1", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", refers.cast("string").alias("refers_to"))

    def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle = Bundle(folder, frame_bytes, level)
        for pdf in batches:
            for page_id, url, data, refers in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["refers_to"], strict=True):
                bundle.add(page_id, record(page_id, url, data, refers))
                if bundle.start >= bundle_bytes:
                    yield bundle.close()
        if bundle.rows:
            yield bundle.close()

    known.mapInPandas(bundles, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read(index: DataFrame) -> DataFrame:
    """READ rows of every record in index; a bundle is opened where its index rows are, a frame is read once for its records."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        held: tuple = (None, None, None)
        for pdf in batches:
            out = []
            for bundle, of_bundle in pdf.groupby("bundle", sort=False):
                store, path = fs.FileSystem.from_uri(bundle)
                with store.open_input_file(path) as file:
                    frames = seek_table(file)
                    for frame, of_frame in of_bundle.groupby("frame"):
                        start, packed, size = frames[frame]
                        if held[:2] != (bundle, frame):
                            file.seek(start)
                            held = (bundle, frame, unpack.decompress(file.read(packed), max_output_size=size))
                        out += [parse(held[2][at : at + n]) for at, n in zip(of_frame["at"], of_frame["length"], strict=True)]
            yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    got = index.mapInPandas(records, READ)
    return got.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def lookup(index: DataFrame, record_ids: list[int]) -> DataFrame:
    """READ rows of some records: the index is filtered by id, and only their frames are read."""
    return read(index.where(F.col("record_id").isin([str(i) for i in record_ids])))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of `pages`, archived and read back: see write(), read()."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read(write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder))
