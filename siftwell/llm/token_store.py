"""Token ids in files of their own format: one Zstandard frame a document under a shared dictionary, with an offset index.

A file is HEAD, the frames, the index (INDEX, a row a document) and TAIL. HEAD names the width of an id and the SHA-256 of the
dictionary, which stands once beside the files; TAIL says where the index is. So a document costs the tail, the index and its own
frame. Files hold ascending ids and are named after their place; the manifest, written once their task ended well, says which count.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table, written
from .tokens import END_ID, blocks, encoder, tokenizer_path
from .warc import uri

LEVEL = 3
#: The dictionary's size, and the sample that it is trained on: so many documents of at most so many bytes, and how many times as many hashes are looked at.
DICT_BYTES, SAMPLE_ROWS, SAMPLE_BYTES, OVERSAMPLED = 64 << 10, 1000, 8 << 10, 8
#: Bytes of frames a file: the most, and the least where that many tasks are not needed.
FILE_BYTES, LEAST_BYTES = 256 << 20, 4 << 20
#: Bytes read at a time.
READ_BYTES = 8 << 20

MAGIC = b"TOKENIDS"
#: MAGIC, bytes an id, SHA-256 of the dictionary.
HEAD = "<8sB32s"
#: Where the index starts, its rows, their CRC-32, MAGIC.
TAIL = "<QQI8s"
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("start", "<i8"), ("n", "<i8"), ("at", "<i8"), ("size", "<i8"), ("crc", "<u4")])
_ENCODED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("size", pa.int64()), ("frame", pa.binary())])
MANIFEST = "part int, file string, docs long, ids long, bytes long, first_id long, last_id long"


def train(docs: DataFrame, path: str, end_id: int = END_ID, *, dict_bytes: int = DICT_BYTES, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> bytes:
    """A dictionary for the ids of short documents, trained on those with the least hashes, each whole: `rows` at most, of `most` bytes at most.

    Only hashes of a share of the range are looked at that holds OVERSAMPLED times as many documents of any length, so that a task sends no more than its part; where few documents are
    short the sample is smaller. Copies count once in it. Empty where there is too little to train on; what a frame decodes to never depends on the dictionary.
    """
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 62))
    share = int((1 << 62) * min(1.0, OVERSAMPLED * rows / max(1, docs.count())))
    short = docs.select("text", at.alias("at")).where((F.col("at") < share) & F.octet_length("text").between(1, most))
    sample = short.orderBy("at", "text").limit(rows).select("text").dropDuplicates()

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id)
        for batch in batches:
            for _, texts in blocks(batch["text"]):
                ids, at = encode(texts)
                data = ids.astype(f"<u{encode.width}")
                yield pa.RecordBatch.from_pydict({"ids": [data[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]}, schema=pa.schema([("ids", pa.binary())]))

    samples = sorted(bytes(r["ids"]) for r in sample.mapInArrow(serialized, "ids binary").collect())
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return store, path


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def encoded(docs: DataFrame, path: str, dictionary: bytes, end_id: int = END_ID, level: int = LEVEL) -> DataFrame:
    """(doc_id, n, crc, size, frame): each document's ids, serialized and compressed on their own."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shared = encoder(path, end_id), _dictionary(dictionary)
        if shared:
            shared.precompute_compress(level=level)
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=False, write_content_size=True)
        for batch in batches:
            for row, texts in blocks(batch["text"]):
                ids, at = encode(texts)
                long, data = memoryview(ids.astype("<u4").tobytes()), memoryview(ids.astype(f"<u{encode.width}").tobytes())
                spans = list(zip(at.tolist(), at[1:].tolist(), strict=False))
                frames = [packer.compress(data[encode.width * a : encode.width * b]) for a, b in spans]
                crc = [zlib.crc32(long[4 * a : 4 * b]) for a, b in spans]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, len(texts)), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(list(map(len, frames)), pa.int64()), pa.array(frames, pa.binary())], schema=_ENCODED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(compress, "doc_id long, n long, crc long, size long, frame binary")


def write(docs: DataFrame, folder: str, *, path: str | None = None, end_id: int = END_ID, level: int = LEVEL, file_bytes: int = FILE_BYTES, least_bytes: int = LEAST_BYTES, dict_bytes: int = DICT_BYTES) -> DataFrame:
    """Writes the ids of docs (doc_id, text) to folder in ascending order of doc_id; returns the manifest, a row a file, which also stands in folder/manifest.

    path: the tokenizer's file. A null text is empty: its ids are end_id alone. Null ids come first; rows of one id follow each other by their ids' CRC, and
    repeated rows are documents of their own, so that a file ends between any two rows however often an id stands there. An id that is no whole number is an error.
    Very long texts count whole, a block and a frame of their own; other columns are not read; no documents make a folder without files. Texts are tokenized
    where they are read, and only frames are exchanged.
    """
    spark, folder, path = docs.sparkSession, uri(folder), path or tokenizer_path()
    data = train(docs, path, end_id, dict_bytes=dict_bytes)
    name = hashlib.sha256(data).digest()
    store, place = _store(folder)
    with store.open_output_stream(f"{place}/{name.hex()}.dict", compression=None) as out:
        out.write(data)
    width = encoder(path, end_id).width
    rows = written(encoded(docs, path, data, end_id, level).withColumn("nth", F.monotonically_increasing_id()), "frames")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(1, -(-total // file_bytes), min(-(-total // least_bytes), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = ("doc_id", "crc", "nth")
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n", "crc", "frame")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        index, at, start, out = [], struct.calcsize(HEAD), 0, None
        file = f"{folder}/{part:06d}-{uuid.uuid4().hex}.ids"  # no other attempt has this name
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store, place = fs.FileSystem.from_uri(file)
                out = store.open_output_stream(place, compression=None)
                out.write(struct.pack(HEAD, MAGIC, width, name))
            size = pc.binary_length(batch["frame"]).to_numpy(zero_copy_only=False).astype(np.int64)
            n, ids = batch["n"].to_numpy(), batch["doc_id"]
            rows = np.zeros(batch.num_rows, INDEX)
            rows["doc_id"], rows["known"] = pc.fill_null(ids, 0).to_numpy(), pc.is_valid(ids).to_numpy(zero_copy_only=False)
            rows["start"], rows["n"], rows["crc"] = start + np.cumsum(n) - n, n, batch["crc"].to_numpy()
            rows["at"], rows["size"] = at + np.cumsum(size) - size, size
            for frame in batch["frame"]:
                out.write(frame.as_buffer())
            index.append(rows)
            at, start = at + int(size.sum()), start + int(n.sum())
        if out is not None:
            rows = np.concatenate(index)
            out.write(rows.tobytes())
            out.write(struct.pack(TAIL, at, len(rows), zlib.crc32(rows.tobytes()), MAGIC))
            out.close()
            ids = rows["doc_id"][rows["known"] > 0].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (([part], pa.int32()), ([file], pa.string()), ([len(rows)], pa.int64()), ([start], pa.int64()), ([at], pa.int64()), (ids[:1] or [None], pa.int64()), (ids[-1:] or [None], pa.int64()))], ["part", "file", "docs", "ids", "bytes", "first_id", "last_id"])

    ranged.mapInArrow(save, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def index_of(file) -> tuple[int, bytes, np.ndarray]:
    """(bytes an id, SHA-256 of the dictionary, INDEX rows) of an open file."""
    end = file.size()
    magic, width, name = struct.unpack(HEAD, file.read_at(struct.calcsize(HEAD), 0))
    at, rows, crc, tail = struct.unpack(TAIL, file.read_at(struct.calcsize(TAIL), end - struct.calcsize(TAIL)))
    data = file.read_at(rows * INDEX.itemsize, at)
    if magic != MAGIC or tail != MAGIC or zlib.crc32(data) != crc:
        raise ValueError("no file of token ids, or one that is cut off")
    return width, name, np.frombuffer(data, INDEX)


def read(manifest: DataFrame, *, ids: bool = False, only: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), and `ids` if asked for, of every document in the files, or of those whose id is in `only`.

    start counts the ids of all documents before this one: those of the files before it, one row of the manifest each, and those before it in its file. With
    `only`, files whose range holds none of them are not opened and frames of other documents not read. Ids whose CRC is not the index's are an error.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over files, not documents
    files = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    if only is not None:
        files = files.where(F.exists(F.lit(sorted(only)).cast("array<bigint>"), lambda i: i.between(F.col("first_id"), F.col("last_id"))))
    wanted = None if only is None else np.array(sorted(only), np.int64)
    n = max(1, manifest.count())
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if ids else [])])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            for name, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_file(path) as file:
                    width, digest, rows = index_of(file)
                    if held[0] != digest:
                        with store.open_input_file(f"{path.rpartition('/')[0]}/{digest.hex()}.dict") as shared:
                            data = shared.read()
                        if hashlib.sha256(data).digest() != digest:
                            raise ValueError(f"{name}: its dictionary is not the one that it names")
                        held = (digest, zstandard.ZstdDecompressor(dict_data=_dictionary(data)))
                    if wanted is not None:
                        rows = rows[(rows["known"] > 0) & np.isin(rows["doc_id"], wanted)]
                    span = (rows["at"] + rows["size"] - (rows["at"][0] if len(rows) else 0)) // READ_BYTES
                    cuts = [0, *(np.flatnonzero((np.diff(span) > 0) | (rows["at"][1:] != rows["at"][:-1] + rows["size"][:-1])) + 1).tolist(), len(rows)]
                    for a, b in zip(cuts, cuts[1:], strict=False):  # frames that stand together are read together
                        if b == a:
                            continue
                        some = rows[a:b]
                        first = int(some["at"][0])
                        data = memoryview(file.read_at(int(some["at"][-1] + some["size"][-1]) - first, first))
                        crc, found = [], []
                        for x, size, stated, count in zip((some["at"] - first).tolist(), some["size"].tolist(), some["crc"].tolist(), some["n"].tolist(), strict=True):
                            got = np.frombuffer(held[1].decompress(data[x : x + size]), f"<u{width}").astype("<u4")
                            crc.append(zlib.crc32(got))
                            if crc[-1] != stated or len(got) != count:
                                raise ValueError(f"{name}: a frame at {first + x} does not hold the ids that its index states")
                            if ids:
                                found.append(got.astype(np.int64))
                        out = [pa.array(some["doc_id"], mask=some["known"] == 0), pa.array(some["start"] + base), pa.array(some["n"]), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays([*out, *([pa.array(found, pa.list_(pa.int64()))] if ids else [])], schema=kind)

    return files.select("file", "base").repartition(n).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))


def op12_shared_dictionary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of `documents`, tokenized, written and read back: see write(), read()."""
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    return read(write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder))
