"""Packing token sequences into bins of a fixed capacity: large items matched in pairs, small ones best-fit.

The packing itself is a plan over the histogram of lengths, which has at most `capacity` entries whatever the
corpus: runs of equal bins, not single bins. Documents then find their place in the plan by their rank
among pieces of their length, so no task and no driver ever holds the pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tidied, written
from .tokens import blocks, encoder, tokenizer_path

CAPACITY, SALTS = 2048, 32


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a closing 0, cut every `capacity` ids.

    A null text is empty: one piece of one id. The text is tokenized whole; nothing is shuffled.
    """
    path = path or tokenizer_path()

    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, 0)
        for batch in batches:
            for row, texts in blocks(batch["text"]):
                ids, at = encode(texts)
                n = np.diff(at)
                each = -(-n // capacity)
                of = np.repeat(np.arange(len(n)), each)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * capacity
                length = np.minimum(n[of] - start, capacity)
                first, data = at[:-1][of] + start, memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist(), strict=True)]
                columns = (pa.array(c, f.type) for c, f in zip((piece, start, length, crc), list(kind)[1:], strict=True))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, len(texts)).take(pa.array(of)), *columns], schema=kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, ranks, first bin, offset): rank first + i of that length goes to bin first + i.

    Lengths over a third of the capacity pair at most twice a bin: from the longest down, each with the longest
    that still fits beside it. Shorter ones then go, longest first, into the tightest gap that takes them, and
    open a bin only where none does.
    """
    left, rank, runs, gaps, bins = dict(counts), dict.fromkeys(counts, 0), [], {}, 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], n, first, offset))
        rank[length] += n

    large = sorted(x for x in counts if 3 * x > capacity)
    for x in reversed(large):
        while left[x]:
            at = bisect.bisect_right(large, min(x, capacity - x)) - 1
            while at >= 0 and (not left[large[at]] or (large[at] == x and left[x] < 2)):
                at -= 1
            y = large[at] if at >= 0 else 0
            n = left[x] // 2 if y == x else min(left[x], left[y]) if y else left[x]
            put(x, n, bins, 0)
            left[x] -= n
            if y:
                put(y, n, bins, x)
                left[y] -= n
            if capacity > x + y:
                gaps.setdefault(capacity - x - y, []).append((bins, n))
            bins += n
    order = sorted(gaps)
    for x in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[x]:
            at = bisect.bisect_left(order, x)
            if at == len(order):
                n = -(-left[x] // (capacity // x))
                gap, first = capacity, bins
                bins += n
            else:
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            q = gap // x
            full = min(n, left[x] // q)
            rest = min(1, n - full) if left[x] > full * q else 0
            for bins_here, start, each in ((full, first, q), (rest, first + full, left[x] - full * q)):
                if bins_here:
                    for k in range(each):
                        put(x, bins_here, start, capacity - gap + k * x)
                    left[x] -= bins_here * each
                    now = gap - each * x
                    if now:
                        if now not in gaps:
                            bisect.insort(order, now)
                        gaps.setdefault(now, []).append((start, bins_here))
            if n > full + rest:  # untouched bins keep their gap
                if gap not in gaps:
                    bisect.insort(order, gap)
                gaps.setdefault(gap, []).append((first + full + rest, n - full - rest))
    return runs


def pack(items: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """items (doc_id, piece, length, ...) with sequence_id and offset; items come from a written table.

    A piece that fills a sequence has one of its own (of a negative number) and is not exchanged. Another's rank among equals is its place in
    its (length, salt) group plus the count of the salts before it;
    the driver holds lengths x salts counts. A length with a third of all rows is spread over `salts` tasks.
    Repeated pieces are packed as often as they stand there. No items: no rows.
    """
    spark = items.sparkSession
    full = items.where(F.col("length") >= capacity).select(*items.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = items.where(F.col("length") < capacity)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = {(x, s): n for x, s, n in salted.groupBy("length", "_salt").count().collect()}
    keys = sorted(counts)
    by_length: dict[int, int] = {}
    before = []
    for x, s in keys:
        before.append(by_length.get(x, 0))
        by_length[x] = by_length.get(x, 0) + counts[x, s]
    runs = sorted(plan(by_length, capacity))
    shared = spark.sparkContext.broadcast((np.array([x * salts + s for x, s in keys]), np.array(before), *(np.array([r[i] for r in runs], "int64") for i in range(5))))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, salt: pd.Series, nth: pd.Series) -> pd.DataFrame:
        groups, before, lengths, firsts, _, bins, offsets = shared.value
        rank = before[np.searchsorted(groups, length.to_numpy() * salts + salt.to_numpy())] + nth.to_numpy()
        at = np.searchsorted(lengths * (1 << 48) + firsts, length.to_numpy() * (1 << 48) + rank, "right") - 1
        return pd.DataFrame({"sequence_id": bins[at] + rank - firsts[at], "offset": offsets[at]})

    nth = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    placed = salted.withColumn("_nth", nth).withColumn("_at", place(F.col("length"), F.col("_salt"), F.col("_nth")))
    return placed.select(*items.columns, "_at.sequence_id", "_at.offset").unionByName(full)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each document: see pieces(), pack(). A null doc_id stays null; other columns than doc_id and text are not read."""
    return pack(written(pieces(docs), "pieces"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of `documents` in sequences of 2048 tokens: see stage()."""
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)
