"""Sharding by histogram sort: refine splitters against exact byte counts, then exchange once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, utf8_size, written

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Bits of a row's tie; with the number of a shared key before it, it is a long.
TIE_BITS = 48
#: Ranges a shard is sorted in, tolerance of a splitter as a share of a range, probes in a round, rounds at most.
PARTS, TOLERANCE, PROBES, ROUNDS = 8, 0.02, 16_384, 40


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, tie). The key sorts equal texts together and, among them, by a hash of doc_id.

    A group of copies of any size can thus be cut between shards. Rows with equal text and doc_id share a key: `tie`, a hash of the row's place, cuts them where that is
    needed. It is fixed once the rows are written, and which of such rows goes where makes no difference.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    key = F.shiftleft(crc - F.lit(1 << 31), 32) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    tie = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << TIE_BITS))
    return docs.select("doc_id", (utf8_size(F.col("text")) + 16).alias("size"), crc.alias("text_crc32"), key.alias("key"), tie.alias("tie"))


def _below(rows: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe; each task sends one row per interval that it has met."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, n = np.zeros(len(probes) + 1, "int64"), np.zeros(len(probes) + 1, "int64")
        for pdf in batches:
            at = np.searchsorted(probes, pdf["key"].to_numpy(), "right")
            np.add.at(size, at, pdf["size"].to_numpy())
            n += np.bincount(at, minlength=len(n))
        met = np.flatnonzero(n)
        yield pd.DataFrame({"at": met, "size": size[met], "n": n[met]})

    got = rows.select("key", "size").mapInPandas(count, "at long, size long, n long").groupBy("at").agg(F.sum("size"), F.sum("n")).collect()
    size, n = np.zeros(len(probes) + 1, "int64"), np.zeros(len(probes) + 1, "int64")
    for at, s, k in got:
        size[at], n[at] = s, k
    return np.cumsum(size)[:-1], np.cumsum(n)[:-1]


def _refined(rows: DataFrame, targets: list[int], within: float, probes: int, rounds: int) -> tuple[list[int], list[int]]:
    """(keys, those of targets whose key holds more bytes than `within` allows): boundaries that have as many bytes below them as targets say.

    Every round counts the bytes below probes laid evenly through the intervals that still hold a boundary; a
    boundary is settled once within `within` bytes or once its interval holds a single key, the greater one then being its key.
    """
    lo, hi, found, coarse = [LOW] * len(targets), [HIGH] * len(targets), {}, []
    for _ in range(rounds):
        todo = [i for i in range(len(targets)) if i not in found]
        if not todo:
            break
        each = max(2, probes // len({(lo[i], hi[i]) for i in todo}))
        grid = sorted({lo[i] + (hi[i] - lo[i]) * j // each for i in todo for j in range(each + 1)})
        size, _ = _below(rows, np.array(grid, "int64"))
        for i in todo:
            at = int(np.searchsorted(size, targets[i], "right"))  # the first probe with more bytes below it
            near = min((p for p in (at - 1, at) if 0 <= p < len(grid)), key=lambda p: abs(int(size[p]) - targets[i]))
            lo[i] = grid[at - 1] if at else LOW
            hi[i] = grid[at] if at < len(grid) else HIGH
            if abs(int(size[near]) - targets[i]) <= within:
                found[i] = grid[near]
            elif hi[i] - lo[i] <= 1:
                found[i] = grid[near]
                coarse.append(i)
    return [found.get(i, hi[i]) for i in range(len(targets))], coarse


def splitters(rows: DataFrame, ranges: int, tolerance: float = TOLERANCE, probes: int = PROBES, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """(key, tie) of the ranges - 1 boundaries in order, each within tolerance x bytes / ranges of its share of the bytes; rows from (key, tie) on lie behind one.

    A boundary within a key that many rows share is refined in the same way by their ties, all such keys at once, in one space of (which key, tie). What can't be cut at
    all is a single row that is larger than the tolerance.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets, within = [total * i // ranges for i in range(1, ranges)], tolerance * total / ranges
    keys, coarse = _refined(rows, targets, within, probes, rounds)
    cuts = [(k, 0) for k in keys]
    if coarse:
        # the key that such a boundary cuts is the one before or behind it: the one whose bytes hold the target
        around = np.array(sorted({k + d for i in coarse for k in (keys[i],) for d in (-1, 0, 1) if LOW < k + d < HIGH}), "int64")
        size, n = (dict(zip(around.tolist(), map(int, x), strict=True)) for x in _below(rows, around))
        holds = {}
        for i in coarse:
            for k in (keys[i] - 1, keys[i]):
                if k in size and k + 1 in size and size[k] <= targets[i] < size[k + 1] and n[k + 1] - n[k] > 1:
                    holds[i] = k
        shared = sorted(set(holds.values()))
        if shared:
            place = np.array(shared, "int64")

            @F.pandas_udf("long")
            def spot(key: pd.Series, tie: pd.Series) -> pd.Series:
                return pd.Series(np.searchsorted(place, key.to_numpy()) * (1 << TIE_BITS) + tie.to_numpy())

            among = rows.where(F.col("key").isin(shared)).select(spot("key", "tie").alias("key"), "size")
            before = dict(zip(shared, np.cumsum([0, *(size[k + 1] - size[k] for k in shared)])[:-1].tolist(), strict=True))
            order = sorted(holds)
            finer, _ = _refined(among, [before[holds[i]] + targets[i] - size[holds[i]] for i in order], within, probes, rounds)
            for i, at in zip(order, finer, strict=True):
                cuts[i] = (holds[i], min(max(at - shared.index(holds[i]) * (1 << TIE_BITS), 0), 1 << TIE_BITS))
    return sorted(cuts)


def range_of(cuts: list[tuple[int, int]], key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """How many of cuts lie at or before each row."""
    keys, ties = np.array([k for k, _ in cuts], "int64"), np.array([t for _, t in cuts], "int64")
    at, upto = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    out = upto.copy()
    for k in np.unique(keys[(ties > 0)]):
        some = key == k
        if some.any():
            first, last = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            out[some] = at[some] + np.searchsorted(ties[first:last], tie[some], "right")
    return out


def shard(docs: DataFrame, shards: int = 40, parts: int = PARTS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): sizes near equal by shard, slots in key order.

    A shard is sorted as `parts` ranges in tasks of their own: the rows of each range are counted, so
    slots are gapless without gathering a shard in one task. Null texts, like empty ones, have size 16 and the crc32 of no bytes;
    a null doc_id is an id like another; rows equal in text and doc_id are cut like any others; a very long text makes its shard larger by
    what cannot be cut; fewer rows than shards leave shards empty; no rows, no result. Other columns are not read.
    """
    rows = written(keyed(docs), "keyed")
    cuts = splitters(rows, shards * parts)

    @F.pandas_udf("int")
    def placed(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(range_of(cuts, key.to_numpy(), tie.to_numpy()).astype("int32"))

    ranged = rows.withColumn("_at", placed("key", "tie"))
    n = np.zeros(shards * parts, "int64")
    for at, k in ranged.groupBy("_at").count().collect():  # one row a range
        n[at] = k
    below = np.cumsum(n) - n
    start = below - below[np.arange(shards * parts) // parts * parts]

    @F.pandas_udf("long")
    def slot_of(at: pd.Series, nth: pd.Series) -> pd.Series:
        return pd.Series(start[at.to_numpy()] + nth.to_numpy())

    nth = F.row_number().over(Window.partitionBy("_at").orderBy("key", "doc_id", "tie")) - 1
    return ranged.withColumn("_nth", nth).select("doc_id", "size", "text_crc32", F.floor(F.col("_at") / parts).cast("int").alias("shard"), slot_of("_at", "_nth").alias("slot"))


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of `documents` in 40 shards of near equal bytes: see shard()."""
    got = shard(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
