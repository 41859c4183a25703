"""Evidence that photos show one scene, and groups made of it: shared histograms, cameras, structure behind a hash, and the choice between engines."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from ..functions.markers import let
from ..functions.storage import kept, written
from .blocks import compared

#: Shares within which sums of doubles count as equal.
SLACK = 1e-9
#: Pairs whose blocks are compared at once.
PAIRS = 16384
#: Bins of cells, bits of a hash that tell the cells of a bin apart, the error of sums of single floats, and the rows whose cells are put in order at once.
BINS, REST, ROUGH, SOME = 1 << 20, 43, 1e-6, 1024
#: What a pair has to share in its rare bins, and how many cells' mass in rows of few cells.
DELTA, FEW = 0.04, 4.0
#: Rows of a tile as a multiple of blocks.TILE, rows of a block that are summed at once, and sums at once; bytes of text that are counted at once.
WIDE, ROWS, SUMS, TEXTS = 4, 16, 1 << 18, 8 << 20


def overlaps(cells: DataFrame, photo: str, cell: str, mass: str, least: float, by: list[str] | None = None) -> DataFrame:
    """(by, a, b, overlap): photos of one `by` whose histograms share `least` or more of their mass, a before b; cells (photo, cell, mass) of by.

    A histogram's masses become shares of their sum, and what of them is shared is shared_histograms'. Null masses and those of 0 or less count nowhere; a photo without mass has no pair.
    """
    by = by or []
    pairs = [*by, "_p"]
    rows = cells.where(F.col(mass) > 0).select(*by, F.col(photo).alias("_p"), F.col(cell).alias("_c"), F.col(mass).cast("double").alias("_m"))
    rows = rows.repartition(*pairs).groupBy(*pairs, "_c").agg(F.sum("_m").alias("_m"))  # one exchange serves both aggregations
    whole = rows.groupBy(*pairs).agg(F.sort_array(F.collect_list(F.struct("_c", "_m"))).alias("_h"))
    total = F.aggregate("_h", F.lit(0.0), lambda s, x: s + x["_m"])
    # the total is bound, as an expression inside the lambda would be summed again for each cell
    share = let({"h": F.col("_h"), "total": total}, lambda g: F.transform(g["h"], lambda x: F.struct(x["_c"].alias("_c"), F.round(x["_m"] / g["total"], 12).alias("_m"))))
    whole = whole.select(*pairs, share.alias("_h")).withColumn("_d", F.sha2(F.to_json("_h"), 256))
    return shared_histograms(whole.select(*pairs, F.col("_h._c").alias("_c"), F.col("_h._m").alias("_m"), "_d"), least, by)


def worded(rows: DataFrame, key: str, text: str, by: list[str] | None = None) -> DataFrame:
    """(by, _p, _c, _m, _d): histograms of the words between single spaces (empty ones count) of all texts of a key, as shares; _d is of one histogram only. A key without a text has no row.

    Texts are exchanged as they are, and counted in arrays of a few MB: a row for each word would cost ten times as much.
    """
    by = by or []
    found = rows.where(F.col(text).isNotNull()).groupBy(*by, F.col(key).alias("_p")).agg(F.collect_list(F.col(text).cast("string")).alias("_t"))
    kind = StructType([*found.drop("_t").schema, *StructType().add("_c", ArrayType(StringType())).add("_m", ArrayType(DoubleType())).add("_d", "string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            first = texts.offsets.to_numpy()
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts.values), 0).to_numpy(zero_copy_only=False), dtype="int64")])
            sizes = ends[first[1:]] - ends[first[0]]
            cuts = [0, *(np.flatnonzero(np.diff(sizes // TEXTS)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(low, high - low)
                made = _histograms(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*part.schema.names[:-1], "_c", "_m", "_d"])

    return found.mapInArrow(run, kind)


def _histograms(texts: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each list of texts: its words in order, their shares, and a digest of both."""
    words = pc.split_pattern(texts.flatten(), " ")
    row = pc.list_parent_indices(texts).to_numpy()[pc.list_parent_indices(words).to_numpy()]
    coded = words.flatten().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)  # by bytes
    place = np.empty(len(order), "int64")
    place[order.to_numpy()] = np.arange(len(order))
    at, n = np.unique(row.astype("int64") * len(place) + place[coded.indices.to_numpy()], return_counts=True)
    row, word = np.divmod(at, len(place))
    share = np.floor(n / np.bincount(row, n)[row] * 1e12 + 0.5) / 1e12
    starts = np.searchsorted(row, np.arange(len(texts) + 1)).astype("int32")
    cells = coded.dictionary.take(order).take(pa.array(word))
    bounds, held = np.frombuffer(cells.buffers()[1], "int32", len(cells) + 1), memoryview(cells.buffers()[2])
    digests = []
    for low, high in zip(starts, starts[1:], strict=False):
        digest = hashlib.sha256(np.diff(bounds[low : high + 1]).tobytes() + share[low:high].tobytes())
        digest.update(b"%d " % (high - low))
        digest.update(held[bounds[low] : bounds[high]])
        digests.append(digest.hexdigest())
    return pa.ListArray.from_arrays(starts, cells), pa.ListArray.from_arrays(starts, pa.array(share)), pa.array(digests)


def shared_histograms(histograms: DataFrame, least: float, by: list[str]) -> DataFrame:
    """(by, a, b, overlap): histograms of one `by` that share `least` or more, a before b; (by, _p, _c, _m, _d): photo, cells, shares and what only equal histograms have alike.

    Histograms that are equal are one class under its least photo: classes are compared, and each other member has a row beside its class's photo, of overlap 1. Cells are known by 63 bits of a hash, 20 of which are
    their bin; bins stand in one order for all, rarest first. Whoever shares `least` shares DELTA of it (more in small rows) among the first cells of both, those before the last `least` - DELTA of each mass: what a tile's rows have
    there is an index by bin, in which the rows of a block are looked up, and what they share there is summed in arrays. A pair that passes, and has as many cells as `least` needs, is summed in full where it stands.
    How many pairs share a rare bin still grows with the square of a group; most cost a few nanoseconds each.
    """
    pairs = [*by, "_p"]
    known = [F.size("_c") > 0, *(F.col(c).isNotNull() for c in pairs)]
    whole = histograms.where(reduce(and_, known)).withColumn("_x", F.transform("_c", lambda x: F.xxhash64(x))).withColumn("_by", F.xxhash64(F.lit(0), *by))
    whole = written(whole.select(*pairs, "_d", "_by", "_x", "_m"), "histograms")
    named = whole.select(*pairs, "_d", "_by")
    heads = named.groupBy(*by, "_d").agg(F.min("_p").alias("a"))
    copies = written(named.join(heads, [*by, "_d"]).where("_p <> a").select(*by, "_by", "a", F.col("_p").alias("b")), "copies")
    counts = written(whole.select(F.explode("_x").alias("x")).groupBy(F.pmod("x", F.lit(BINS)).alias("x")).agg(F.count("*").alias("n")), "counts").inputFiles()
    members = copies.select(*by, "a", "b", F.lit(1.0).alias("overlap"))
    if not counts:
        return members
    folder = counts[0].rpartition("/")[0]
    kind = whole.schema["_p"].dataType

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their cells in order, as bin's place and rest of the hash, in bytes of long and double, which are read many times as fast as lists; _size of them, of which _n come before the last mass, and _need at least of which hold `least`."""
        store, path = fs.FileSystem.from_uri(folder)
        found = ds.dataset(path, filesystem=store, format="parquet").to_table()
        n, place = np.zeros(BINS, "int64"), np.empty(BINS, "int64")
        n[found["x"].to_numpy()] = found["n"].to_numpy()
        place[np.argsort(n, kind="stable")] = np.arange(BINS) << REST
        for batch in batches:
            for low in range(0, len(batch), SOME):
                part = batch.slice(low, SOME)
                x, m, row = part.column("_x").flatten().to_numpy(), part.column("_m").flatten().to_numpy(), pc.list_parent_indices(part.column("_x")).to_numpy().astype("int16")
                x = place[x & (BINS - 1)] | (x.view("uint64") >> np.uint64(64 - REST)).astype("int64")
                order = np.argsort(x, kind="stable")
                order = order[np.argsort(row[order], kind="stable")]
                x, m = x[order], m[order]
                starts = np.searchsorted(row, np.arange(len(part) + 1)).astype("int32")
                size = np.diff(starts)
                after = np.cumsum(m[::-1])[::-1]  # a cell's mass and all that comes after it, of its row and all later rows
                after -= np.append(after, 0.0)[starts[1:]][row]
                first = after >= least - np.minimum(np.maximum(DELTA, FEW / size), least / 2)[row] - ROUGH
                held = np.cumsum(m[np.lexsort((-m, row))])
                held -= np.append(0.0, held)[starts[:-1]][row]
                need = np.minimum(np.bincount(row, held < least - ROUGH) + 1, size)
                made = [size, np.maximum(np.bincount(row, first), 1), need]
                yield pa.RecordBatch.from_arrays([part.column("_by"), part.column("_p"), *(pa.array(v.astype("int32")) for v in made), *(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(starts * 8), pa.py_buffer(v)]) for v in (x, m))], ["_by", "_k", "_size", "_n", "_need", "_x", "_m"])

    classes = whole.join(copies.select("_by", F.col("b").alias("_p")), ["_by", "_p"], "left_anti").select("_by", "_p", "_x", "_m", F.size("_x").alias("_size"))
    # in ranges before their cells are ordered, so that those are written once
    order = ["_by", "_size", "_p"]
    classes = classes.repartitionByRange(3 * whole.sparkSession.sparkContext.defaultParallelism, *order).sortWithinPartitions(*order)
    coded = StructType().add("_by", "long").add("_k", kind).add("_size", "integer").add("_n", "integer").add("_need", "integer").add("_x", "binary").add("_m", "binary")
    coded = classes.mapInArrow(ordered, coded)

    def answer(tile: pd.DataFrame, blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, entries, end, rest = _first(tile)
        index = np.zeros(BINS + 1, "int64")
        np.cumsum(np.bincount(slots, minlength=BINS), out=index[1:])
        entries = entries[np.argsort(slots, kind="stable")]
        group, ids, size, need, x, m = (tile[c].to_numpy() for c in ("_by", "_k", "_size", "_need", "_x", "_m"))
        for block in blocks:
            groups, names, sizes, needs, y, w = (block[c].to_numpy() for c in ("_by", "_k", "_size", "_need", "_x", "_m"))
            slots, mine, ends, others = _first(block)
            lowest = least - max(rest.max(), others.max()) - ROUGH
            low = index[slots]
            n = index[slots + 1] - low
            low, n, mine = low[n > 0], n[n > 0], mine[n > 0]
            # rows of the block that are summed at once: as many as ROWS, and fewer where they meet much
            starts = np.searchsorted(mine, np.arange(len(block) + 1) << 32)
            load = np.append(0, np.cumsum(n))[starts[1:]] // SUMS
            cuts = np.flatnonzero((np.arange(len(block)) % ROWS == 0) | (np.diff(load, prepend=0) > 0)).tolist()
            for g, h in zip(cuts, [*cuts[1:], len(block)], strict=True):
                at = slice(starts[g], starts[h])
                upto = np.cumsum(n[at])
                meets = np.arange(upto[-1] if len(upto) else 0)
                meets += np.repeat(low[at] - upto + n[at], n[at])
                theirs, ours = entries[meets], np.repeat(mine[at] - (g << 32), n[at])
                held = np.minimum(theirs.view("float32")[::2], ours.view("float32")[::2])
                theirs >>= 32
                theirs *= h - g
                ours >>= 32
                theirs += ours
                held = np.bincount(theirs, held, len(tile) * (h - g))
                pair = np.flatnonzero(held >= lowest)
                i, j = np.divmod(pair, h - g)
                j += g
                # beyond the first cells of both is what the row has whose first cells end first; each pair once, by rising size and then name
                fit = held[pair] + np.where(end[i] <= ends[j], rest[i], others[j]) >= least - ROUGH
                fit &= (group[i] == groups[j]) & (size[i] >= needs[j]) & (sizes[j] >= need[i]) & ((size[i] < sizes[j]) | (size[i] == sizes[j]) & (ids[i] < names[j]))
                i, j = i[fit], j[fit]
                both = np.fromiter((_shared(x[p], m[p], y[q], w[q]) for p, q in zip(i, j, strict=True)), "float64", len(i))
                i, j, both = (v[both + SLACK >= least] for v in (i, j, both))
                if len(i):
                    swap = ids[i] > names[j]
                    yield pd.DataFrame({"a": np.where(swap, names[j], ids[i]), "b": np.where(swap, ids[i], names[j]), "_by": group[i], "overlap": both})

    def only(tile: pd.DataFrame) -> ds.Expression:
        return (ds.field("_size") >= int(tile["_size"].min())) & (ds.field("_need") <= int(tile["_size"].max()))

    met = compared(coded, coded, answer, StructType().add("a", kind).add("b", kind).add("_by", "long").add("overlap", "double"), ["_by", "_size", "_k"], WIDE, "_size", only)
    met = written(met, "met").join(whole.select("_by", *by, F.col("_p").alias("a")), ["_by", "a"])
    return met.select(*by, "a", "b", "overlap").unionByName(members)


def _first(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first cells of all rows: where their bins stand in an index (those of another group elsewhere), and the row above the bits of a share. Of each row: its last one of these, and the mass beyond."""
    n, size = pdf["_n"].to_numpy().astype("int64"), pdf["_size"].to_numpy().astype("int64")
    x, starts = np.frombuffer(b"".join(pdf["_x"]), "int64"), np.cumsum(size) - size
    row = np.repeat(np.arange(len(pdf)), n)
    at = np.arange(len(row))
    at += (starts - np.cumsum(n) + n)[row]
    slots = (x[at] >> REST).astype("int32")
    slots ^= (pdf["_by"].to_numpy() & (BINS - 1)).astype("int32")[row]
    share = np.frombuffer(b"".join(pdf["_m"]), "float64")[at]
    rest = 1 - np.bincount(row, share)
    row <<= 32
    row |= share.astype("float32").view("int32")
    return slots, row, x[starts + n - 1], rest


def _shared(a: bytes, x: bytes, b: bytes, y: bytes) -> float:
    """What two histograms share, of cells in order."""
    a, b, x, y = np.frombuffer(a, "int64"), np.frombuffer(b, "int64"), np.frombuffer(x), np.frombuffer(y)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    return float(np.minimum(x[same], y[at[same]]).sum())


#: Fixed values for one camera position: aspects, inliers and their share, spans and hull of them, how far scale, rotation and translation may go, and when too few matches speak against it.
ASPECT, INLIERS, INLIER_SHARE, SPAN, HULL, SCALE = 1.08, 10, 0.45, 0.18, 0.008, (0.5, 2.0)
SCALE_OFF, ROTATION, TRANSLATION = 0.085, 5.0, 0.075
FEW, MANY_POINTS, TEXTURED = 3, 80, 60.0


def camera(fit: dict[str, Column], moved: Column, aspects: tuple[Column, Column], points: Column, texture: Column) -> Column:
    """same, different or unknown, from a fit (matches, inliers, source, target: shares of the frames) and its movement.

    points and texture: the lesser of both photos' keypoints and background textures. Frames of another shape differ; too few matches differ only where both photos have much to match;
    a fit that is thin, narrow or out of proportion says nothing; one that has moved differs.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    matches = F.coalesce(fit["matches"], F.lit(0))
    bare = (matches < FEW) & (points > MANY_POINTS) & (texture > TEXTURED)
    wide = lambda s: F.greatest(s["span_x"], s["span_y"])
    thin = (fit["inliers"] < INLIERS) | (fit["inliers"] / matches < INLIER_SHARE) | (wide(fit["source"]) < SPAN) | (fit["source"]["area"] < HULL) | (wide(fit["target"]) < SPAN) | ~((moved["scale"] > SCALE[0]) & (moved["scale"] < SCALE[1]))
    still = (F.abs(moved["scale"] - 1) <= SCALE_OFF) & (moved["rotation"] <= ROTATION) & (moved["translation"] <= TRANSLATION)
    return F.when(no(F.greatest(*aspects) / F.least(*aspects) > ASPECT), "different").when(matches < INLIERS, F.when(no(bare), "different").otherwise("unknown")).when(F.coalesce(thin, F.lit(True)), "unknown").when(no(still), "same").otherwise("different")


def verified_pairs(rows: DataFrame, key: str, value: str, blocks: str, aspect: str, radius: int, least: float, ratio: float, bits: int = 64, deepest: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """((a, b, distance, score), (key, member)): rows whose hashes are within radius, shapes within ratio and blocks alike by `least` or more, and the rows that are copies of one of those.

    In arrays, block by block: the hashes, then the shapes of those within radius, and only then the blocks; only pairs that are alike become rows. Rows of one hash, shape and blocks
    are a class under their least key, which alone is compared. Structures that differ but share a hash do meet each other: nothing short of comparing them tells them apart. A row without
    hash, shape or blocks links with nothing.
    """
    whole = rows.where(F.col(value).isNotNull() & F.col(blocks).isNotNull() & F.col(aspect).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.col(blocks).alias("_b"), F.col(aspect).alias("_r"))
    marked = whole.withColumn("_d", F.sha2(F.to_json(F.struct("_v", "_r", "_b")), 256))
    classes = written(marked.groupBy("_d").agg(F.min("_k").alias("_k"), F.first("_v").alias("_v"), F.first("_b").alias("_b"), F.first("_r").alias("_r")).drop("_d"), "classes")
    members = marked.select("_d", "_k").join(marked.groupBy("_d").agg(F.min("_k").alias("member_of")), "_d").where("_k <> member_of").select(F.col("member_of").alias("key"), F.col("_k").alias("member"))
    # blocks as one array and their sizes: structures of other sizes never compare
    flat = classes.select("_k", "_v", "_r", F.flatten("_b").cast("array<double>").alias("_x"), F.concat_ws(",", F.transform("_b", lambda b: F.size(b).cast("string"))).alias("_n"))
    c1, c2 = (0.01 * deepest) ** 2, (0.03 * deepest) ** 2

    def moments(pdf: pd.DataFrame) -> dict[str, tuple[np.ndarray, ...]]:
        """By sizes: places of the rows, their values, and each block's mean and variance."""
        out = {}
        for n, part in pdf.reset_index(drop=True).groupby("_n"):
            sizes = np.array([int(x) for x in n.split(",")]) if n else np.array([0])
            if sizes.min() > 0:
                x, starts = np.stack(list(part["_x"])), np.cumsum(sizes) - sizes
                mean = np.add.reduceat(x, starts, axis=1) / sizes
                out[n] = part.index.to_numpy(), x, mean, np.add.reduceat(x * x, starts, axis=1) / sizes - mean * mean, starts, sizes
        return out

    def answer(tile: pd.DataFrame, found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = moments(tile)
        for block in found:
            others = moments(block)
            for n in mine.keys() & others.keys():
                (p, x, mx, vx, starts, sizes), (q, y, my, vy, *_) = mine[n], others[n]
                one, two = tile.iloc[p], block.iloc[q]
                distance = np.bitwise_count(one["_v"].to_numpy().astype("uint64")[:, None] ^ two["_v"].to_numpy().astype("uint64"))
                i, j = np.nonzero((distance <= radius) & (one["_k"].to_numpy()[:, None] < two["_k"].to_numpy()))
                r, t = one["_r"].to_numpy()[i], two["_r"].to_numpy()[j]
                shaped = np.maximum(r, t) / np.minimum(r, t) <= ratio
                i, j = i[shaped], j[shaped]
                for low in range(0, len(i), PAIRS):
                    g, h = i[low : low + PAIRS], j[low : low + PAIRS]
                    mm = mx[g] * my[h]
                    light = (2 * mm + c1) / (mx[g] ** 2 + my[h] ** 2 + c1)
                    both = np.add.reduceat(x[g] * y[h], starts, axis=1) / sizes
                    score = np.clip((light * (2 * (both - mm) + c2) / (vx[g] + vy[h] + c2)).mean(axis=1), -1, 1)
                    good = score >= least
                    if good.any():
                        g, h = g[good], h[good]
                        yield pd.DataFrame({"a": one["_k"].to_numpy()[g], "b": two["_k"].to_numpy()[h], "distance": distance[g, h].astype("int32"), "score": score[good]})

    kind = classes.schema["_k"].dataType
    return compared(flat, flat, answer, StructType().add("a", kind).add("b", kind).add("distance", "integer").add("score", "double")), members


def representatives(nodes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """nodes with representative: itself, or the one it joins. Nodes are taken by rising key; each joins, of the representatives before it that it links with, the one of least distance (then least key), and represents itself if there is none.

    links (a, b, distance), a before b. Members never attract others, so groups don't chain. No order is walked: a node with no undecided neighbour before it is decided with all others like it, so rounds
    are as many as the longest rising chain of links needs. A round reads and writes links between undecided nodes only, which become fewer each time, and ends in checkpoints of narrow rows.
    """
    edges = kept(links.where("a < b").groupBy("a", "b").agg(F.min("distance").alias("distance")))
    live = edges.select("a", "b")
    members = None
    while True:
        # led by nobody who is undecided: they lead, and whoever they link with joins
        first = kept(live.select(F.col("a").alias("n")).distinct().join(live.select(F.col("b").alias("n")), "n", "left_anti"))
        if first.isEmpty():
            break
        led = kept(live.join(first.withColumnRenamed("n", "a"), "a", "left_semi").select(F.col("b").alias("n")).distinct())
        members = led if members is None else members.union(led)
        live = kept(live.join(first.withColumnRenamed("n", "a"), "a", "left_anti").join(led.withColumnRenamed("n", "a"), "a", "left_anti").join(led.withColumnRenamed("n", "b"), "b", "left_anti"))
        # a node whose last links went with members is alone, and leads; it has no live link and isn't led
    if members is None:
        return nodes.withColumn("representative", F.col(key))
    joined = edges.join(kept(members).withColumnRenamed("n", "a"), "a", "left_anti").groupBy("b").agg(F.min(F.struct("distance", "a")).alias("_m"))
    joined = joined.join(members.withColumnRenamed("n", "b"), "b", "left_semi").select("b", F.col("_m.a").alias("_rep"))
    return nodes.join(joined, F.col(key) == F.col("b"), "left").withColumn("representative", F.coalesce("_rep", F.col(key))).drop("b", "_rep")


def grouped(rows: DataFrame, key: str, value: str, blocks: str, aspect: str, radius: int, least: float, ratio: float, bits: int = 64, deepest: float = 1.0) -> DataFrame:
    """rows with representative: groups of alike structure behind near hashes, around fixed representatives; copies go with their class."""
    links, members = verified_pairs(rows, key, value, blocks, aspect, radius, least, ratio, bits, deepest)
    heads = representatives(rows.join(members.select(F.col("member").alias(key)), key, "left_anti").select(key), links, key).select(F.col(key).alias("_head"), "representative")
    of = rows.select(key).join(members, F.col(key) == F.col("member"), "left").select(key, F.coalesce("key", F.col(key)).alias("_head"))
    return rows.join(of.join(heads, "_head").select(key, "representative"), key)


def dispatched(rows: DataFrame, by: str, qualifies: Column, one: Callable[[DataFrame], DataFrame], other: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """one() over the groups all of whose rows qualify, other() over the rest, as one table; both must give the same columns.

    The source is read once, as its rows are written with their answer; whether a group qualifies is one aggregation of two narrow columns of that table, and each engine reads the
    rows that a semi-join leaves it. An unknown condition doesn't qualify; rows without a group are a group.
    """
    table = written(rows.withColumn("_fits", F.coalesce(qualifies, F.lit(False))), "routed")
    groups = table.groupBy(F.col(by).alias("_by")).agg(F.bool_and("_fits").alias("_all"))
    way = lambda yes: table.join(groups.where(F.col("_all") if yes else ~F.col("_all")), F.col(by).eqNullSafe(F.col("_by")), "left_semi").drop("_fits")
    return one(way(True)).unionByName(other(way(False)))
