"""Near-duplicate documents: MinHash tables by tensored banding, every link confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, kept, table, tidied, written

SHINGLE = 5
#: Two collections of HALVES half-keys of ROWS minhashes make HALVES^2 tables of 2 x ROWS rows: 72 minhashes do the work of
#: 864. All tables miss a pair of similarity .85 with probability .00002, and one of .80 with .0004.
HALVES, ROWS, SEED = 12, 3, 7
MINS = 2 * HALVES * ROWS
#: Hundredths of similarity from which documents link; agreeing minhashes that lead to a comparison in full lie four
#: standard deviations below.
PERCENT = 80
#: Documents in a block of the comparison in full, rows of a bucket beyond which it is cut by a further half-key.
BLOCK, WIDE = 256, 2048
#: Rounds in which nodes pair with the likeliest of other components, so many of them, and neighbours on either side that they look at in each order.
NEAREST, PARTNERS, BESIDE = 1, 3, 4
#: Rows of whole numbers, 64 bytes each at most, that are broadcast.
BROADCAST_ROWS = (64 << 20) // 64

_ODD = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(SHINGLE)], "uint64")


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: ASCII lower case, words between ASCII white space.

    bytes.lower and bytes.split touch ASCII only, as the definition asks. Fewer words than a shingle: all of
    them as one; none: an empty array.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "uint64")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    k = min(width, len(h))
    n = len(h) - k + 1
    s = np.full(n, np.uint64(k))
    for j in range(k):
        s += h[j : j + n] * _ODD[j]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def _families(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, MINS, "uint32") | np.uint32(1), rng.integers(0, 1 << 32, MINS, "uint32")


SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("half1", pa.binary()), ("half2", pa.binary()), ("code", pa.binary())])


def _half_keys(low: np.ndarray) -> np.ndarray:
    """The 2 HALVES half-keys of a row of minhashes, the first collection's first."""
    m = low.reshape(2 * HALVES, ROWS).astype("uint64")
    out = np.full(2 * HALVES, np.uint64(0x51ED270B))
    for r in range(ROWS):
        out = (out ^ m[:, r]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = _families(SEED)
    with np.errstate(over="ignore"):
        for batch in batches:
            rows = []
            for text in batch["text"]:  # one text at a time is a Python string
                s = shingles(text.as_py())
                low, x = np.full(MINS, 0xFFFFFFFF, "uint32"), (s >> np.uint64(32)).astype("uint32")
                for at in range(0, len(x), 4096):
                    low = np.minimum(low, (np.multiply.outer(a, x[at : at + 4096]) + b[:, None]).min(1))
                half = _half_keys(low)
                rows.append((len(s), *np.array([s.sum(dtype="uint64"), (s * s).sum(dtype="uint64")]).view("int64").tolist(), half[:HALVES].tobytes(), half[HALVES:].tobytes(), low.view("uint8")[::4].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(SKETCH)[1:], strict=True))], schema=SKETCH)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * np.uint64(3) + b) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def _keys(column: str):
    """(key, rep, or of beside it): each row's key, if it has one, mixed with the HALVES half-keys in `column` and their places."""
    place = np.arange(HALVES, dtype="uint64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for pdf in batches:
                for at in range(0, len(pdf), 4096):
                    part = pdf.iloc[at : at + 4096]
                    half = np.frombuffer(b"".join(part[column]), "uint64").reshape(len(part), HALVES)
                    own = part["key"].to_numpy().view("uint64") if "key" in part else np.zeros(len(part), "uint64")
                    key = _mixed(_mixed(own[:, None], half), place)
                    yield pd.DataFrame({"key": key.ravel().view("int64"), **{c: np.repeat(part[c].to_numpy(), HALVES) for c in ("rep", "of") if c in part}})

    return run


def _repeated(rows: DataFrame) -> DataFrame:
    """rows (key, rep) of keys that stand there more than once; counts are combined before they are exchanged."""
    return rows.join(rows.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")


def _agreeing(percent: int) -> int:
    p = percent / 100
    return int(MINS * p - 4 * (MINS * p * (1 - p)) ** 0.5)


def _alike(n: np.ndarray, codes: np.ndarray, x: int, others: np.ndarray, percent: int) -> np.ndarray:
    low, high = np.minimum(n[others], n[x]), np.maximum(n[others], n[x])
    return ((codes[others] == codes[x]).sum(1) >= _agreeing(percent)) & (100 * low >= percent * high)


def _by_bucket(batches: Iterator[pd.DataFrame], f) -> Iterator[pd.DataFrame]:
    """f of rows that come sorted by key, in portions that hold whole buckets; a bucket may span batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf["key"].to_numpy()
        if keys[0] == keys[-1] and (not held or held[0]["key"].iloc[0] == keys[-1]):
            held.append(pdf)
            continue
        whole = pd.concat([*held, pdf])
        tail = whole["key"].to_numpy() == keys[-1]
        held = [whole[tail]]
        yield f(whole[~tail])
    if held:
        yield f(pd.concat(held))


def _nearest(percent: int):
    """(key, b, a, agreeing): of each row its likeliest neighbour a of another component, in buckets of rows (key, rep, of, n, code).

    A bucket's rows are sorted by each eight of their minhashes in turn, and each row looks at those beside it: rows that
    are most alike stand side by side in some of these orders, and the work is in proportion to the rows.
    """

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        key, rep, of, n = (pdf[c].to_numpy() for c in ("key", "rep", "of", "n"))
        codes = np.frombuffer(b"".join(pdf["code"]), "uint8").reshape(len(pdf), MINS)
        best, at = np.full(len(pdf), _agreeing(percent) - 1), np.full(len(pdf), -1)
        for words in codes.view(">u8").T:
            order = np.lexsort((words, key))
            for d in range(1, min(BESIDE, len(order) - 1) + 1):
                x, y = order[:-d], order[d:]
                able = (key[x] == key[y]) & (of[x] != of[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                x, y = x[able], y[able]
                same = (codes[x] == codes[y]).sum(1)
                for p, q in ((x, y), (y, x)):
                    more = same > best[p]
                    best[p[more]], at[p[more]] = same[more], q[more]
        has = at >= 0
        return pd.DataFrame({"key": key[has], "b": rep[has], "a": rep[at[has]], "agreeing": best[has]}, dtype="int64")

    return lambda batches: _by_bucket(batches, pairs)


def _contacts(of: np.ndarray, n: np.ndarray, codes: np.ndarray, percent: int, wide: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the components `of` which likely pairs of a bucket's rows join. A wide bucket is cut by every half-key in turn."""
    if len(of) > wide:
        for h in range(2 * HALVES):
            _, at = np.unique(np.ascontiguousarray(codes[:, h * ROWS : (h + 1) * ROWS]).view(f"V{ROWS}").ravel(), return_inverse=True)
            order = np.argsort(at, kind="stable")
            for g in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                if len(g) == len(of):
                    yield from _contacts(of, n, codes, percent, len(of))
                    return
                if len(g) > 1:
                    yield from _contacts(of[g], n[g], codes[g], percent, wide)
        return
    names, at, size = np.unique(of, return_inverse=True, return_counts=True)
    root = np.arange(len(names))
    for x in np.flatnonzero(at != size.argmax()):  # the largest component's rows are met by the others
        others = np.flatnonzero(root[at] != root[at[x]])
        if not len(others):
            return
        for y in np.unique(at[others[_alike(n, codes, x, others, percent)]]):
            if root[y] != root[at[x]]:
                root[root == root[y]] = root[at[x]]
                yield min(names[y], names[at[x]]), max(names[y], names[at[x]])


def _likely(percent: int, wide: int):
    """Pairs (a, b) of components from rows (key, of, n, code) that come sorted by key; a bucket may span batches."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        of, n = pdf["of"].to_numpy(), pdf["n"].to_numpy()
        codes = np.frombuffer(b"".join(pdf["code"]), "uint8").reshape(len(pdf), MINS)
        out: set = set()
        for g in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(pdf["key"].to_numpy())) + 1):
            if len(g) > 1:
                out.update(_contacts(of[g], n[g], codes[g], percent, wide))
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return lambda batches: _by_bucket(batches, pairs)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _star(percent: int):
    """Links (a, b) of leaders with others, from rows (key, a, lead, doc_id, shingles) sorted by key: an id that stands with several texts links by any of them."""

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        lead, ids, of = pdf["lead"].to_numpy(), pdf["doc_id"].to_numpy(), pdf["a"].to_numpy()
        sets, out = [np.frombuffer(x, "uint64") for x in pdf["shingles"]], set()
        for g in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(pdf["key"].to_numpy())) + 1):
            heads = g[lead[g]]
            out.update((of[x], ids[x]) for x in g[~lead[g]] if any(_linked(sets[h], sets[x], percent) for h in heads))
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return lambda batches: _by_bucket(batches, linked)


def _exact(percent: int):
    """Links (a, b) between one or two blocks of documents of one likely group: a spanning forest of those that hold on full sets and join two components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, "uint64") for x in pdf["shingles"]]
        rep, n, size = pdf["doc_id"].to_numpy(), len(sets), np.array([len(s) for s in sets])
        cross = pdf["bi"].iat[0] != pdf["bj"].iat[0]
        side = (pdf["block"] == pdf["bi"]).to_numpy()
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        root, out = np.unique(pdf["of"].to_numpy(), return_inverse=True)[1], []
        for x in np.flatnonzero(side) if cross else range(n):
            other = ~side if cross else np.arange(n) > x
            todo = other & (root != root[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
            if not todo.any():
                continue
            lo, hi = np.searchsorted(tokens, sets[x], "left"), np.searchsorted(tokens, sets[x], "right")
            k = hi - lo
            hits = owner[np.repeat(lo - np.cumsum(k) + k, k) + np.arange(k.sum())]
            both = np.bincount(hits, minlength=n)
            for y in np.flatnonzero(todo & (100 * both >= percent * (size + size[x] - both))):
                if root[y] != root[x]:
                    root[root == root[y]] = root[x]
                    out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.drop(columns="text").assign(shingles=[shingles(t).tobytes() for t in pdf["text"]])


def _with_sets(docs: DataFrame, wanted: DataFrame, schema: str) -> DataFrame:
    """wanted (doc_id, ...) with the shingles of each document that it names; texts stay where they are while wanted is small."""
    wanted = kept(wanted)
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return docs.select("doc_id", "text").where("text is not null").join(wanted, "doc_id").mapInPandas(tidied(_sets), schema + ", shingles binary").where("length(shingles) > 0")


def _confirmed(docs: DataFrame, pairs: DataFrame, percent: int, block: int) -> DataFrame:
    """Those of pairs (a, b) that link on full sets. Each b's set is sent once, to a part of its leader a's pairs; parts hold about `block` of them."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    of = pairs.join(parts, "a").select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(False).alias("lead"))
    heads = parts.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("lead"))
    sets = _with_sets(docs, of.unionByName(heads), "doc_id long, a long, part int, lead boolean").withColumn("key", F.xxhash64("a", "part"))
    return sets.repartition("key").sortWithinPartitions("key", "a").mapInPandas(tidied(_star(percent)), "a long, b long")


def _compared(docs: DataFrame, members: DataFrame, percent: int, block: int) -> DataFrame:
    """Links on full sets between the components `of` of each group of members (doc_id, of, root).

    The largest component of a group, which a hot group of copies is, is compared with the rest only, in blocks of about
    `block` documents: with few others it is sent few times.
    """
    sizes = members.groupBy("root", "of").agg(F.count("*").alias("k"))
    groups = sizes.groupBy("root").agg(F.max(F.struct("k", "of")).alias("most"), F.sum("k").alias("all")).select("root", F.col("most.of").alias("most"), F.ceil((F.col("all") - F.col("most.k")) / block).cast("int").alias("rest"), F.ceil(F.col("most.k") / block).cast("int").alias("own"))
    at = F.pmod(F.xxhash64("doc_id"), F.when(F.col("of") == F.col("most"), F.col("own")).otherwise(F.col("rest"))).cast("int")
    rows = members.join(groups, "root").withColumn("block", at + F.when(F.col("of") == F.col("most"), F.col("rest")).otherwise(0))
    upto = F.when(F.col("of") == F.col("most"), F.col("rest")).otherwise(F.col("rest") + F.col("own")) - 1
    sets = _with_sets(docs, rows.select("doc_id", "of", "root", "block", upto.alias("upto")), "doc_id long, of long, root long, block int, upto int")
    sets = sets.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("upto")))).select("doc_id", "of", "root", "block", F.least("block", "k").alias("bi"), F.greatest("block", "k").alias("bj"), "shingles")
    return sets.groupBy("root", "bi", "bj").applyInPandas(_exact(percent), "a long, b long")


def linked(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """(id, root): the components of nodes (rep, n, half1, half2, code: a byte of each minhash) under their confirmed links; a node without links has no row.

    1. The first collection's half-keys are exchanged; rows whose half-key repeats are buckets. 2. Each node pairs with the
    likeliest nodes of its buckets, PARTNERS at most; the pairs are confirmed on full sets, and what links is one component. So
    again, a few times, with nodes of other components in the buckets that had such pairs: a group of copies with edits is settled by work in proportion to
    it. 3. Rows of buckets that hold several components are split by the second collection's half-keys into the buckets of the
    tables, and of these again those that hold several are searched for likely pairs (agreeing minhashes). The groups which the pairs make are
    compared in full, but never within a component. No pair is dropped for the size of its bucket or group.
    """
    first = written(_repeated(nodes.select("rep", "half1").mapInPandas(tidied(_keys("half1")), "key long, rep long")), "buckets")
    codes = nodes.select("rep", "n", "code")
    active, found = first.select("key", "rep", F.col("rep").alias("of")), None
    for _ in range(NEAREST):
        near = active.join(codes, "rep").select("key", "rep", "of", "n", "code").repartition("key").sortWithinPartitions("key", "rep").mapInPandas(tidied(_nearest(percent)), "key long, b long, a long, agreeing long")
        near = written(near, "near")
        best = F.slice(F.sort_array(F.collect_set(F.struct("agreeing", "a")), asc=False), 1, PARTNERS)  # of one a bucket at most
        pairs = kept(near.groupBy("b").agg(best.alias("best")).select("b", F.explode("best.a").alias("a")))
        if pairs.isEmpty():
            break
        found = _merged(found, _confirmed(docs, pairs, percent, block))
        active = kept(_apart(_placed(first.join(near.select("key").distinct(), "key", "left_semi"), found)))
    rows = _apart(_placed(first, found)).join(nodes.select("rep", "half2"), "rep").select("key", "rep", "of", "half2")
    rows = _apart(written(rows.mapInPandas(tidied(_keys("half2")), "key long, rep long, of long"), "tables")).join(codes, "rep").select("key", "of", "n", "code")
    likely = rows.repartition("key").sortWithinPartitions("key", "of").mapInPandas(tidied(_likely(percent, wide)), "a long, b long").distinct()
    groups = kept(components(likely).select(F.col("id").alias("of"), "root"))
    if groups.isEmpty():
        return groups.select(F.col("of").alias("id"), "root") if found is None else found
    within = groups if found is None else groups.join(found.withColumnRenamed("root", "of"), "of", "left")
    within = within.select((F.coalesce("id", "of") if found is not None else F.col("of")).alias("doc_id"), "of", "root")
    return _merged(found, _compared(docs, within, percent, block))


def _merged(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of what is found, if anything, and of links (a, b)."""
    return kept(components(links if found is None else links.unionByName(found.select(F.col("id").alias("a"), F.col("root").alias("b")))))


def _placed(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """(key, rep, of): rows (key, rep) with their component."""
    if found is None:
        return rows.select("key", "rep", F.col("rep").alias("of"))
    return rows.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("of"))


def _apart(rows: DataFrame) -> DataFrame:
    """rows (key, rep, of) of the keys that hold several components."""
    keys = rows.groupBy("key").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo < hi").select("key")
    return rows.join(keys, "key", "left_semi").select("key", "rep", "of")


def group(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of docs (doc_id, text). Documents link from `percent` on.

    Documents of equal shingle sets are one node, their smallest doc_id. Null, empty and blank texts have no
    shingles and link with nothing. Long texts count whole. Repeated rows share a component; of an id with several texts each
    row has its text's component, and others link to that id by any of its texts. A row without doc_id is alone, with a null component. No rows:
    no result. Other columns are not read.
    """
    kind = "doc_id long, n long, s1 long, s2 long, half1 binary, half2 binary, code binary"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = written(docs.mapInArrow(tidied(_sketch), kind), "sketches")
    some, own = sketched.where("n > 0"), ("half1", "half2", "code")
    nodes = written(some.where("doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), *(F.min_by(c, "doc_id").alias(c) for c in own)), "nodes")
    found = linked(docs, nodes.select("rep", "n", *own), **how)
    classes = nodes.select("s1", "s2", "n", "rep").join(found, F.col("rep") == F.col("id"), "left").select("s1", "s2", "n", F.coalesce("root", "rep").alias("component"))
    out = sketched.drop(*own).join(classes, ["s1", "s2", "n"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose component has a smaller doc_id; rows without doc_id stay. Columns keep their names and order."""
    gone = written(group(docs).where("not kept").select("doc_id").distinct(), "near-copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies in the whole of `documents`, from 85 hundredths on: see group()."""
    return group(table(spark, sf_dir, "documents"), percent=85)
