"""Exact BM25 top-k: an inverted index per shard, searched with block-max pruning, merged under global statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

K1, B, TOP = 1.2, 0.75, 10
#: Scores count to so many decimals; two that are equal then rank by doc_id.
DIGITS = 6
#: Documents and postings at which a shard is closed, documents of a block, queries of a block, blocks evaluated before pruning.
SHARD_DOCS, SHARD_POSTINGS, BLOCK, QUERIES, FIRST = 8192, 2_000_000, 32, 128, 8
#: Groups of shards: a query leaves each with its best, so that what is merged grows with the queries, not with the shards too.
GROUPS = 8
#: Most terms of a shard that count as common, and the share of its documents that such a term is in at least.
COMMON, OFTEN = 512, 1 / 40
#: Words whose hashes a task remembers.
HASHES = 100_000
SHARD = "n long, words long, doc_ids binary, lengths binary, terms binary, starts binary, docs binary, tfs binary"
#: ASCII signs part words, as white space does.
_SIGNS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


class _Hashes(dict):
    """Hashes of words met lately: most words of a text were in the texts before it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASHES:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def terms(text: str | None, hashes: dict | None = None) -> Counter:
    """Terms (hashes of words in ASCII lower case) with their frequencies; none for a null or blank text."""
    words = Counter((text or "").encode("utf-8", "surrogatepass").lower().translate(_SIGNS).split())
    return Counter(dict(zip(map((_Hashes() if hashes is None else hashes).__getitem__, words), words.values(), strict=True)))


class _Shard:
    """Documents gathered for a shard. They are laid out by their commonest term, so that blocks hold like documents."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, doc_id: int, found: Counter) -> None:
        t = np.fromiter(found, "uint64", len(found))
        n = np.fromiter(found.values(), "uint32", len(found))
        self.rows.append((int(t[np.lexsort((t, n))[-1]]) if len(t) else 0, doc_id, int(n.sum()), t, n))
        self.size += len(t)

    def row(self) -> tuple:
        self.rows.sort(key=lambda r: (r[0], r[2], r[1]))
        t, n = np.concatenate([r[3] for r in self.rows]), np.concatenate([r[4] for r in self.rows])
        doc = np.repeat(np.arange(len(self.rows), dtype="uint32"), [len(r[3]) for r in self.rows])
        order = np.argsort(t, kind="stable")
        t, n, doc = t[order], n[order], doc[order]
        starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.empty(0, "int64")
        lengths = np.array([r[2] for r in self.rows], "uint32")
        out = (len(self.rows), int(lengths.sum()), np.array([r[1] for r in self.rows], "int64").tobytes(), lengths.tobytes(), t[starts].tobytes(), np.append(starts, len(t)).astype("uint32").tobytes(), doc.tobytes(), n.tobytes())
        self.__init__()
        return out


def build(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The index of docs (doc_id, text): one row a shard. Each task closes a shard when it is full; nothing is shuffled."""

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, shard = SHARD.replace(" long", "").replace(" binary", "").split(", "), _Shard()
        hashes = _Hashes()
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                shard.add(doc_id, terms(text if isinstance(text, str) else None, hashes))
                if len(shard.rows) >= shard_docs or shard.size >= shard_postings:
                    yield pd.DataFrame([shard.row()], columns=name)
        if shard.rows:
            yield pd.DataFrame([shard.row()], columns=name)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(shards, SHARD)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for t, s in zip(pdf["terms"], pdf["starts"], strict=True):
            yield pd.DataFrame({"term": np.frombuffer(t, "int64"), "df": np.diff(np.frombuffer(s, "uint32").astype("int64"))})


def _query_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for q, text in zip(pdf["query_id"], pdf["text"], strict=True):
            found = terms(text if isinstance(text, str) else None)
            yield pd.DataFrame({"query_id": np.full(len(found), q, "int64"), "term": np.fromiter(found, "uint64", len(found)).view("int64"), "tf": np.fromiter(found.values(), "int64", len(found))})


class _Searcher:
    """A shard in memory: impacts of its postings, and the greatest impact of each term in each block of documents.

    Terms that are in many of its documents stand as a table of impacts by document instead: no block lacks them, so
    their greatest impacts bound little, and their exact sums cost less than a list of them.
    """

    def __init__(self, row, mean: float):
        of = lambda name, kind: np.frombuffer(row[name], kind)
        self.doc_ids, self.terms, self.starts, self.docs = of("doc_ids", "int64"), of("terms", "uint64"), of("starts", "uint32").astype("int64"), of("docs", "uint32")
        # in place, as a shard has millions of postings: tf * (K1 + 1) / (tf + what the document's length makes of it)
        self.impacts = of("tfs", "uint32").astype("float64")
        below = (K1 * (1 - B + B * of("lengths", "uint32") / mean))[self.docs]
        below += self.impacts
        self.impacts *= K1 + 1
        self.impacts /= below
        del below
        self.blocks = -(-len(self.doc_ids) // BLOCK)
        # runs: postings of one term in one block
        new = np.zeros(len(self.docs), bool)
        new[self.starts[:-1]] = True
        new[1:] |= self.docs[1:] // BLOCK != self.docs[:-1] // BLOCK
        self.run = np.append(np.flatnonzero(new), len(self.docs))
        self.run_block = self.docs[self.run[:-1]] // BLOCK
        self.run_max = np.maximum.reduceat(self.impacts, self.run[:-1]) if len(self.docs) else np.empty(0)
        self.term_run = np.searchsorted(self.run, self.starts)
        self.scored = self.asked = 0  # blocks scored for a query, and blocks that hold a term of it
        n, df = len(self.doc_ids), np.diff(self.starts)
        common = np.argsort(-df, kind="stable")[:COMMON]
        common = common[df[common] >= OFTEN * n]
        self.column = np.full(len(self.terms), -1)
        self.column[common] = np.arange(len(common))
        self.common = np.zeros((len(common), n))
        for j, t in enumerate(common):
            of_term = slice(self.starts[t], self.starts[t + 1])
            self.common[j, self.docs[of_term]] = self.impacts[of_term]

    @staticmethod
    def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every position of the ranges lo to hi, and which range it is of."""
        n = hi - lo
        of = np.repeat(np.arange(len(n)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of], of

    def search_all(self, terms: list[np.ndarray], weights: list[np.ndarray], top: int, floors: list[float]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """search() for each of a block of queries; the common terms of all are summed at once."""
        if not len(self.terms) or not terms:
            yield from ((np.empty(0, "int64"), np.empty(0)) for _ in terms)
            return
        ends = np.cumsum([len(t) for t in terms])
        t, w, query = np.concatenate(terms), np.concatenate(weights), np.repeat(np.arange(len(terms)), np.diff(ends, prepend=0))
        at = np.searchsorted(self.terms, t)
        here = self.terms[np.minimum(at, len(self.terms) - 1)] == t
        at, w, query = at[here], w[here], query[here]
        often = self.column[at] >= 0
        table = np.zeros((len(terms), len(self.common)))
        table[query[often], self.column[at[often]]] = w[often]
        sums = table @ self.common
        most = np.maximum.reduceat(sums, np.arange(0, len(self.doc_ids), BLOCK), axis=1)
        at, w = at[~often], w[~often]
        cuts = np.searchsorted(query[~often], np.arange(len(terms) + 1))
        for q, floor in enumerate(floors):
            own = slice(cuts[q], cuts[q + 1])
            yield self.search(at[own], w[own], sums[q], most[q], top, floor)

    def search(self, at: np.ndarray, weights: np.ndarray, sums: np.ndarray, most: np.ndarray, top: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of all documents that can be among the `top`, given that scores under floor can't.

        at: the query's terms that aren't common; sums: each document's score from the common ones, most: the greatest of a
        block. A block's bound is that and the sum of the other terms' greatest impacts in it. Blocks are scored from the
        highest bound down: a few, and then those whose bound reaches the least score that now counts.
        """
        runs, of = self._spread(self.term_run[at], self.term_run[at + 1])
        block = self.run_block[runs]
        bound = (most + np.bincount(block, self.run_max[runs] * weights[of], self.blocks)) * (1 + 1e-9)
        able = np.flatnonzero((bound > 0) & (bound >= floor - 10.0**-DIGITS))  # a rounded score may still reach the floor
        self.asked += np.count_nonzero(bound > 0)
        order, found, scores, best = able[np.argsort(-bound[able], kind="stable")], [], [], np.empty(0)
        for take in (order[:FIRST], order[FIRST:]):
            take = take[bound[take] >= floor - 10.0**-DIGITS]
            if not len(take):
                break
            self.scored += len(take)
            chosen = np.zeros(self.blocks, bool)
            chosen[take] = True
            some = np.flatnonzero(chosen[block])
            post, which = self._spread(self.run[runs[some]], self.run[runs[some] + 1])
            total = sums + np.bincount(self.docs[post], self.impacts[post] * weights[of[some]][which], len(sums))
            hit = (take[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            hit = hit[hit < len(sums)]
            hit = hit[(total[hit] > 0) & (total[hit] >= floor - 10.0**-DIGITS)]
            found.append(hit)
            scores.append(total[hit])
            best = np.concatenate((best, total[hit]))
            if len(best) > top:
                best = np.partition(best, len(best) - top)[-top:]
            if len(best) == top:
                floor = max(floor, best.min())
        if not found:
            return np.empty(0, "int64"), np.empty(0)
        found, scores = np.concatenate(found), np.concatenate(scores)
        stay = scores >= floor - 10.0**-DIGITS
        return self.doc_ids[found[stay]], np.round(scores[stay], DIGITS)


def _rows(store: fs.FileSystem, files: list[str]) -> Iterator[dict]:
    """The shards of files, one in memory at a time."""
    for file in files:
        with store.open_input_file(file) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1, use_threads=False):
                yield {name: batch[name][0].as_buffer() for name in ("doc_ids", "lengths", "terms", "starts", "docs", "tfs")}


def _best(ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:top]
    return ids[order], scores[order]


def _found(index: DataFrame, packed: DataFrame, mean: float, top: int) -> DataFrame:
    """(query_id, doc_id, score): the `top` of each group of shards of index, a written table, for each of packed (query_id, terms, weights), another."""
    files = index.inputFiles()
    if not files:
        return packed.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    folder = files[0].rpartition("/")[0]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = fs.FileSystem.from_uri(folder)
        shards = sorted(ds.dataset(path, filesystem=store, format="parquet").files)
        for pdf in batches:
            for group, asked in pdf.groupby("group"):
                t, w = ([np.asarray(x) for x in asked[c]] for c in ("terms", "weights"))
                best = [(np.empty(0, "int64"), np.empty(0))] * len(t)
                for row in _rows(store, shards[group::GROUPS]):
                    shard = _Searcher(row, mean)
                    for low in range(0, len(t), QUERIES):
                        some = slice(low, low + QUERIES)
                        floors = [scores[-1] if len(scores) == top else 0.0 for _, scores in best[some]]
                        for i, found in enumerate(shard.search_all([x.view("uint64") for x in t[some]], w[some], top, floors), low):
                            if len(found[0]):
                                best[i] = _best(*map(np.concatenate, zip(best[i], found, strict=True)), top)
                    del shard, row  # or they stay until the next ones stand
                yield pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy(), [len(ids) for ids, _ in best]), "doc_id": np.concatenate([ids for ids, _ in best]), "score": np.concatenate([scores for _, scores in best])})

    tasks = 3 * packed.sparkSession.sparkContext.defaultParallelism
    dealt = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1)))).repartitionByRange(tasks, "group", "query_id")
    return dealt.sortWithinPartitions("group").mapInPandas(scored, "query_id long, doc_id long, score double")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, **how) -> DataFrame:
    """(query_id, rank, doc_id, score): the exact BM25 `top` documents of docs (doc_id, text) for queries (query_id, text).

    Terms weigh by global document frequencies and lengths, so a document's score does not depend on its shard,
    and merging the `top` of GROUPS groups of shards is exact. Scores have DIGITS decimals, and equal ones rank by doc_id. Shards stand in the shared folder, a file each;
    a task opens those of a group one after another for its batch of queries, whose best so far bound what a later shard need score: it holds a shard and a batch. A query without a term that
    occurs (so a null, empty or blank one) has no rows, and a document without terms is never found but counts among the documents. Long
    texts count whole. Rows that repeat a doc_id are documents of their own; a row without doc_id can't be named in a result, and is no part of
    the corpus or of its statistics. Other columns are not read. No documents or no queries: no rows.
    """
    spark = docs.sparkSession
    index = written(build(docs, **how), "index", maxRecordsPerFile=1)
    n, words = index.agg(F.sum("n"), F.sum("words")).first()
    n, mean = n or 0, (words or 0) / n if n and words else 1.0
    df = index.select("terms", "starts").mapInPandas(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    asked = queries.select("query_id", "text").mapInPandas(_query_terms, "query_id long, term long, tf long").groupBy("query_id", "term").agg(F.max("tf").alias("tf"))
    weighed = asked.join(df, "term").select("query_id", F.struct("term", (F.col("tf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w")).alias("t"))
    packed = weighed.groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("query_id", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"))
    packed = written(packed, "queries")
    merged = _found(index, packed, mean, top)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "doc_id", "score")


def op6_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of the whole of `documents` for each document whose id is divisible by 100: see search()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"))
