import collections
import math

import numpy as np
import pytest
import xxhash

from siftwell.llm import mixing

from .cases import SCHEMA, rows


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, total, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        level = total / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        for s in over or free:
            target[s] = 2 * sizes[s] if over else weight[s] * level
            total -= target[s]
        free -= over or free
    return target


def spark_hash(*values):
    h = 42
    for v, width in values:
        if v is not None:
            h = xxhash.xxh64_intdigest((v & ((1 << 8 * width) - 1)).to_bytes(width, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def brute_copies(rows, seed=0):
    """Copies of each of rows (doc_id, tie, source, size), apart from the code under test."""
    by_source = collections.defaultdict(list)
    for i, r in enumerate(rows):
        by_source[r[2]].append(i)
    target, out = brute_targets({s: sum(rows[i][3] for i in own) for s, own in by_source.items()}), [0] * len(rows)
    for source, own in by_source.items():
        own = [i for i in own if rows[i][3]]
        level = {i: rows[i][3].bit_length() - 1 for i in own}
        words = collections.Counter()
        for i in own:
            words[level[i]] += rows[i][3]
        each, left, free = {}, target[source], set(words)
        while free:
            share = left / sum(words[c] * 2.0 ** (0.25 * c) for c in free)
            full = {c for c in free if share * 2.0 ** (0.25 * c) >= 2}
            for c in full or free:
                each[c] = 2.0 if full else share * 2.0 ** (0.25 * c)
                left -= each[c] * words[c]
            free -= full or free
        need = math.floor(target[source] - sum(math.floor(each[level[i]]) * rows[i][3] for i in own) + 0.5)
        ranks = collections.defaultdict(list)
        for i in own:
            p = each[level[i]] - math.floor(each[level[i]])
            out[i] = math.floor(each[level[i]])
            if p > 0:
                u = (spark_hash((rows[i][0], 8), (rows[i][1], 8), (seed, 4)) % (1 << 50) + 0.5) / (1 << 50)
                p = min(max(p, 1e-9), 1 - 1e-9)
                q = (u / (1 - u)) / (p / (1 - p))
                ranks[math.floor(q / (1 + q) * ((1 << 48) - 1))].append(i)
        later = []
        for k, rank in enumerate(order := sorted(ranks)):
            size = sum(rows[i][3] for i in ranks[rank])
            if size > need:
                later = order[k:]
                break
            need -= size
            for i in ranks[rank]:
                out[i] += 1
        for _ in range(2):
            fit = [(rows[i][3], -rank) for rank in later for i in ranks[rank] if rows[i][3] <= need]
            if fit and need > 0:
                size, rank = max(fit)
                later.remove(-rank)
                need -= size
                for i in ranks[-rank]:
                    out[i] += 1
    return out


def test_mixing_against_brute_force(spark, sf):
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(0, 30, 300), rng.integers(1, 20_000, 60)]).tolist()
    made = spark.createDataFrame([(i, i * 7, ("hot" if i % 3 else f"s{i % 5}") if i % 11 else None, n) for i, n in enumerate(sizes)], "doc_id long, tie long, source string, size long")
    docs, real = spark.createDataFrame(rows(), SCHEMA), spark.read.parquet(f"{sf}/documents.parquet")
    for df in (made, *(x.select("doc_id", "source", *mixing._sizes("text")) for x in (docs, real))):
        had = [(r.doc_id, r.tie, r.source, r.size) for r in df.collect()]
        want = collections.Counter(zip(had, brute_copies(had)))
        got = mixing.sample(df).collect()
        assert collections.Counter(((r.doc_id, r.tie, r.source, r.size), r.copies) for r in got) == want
        size, taken, target = collections.Counter(), collections.Counter(), {}
        for r in got:
            assert 0 <= r.copies <= 2
            size[r.source] += r.size
            taken[r.source] += r.copies * r.size
            target[r.source] = r.target
        want = brute_targets(size)
        for s in size:
            assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-6) and size[s] == next(r.source_size for r in got if r.source == s)
        if df is made:
            assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 1 for s in size)


def test_longer_documents_are_likelier(spark):
    df = spark.range(40_000).selectExpr("id as doc_id", "id as tie", "if(id % 2 = 0, 'a', 'b') as source", "if(id % 4 < 2, 10L, 1000L) as size")
    share = {r["size"]: r.m for r in mixing.sample(df, share=0.5).groupBy("size").agg({"copies": "avg"}).withColumnRenamed("avg(copies)", "m").collect()}
    assert share[1000] > 1.5 * share[10] > 0


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.sample(empty.select("doc_id", "source", *mixing._sizes("text"))).count() == 0
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert mixing.stage(spark, docs, "").columns == docs.columns
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r.copies for r in mixing.sample(blank.select("doc_id", "source", *mixing._sizes("text"))).collect()] == [0, 0]
    pick = lambda seed: sorted(map(str, mixing.sample(docs.select("doc_id", "source", *mixing._sizes("text")), seed=seed).collect()))
    assert pick(1) == pick(1)


def test_targets_stop_at_twice_a_source(spark):
    sizes = {"a": 10, "b": 10, "c": 1000, None: 30, "d": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))
