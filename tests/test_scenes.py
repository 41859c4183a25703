"""Scenes and trials against plain Python, hot groups among them."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import scenes, trials


def test_pair_counts_equal_listed_pairs(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for k in range(3) for _ in range(40)] + [(9, 1, None), (8, 1, "a")]
    got = {r["k"]: r for r in trials.pair_scores(spark.createDataFrame(rows, "k int, c int, t string"), ["k"], "c", "t").collect()}
    for k in (0, 1, 2, 8):
        part = [(c, t) for q, c, t in rows if q == k and t is not None]
        n = Counter((a[0] is not None and a[0] == b[0], a[1] == b[1]) for i, a in enumerate(part) for b in part[:i])
        r = got[k]
        assert (r["tp"], r["fp"], r["fn"], r["tn"], r["pairs"]) == (n[True, True], n[True, False], n[False, True], n[False, False], sum(n.values()))
    assert got[8]["precision"] is None and 9 not in got


def test_pair_counts_beyond_a_long(spark):
    big = spark.range(3).select(F.lit(1).alias("c"), F.lit("t").alias("t"))
    assert trials.pair_scores(big, [], "c", "t").first()["tp"] == 3
    assert trials.pair_scores(big.limit(0), ["c"], "t", "t").collect() == []


@pytest.fixture(scope="module")
def faces(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [None, *"abcdefg"][i % 8], rng.normal(size=5).tolist()) for i in range(300)] + [(400 + i, "hot", rng.normal(size=5).tolist()) for i in range(300)] + [(900, "a", [0.0] * 5)]
    return rows, spark.createDataFrame(rows, "id int, who string, v array<double>")


def test_recognition_equals_all_pairs(spark, faces, monkeypatch):
    monkeypatch.setattr(trials, "BLOCK", 5)  # a subject's references go over a block's end
    rows, df = faces
    split = trials.gallery_split(df, "who", "id", 3, 5)
    part = {r["id"]: r["part"] for r in split.collect()}
    assert Counter(v for i, v in part.items() if rows and v == "reference")["reference"] == 8 * 3 and sum(v is None for v in part.values()) == 38
    unit = {i: np.array(v) / (np.linalg.norm(v) or np.nan) for i, _, v in rows}
    who = {i: w for i, w, _ in rows}
    refs = [i for i, p in part.items() if p == "reference" and who[i] != "g"]
    got = trials.recognised(split.where("part = 'probe' or who <> 'g'"), "who", "id", "v").collect()
    assert len(got) == sum(p == "probe" for p in part.values())
    for r in got:
        best = {}
        for i in refs:
            s = round(float(unit[r["id"]] @ unit[i]), 9)
            if not np.isnan(s):
                best[who[i]] = max(best.get(who[i], -9), s)
        own = best.get(r["who"])
        others = sorted((-s, w) for w, s in best.items() if w != r["who"])
        assert (r["own"], r["other_score"]) == (own, -others[0][0] if others else None) and (not others or r["other"] == others[0][1])
        assert r["rank"] == (None if own is None else 1 + sum(-s > own for s, _ in others))


def test_sweep_equals_one_pass_a_threshold(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.uniform(-1, 1)]), rng.choice([None, rng.uniform(-1, 1)])) for _ in range(300)]
    for r in trials.swept(spark.createDataFrame(rows, "own double, other_score double"), 8).collect():
        t = r["threshold"]
        low = lambda x: x is not None and x >= t
        named = [(o, p) for o, p in rows if low(max((x for x in (o, p) if x is not None), default=None))]
        assert r["accepted"] == len(named) and r["correct"] == sum(low(o) and (p is None or o >= p) for o, p in rows)
        assert r["false"] == sum(low(p) for _, p in rows) and r["missed"] == sum(not low(o) for o, _ in rows)


def test_leaks(spark):
    rows = [("x", "reference"), ("x", "probe"), ("y", "probe"), ("z", None)]
    assert [tuple(r) for r in trials.leaks(spark.createDataFrame(rows, "digest string, part string"), "digest").collect()] == [("x", 1, 1)]


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(4)
    photos = {i: {rng.randrange(12): rng.randrange(1, 9) for _ in range(rng.randrange(1, 7))} for i in range(120)}
    photos |= {200 + i: {c: 2 * m for c, m in photos[5].items()} for i in range(50)}  # one histogram, scaled
    burst = {i: i % 3 if i < 200 else 5 % 3 for i in photos}
    rows = [(burst[i], i, c, m) for i, h in photos.items() for c, m in h.items()] + [(0, 300, 1, 0), (0, 301, 1, None), (None, 302, 1, 1), (None, 303, 1, 1)]
    cells = spark.createDataFrame(rows, "burst int, photo int, cell int, mass int")
    share = {i: {c: m / sum(h.values()) for c, m in h.items()} for i, h in photos.items()}
    same = {}
    for i, h in share.items():
        same.setdefault((burst[i], tuple(sorted((c, round(m, 12)) for c, m in h.items()))), []).append(i)
    head = {i: min(v) for v in same.values() for i in v}
    for least in (0.3, 0.64, 0.95):
        want = {(head[i], i) for i in photos if head[i] != i}
        heads = sorted(set(head.values()))
        want |= {(a, b) for n, b in enumerate(heads) for a in heads[:n] if burst[a] == burst[b] and sum(min(share[a][c], share[b].get(c, 0)) for c in share[a]) + 1e-9 >= least}
        got = [(r["a"], r["b"]) for r in scenes.overlaps(cells, "photo", "cell", "mass", least, ["burst"]).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_representatives_are_those_of_one_pass_in_order(spark):
    rng = random.Random(5)
    links = {(a, b): rng.randrange(4) for a, b in (sorted(rng.sample(range(150), 2)) for _ in range(300))}
    links |= {(i, i + 1): 1 for i in range(160, 175)}  # a chain does not become one group
    heads, want = [], {}
    for n in range(180):
        found = [(links[h, n], h) for h in heads if (h, n) in links]
        want[n] = min(found)[1] if found else n
        if not found:
            heads.append(n)
    nodes = spark.createDataFrame([(i,) for i in range(180)], "id int")
    edges = spark.createDataFrame([(a, b, d) for (a, b), d in links.items()], "a int, b int, distance int")
    assert {r["id"]: r["representative"] for r in scenes.representatives(nodes, edges, "id").collect()} == want
    assert {r["id"]: r["representative"] for r in scenes.representatives(nodes, edges.limit(0), "id").collect()} == {i: i for i in range(180)}


def test_groups_of_structures_and_copies(spark):
    rng = np.random.default_rng(6)
    base = rng.random((3, 4, 16))
    rows = [(i, 7, [b.tolist() for b in base[0]], 1.0) for i in range(0, 300, 3)]  # copies
    rows += [(1, 7, [b.tolist() for b in base[1]], 1.0), (4, 6, [(b + 0.001).tolist() for b in base[0]], 1.1), (7, 7, [b.tolist() for b in base[0]], 1.5), (10, -1, [b.tolist() for b in base[0]], 1.0), (13, None, None, 1.0), (16, 5, [(b + 0.002).tolist() for b in base[1]], 1.0)]
    df = spark.createDataFrame(rows, "id int, hash bigint, blocks array<array<double>>, aspect double")
    got = {r["id"]: r["representative"] for r in scenes.grouped(df, "id", "hash", "blocks", "aspect", 3, 0.8, 1.15).collect()}
    assert len(got) == len(rows) and all(got[i] == 0 for i in range(0, 300, 3))
    assert (got[1], got[4], got[7], got[10], got[13], got[16]) == (1, 0, 7, 10, 13, 1)


def test_cameras(spark):
    side = "struct<span_x:double,span_y:double,area:double>"
    kind = f"matches int, inliers int, source {side}, target {side}, scale double, rotation double, translation double, a double, b double, points int, texture double"
    good = {"matches": 40, "inliers": 30, "source": (0.5, 0.4, 0.1), "target": (0.5, 0.4, 0.1), "scale": 1.02, "rotation": 1.0, "translation": 0.01, "a": 1.5, "b": 1.5, "points": 200, "texture": 80.0}
    cases = [
        ({}, "same"), ({"a": 1.7}, "different"), ({"matches": 5, "inliers": 5}, "unknown"), ({"matches": 1, "inliers": 0}, "different"), ({"matches": None}, "different"), ({"matches": 1, "points": 50}, "unknown"), ({"matches": 1, "texture": None}, "unknown"),
        ({"inliers": 9}, "unknown"), ({"inliers": 15}, "unknown"), ({"source": (0.1, 0.1, 0.1)}, "unknown"), ({"target": (0.1, 0.1, 0.1)}, "unknown"), ({"source": (0.5, 0.5, 0.001)}, "unknown"), ({"scale": 2.5}, "unknown"), ({"scale": None}, "unknown"), ({"scale": 1.2}, "different"), ({"rotation": 9.0}, "different"), ({"translation": 0.3}, "different"),
    ]
    df = spark.createDataFrame([tuple((good | c).values()) for c, _ in cases], kind)
    fit = {c: F.col(c) for c in ("matches", "inliers", "source", "target")}
    got = [r["c"] for r in df.select(scenes.camera(fit, F.struct("scale", "rotation", "translation"), (F.col("a"), F.col("b")), F.col("points"), F.col("texture")).alias("c")).collect()]
    assert got == [w for _, w in cases]


def test_dispatch_reads_once(spark, tmp_path):
    rows = [(g, i, g != 2 or i % 2 == 0) for g in (1, 2, 3) for i in range(10)] + [(None, 1, True), (None, 2, None), (4, 1, True)]
    spark.createDataFrame(rows, "g int, i int, ok boolean").write.parquet(str(tmp_path / "rows"))
    calls = []

    def engine(name):
        return lambda part: (calls.append(part.inputFiles()), part.select("g", "i", F.lit(name).alias("engine")))[1]

    source = spark.read.parquet(str(tmp_path / "rows"))
    got = scenes.dispatched(source, "g", F.col("ok"), engine("one"), engine("other"))
    assert {(r["g"], r["engine"]) for r in got.collect()} == {(1, "one"), (3, "one"), (4, "one"), (2, "other"), (None, "other")} and got.count() == len(rows)
    assert not any(str(tmp_path / "rows") in f for files in calls for f in files)  # both read the routed table
