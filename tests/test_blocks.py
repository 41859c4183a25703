"""Comparisons in blocks, copies among the rows, against every pair."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.operators import blocks, evaluation, folds, regions, scenes, similarity


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(blocks, "TILE", 7)
    monkeypatch.setattr(blocks, "BLOCK", 5)


def _hashes():
    rng = np.random.default_rng(1)
    values = [int(v) for v in rng.integers(-(2**62), 2**62, 60)]
    return [(i, values[i % 40] if i < 90 else values[i % 40] ^ 0b1011) for i in range(120)]


def _apart(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def test_wide_radius_compares_in_arrays_and_finds_all(spark):
    rows = _hashes()
    df = spark.createDataFrame(rows, "id long, h long")
    want = {(a, b): _apart(x, y) for a, x in rows for b, y in rows if a < b and _apart(x, y) <= 24}
    assert similarity._share(24, 64) > similarity.FILTER
    assert "MapInPandas" in similarity.hamming_pairs(df, "id", "h", 24)._jdf.queryExecution().toString()
    near = {}
    for (a, b), d in want.items():
        for x, y in ((a, b), (b, a)):
            near[x] = min(near.get(x, (99, 0)), (d, y))
    got = similarity.nearest(similarity.hamming_pairs(df, "id", "h", 24), "id", "other", "distance").collect()
    assert {r["id"]: (r["distance"], r["other"]) for r in got} == near


def test_pairs_of_copies_stand_for_themselves(spark):
    rows = _hashes()
    got = similarity.hamming_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h", 18, copies=True).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b): r.distance for r in got} == {(a, b): _apart(x, y) for a, x in rows for b, y in rows if a < b and _apart(x, y) <= 18}


def test_counters_count_pairs_of_copies(spark):
    rows = _hashes()
    pairs = similarity.hamming_counts(spark.createDataFrame(rows, "id long, h long"), "h", 18).withColumnRenamed("n", "w")
    got = {r["counter"]: r["n"] for r in evaluation.counters({"all": pairs, "same": pairs.where("distance = 0"), "none": pairs.where("distance > 18")}, "w").collect()}
    far = [_apart(x, y) for a, x in rows for b, y in rows if a < b]
    assert got == {"all": sum(d <= 18 for d in far), "same": far.count(0), "none": 0}


def test_variants_of_copies_stand_for_themselves(spark):
    rows = [(i, v, [v ^ 1, v ^ 0xFF00]) for i, v in _hashes()]
    got = similarity.variant_pairs(spark.createDataFrame(rows, "id long, v long, parts array<long>"), "id", "v", "parts", 16, copies=True).collect()
    want = {}
    for a, v, _ in rows:
        for b, _, parts in rows:
            d = min(_apart(v, p) for p in parts)
            if a != b and d <= 16:
                want[min(a, b), max(a, b)] = min(d, want.get((min(a, b), max(a, b)), 99))
    assert len(got) == len(want) and {(r.a, r.b): r.distance for r in got} == want


def _vectors(n=90):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(n, 6))
    base[n // 2 :] = base[: n - n // 2]  # copies: ties go to the least
    return [(i, v.tolist()) for i, v in enumerate(base)] + [(500, [0.0] * 6)]


def _cosines(rows):
    unit = np.array([v for _, v in rows])
    with np.errstate(invalid="ignore"):
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        return np.nan_to_num(unit @ unit.T, nan=-9)


def test_best_over_blocks_are_the_best_of_all(spark):
    rows = _vectors()
    s = _cosines(rows).round(9)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in similarity.cosine_pairs(df, "id", "v", df.select(F.col("id").alias("query"), F.col("v").alias("vector")), 0.1, 3).collect():
        got.setdefault(r["id"], []).append((-round(r["score"], 9), r["query"]))
    for n, (i, _) in enumerate(rows):
        assert [q for _, q in sorted(got.get(i, []))] == [q for _, q in sorted((-s[n, m], q) for m, (q, _) in enumerate(rows) if s[n, m] >= 0.1)[:3]]


def test_mutual_from_the_two_best_of_each_side(spark):
    rng = np.random.default_rng(3)
    scores = [(a, 100 + b, float(rng.integers(1, 30)) / 10) for a in range(12) for b in range(12) if rng.random() < 0.6]
    best = lambda side: [r for k in {s[side] for s in scores} for r in sorted((s for s in scores if s[side] == k), key=lambda s: (-s[2], s[1 - side]))[:2]]
    df = lambda rows: spark.createDataFrame(rows, "a long, b long, score double")
    whole = sorted(map(tuple, similarity.mutual(df(scores), "a", "b", "score", 0.9).collect()))
    assert whole and whole == sorted(map(tuple, similarity.mutual(df(best(0)), "a", "b", "score", 0.9, df(best(1))).collect()))


def test_components_ask_for_one_link_a_row(spark, monkeypatch):
    rows = _vectors(60)
    s, made = _cosines(rows), []
    kept = similarity.kept
    monkeypatch.setattr(similarity, "kept", lambda df: made.append(kept(df)) or made[-1])
    for least in (0.8, 0.97):
        root = list(range(len(rows)))
        for _ in rows:
            root = [min([root[n], *(root[m] for m in range(len(rows)) if s[n, m] >= least)]) for n in range(len(rows))]
        made.clear()
        got = {r["id"]: r["root"] for r in similarity.cosine_components(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", least).collect()}
        assert got == {i: rows[root[n]][0] for n, (i, _) in enumerate(rows)}
        assert all(df.count() <= len(rows) for df in made)


def test_structures_compare_in_blocks(spark):
    from siftwell.functions.vectors import block_ssim

    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 2**20)), [b.tolist() for b in (np.arange(4) + rng.random((2 if i % 9 else 3, 4)) * 3)], 1.0 + i % 3 * 0.1) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, h bigint, blocks array<array<double>>, aspect double")
    links, _ = scenes.verified_pairs(df, "id", "h", "blocks", "aspect", 10, 0.5, 1.15)
    both = df.alias("x").crossJoin(df.alias("y")).where("x.id < y.id and size(x.blocks) = size(y.blocks) and bit_count(x.h ^ y.h) <= 10 and greatest(x.aspect, y.aspect) / least(x.aspect, y.aspect) <= 1.15")
    want = both.select("x.id", "y.id", block_ssim(F.col("x.blocks"), F.col("y.blocks")).alias("s")).where("s >= 0.5").collect()
    assert want and {(r.a, r.b): round(r.score, 9) for r in links.collect()} == {(a, b): round(s, 9) for a, b, s in want}


def test_cliques_are_a_guarded_merge_of_single_rows(spark):
    rows = [(i % 2, i, v) for i, v in _vectors(40)]
    s = _cosines([r[1:] for r in rows])
    pairs = [(rows[n][0], rows[n][1], rows[m][1]) for n in range(len(rows)) for m in range(n + 1, len(rows)) if rows[n][0] == rows[m][0] and s[n, m] >= 0.2]
    members = spark.createDataFrame([(k, i, i) for k, i, _ in rows], "k int, id long, part long")
    want = {r["id"]: r["root"] for r in folds.guarded_merge(spark.createDataFrame(pairs, "k int, a long, b long"), members, ["k"]).collect()}
    got = folds.cliques(spark.createDataFrame(rows, "k int, id long, v array<double>"), ["k"], "id", "v", 0.2).collect()
    assert {r["id"]: r["root"] for r in got} == want


def test_distances_of_faces_are_roots_of_sums_to_the_last_bit(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.random(8) + 0.5]) for i in range(200)]
    df = spark.createDataFrame(rows, "photo int, b array<double>")
    box = lambda at: F.struct(*(F.get("b", F.lit(at + n)).alias(c) for n, c in enumerate("xywh")))
    got = regions.face_person(df.select("photo", F.lit(1).alias("face"), box(0).alias("box")), df.select("photo", F.lit(2).alias("person"), box(4).alias("box"), F.lit(0.0).alias("confidence")), "photo").collect()
    for r in got:
        x, y, w, h, a, b, c, d = rows[r["photo"]][1]
        both = max(min(x + w, a + c) - max(x, a), 0.0) * max(min(y + h, b + d) - max(y, b), 0.0)
        dx, dy = a + c / 2 - x - w / 2, b + d / 2 - y - h / 2
        away = (dx * dx + dy * dy) ** 0.5 / max((w * w + h * h) ** 0.5, 1.0)
        assert r["score"] == 2 * (both / (w * h + c * d - both)) + max(1 - away, 0.0)


def test_overlaps_in_many_blocks_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    photos = {i: {f"w{c}": int(m) for c, m in zip(rng.integers(0, 30, 12), rng.integers(1, 9, 12), strict=True)} for i in range(60)}
    photos |= {100 + i: photos[i] for i in range(10)}
    cells = spark.createDataFrame([(i % 2, i, c, 1) for i, h in photos.items() for c, m in h.items() for _ in range(m)], "g int, p int, c string, m int")  # masses stand in many rows
    share = {i: {c: m / sum(h.values()) for c, m in h.items()} for i, h in photos.items()}
    alone = [i for i in photos if i < 100]
    want = {(a, b) for a in alone for b in alone if a < b and a % 2 == b % 2 and sum(min(share[a][c], share[b].get(c, 0)) for c in share[a]) + 1e-9 >= 0.5} | {(i, 100 + i) for i in range(10)}
    made = scenes.overlaps(cells, "p", "c", "m", 0.5, ["g"])
    got = [(r["a"], r["b"]) for r in made.collect()]
    assert len(want) > 12 and len(got) == len(set(got)) and set(got) == want


def test_links_of_decided_nodes_are_not_read_again(spark, monkeypatch):
    made = []
    kept = scenes.kept
    monkeypatch.setattr(scenes, "kept", lambda df: made.append(kept(df)) or made[-1])
    edges = spark.createDataFrame([(a, b, 1) for a in range(5) for b in range(5, 40)] + [(50, 51, 1), (51, 52, 1), (52, 53, 1)], "a int, b int, distance int")
    got = {r["id"]: r["representative"] for r in scenes.representatives(spark.createDataFrame([(i,) for i in range(54)], "id int"), edges, "id").collect()}
    assert all(got[i] == i for i in range(5)) and all(got[i] == 0 for i in range(5, 40)) and (got[51], got[52], got[53]) == (50, 52, 52)
    live = [df.count() for df in made if set(df.columns) == {"a", "b"}]
    assert live == [1, 0]


def test_passages_end_within_words_and_begin_within_them(spark):
    docs = [(1, "a the cat sat on mats b"), (2, "bathe cat sat on mat the cat"), (3, "the cat sat"), (4, "xthe cat sat on mat"), (5, "cat"), (6, "one two three four five six seven eight nine tenth"), (7, None)]
    items = [(1, "the cat sat on mat"), (2, "cat"), (3, "the ca"), (4, "one two three four five six seven eight nine ten"), (5, None)]
    got = evaluation.contained(spark.createDataFrame(docs, "d int, t string"), "d", "t", spark.createDataFrame(items, "i int, p string"), "i", "p").collect()
    want = set()
    for d, t in docs:
        for i, p in items:
            if t and p and p in f" {t} " and p.split(" ")[0] in t.split(" ") and (len(p.split(" ")) < 2 or " ".join(p.split(" ")[:2]) in t):
                want.add((d, i))
    assert {tuple(r) for r in got} == want and len(got) == len(want) and {(1, 1), (2, 1), (6, 4)} <= want


def _brute(texts, least):
    """(group, a, b): what overlaps must give for words; texts of (group, key, text)."""
    counts = {}
    for g, k, t in texts:
        if g is not None and k is not None and t is not None:
            for w in t.split(" "):
                cells = counts.setdefault((g, k), {})
                cells[w] = cells.get(w, 0) + 1
    share = {at: {w: n / sum(c.values()) for w, n in c.items()} for at, c in counts.items()}
    classes, want = {}, {}
    for (g, k), c in sorted(share.items()):
        head = classes.setdefault((g, tuple(sorted((w, round(s, 12)) for w, s in c.items()))), k)
        if head != k:
            want[g, head, k] = 1.0
    heads = sorted((g, k) for (g, _), k in classes.items())
    for n, (g, b) in enumerate(heads):
        for h, a in heads[:n]:
            both = sum(min(s, share[g, b].get(w, 0)) for w, s in share[h, a].items())
            if g == h and both + 1e-9 >= least:
                want[g, a, b] = both
    return want


@pytest.mark.parametrize("least", [0.2, 0.64, 0.9])
def test_words_are_histograms_of_all_texts_of_a_key(spark, monkeypatch, least):
    monkeypatch.setattr(blocks, "EACH", 3)  # so that most tiles end by weight
    monkeypatch.setattr(scenes, "TEXTS", 200)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(25)] + ["ß", "漢字", "\n"]
    texts = [(f"g{i % 3}", f"k{i:03}", " ".join(rng.choice(words, rng.integers(1, 9)))) for i in range(90)]
    texts += [(g, f"z{k}", t) for g, k, t in texts[:12]]  # copies
    texts += [("g0", "k000", "w1 w2"), ("g1", "k000", "w1 w2"), ("g0", "y1", None), ("g0", "y2", ""), ("g0", "y3", ""), ("g0", "y4", " "), ("g0", "y5", "w1  w2 "), ("g0", None, "w1"), (None, "y6", "w1"), (None, "y7", "w1")]
    texts += [("g1", f"t{i}", "w3 " * (i + 1) + "rare") for i in range(40)] + [("g2", "long", " ".join(f"v{i}" for i in range(400)))]
    df = spark.createDataFrame(texts, "g string, k string, t string").repartition(5)
    got = scenes.shared_histograms(scenes.worded(df, "k", "t", ["g"]), least, ["g"]).collect()
    want = _brute(texts, least)
    assert len(want) > 100 and len(got) == len(want)
    assert all(abs(want[r["g"], r["a"], r["b"]] - r["overlap"]) < 1e-9 for r in got)
    none = df.where("false")
    assert scenes.shared_histograms(scenes.worded(none, "k", "t", ["g"]), least, ["g"]).count() == 0


def test_words_are_not_rows(spark):
    df = spark.createDataFrame([("g", 1, "a b")], "g string, k int, t string")
    plan = scenes.worded(df, "k", "t", ["g"])._jdf.queryExecution().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_pairs_that_share_common_cells_only_are_not_summed_in_full(spark, monkeypatch):
    # 0.62 is the same in all, and by chance a little more in cells thrown together
    near = [(i, f"r{i // 2 if i < 10 else i}_{j}") for i in range(80) for j in range(38)]
    cells = [(i, f"common{j}", 2) for i in range(80) for j in range(31)] + [(i, c, 1) for i, c in near]
    asked, made = [], []

    def local(rows, stated, answer, schema, *_):
        pdf = stated.toPandas()
        monkeypatch.setattr(scenes, "_shared", lambda *a, real=scenes._shared: asked.append(1) or real(*a))
        made.extend(zip(*(found[c] for c in "ab"), strict=True) for found in answer(pdf, iter([pdf])))
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(scenes, "compared", local)
    cells += [(i, "one", 1) for i in range(0, 10, 2)]  # so that two of a pair aren't copies
    scenes.overlaps(spark.createDataFrame(cells, "p int, c string, m int"), "p", "c", "m", 0.64)
    assert sorted(p for found in made for p in found) == [(i, i + 1) for i in range(0, 10, 2)]
    assert len(asked) < 20


def test_tiles_end_by_weight():
    rows = [1, 1, 1, 9, 1, 20, 1, 1, 1, 1, 1]
    got = blocks.weighed(iter([pd.DataFrame({"w": rows[:4]}), pd.DataFrame({"w": rows[4:4]}), pd.DataFrame({"w": rows[4:]})]), 4, "w", 10)
    assert [t["w"].tolist() for t in got] == [[1, 1, 1], [9, 1], [20], [1, 1, 1, 1], [1]]


def test_weighed_tiles_are_read_once_and_meet_only_what_they_ask_for(spark, monkeypatch):
    import pyarrow.dataset as ds

    monkeypatch.setattr(blocks, "EACH", 2)
    rows = spark.range(120).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 12).cast("int").alias("size"), F.format_string("k%03d", "id").alias("k"), F.lit(b"x").alias("load"))

    def answer(tile, found):
        for block in found:
            assert len(block) <= blocks.BLOCK
            yield tile[["g", "size", "k", "load"]].merge(block.rename(columns={"g": "h", "size": "other", "k": "l"})[["h", "other", "l"]], how="cross")

    got = blocks.compared(rows, rows, answer, "g long, size int, k string, load binary, h long, other int, l string", ["g", "size", "k"], 4, "size", lambda tile: ds.field("size") >= int(tile["size"].min())).collect()
    pairs = {(r["k"], r["l"]) for r in got}
    every = [(i, j) for i in range(120) for j in range(120) if i % 2 == j % 2 and i // 12 <= j // 12]
    assert len(got) == len(pairs) < 120 * 120 * 0.7 and all(bytes(r["load"]) == b"x" for r in got)
    assert {(f"k{i:03}", f"k{j:03}") for i, j in every} <= pairs
