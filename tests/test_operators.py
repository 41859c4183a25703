import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import geometry, identity, storage, vectors
from siftwell.operators import decisions, evaluation, folds, inventory, journal, measurement, ranking, similarity
from siftwell.operators.graph import components
from siftwell.sources import images, json


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    links = [tuple(map(int, x)) for x in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5050)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert pairs(got, "id", "root") == sorted((x, find(x)) for x in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hamming_pairs_at_the_limit(spark):
    rows = [(1, 0), (2, (1 << 10) - 1), (3, (1 << 11) - 1), (4, -1), (5, 0), (6, None), (7, -(1 << 63))]
    got = similarity.hamming_pairs(spark.createDataFrame(rows, "k long, h long"), "k", "h", 10)
    assert pairs(got, "a", "b", "distance") == [(1, 2, 10), (1, 5, 0), (1, 7, 1), (2, 3, 1)]


def test_cosine_pairs_skip_vectors_of_no_length(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.6, 0.8])], "k long, v array<double>")
    got = similarity.cosine_pairs(rows, "k", "v", rows.select(F.col("k").alias("query"), F.col("v").alias("vector")), 0.6 - 1e-9)
    assert [(q, k, round(s, 9)) for q, k, s in pairs(got, "query", "k", "score")] == [(1, 1, 1.0), (1, 3, 0.6), (3, 1, 0.6), (3, 3, 1.0)]


@pytest.mark.parametrize("gap,span", [(8.0, 60.0), (12.0, 90.0), (18.0, 120.0)])
def test_bursts_at_the_limits(spark, gap, span):
    times = [0.0, gap, 2 * gap + 1e-6, 3 * gap, span + 2 * gap + 1e-6, span + 3 * gap + 1]
    rows = spark.createDataFrame([(k, i, t) for k in ("a", "b") for i, t in enumerate(times)], "k string, i long, t double")
    got = [r.burst for r in folds.bursts(rows, ["k"], "t", ["i"], gap, span).where("k = 'a'").orderBy("t", "i").collect()]
    want, burst, anchor, last = [], -1, 0, 0
    for t in times:
        if burst < 0 or t - last > gap or t - anchor > span:
            burst, anchor = burst + 1, t
        last = t
        want.append(burst)
    assert got == want and len(set(got)) > 1


def test_pages(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([4, 16, 4, 40, 1])], "k long, i long, n long")
    assert [r.page for r in folds.pages(rows, ["k"], ["i"], "n").orderBy("i").collect()] == [0, 0, 1, 1, 3]


def test_leaders_never_chain(spark):
    v = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    rows = spark.createDataFrame([("x", i, v(d), p) for i, (d, p) in enumerate([(0, False), (20, False), (40, False), (41, True), (42, False)])], "k string, i long, v array<double>, p boolean")
    got = folds.leaders(rows, ["k"], ["i"], "v", "i", float(np.cos(np.radians(25))), "p")
    assert [r.leader for r in got.orderBy("i").collect()] == [0, 0, 2, 3, 2]


def test_suppression_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 3), int(i), float(s), float(a), float(a + 10)) for i, (s, a) in enumerate(zip(rng.integers(0, 20, 60), rng.integers(0, 60, 60), strict=True))]
    want = []
    for k in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1])):
            if all((s := min(r[4], x[4]) - max(r[3], x[3])) <= 0 or s / (20 - s) < 0.35 for x in kept):
                kept.append(r)
        want += [r[1] for r in kept]
    got = folds.suppressed(spark.createDataFrame(rows, "k long, i long, s double, a double, b double"), ["k"], "s", ["i"], "a", "b", 0.35)
    assert sorted(r.i for r in got.collect()) == sorted(want)


def test_policies_differ_on_mixed_groups(spark):
    rows = spark.createDataFrame([("mixed", "severe", True), ("mixed", "clear", True), ("all", "severe", True), ("unsure", "clear", None), ("clear", "clear", True)], "g string, s string, ok boolean")
    got = rows.groupBy("g").agg(decisions.unanimous(F.col("s"), F.col("ok"), "clear", "severe").alias("u"), decisions.any_severe(F.col("s"), F.col("ok"), ["clear"], "severe").alias("a"))
    assert pairs(got, "g", "u", "a") == [("all", "reject", "reject"), ("clear", "keep", "keep"), ("mixed", "review", "reject"), ("unsure", "review", "review")]


def test_precedence(spark):
    rows = spark.createDataFrame([("keep", True, True, "reject", None, "review"), ("keep", False, True, "keep", None, "review"), (None, True, None, "keep", "reject", "review"), (None, None, False, None, "reject", None), (None, None, None, None, None, None)], "m string, c boolean, q boolean, s string, f string, l string")
    got = rows.select(decisions.precedence(*(F.col(c) for c in "mcqsfl")).alias("d")).select("d.*").collect()
    assert [tuple(r) for r in got] == [("keep", "manual"), ("reject", "quality"), ("keep", "selection"), ("reject", "focus"), (None, "local")]


def test_weak_peers_leave_oneself_out(spark):
    rows = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 10.0), ("a", 3, 4.0), ("b", 4, 1.0), ("b", 5, 9.0), ("c", 6, None)], "g string, i long, v double")
    assert pairs(decisions.weaker_than_peers(rows, ["g"], "v"), "i", "peer_median", "weak") == [(1, 7.0, False), (2, 7.0, False), (3, 10.0, True)]


def test_margin(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.88), ("b", 3, 0.5), ("c", 4, 0.7), ("c", 5, 0.1)], "k string, i long, s double")
    assert pairs(decisions.margin(rows, "k", "s", ["i"], 0.05), "k", "i", "ambiguous") == [("a", 1, True), ("b", 3, False), ("c", 4, False)]


def test_upsert_and_manual(spark):
    old, new = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k long, x string, y int"), spark.createDataFrame([(2, None, 7), (3, "c", 1)], "k long, x string, y int")
    assert pairs(inventory.upsert(old, new, "k"), "k", "x", "y", "origin") == [(1, "a", 5, "old"), (2, "b", 7, "both"), (3, "c", 1, "new")]
    assert sorted(r.k for r in inventory.keep_manual(old, new, "k").collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="rules broken"):
        inventory.required(old, {"y": F.col("y") > 0})


def test_journal(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 5, "z"), ("b", 1, "q"), ("b", 1, "r")], "k string, n long, v string")
    assert pairs(journal.gaps(log, "k", "n"), "k", "after", "before", "missing") == [("a", 2, 5, 2)]
    assert pairs(journal.conflicts(log, ["k", "n"], "v"), "k", "n") == [("b", 1)]
    assert pairs(journal.merged(log.where("n < 5"), ["k"], "n", ["v"]).where("k = 'a'"), "k", "n", "v") == [("a", 2, "x")]
    assert journal.append(log, log, ["k", "n"]).count() == log.count()


def test_geometry(spark):
    box = lambda x, y, w, h: f"named_struct('x', {x}D, 'y', {y}D, 'w', {w}D, 'h', {h}D)"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(geometry.box_ok(F.expr(box(0, 0, 1, 1)))) and not one(geometry.box_ok(F.expr(box(0.5, 0, 0.6, 1))))
    assert round(one(geometry.iou(F.expr(box(0, 0, 0.5, 0.5)), F.expr(box(0.25, 0, 0.5, 0.5)))), 9) == round(1 / 3, 9)
    assert one(geometry.iou(F.expr(box(0, 0, 0.1, 0.1)), F.expr(box(0.5, 0.5, 0.1, 0.1)))) == 0
    turned = {k: tuple(one(geometry.oriented(F.lit(0.1), F.lit(0.2), F.lit(k)))) for k in range(1, 9)}
    assert [tuple(round(v, 9) for v in turned[k]) for k in (1, 3, 6, 8)] == [(0.1, 0.2), (0.9, 0.8), (0.8, 0.1), (0.2, 0.9)]
    head = lambda x, y, w, h: F.struct(*(F.lit(v).alias(n) for n, v in zip("xywh", (x, y, w, h))))
    crop = lambda box, ratio, scale, down=0.0, aside=0.0, size=(1000.0, 800.0): tuple(one(geometry.crop(F.lit(size[0]), F.lit(size[1]), box, *map(F.lit, (ratio, scale, down, aside)))))
    assert crop(head(0.4, 0.4, 0.2, 0.25), 1.0, 2.0) == (300, 220, 700, 620)
    assert crop(head(0.0, 0.0, 0.2, 0.25), 0.75, 2.0, 0.5, -0.5) == (0, 0, 300, 400)  # moved inside
    assert crop(head(0.4, 0.4, 0.2, 0.5), 1.0, 4.0) == (100, 0, 900, 800)  # shrunk to the frame
    assert crop(head(0.25, 0.25, 0.125, 0.125), 1.0, 0.75, size=(32.0, 32.0)) == (8, 8, 12, 12)  # 8.5 and 11.5, each to even
    assert len(one(geometry.tiles(F.lit(4), F.lit(4)))) == 16


def test_vectors_and_identity(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    a, b = F.array(*(F.lit(float(x)) for x in (1, 0, 0))), F.array(*(F.lit(0.0) for _ in range(3)))
    assert one(vectors.cosine(a, a)) == 1 and one(vectors.cosine(a, b)) is None and round(one(vectors.ssim(a, a)), 9) == 1
    assert one(vectors.sign_hash(F.array(*(F.lit(1.0 if i == 63 else -1.0) for i in range(64))))) == -(1 << 63)
    assert one(vectors.hamming(F.lit(0).cast("long"), F.lit(-1).cast("long"))) == 64
    assert one(identity.clamp(F.lit(float("nan")), 0.6, 2.0, 1.0)) == 1.0
    assert one(identity.version_key(F.lit("v1.10.2"))) > one(identity.version_key(F.lit("1.9.9")))
    assert str(one(identity.capture_time(F.lit("junk"), F.lit("2024:01:02 03:04:05"), subsecond=F.lit("12")))) == "2024-01-02 03:04:05.120000"
    assert one(identity.digest(F.lit(None), F.lit("a"))) != one(identity.digest(F.lit(""), F.lit("a")))


def test_measurement(spark):
    g = np.add.outer(np.arange(8.0) * 3, np.arange(9.0) * 2)
    rows = spark.createDataFrame([(1, g.ravel().tolist(), 9), (2, [1.0], 1), (3, None, None)], "i long, p array<double>, w int")
    got = {r.i: r for r in measurement.focus(rows, "i", "p", "w").collect()}
    assert got[1].laplacian == 0 and round(got[1].gradient, 6) == round(13**0.5, 6) and got[2].laplacian is None and got[3].gradient is None
    assert rows.where("i = 1").select(measurement.dhash(F.col("p"))).first()[0] == -1
    out = spark.createDataFrame([(4.4, 26.0), (4.4, 27.0), (3.4, 30.0), (None, 1.0)], "l double, g double").select(measurement.blurred(F.col("l"), F.col("g"))).collect()
    assert [r[0] for r in out] == [True, False, True, None]


def test_image_folder(spark, tmp_path):
    for f in ("a/IMG1.NEF", "a/img1.jpg", "a/img1.JPEG", "b/img1.cr3", "b/x.png", "b/notes.txt"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    got = images.assets(images.listing(spark, str(tmp_path)))
    assert got.count() == 4 and got.where("raw is not null and jpg is not null").count() == 1 and got.select("asset").distinct().count() == 4
    assert images.rating_targets(got).count() == 5
    assert images.decoded(spark, str(tmp_path), lambda b: [float(len(b))], lambda b: 1).count() == 6
    assert images.verified(spark, str(tmp_path)).where("ok").count() == 0


def test_replies(spark):
    batches = spark.createDataFrame([("b1", ["p1", "p2", "p3", "p4"]), ("b2", ["q1"]), ("b3", ["r1"])], "batch_id string, photo_ids array<string>")
    text = '```json\n[{"photo_id": "p1", "rating": 5}, {"photo_id": "p2", "rating": 6}, {"photo_id": "p3", "rating": 1}, {"photo_id": "p3", "rating": 2}, {"photo_id": "zz", "rating": 1}]\n```'
    got = json.replies(batches, spark.createDataFrame([("b1", text), ("b2", '[{"photo_id": "q1", "rating": 0}]'), ("b3", "```a``` ```b```")], "batch_id string, text string"))
    assert {(r.photo_id, r.rating, r.issue) for r in got.collect()} == {("p1", 5, None), ("p2", None, "rating"), ("p3", None, "repeated"), ("p4", None, "missing"), ("zz", None, "unexpected"), ("q1", 0, None), ("r1", None, "missing"), (None, None, "unreadable")}
    assert [r.photo_id for r in json.whole(got).collect()] == ["q1"]


def test_strict_json(spark):
    got = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "a": 2}',), ("{",)], "t string").select(json.strict(F.col("t")).isNull()).collect()
    assert [r[0] for r in got] == [False, True, True]


def test_contained_needs_every_word(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine y"), (2, "one two three four five six seven eight ten"), (3, None), (4, "short")], "d long, t string")
    items = spark.createDataFrame([(7, "one two three four five six seven eight nine"), (8, "short")], "i long, p string")
    assert pairs(evaluation.contained(docs, "d", "t", items, "i", "p"), "d", "i") == [(1, 7), (4, 8)]


def test_hamming_join_filters_candidates(spark):
    """Of thousands of values a value meets few, and no pair within the radius is missed, nor one of two variants added."""
    rng = np.random.default_rng(4)
    near = lambda v, n: int(v) ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    base = [int(x) for x in rng.integers(0, 1 << 63, 1500)]
    values = base + [near(base[i], i % 10) for i in range(300)] + base[:5]
    df = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(values)], "id long, v long")
    for radius in (0, 3, 8):
        got = {(r.a, r.b): r.distance for r in similarity.hamming_pairs(df, "id", "v", radius).collect()}
        first = {}
        for i, v in enumerate(values):
            first.setdefault(v, i)
        reps = sorted(first.items(), key=lambda x: x[1])
        want = {(i, j): (v ^ w).bit_count() for k, (v, i) in enumerate(reps) for w, j in reps[k + 1 :] if (v ^ w).bit_count() <= radius} | {(first[v], i): 0 for i, v in enumerate(values) if first[v] != i}
        assert got == want
    classes = df.groupBy(F.col("v").alias("_v")).agg(F.min("id").alias("_a"))
    met = similarity.hamming_candidates(classes, classes.select(F.col("_v").alias("_w"), F.col("_a").alias("_b")), 8).groupBy("_a").count().agg(F.max("count")).first()[0]
    assert met < 100
    some, rows = range(0, 1800, 12), []
    for i in some:
        rows.append((i, signed(values[i]), [signed(near(values[(i + 7) % 1800], 2)), signed(near(values[(i + 12) % 1800], 5)), None] if i % 5 else None))
    rows += [(5000, *rows[1][1:]), (5001, *rows[1][1:])]
    got = {(r.a, r.b): r.distance for r in similarity.variant_pairs(spark.createDataFrame(rows, "id long, v long, parts array<long>"), "id", "v", "parts", 8).collect()}
    kinds = {}
    for i, v, parts in rows:
        kinds.setdefault((v, str(parts)), []).append(i)
    heads = {own[0] for own in kinds.values()}
    want = {}
    for i, v, parts in rows:
        for j, w, others in rows:
            if not {i, j} <= heads:
                continue
            d = min([((v ^ x) & (2**64 - 1)).bit_count() for x in others or () if x is not None] or [99])
            if i != j and d <= 8:
                want[min(i, j), max(i, j)] = min(d, want.get((min(i, j), max(i, j)), 99))
    members = {(own[0], i): None for own in kinds.values() for i in own[1:]}  # none is near its own variants
    assert len(members) > 2 and len(want) > 100 and got == want | members


def test_best_of_each_row_leaves_the_task(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    asked = df.where("id < 30").select(F.col("id").alias("query"), F.col("v").alias("vector"))
    every = similarity.cosine_pairs(df, "id", "v", asked, -1.0).collect()
    best = similarity.cosine_pairs(df, "id", "v", asked, -1.0, best=2).collect()
    want = {i: sorted(((-round(r.score, 9), r.query) for r in every if r.id == i))[:2] for i in range(60)}
    assert {i: sorted((-round(r.score, 9), r.query) for r in best if r.id == i) for i in range(60)} == want


def test_block_ssim(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(100, 40, (16, 64)), rng.normal(100, 40, (16, 64))
    pairs = [(a, a), (a, b), (a, a + 5), (a, -a), (np.zeros_like(a), np.zeros_like(a))]
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in pairs], "x array<array<double>>, y array<array<double>>")
    got = df.select(vectors.block_ssim("x", "y", 255.0).alias("s"), vectors.block_ssim_bound("x", "y", 255.0).alias("m")).collect()
    c1, c2 = 2.55**2, 7.65**2
    for (x, y), r in zip(pairs, got):
        mx, my, vx, vy = x.mean(1), y.mean(1), x.var(1), y.var(1)
        cov = (x * y).mean(1) - mx * my
        want = ((2 * mx * my + c1) / (mx**2 + my**2 + c1) * (2 * cov + c2) / (vx + vy + c2)).mean()
        assert math.isclose(r.s, np.clip(want, -1, 1), rel_tol=1e-9, abs_tol=1e-9) and r.s <= r.m + 1e-9
    assert got[0].s == got[4].s == 1.0


def test_no_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("C", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        conf = type("Conf", (), {"get": lambda self, *a: None})()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())


def test_ranking(spark):
    """Numbers, running counts and percentiles against one sorted list a group, over more ranges than groups."""
    rng = np.random.default_rng(12)
    rows = [(["a", "b", None][int(min(g, 2))], float(v)) for g, v in zip(rng.integers(0, 9, 3000), rng.integers(0, 400, 3000))] + [("a", None), ("c", None), ("d", 5.0), ("d", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    values = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            values.setdefault(g, []).append(v)
    got = {r.g: r._p for r in ranking.percentiles(df, ["g"], "v", [0.0, 0.05, 0.5, 0.9, 1.0]).collect()}
    assert got.keys() == values.keys() and all(np.allclose(got[g], np.percentile(values[g], [0, 5, 50, 90, 100])) for g in values)
    for r in ranking.running(df, ["g"], "v").collect():
        own = values[r.g]
        assert (r._k, r._upto, r._n) == (own.count(r.v), sum(x <= r.v for x in own), len(own))
    numbers = ranking.row_numbers(df.where("v is not null").select("v").distinct(), ["v"], "n").collect()
    assert [r.n for r in sorted(numbers, key=lambda r: (math.isnan(r.v), r.v))] == list(range(1, len(numbers) + 1))
    assert ranking.row_numbers(df.limit(0), ["v"], "n").count() == 0 and ranking.percentiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
