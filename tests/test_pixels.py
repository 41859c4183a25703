"""Operators on pixels against numpy and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import pixels, portrait

BOX = "struct<x:double,y:double,w:double,h:double>"


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 256, w * h).tolist(), w) for i, (w, h) in enumerate([(9, 7), (12, 12), (9, 7), (1, 5), (40, 3)])]
    return rows, spark.createDataFrame([*rows, (10, None, 4), (11, [], 4), (12, [1, 2, 3], 2), (13, [1, None], 1), (14, [1], None), (15, [1, 2], 0)], "id int, pixels array<bigint>, width int")


def test_any_box_is_four_reads(images):
    rows, df = images
    got = {r["id"]: r["t"] for r in df.select("id", pixels.summed(F.col("pixels"), F.col("width")).alias("t")).collect()}
    assert all(got[i] is None for i in range(10, 16))
    rng = random.Random(2)
    boxes = [(i, *sorted(rng.choices(range(w + 1), k=2)), *sorted(rng.choices(range(len(p) // w + 1), k=2))) for i, p, w in rows for _ in range(40)]
    asked = df.sparkSession.createDataFrame(boxes, "id int, x0 int, x1 int, y0 int, y1 int").join(df, "id").withColumn("t", pixels.summed(F.col("pixels"), F.col("width")))
    box = F.struct("x0", "y0", "x1", "y1")
    for r in asked.select("*", *(pixels.box_sum(F.col("t")[n], F.col("width"), box).alias(f"s_{n}") for n in ("value", "square", "laplacian"))).collect():
        g = np.array(r["pixels"]).reshape(-1, r["width"])
        lap = np.zeros_like(g)
        lap[1:-1, 1:-1] = (4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]) ** 2
        part = np.s_[r["y0"] : r["y1"], r["x0"] : r["x1"]]
        assert (r["s_value"], r["s_square"], r["s_laplacian"]) == (g[part].sum(), (g[part] ** 2).sum(), lap[part].sum())


def test_regions_without_image_or_pixels(spark, images):
    boxes = [(0, 1, (0.0, 0.0, 1.0, 1.0)), (0, 2, (1.0, 0.0, 0.5, 0.5)), (0, 3, None), (12, 4, (0.0, 0.0, 1.0, 1.0)), (99, 5, (0.0, 0.0, 1.0, 1.0)), (3, 6, (0.0, 0.0, 1.0, 1.0))]
    got = {r["region"]: r for r in pixels.measured(images[1], spark.createDataFrame(boxes, f"id int, region int, box {BOX}"), "id").collect()}
    assert len(got) == 6 and all(got[i]["state"]["state"] == "insufficient" for i in range(2, 7)) and got[1]["state"]["state"] == "clear"
    assert got[1]["figures"]["pixels"] == 63 and got[6]["figures"]["detail"] is None
    flat = spark.createDataFrame([(0, [7] * 64, 8)], "id int, pixels array<bigint>, width int")
    smooth = spark.createDataFrame([(0, [20 * x for _ in range(12) for x in range(12)], 12)], "id int, pixels array<bigint>, width int")
    whole = spark.createDataFrame([(0, 1, (0.0, 0.0, 1.0, 1.0))], f"id int, region int, box {BOX}")
    assert [pixels.measured(i, whole, "id").first()["state"]["state"] for i in (flat, smooth)] == ["insufficient", "severe_blur"]


def test_every_offset_of_a_template():
    rng = np.random.default_rng(3)
    for (h, w), (a, b) in (((20, 17), (5, 4)), ((8, 8), (8, 8)), ((9, 30), (2, 11))):
        image, template = rng.integers(0, 256, (h, w)).astype(float), rng.integers(0, 256, (a, b)).astype(float)
        image[: a + 1, : b + 1] = 9  # no contrast there
        got = pixels.correlated(image, template)
        assert got.shape == (h - a + 1, w - b + 1)
        for y in range(got.shape[0]):
            for x in range(got.shape[1]):
                part = image[y : y + a, x : x + b]
                if part.std() == 0:
                    assert np.isnan(got[y, x])
                else:
                    assert got[y, x] == pytest.approx(np.corrcoef(part.ravel(), template.ravel())[0, 1], abs=1e-8)
    assert np.isnan(pixels.correlated(rng.random((5, 5)), np.ones((2, 2)))).all()


def test_resizing_keeps_the_mean():
    image = np.random.default_rng(4).random((12, 10))
    for size in ((5, 7), (24, 20), (12, 10), (1, 1)):
        assert pixels._resized(image, *size).mean() == pytest.approx(image.mean())
    assert np.allclose(pixels._resized(image, 6, 5), image.reshape(6, 2, 5, 2).mean((1, 3)))


def test_a_template_is_found_where_it_was_put(spark):
    rng = np.random.default_rng(5)
    template = np.kron(rng.integers(0, 256, (6, 6)), np.ones((2, 2))).astype(int)  # 12 x 12
    image = rng.integers(100, 130, (60, 60))
    image[30:42, 8:20], image[5:29, 30:54] = template, np.kron(template, np.ones((2, 2)))
    rows = [("a", image.ravel().tolist(), 60, template.ravel().tolist(), 12, (0.2, 0.2)), ("b", [3] * 3600, 60, template.ravel().tolist(), 12, (0.2, 0.2)), ("c", None, 60, [1], 1, (0.2, 0.2)), ("d", [1, 2], 2, [1, 2], 2, None)]
    df = spark.createDataFrame(rows, "id string, pixels array<bigint>, width int, template array<bigint>, template_width int, box struct<w:double,h:double>")
    peaks = pixels.template_peaks(df, scales=(0.55, 1.0, 2.0)).collect()
    assert {r["id"] for r in peaks} == {"a"} and max(r["nth"] for r in peaks) <= 1
    kept = pixels.anchors(pixels.template_peaks(df, scales=(0.55, 1.0, 2.0)), ["id"]).collect()
    assert {(round(r["x"] * 60), round(r["y"] * 60), round(r["w"] * 60)) for r in kept} == {(8, 30, 12), (30, 5, 24)}


def test_anchors_are_those_of_plain_greedy_suppression(spark):
    rng = random.Random(6)
    rows = [(k, rng.random(), *(rng.random() * 0.5 for _ in range(4)), 1.0, n) for k in range(30) for n in range(10)]

    def iou(a, b):
        side = lambda i: max(0.0, min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i]))
        both = side(0) * side(1)
        return both / max(a[2] * a[3] + b[2] * b[3] - both, 1e-9)

    want = set()
    for k in range(30):
        kept = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]):
            if len(kept) < 2 and all(iou(r[2:6], q[2:6]) < 0.35 for q in kept):
                kept.append(r)
        want |= {(k, r[1]) for r in kept}
    df = spark.createDataFrame(rows, "k int, score double, x double, y double, w double, h double, scale double, nth int")
    assert {(r["k"], r["score"]) for r in pixels.anchors(df, ["k"]).collect()} == want


def test_references_tell_what_they_lack(spark):
    rng = np.random.default_rng(7)
    colour, gray = rng.integers(0, 256, 40 * 40 * 3).tolist(), np.repeat(rng.integers(0, 256, 1600), 3).tolist()
    rows = [(0, colour, 40), (1, gray, 40), (2, [80] * 4800, 40), (3, None, 40)]
    faces = [(i, 1, (0.3, 0.2, 0.3, 0.3)) for i in range(5)] + [(0, 2, (0.3, 0.2, 0.3, 0.3)), (0, 3, (0.0, 0.0, 0.01, 0.01)), (0, 4, None)]
    built = pixels.references(spark.createDataFrame(rows, "photo int, rgb array<bigint>, width int"), spark.createDataFrame(faces, f"photo int, n int, box {BOX}"), "photo")
    got = {(r["photo"], r["n"]): r for r in built.collect()}
    assert {k: r["flags"] for k, r in got.items()} == {(0, 1): [], (0, 2): [], (1, 1): ["achromatic"], (2, 1): ["achromatic", "low_texture"], (3, 1): ["low_texture"], (4, 1): ["low_texture"], (0, 3): ["low_texture"], (0, 4): ["low_texture"]}
    assert got[0, 3]["face"] is None and sum(got[0, 1]["face"]["colour"]) == pytest.approx(1) and len(got[0, 1]["face"]["texture"]) == 16
    both = built.where("n = 1").crossJoin(built.where("photo = 0 and n = 2").select(*(F.col(k).alias(f"o_{k}") for k in pixels.AROUND)))
    score = {r["photo"]: r["s"] for r in both.select("photo", pixels.appearance({k: F.col(k) for k in pixels.AROUND}, {k: F.col(f"o_{k}") for k in pixels.AROUND}).alias("s")).collect()}
    assert score[0] == pytest.approx(1) and score[3] == 0 and 0 < score[2] < score[0]


def test_hues_and_octants():
    pure = {(255, 0, 0): 0, (255, 255, 0): 2, (0, 255, 0): 4, (0, 255, 255): 6, (0, 0, 255): 8, (255, 0, 255): 10, (255, 0, 10): 11}
    for rgb, hue in pure.items():
        colour = pixels._descriptors(np.tile(np.array(rgb), (1, 8, 8, 1)), 8)[0][0]
        assert colour[hue * pixels.SATURATIONS + pixels.SATURATIONS - 1] == 1
    y, x = np.mgrid[:10, :10]
    for k in range(8):
        t = (k + 0.5) * math.pi / 4
        ramp = np.repeat(np.round(128 + 20 * (np.cos(t) * (x - 5) + np.sin(t) * (y - 5)))[None, :, :, None], 3, 3).clip(0, 255).astype(int)
        assert pixels._descriptors(ramp, 8)[1][0][:8].argmax() == k


def test_one_touched_region_is_recomputed(spark):
    rng = np.random.default_rng(8)
    images = spark.createDataFrame([(i, rng.integers(0, 256, 100).tolist(), 10) for i in range(4)] + [(9, None, 10)], "photo int, pixels array<bigint>, width int")
    regions = [(p, r, (0.1 * r, 0.1, 0.5, 0.6)) for p in range(4) for r in range(4)] + [(9, 0, (0.0, 0.0, 1.0, 1.0)), (8, 0, (0.0, 0.0, 1.0, 1.0))]
    of = lambda rows: spark.createDataFrame(rows, f"photo int, region int, box {BOX}")
    first = pixels.region_features(images, of(regions), None, "photo", "region")
    assert first.where("recomputed").count() == 18 and first.where("hash is null").count() == 2
    again = pixels.region_features(images, of(regions), first, "photo", "region")
    assert again.where("recomputed").count() == 0 and sorted(again.drop("recomputed").collect()) == sorted(first.drop("recomputed").collect())
    regions[5] = (1, 1, (0.0, 0.0, 0.9, 0.9))
    touched = pixels.region_features(images, of(regions[:-2]), again, "photo", "region")
    assert [(r["photo"], r["region"]) for r in touched.where("recomputed").collect()] == [(1, 1)] and touched.count() == 16
    roots = lambda df: {r["photo"]: r["root"] for r in df.collect()}
    assert {p for p in range(4) if roots(touched)[p] != roots(first)[p]} == {1}


def test_similarity_from_votes(spark):
    rng = np.random.default_rng(9)
    rows, truth = [], {}
    for k in range(6):
        turn, scale, p, q = math.radians(rng.uniform(-2, 2)), rng.uniform(0.97, 1.03), *rng.uniform(-15, 15, 2)
        a, b = scale * math.cos(turn), scale * math.sin(turn)
        truth[k] = (a, b, p, q)
        for i in range(60):
            x, y = rng.uniform(0, 640), rng.uniform(0, 480)
            u, v = (a * x - b * y + p, b * x + a * y + q) if i % 3 else rng.uniform(0, 480, 2)
            rows.append((k, -k, float(x), float(y), float(u), float(v)))
    rows += [(7, -7, 5.0, 5.0, 9.0, 9.0)] * 4  # one place only
    got = {r["left"]: r for r in portrait.aligned(spark.createDataFrame(rows, "left int, right int, sx double, sy double, tx double, ty double"), cell=40.0).collect()}
    for k, want in truth.items():
        r = got[k]
        assert (r["a"], r["b"], r["p"], r["q"]) == pytest.approx(want, abs=1e-6) and 40 <= r["inliers"] <= 43 and r["matches"] == 60
    assert got[7]["a"] is None and got[7]["inliers"] == 0 and got[7]["source"]["area"] == 0
    size = (F.lit(640.0), F.lit(480.0))
    fit = spark.createDataFrame([(0.0, 1.0, 560.0, -80.0)], "a double, b double, p double, q double")
    moved = fit.select(portrait.movement({c: F.col(c) for c in "abpq"}, size, size).alias("m")).first()["m"]
    assert (moved["scale"], moved["translation"]) == pytest.approx((1.0, 0.0)) and moved["rotation"] == pytest.approx(90)


def test_one_exchange_serves_the_fits(spark):
    found = spark.createDataFrame([(1, 2, 0.0, 0.0, 1.0, 1.0)], "left int, right int, sx double, sy double, tx double, ty double")
    plan = portrait.aligned(found)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= 3  # of the same rows: for the votes, for the fits


def test_descriptor_matches(spark):
    rng = random.Random(10)
    word = lambda: [rng.getrandbits(63) for _ in range(4)]
    left, right = {i: word() for i in range(300)}, {}
    for i in range(300):
        near = list(left[i if i % 10 else 5])  # every tenth is like the sixth
        near[0] ^= (1 << (i % 7)) - 1
        right[i] = near if i % 4 else word()
    points = spark.createDataFrame([(p, i, float(i), float(-i), w) for p, side in (("l", left), ("r", right)) for i, w in side.items()] + [("one", 0, 0.0, 0.0, word())], "photo string, point int, x double, y double, bits array<bigint>")
    got = {(int(r["sx"]), int(r["tx"]), r["distance"]) for r in portrait.matches(spark.createDataFrame([("l", "r"), ("l", "one"), ("one", "l"), ("l", "none")], "left string, right string"), points).collect()}
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    best = {}
    for i, w in left.items():
        d = sorted((bits(w, v), j) for j, v in right.items())
        if d[0][0] < 0.78 * d[1][0]:
            best[d[0][1]] = min(best.get(d[0][1], (999, 0)), (d[0][0], i))
    assert got == {(i, j, n) for j, (n, i) in best.items()} and len(got) > 100


def test_hull_areas():
    assert portrait._hull([(0, 0), (4, 0), (4, 3), (0, 3), (2, 1), (2, 0), (4, 3)]) == 12
    assert portrait._hull([]) == portrait._hull([(1, 1)]) == portrait._hull([(0, 0), (1, 1), (2, 2)]) == 0


def test_background_and_shift(spark):
    rng = np.random.default_rng(11)
    big = rng.integers(0, 256, (40, 40))
    a, b = big[4:36, 4:36], big[6:38, 3:35]  # the second frame looks one to the left and two further down
    rows = [(a.ravel().tolist(), b.ravel().tolist(), [1] * 1024, 32), (a.ravel().tolist(), None, [1] * 1024, 32), ([5] * 1024, [5] * 1024, [0] * 1024, 32)]
    df = spark.createDataFrame(rows, "l array<bigint>, r array<bigint>, m array<bigint>, w int")
    unit = F.struct(F.lit(1.0).alias("xx"), F.lit(0.0).alias("xy"), F.lit(1 / 32).alias("x0"), F.lit(0.0).alias("yx"), F.lit(1.0).alias("yy"), F.lit(-2 / 32).alias("y0"))
    laid = [r["b"] for r in df.select(portrait.background(F.col("l"), F.col("m"), F.col("r"), F.col("m"), F.col("w"), unit).alias("b")).collect()]
    assert laid[0]["difference"] == 0 and laid[0]["coverage"] == pytest.approx(31 * 30 / 1024) and laid[1] is None and (laid[2]["coverage"], laid[2]["difference"]) == (0, None)
    found = [r["s"] for r in df.select(portrait.shifted(F.col("l"), F.col("r"), F.col("w")).alias("s")).collect()]
    assert (found[0]["dx"], found[0]["dy"]) == (1, -2) and found[0]["response"] == pytest.approx(1) and found[0]["agreement"] == pytest.approx(1) and found[1] is None and found[2] is None


def test_gates_in_order_and_the_drifted_body(spark):
    true, false, unknown = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    result = lambda *gates: spark.range(1).select(portrait.compatible(*gates).alias("c")).first()["c"]
    assert tuple(result([("a", true), ("b", unknown), ("c", false)], [("d", false)])) == (False, "b")
    assert tuple(result([("a", true)], [("d", true), ("e", false)])) == (False, "e")
    assert tuple(result([("a", true)], [("d", false)], [("x", true), ("y", true)])) == (True, None)
    assert tuple(result([("a", true)], [("d", false)], [("x", true), ("y", unknown)])) == (False, "d")
    box = lambda x: F.struct(F.lit(x).alias("x"), F.lit(0.2).alias("y"), F.lit(0.4).alias("w"), F.lit(0.5).alias("h"))
    side = lambda h, body, x: {"whole_hash": F.lit(h).cast("long"), "body_hash": F.lit(body).cast("long"), "body": box(x), "aspect": F.lit(1.5)}
    shift = F.struct(F.lit(0.9).alias("response"), F.lit(0.87).alias("agreement"))
    failed = lambda a, b, preset: spark.range(1).select(portrait.first_failed(portrait.same_drifted(a, b, shift, preset)).alias("f")).first()["f"]
    assert failed(side(0, 0, 0.2), side(0, 4095, 0.25), "standard") is None
    assert failed(side(0, 0, 0.2), side(0, 4095, 0.25), "strict") == "frames_differ"
    assert failed(side(0, 0, 0.2), side(0, 1, 0.25), "standard") == "same_body_hash" and failed(side(0, 0, 0.2), side(0, 4095, 0.2), "standard") == "same_body_box"
    assert failed(side(0, 0, 0.2), side(0, 4095, 0.35), "standard") == "body_overlap" and failed(side(0, 0, 0.2), side(4095, 4095, 0.25), "standard") == "whole_hash"


def test_context_of_one_automatic_subject(spark):
    record = "array<struct<box:int,hash:bigint,origin:string>>"
    kind = f"mode string, decoded boolean, checked boolean, schema_ok boolean, must_select boolean, faces {record}, bodies {record}, face int, body int, primary_face int, primary_body int, face_hash bigint"
    good = {"mode": "portrait", "decoded": True, "checked": True, "schema_ok": True, "must_select": False, "faces": [(1, 7, "automatic")], "bodies": [(2, 8, "automatic")], "face": 1, "body": 2, "primary_face": 0, "primary_body": 0, "face_hash": 7}
    odd = [{}, {"mode": "landscape"}, {"decoded": None}, {"schema_ok": False}, {"must_select": True}, {"faces": []}, {"faces": None}, {"primary_body": None}, {"faces": [(1, 7, "manual")]}, {"body": 3}, {"face_hash": 9}]
    rows = spark.createDataFrame([tuple((good | o).values()) for o in odd], kind)
    got = [r["p"] for r in rows.select(portrait.context_problem({c: F.col(c) for c in good}).alias("p")).collect()]
    assert got == [None, "not_a_portrait", "not_decoded", "old_schema", "primary_not_selected", "not_one_subject", "not_one_subject", "not_primary", "not_automatic", "moved_box", "changed_pixels"]


def test_lists_of_a_batch_are_slices(spark):
    import pyarrow as pa

    rows = pa.array([[9], [1, 2], None, [], [3, None]], pa.list_(pa.int64())).slice(1)
    got = portrait._lists(rows)
    assert got[0].tolist() == [1, 2] and got[1] is None and got[2].tolist() == [] and got[3][0] == 3 and np.isnan(got[3][1])
    values, at = portrait._cut(rows)
    assert values.to_pylist() == [1, 2, 3, None] and at.tolist() == [0, 2, 2, 2, 4]
    # a photo's descriptors have a width of their own, and a place that isn't known stays null
    points = spark.createDataFrame([(p, i, None if i == 1 else float(i), 0.0, [(1 << 4 * i) - 1] * w) for p, w in (("a", 1), ("b", 1), ("c", 2), ("d", 2)) for i in range(3)], "photo string, point int, x double, y double, bits array<bigint>")
    found = portrait.matches(spark.createDataFrame([("a", "b"), ("c", "d"), ("a", "none")], "left string, right string"), points).collect()
    assert sorted((r["left"], r["sx"] is None, r["tx"] is None, r["distance"]) for r in found) == sorted((p, i == 1, i == 1, 0) for p in "ac" for i in range(3))
