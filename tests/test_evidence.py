import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import identity
from siftwell.operators import annotation, decisions, folds, journal, people, regions
from siftwell.plans import evidence


def test_covers_against_permutations(spark):
    rng = np.random.default_rng(1)
    cases = [[int(x) for x in rng.integers(0, 16, n)] for n in (1, 2, 3, 4, 4, 4, 4) for _ in range(10)] + [[]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, m array<int>")
    got = {r.i: r.c for r in df.select("i", regions.covers(F.col("m")).alias("c")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == (bool(c) and any(all(m >> b & 1 for m, b in zip(c, p)) for p in itertools.permutations(range(4), len(c))))


def test_covers_no_more_than_four(spark, tmp_path):
    df = spark.createDataFrame([([1, 2, 4, 8],), ([1, 2, 4, 8, 16],), ([31] * 7,)], "m array<int>")
    assert [r[0] for r in df.select(regions.covers(F.col("m"))).collect()] == [True, False, False]
    lines = spark.createDataFrame([(o, n, 1 << (n - 1) % 4) for o, count in ((1, 4), (2, 5), (3, 7)) for n in range(1, count + 1)], "l_orderkey long, l_linenumber int, l_partkey long")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert sorted(map(tuple, evidence.whole_cohort_cover(spark, str(tmp_path)).collect())) == [(1, True), (2, False), (3, False)]


GOOD = [10.0, 10.0, 40.0, 50.0, 20.0, 25.0, 40.0, 25.0, 30.0, 35.0, 22.0, 48.0, 38.0, 48.0, 0.95]


@pytest.mark.parametrize("at,value", [(None, None), (14, 0.5), (2, 8.0), (2, 200.0), (0, -30.0), (4, 300.0), (9, 90.0), (11, 3.0), (14, float("nan")), (14, None)])
def test_detection_gate(spark, at, value):
    row = [value if i == at else v for i, v in enumerate(GOOD)]
    df = spark.createDataFrame([(row,), (None,)], "r array<double>")
    assert [r[0] for r in df.select(regions.detection_ok(F.col("r"), F.lit(100.0), F.lit(100.0))).collect()] == [at is None, False]


def test_matching_against_brute_force(spark):
    rng = np.random.default_rng(2)
    pairs = [(g, a, b, float(rng.integers(0, 6))) for g in range(5) for a in range(4) for b in range(5)]
    got = {(r.g, r.a, r.b) for r in folds.matched(spark.createDataFrame(pairs, "g long, a long, b long, s double"), ["g"], "a", "b", "s").collect()}
    want, taken = set(), set()
    for g, a, b, _ in sorted(pairs, key=lambda p: (p[3], p[1], p[2]), reverse=True):
        if (g, "l", a) not in taken and (g, "r", b) not in taken:
            taken |= {(g, "l", a), (g, "r", b)}
            want.add((g, a, b))
    assert got == want


def test_guarded_merge_against_brute_force(spark):
    rng = np.random.default_rng(4)
    ids = range(14)
    good = {(a, b) for a, b in itertools.combinations(ids, 2) if rng.random() < 0.55}
    part = {i: i // 2 * 2 for i in ids}
    sets = {}
    for i in ids:
        sets.setdefault(part[i], {i})
        sets[part[i]].add(i)
    for a, b in sorted(good):
        x, y = (next(k for k, s in sets.items() if v in s) for v in (a, b))
        if x != y and all((min(i, j), max(i, j)) in good for i in sets[x] for j in sets[y]):
            sets[min(x, y)] |= sets.pop(max(x, y))
    pairs = spark.createDataFrame([(0, b, a) for a, b in good] + [(0, a, b) for a, b in good], "k long, a long, b long")
    got = folds.guarded_merge(pairs, spark.createDataFrame([(0, i, part[i]) for i in ids], "k long, id long, part long"), ["k"]).collect()
    assert {r.id: r.root for r in got} == {i: k for k, s in sets.items() for i in s}


def test_open_bursts_keep_anchors_and_numbers(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 0.0, x), (2, 1.0, y), (3, 2.0, x), (4, 13.0, y), (5, 14.1, x), (6, 14.2, [0.6, 0.8])]
    df = spark.createDataFrame([("u", *r) for r in rows], "k string, id long, t double, v array<double>")
    got = {r.id: r.burst for r in folds.open_bursts(df, ["k"], "t", ["id"], "v", 12.0, 90.0, 0.7).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 2, 6: 1}  # 5 comes 12.1 after 3
    seeded = df.withColumn("was", F.when(F.col("id") <= 3, F.when(F.col("id") == 2, 9).otherwise(4)))
    again = {r.id: r.burst for r in folds.open_bursts(seeded, ["k"], "t", ["id"], "v", 12.0, 90.0, 0.7, "was").collect()}
    assert again == {1: 4, 2: 9, 3: 4, 4: 9, 5: 10, 6: 9}


def test_ranking(spark):
    box = lambda x: (x, 0.0, 0.4, 0.4)
    c = [("p", 1, [1.0, 0.0], 0.9, box(0.0)), ("p", 2, [0.9, 0.1], 0.9, box(0.05)), ("p", 3, [0.8, 0.6], 0.9, box(0.5)), ("p", 4, [0.0, 1.0], 0.9, box(0.9)), ("q", 5, [1.0, 0.0], 0.9, box(0.0))]
    r = [("p", 1, [1.0, 0.0], True), ("p", 2, [0.6, 0.8], False)]
    refs = spark.createDataFrame(r, "person string, ref long, vector array<double>, positive boolean")
    df = spark.createDataFrame(c, "person string, candidate long, vector array<double>, confidence double, box struct<x: double, y: double, w: double, h: double>")
    found = people.scored(df, refs, "person")
    assert {x.candidate: round(x.score, 6) for x in found.collect() if x.candidate != 2} == {1: round(0.99 - 0.15 * 0.6, 6), 3: round(0.81 - 0.15 * 0.96, 6)}
    got = people.ranked(found, ["person"], ["candidate"]).orderBy("rank").collect()
    assert [(x.candidate, x["rank"], x.ambiguous) for x in got] == [(1, 1, False), (3, 2, False)]
    assert [x.reasons for x in got] == [[], ["negative_conflict"]]
    assert people.apart(df, df.where("candidate = 1"), "person", 0.2).count() == 3


def test_thresholds(spark):
    got = spark.createDataFrame([(i,) for i in range(8)], "n int").select(people.threshold(F.col("n"))).collect()
    assert [r[0] for r in got] == [None, 0.52, 0.53, 0.53, 0.56, 0.56, 0.56, None]


def test_adjudication_needs_exact_and_later_citation(spark):
    r = spark.createDataFrame([("i", "a", 1, "submitted", "K"), ("i", "b", 2, "submitted", "D"), ("i", "b", 3, "draft", "K"), ("j", "a", 4, "submitted", "K"), ("k", "a", 5, "submitted", "K"), ("k", "a", 6, "withdrawn", "K"), ("l", "a", 7, "submitted", "U"), ("l", "b", 8, "submitted", "X")], "item string, who string, rev long, status string, label string")
    a = spark.createDataFrame([("i", 9, [2, 1], "U"), ("l", 10, [7], "K"), ("l", 7, [7, 8], "K")], "item string, rev long, cites array<long>, label string")
    got = {x.item: (x.label, x.basis) for x in annotation.adjudicated(r, a, "item", "who", "rev", "status", "label").collect()}
    assert got == {"i": ("U", "adjudication"), "j": ("K", "agreement"), "l": (None, "unresolved")}


def test_face_focus_order(spark):
    m = {"eye_distance": 60.0, "eye_contrast": 0.2, "core_contrast": 0.2, "eye_lap": 0.005, "core_lap": 0.007, "eye_curvature": 0.2, "coarse_lap": 0.001, "native_curvature": 0.22, "eye_gradient": 0.3}
    cases = [({}, "clear"), ({"eye_lap": 0.0014, "core_lap": 0.0017, "eye_curvature": 0.15}, "severe_blur"), ({"eye_distance": None}, "uncertain"), ({"native_curvature": 0.21}, "uncertain"), ({"eye_lap": None}, "uncertain")]
    for change, want in cases:
        values = m | change
        df = spark.range(1).select(F.struct(*(F.lit(v).cast("double").alias(k) for k, v in values.items())).alias("m"))
        assert df.select(decisions.face_focus(F.col("m"), F.lit(True), F.lit(True), F.lit(None).cast("boolean"), F.lit(False))["state"]).first()[0] == want


def test_metadata_files(spark, tmp_path):
    import json

    from siftwell.sources import metadata

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps([{"SourceFile": "p1", "Make": " Acme ", "Orientation": "6", "DateTimeOriginal": "2020:01:02 03:04:05", "SubSecTimeOriginal": "12"}, {"SourceFile": "p2", "Orientation": 9, "DateTimeOriginal": "bad", "CreateDate": "2021-01-02 03:04:05"}, {"Make": "none"}]))
    got = {r.path: (r.make, r.orientation, str(r.captured)) for r in metadata.metadata(spark, str(tmp_path / "a")).collect()}
    assert got == {"p1": ("Acme", 6, "2020-01-02 03:04:05.120000"), "p2": (None, None, "2021-01-02 03:04:05")}
    for s in ("s1", "s2"):
        (tmp_path / "w" / s).mkdir(parents=True)
        (tmp_path / "w" / s / "session.json").write_text("{}")
    assert sorted(r.session for r in metadata.sessions(spark, str(tmp_path / "w")).collect()) == ["s1", "s2"]


def test_groups_of_two_hundred_thousand_rows(spark):
    """One key with all rows: nothing gathers them in one row or task."""
    n = 200_000
    ratings = spark.range(n).selectExpr("cast(0 as long) item", "id who", "id rev", "'submitted' status", "cast(id % 2 as long) label")
    whole = ratings.select("item", (F.lit(n) + 1).cast("long").alias("rev"), F.col("rev").alias("cites"), F.lit(5).cast("long").alias("label"))
    got = annotation.adjudicated(ratings, whole, "item", "who", "rev", "status", "label").first()
    assert (got["raters"], got["label"], got["basis"]) == (n, 5, "adjudication")
    short = annotation.adjudicated(ratings, whole.where("cites > 0"), "item", "who", "rev", "status", "label").first()
    assert (short["label"], short["basis"]) == (None, "unresolved")
    stored = identity.group_digests(ratings, "item", F.col("who"), F.col("label").cast("string"))
    stale = lambda rows: journal.stale_groups(rows, "item", "who", F.col("label").cast("string"), stored).first()["stale"]
    assert not stale(ratings) and stale(ratings.withColumn("label", F.expr("if(who = 77, 9, label)")))
    members = spark.range(n).selectExpr("cast(null as string) k", "id", "id div 50000 part")
    pairs = members.where("id < 50000").selectExpr("k", "id a", "id + 50000 b")
    roots = {r["part"]: r["root"] for r in folds.guarded_merge(pairs, members, ["k"]).groupBy("part").agg(F.max("root").alias("root")).collect()}
    assert roots == {0: 0, 1: 1, 2: 2, 3: 3}  # of 2.5 thousand million pairs only some are compatible


def test_written_tables_go_with_their_scope(spark):
    from siftwell.functions import storage

    with storage.scope(spark):
        kept = storage.written(spark.range(3).toDF("id"), "scoped")
        place = kept.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert kept.count() == 3 and os.path.isdir(place)
    assert not os.path.exists(place) and not storage._MADE


def test_reply_assembly_groups_rows_and_joins_none(spark):
    expected = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 1, 1), ("c", 1, 1), ("c", 1, 5), ("d", 1, 1), (None, 1, 1), ("e", None, 1), ("f", 1, None)], "scope string, subject int, ordinal int")
    rows = spark.createDataFrame([("a", 1, "x", "soft"), ("a", 2, "z", "soft"), ("a", 2, "y", None), ("b", 1, "x", "clear"), ("b", 2, "x", "clear"), ("c", 1, "x", "severe"), ("d", 1, "x", "clear"), (None, 1, "x", "clear"), ("e", None, "x", "clear"), ("f", 1, "x", "soft")], "scope string, subject int, part string, state string")
    got = decisions.replies(rows, "scope", expected, "subject", "part", F.col("state"), F.lit(True), F.lit(None).cast("boolean"))
    want = {("a", "review", "y"), ("b", "invalid", None), ("c", "reject", "x"), ("d", "keep", None), (None, "invalid", None), ("e", "invalid", None), ("f", "review", "x")}
    assert {tuple(r) for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # both sides' sorts and a third one held a task's memory at once
