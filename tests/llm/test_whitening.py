"""Whitening against plain numpy and whole numbers: exact sums, components, merging in trees, odd vectors."""

import math
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import whitening as wh

KIND = "vec_id long, embedding array<float>"


def plain(rows, k=8):
    """{(vec_id, component): (n, deviation, whitened, explained)} from the covariance itself."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = Counter(len(v) for _, v in rows)
    d = max(lengths, key=lambda size: (lengths[size], size))
    rows = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows if len(v) == d]
    n, s = len(rows), [sum(col) for col in zip(*(x for _, x in rows), strict=True)]
    c = np.array([[(n * a - b) / n for a, b in zip(x, s, strict=True)] for _, x in rows])
    e, u = np.linalg.eigh(c.T @ c / n)
    out = {}
    for j in range(min(k, d)):
        axis = u[:, -1 - j] * np.sign(u[np.abs(u[:, -1 - j]).argmax(), -1 - j])
        for (i, x), w in zip(rows, c @ axis / math.sqrt(e[-1 - j]), strict=True):
            out[i, j + 1] = (n, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), w, e[-1 - j] / e.sum())
    return out


def same(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, w, share = want[r["vec_id"], r["component"]]
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert r["whitened"] == pytest.approx(w, abs=1e-7) and r["explained"] == pytest.approx(share, rel=1e-9)
        assert r["identity_error"] < 1e-9


@pytest.mark.parametrize(("parts", "fan_in"), [(1, 2), (7, 2), (40, 3), (40, 16)])
def test_equals_plain_numpy(spark, parts, fan_in):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=12) * np.arange(1, 13) + 5).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # copies
    same(wh.whiten(spark.createDataFrame(rows, KIND).repartition(parts), fan_in=fan_in).collect(), plain(rows))


def test_the_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = wh.op13_tsqr_whitening(spark, sf)
    assert got.schema["deviation"].dataType.simpleString() == "bigint"
    same(got.collect(), plain(rows))


def test_a_mean_far_from_zero_costs_no_digits(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (3000 + rng.normal(size=4) / 100).astype(np.float32).tolist()) for i in range(300)]
    same(wh.whiten(spark.createDataFrame(rows, KIND).repartition(5)).collect(), plain(rows))


def test_odd_vectors_and_columns(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(50)]
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [1.0, float("inf"), 0.0, 0.0, 0.0]), (105, [1.0]), (106, [2.0] * 6), (107, [3.0] * 6)]
    rows = [*good, *odd, (None, good[0][1])]
    docs = spark.createDataFrame([(i, v, "kept", -1, "s") for i, v in rows], KIND + ", row string, n int, vector string")
    got = wh.whiten(docs).collect()
    same(got, plain(rows))
    assert {(r["row"], r["vector"], r["n"]) for r in got} == {("kept", "s", 51)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]])
def test_nothing_to_whiten(spark, rows):
    got = wh.whiten(spark.createDataFrame(rows, KIND))
    assert got.collect() == [] and got.columns[-6:] == ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_components_than_dimensions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(a)), 2.0, float(np.float32(a))]) for i, a in enumerate(rng.normal(size=40))]
    got = wh.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)


def test_whole_numbers_beyond_a_long(spark):
    big = [(i, [float(np.float32(s * 2.0**49)), float(np.float32(i))]) for i, s in enumerate((1, -1, 1, 1, -1, 3))]
    same(wh.whiten(spark.createDataFrame(big, KIND), components=1).collect(), plain(big, 1))
    huge = [(0, [3e38, 0.0]), (1, [-3e38, 1.0]), (2, [3e38, 2.0])]  # held at 2^62
    got = wh.whiten(spark.createDataFrame(huge, KIND), components=1).collect()
    assert len(got) == 3 and any(r["deviation"] is None for r in got) and all(math.isfinite(r["whitened"]) for r in got)


def test_no_covariance_and_bounded_states(spark, sf):
    x = np.random.default_rng(7).normal(size=(500, 6))
    r = wh._r(np.vstack([wh._r(x[:200]), wh._r(x[200:203]), wh._r(x[203:])]))
    assert r.shape == (6, 6) and np.allclose(r.T @ r, x.T @ x)
