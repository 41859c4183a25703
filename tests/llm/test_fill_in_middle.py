"""Fill-in-middle against a plain Python version, by lines and by characters, in blocks of all sizes."""

import hashlib
import random
import re

import pytest

from siftwell.llm import fill_in_middle as fim

from . import cases


def plain(key, text, unit="line", seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+" if unit == "line" else r"[\s\S]", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h, n = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)], len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    signs = ["\n", "\n\n", "a", "é", "你", "😀", " ", "<", "P", ">", "<S", "S>", "\r\n", "\x00", " ", "word"]
    out = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(400)]
    return [*out, "<P>", "a\n<M>b", "<S>\n", "x<", "P>y\n", "<", "S>", "\n", "", None, "no line feed", "z\n" * 5000, "é" * 70_000, "\n".join(rng.choices(signs, k=3000)), *out[:20]]


@pytest.mark.parametrize(("unit", "rate", "spm", "block"), [("line", 100, 50, 1), ("line", 100, 50, 4 << 20), ("char", 70, 20, 300), ("char", 0, 50, 4 << 20), ("line", 100, 100, 5000)])
def test_equals_plain_python(spark, texts, unit, rate, spm, block):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = fim.fill_in_middle(docs, unit=unit, rate=rate, spm=spm, block_bytes=block)
    rows = got.select("*", fim.restored(got["text"], got["form"]).alias("again")).collect()
    assert {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["text"]) for r in rows} == {i: plain(i, t, unit, 7, rate, spm) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["again"] for r in rows} == {i: t or "" for i, t in enumerate(texts)}
    assert rate != 100 or len({r["form"] for r in rows}) >= 2


def test_a_mark_across_two_texts_is_none(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a<", "P>b", "", "<", "S>", "c<M", ">"])], "doc_id long, text string").coalesce(1)
    assert all(r["form"] != "plain" or not r["text"] for r in fim.fill_in_middle(docs).collect())


def test_odd_rows(spark):
    rows = [(*r, "old", "m") for r in cases.rows()]
    docs = spark.createDataFrame(rows, cases.SCHEMA + ", form string, made string")
    got = fim.fill_in_middle(docs)
    assert sorted(got.columns) == sorted({*docs.columns, "n", "prefix_chars", "middle_chars"})
    key = lambda r: repr(r)
    want = sorted(((r[0], r[2], *plain(r[0], r[1])) for r in rows), key=key)
    assert sorted(((r["doc_id"], r["lang"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["text"]) for r in got.collect()), key=key) == want
    assert all(r["made"] == "m" for r in got.collect())
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_one_kernel_and_no_exchange(spark, sf):
    plan = fim.op11_fill_in_middle(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
