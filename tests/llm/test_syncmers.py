import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftwell.llm import syncmers

from .cases import SCHEMA, rows

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def of_text(t):
    return signed(xxhash.xxh64_intdigest(t.encode(), 42))


def brute_tokens(t, long=syncmers.LONG):
    return [x for w in re.split(r"[ \t-\r]+", t) if w for x in (list(w) if len(w) > long else [w])]


def brute_anchors(t, k=syncmers.K, s=syncmers.S):
    h, out = [of_text(w) for w in brute_tokens(t)], []

    def joined(values):
        x = 42
        for v in values:
            x = xxhash.xxh64_intdigest((v & MASK).to_bytes(8, "little"), x)
        return signed(x)

    m = h if s == 1 else [joined(h[i : i + s]) for i in range(len(h) - s + 1)]
    for i in range(len(h) - k + 1):
        inner = m[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, joined(h[i : i + k]) % (1 << 32)))
    return out or ([(0, of_text(t) % (1 << 32))] if t else [])


def brute_likeness(a, b, band=syncmers.BAND):
    first = [{}, {}]
    for places, found in zip(first, (a, b)):
        for at, name in found:
            places.setdefault(name, at)
    x, y = first
    moved = {n: y[n] - x[n] for n in x.keys() & y.keys()}
    if not x and not y:
        return 1.0
    matched = len(moved) if min(len(x), len(y)) == 1 else sum(any(m != n and abs(moved[m] - d) <= band for m in moved) for n, d in moved.items())
    return matched / (len(x) + len(y) - matched)


def brute_printed(found):
    return "".join(f"{at - before:x}{name:08x}" for (at, name), before in zip(found, [0, *(at for at, _ in found)]))


def check(spark, texts, **how):
    rows = sorted(texts, key=lambda r: -r[0])
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(texts, "doc_id long, text string"), **how).collect()}
    assert len(got) == len(rows)
    for j, (i, text) in enumerate(rows):
        text, following, r = text or "", rows[(j + 1) % len(rows)][1] or "", got[i]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        own, mixed = brute_anchors(text), brute_anchors(edited)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (brute_printed(own), brute_printed(mixed)), i
        assert r.near_edited == pytest.approx(brute_likeness(own, mixed)) and r.near_next == pytest.approx(brute_likeness(own, brute_anchors(following)))
    return got


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_against_brute_force(spark, sf, rows):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = check(spark, texts, rows=rows)
    assert np.mean([r.near_edited for r in got.values()]) > 0.4 > 0.05 > np.mean([r.near_next for r in got.values()])


def prose(n, seed=1):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice([f"{a}{b}" for a in ("ran", "tor", "he", "mil", "os") for b in ("der", "gel", "na", "th", "uz", "")], n))


def test_odd_texts_and_lengths_against_brute_force(spark):
    han = "".join(chr(0x4E00 + i * i * 7 % 5000) for i in range(400))
    texts = [prose(80)[:255], prose(80)[:256], prose(80)[:257], prose(90, 2)[:349], "nine char", None, "", "a", "ab", "abc", "x" * 15, "x" * 16, "x" * 500, "  \n\t  " * 9, han, han[:200] + "x" + han[201:], "é́ 😀 你好 " * 20, "😀" * 30, prose(3000, 3), prose(3000, 3), "line one\r\nline two\n" * 50]
    got = check(spark, list(enumerate(texts)), rows=4)
    assert got[5].near_edited == 1.0 and got[5].fingerprint == ""
    assert got[19].near_next == 1.0 and got[15].near_next > 0.8


def test_a_short_next_text_does_not_break_likeness(spark):
    got = check(spark, [(2, prose(90, 2)[:349]), (1, "nine char")])
    assert got[2].near_edited > 0.4


def test_a_passage_matches_wherever_it_stands(spark):
    passage = prose(55, 4)
    got = check(spark, [(2, prose(4000, 5).upper() + " " + passage), (1, passage + " " + prose(300, 6).swapcase())])
    assert got[2].near_next > 0
    a, b = ({n for _, n in brute_anchors(t)} for t in (passage, "before " + passage + " after"))
    assert a <= b


def test_scattered_common_anchors_do_not_match(spark):
    pieces = [prose(6, 10 + i) for i in range(40)]
    other = [f"{i * i * 977:08x}" * 12 for i in range(41)]
    mixed = [x for pair in zip(other, reversed(pieces)) for x in pair]
    got = check(spark, [(2, "".join(pieces)), (1, "".join(mixed))])
    found = [{n for _, n in brute_anchors(t)} for t in ("".join(pieces), "".join(mixed))]
    assert got[2].near_next <= len(found[0] & found[1]) / len(found[0] | found[1])


def test_edges(spark):
    docs, empty = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([], SCHEMA)
    got = syncmers.fingerprints(docs, rows=3).collect()
    assert syncmers.fingerprints(empty).count() == 0 and len(got) == docs.count()
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for r in syncmers.fingerprints(docs.select("doc_id", "text").where("doc_id is not null").distinct()).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        if r.doc_id != 3:
            assert by_text.setdefault(r.text or "", r.fingerprint) == r.fingerprint
    nulls = spark.createDataFrame([(None, "a text without an id"), (None, None)], "doc_id long, text string")
    assert syncmers.fingerprints(nulls).count() == 2
    single = syncmers.fingerprints(spark.createDataFrame([(5, "the only text that there is, and so its own next one")], "doc_id long, text string")).first()
    assert single.near_next == 1.0
    twice = syncmers.fingerprints(spark.createDataFrame([(5, "b" * 40), (5, "b" * 40), (1, "c" * 40)], "doc_id long, text string"), rows=1).collect()
    assert sorted(r.near_next for r in twice) == [0.0, 0.0, 1.0]


@pytest.mark.parametrize("k, s", [(4, 1), (5, 2), (9, 3), (3, 1)])
def test_any_k_and_s_against_brute_force(spark, k, s):
    texts = [prose(60, 8), prose(k, 9), prose(k - 1, 9), "a a a a a a a a a a a b a a a", "y" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", syncmers.anchors(F.col("text"), k, s)).collect()
    assert [(t, [(a >> 32, a % (1 << 32)) for a in found]) for t, found in got] == [(t, brute_anchors(t, k, s)) for t in texts]


def test_bounds_of_k_and_s():
    with pytest.raises(ValueError):
        syncmers.closed(F.array(), 5, 4)
