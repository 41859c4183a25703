import collections
import hashlib
import math
import re
import time

import numpy as np
from pyspark.sql import functions as F

from siftwell.llm import pii

from .cases import SCHEMA, rows

BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k == 1 and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")), k == 2 and 14 <= len(d) <= 19 and luhn(d), k == 3 and 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def printed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


PII = ["a@b.c_d@e.f x@y a@@b.co é@x.yz +a.b@c-d.e.f.", "1.2.3.4.5.6.7.8 1.2.3.256 0001.2.3.4 99999999999999999999.1.1.1", "4111 1111 1111 1111-5 4111111111111111 4111-1111-1111-1111 12345678901234", "+1 (555) 123-4567+44 20 7946 0958 +123 +1234567890123456 +12345678901", "1" * 20_000 + ".1.1.1", "a" * 20_000 + "@b", "😀 a@b.co 😀 10.0.0.1"]


def test_base_against_regex(spark, sf):
    texts = [*enumerate([*PII, None, ""]), *((100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        want = base_spans(t or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in want) for k in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(printed(want).encode()).hexdigest(), t
        assert set(filter(None, printed(want).split(","))) <= set(got[i].spans.split(","))


def test_stage(spark):
    docs, empty = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([], SCHEMA)
    out = {r.doc_id: r for r in pii.stage(spark, docs, "").where("doc_id = 14").collect()}
    assert out[14].text == "write to [EMAIL] or [PHONE] from [IP] card [CARD] end" and out[14].n_chars == len(out[14].text) and out[14].spans == "s"
    assert pii.stage(spark, docs, "").count() == docs.count() and pii.stage(spark, empty, "").count() == 0


def test_reliabilities_trust_labelers_that_agree():
    post = pii.reliabilities([(0, (1, 1, 1, 1), 50), (0, (-1, -1, 0, 1), 50), (0, (1, 1, 0, -1), 20), (0, (-1, -1, 0, -1), 20)])
    assert post[0, (1, 1, 0, -1)] > 0.9 > 0.1 > post[0, (-1, -1, 0, 1)]




def test_many_matches_in_one_text(spark):
    text = " ".join(f"user{i}@mail{i % 7}.example.com é" for i in range(64_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    got = pii.detect(df).first()
    assert got.n_email == 64_000 and got.base_sha256 == hashlib.sha256(printed(base_spans(text)).encode()).hexdigest()
    clean = pii.redact(df).first().text
    assert clean == re.sub(BASE[0], "[EMAIL]", text) and time.perf_counter() - began < 60


def brute_posteriors(patterns, rounds):
    """Expectation-maximisation over single spans, not over counts of patterns."""
    spans = [(k, v) for k, v, n in patterns for _ in range(n)]
    p = np.array([(1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)) for _, v in spans])
    for _ in range(rounds):
        prior = {k: (1 + sum(q for q, s in zip(p, spans) if s[0] == k)) / (2 + sum(s[0] == k for s in spans)) for k in {s[0] for s in spans}}
        logit = np.array([math.log(prior[k] / (1 - prior[k])) for k, _ in spans])
        for j in range(4):
            votes = np.array([v[j] for _, v in spans])
            for x in (-1, 1):
                true, false = (1 + p[votes == x].sum()) / (2 + p[votes != 0].sum()), (1 + (1 - p)[votes == x].sum()) / (2 + (1 - p)[votes != 0].sum())
                logit[votes == x] += math.log(true / false)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(spans, p))


def test_reliabilities_against_single_spans():
    patterns = [(0, (1, 1, 1, 1), 40), (0, (0, 1, 0, 1), 9), (0, (0, -1, -1, -1), 30), (1, (1, -1, 0, 0), 7), (1, (-1, -1, 1, 1), 12), (3, (-1, 1, -1, 0), 5)]
    got, want = pii.reliabilities(patterns, rounds=7), brute_posteriors(patterns, 7)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)


PEOPLE, HOSTS, AREAS = ("ann.lee", "bo.ruiz", "cy.moss", "di.falk", "ed.park", "flo.hahn"), ("mail.example.com", "post.example.org", "box.example.net"), ("212", "415", "617", "808")
WORDS = "zero one two three four five six seven eight nine".split()


def planted(seed, n=500):
    """(doc_id, text, spans beyond the base rules that are personal, ones that only look so)."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[rng.integers(len(x))]
    number = lambda: f"{pick(AREAS)}-555-{rng.integers(1000, 9999)}"
    out = []
    for i in range(n):
        kind, name, host = i % 10, pick(PEOPLE), pick(HOSTS)
        cue, true, false = pick(("please contact ", "write to ", "call ", "phone ")), "", ""
        if kind < 2:
            text = cue + f"{name}@{host} today"
        elif kind < 4:
            text = cue + f"+1 ({pick(AREAS)}) 555-{rng.integers(1000, 9999)} today"
        elif kind == 4:
            true = f"{name} [at] {host.replace('.', ' [dot] ')}"
        elif kind == 5:
            true = f"{name.replace('.', ' dot ')} at {host.replace('.', ' dot ')}"
        elif kind == 6:
            true = number()
        elif kind == 7:
            true = " ".join(WORDS[int(c)] for c in number() if c != "-")
        elif kind == 8:
            cue, false = pick(("see order no. ", "part ", "serial ")), f"{rng.integers(111, 199)}-{rng.integers(100, 999)}-{rng.integers(1000, 9999)}"
        else:
            cue, false = "they said ", f"look at that dot {pick(('then', 'there', 'so'))}"
        if kind > 3:
            text = f"{cue}{true or false} {pick(('now', 'soon', 'or not'))}"
        out.append((i, f"{pick(WORDS[4:])} some words before. {text}, and after", true, false))
    return out


def test_the_classifier_adds_what_no_base_rule_covers(spark):
    seen, unseen = planted(1), planted(2)
    frame = lambda rows: pii.written(pii.proposed(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), "doc_id"), "planted")
    got = {r.doc_id: r.spans for r in pii.settled(frame(unseen), frame(seen)).collect()}
    right = wrong = missed = 0
    for i, text, true, false in unseen:
        added = {text[s.start : s.end] for s in got[i] if not s.base}
        right += true in added and bool(true)
        missed += bool(true) and true not in added
        wrong += len(added - {true})
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.85, (right, wrong, missed)


def test_weights_against_plain_python(spark):
    found = pii.proposed(spark.createDataFrame([r[:2] for r in planted(3, 200)], "doc_id long, text string"), "doc_id")
    known = pii.gazetteer(found)
    assert {"0:com", "0:org", "0:net"} | {f"3:{a}" for a in AREAS} <= set(known)
    spans = [s for r in found.select(pii.judged(known, F.col("spans")).alias("spans")).collect() for s in r.spans]
    counts = collections.Counter((s.kind, tuple(s.votes)) for s in spans)
    post = pii.reliabilities([(k, v, n) for (k, v), n in sorted(counts.items())])
    true, every = collections.Counter(), collections.Counter()
    for s in spans:
        for f in (*s.features, f"{s.kind}:", "*:"):
            true[f] += post[s.kind, tuple(s.votes)]
            every[f] += 1
    odds = {f: math.log((true[f] + 1) / (every[f] - true[f] + 1)) for f in every}
    want = {f: odds[f] if len(f) == 2 else odds[f] - odds["*:"] if f[0] == "*" else (odds[f] - odds[f[:2]]) / 6 for f in odds if f != "*:"}
    got = pii.train(found, known)
    assert got.keys() == want.keys() and all(math.isclose(got[f], want[f], rel_tol=1e-6, abs_tol=1e-9) for f in got)


def test_overlaps_are_replaced_as_one(spark):
    spans = [(0, 4, 0), (2, 3, 1), (3, 6, 2), (6, 8, 3)]
    text = "0123456789" * 4
    for shift in (0, 20):
        found = [(a + shift, k, b + shift) for a, b, k in spans]
        df = spark.createDataFrame([(text, found)], "text string, spans array<struct<start: int, kind: int, end: int>>")
        for many in (16, 2):
            pii._MANY, kept = many, pii._MANY
            got = df.select(pii.cleaned(F.col("text"), F.col("spans"))).first()[0]
            pii._MANY = kept
            assert got == text[:shift] + "[EMAIL][PHONE]" + text[shift + 8 :]


def test_odd_rows(spark):
    docs, empty = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert pii.detect(docs).count() == docs.count() and pii.detect(empty).count() == 0
    assert pii.redact(docs).where("text is null").count() == docs.where("text is null").count()
