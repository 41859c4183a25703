import base64
import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from siftwell.llm import language_id, neardup, packing, search, secret_ledger, sharding, warc

from .cases import SCHEMA, rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_language_id(docs, empty, real):
    got = [r for r in language_id.identify(docs).select("row.doc_id", "row.text", "lang_pred", "score", "margin").collect()]
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or ""))
    assert language_id.identify(empty).count() == 0
    same = language_id.identify(real).where(F.crc32(F.col("row.doc_id").cast("string")) % 4 == 2).select("row.lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in same]) > 0.9


def test_language_id_learns_from_many_copies(spark):
    texts = spark.range(20).select(F.concat(F.lit("a text of which there are many copies "), F.conv("id", 10, 2).alias("x"), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.when(F.col("id") < 10, "en").otherwise("de").alias("lang"))
    copies = texts.crossJoin(spark.range(500)).select("text", "lang")
    got = language_id.fit(copies, sample_rows=12)
    assert set(got) == {"en", "de"} and got == {k: v for k, v in language_id.fit(texts, sample_rows=12).items()}


def brute_dictionaries(rows, sample=language_id.SAMPLE_ROWS):
    """From (text, lang), apart from the code under test: the texts of lowest hash, each language's letters joined."""
    texts, often = collections.defaultdict(dict), collections.Counter()
    for text, lang in rows:
        if text is not None and lang is not None:
            h = xxhash.xxh64_intdigest(text.encode(), 42)
            texts[lang][h - (1 << 64) if h >> 63 else h] = text[:400]
            often[lang] += 1
    out = {}
    for lang in sorted(texts, key=lambda x: (-often[x], x)):
        heads = [re.sub(r"[\W\d_]+", " ", f" {t} ".lower()).encode() for _, t in sorted(texts[lang].items())[:sample]]
        data = b"".join(dict.fromkeys(heads))
        if data.strip():
            while len(data) < 8:
                data += data
            out[lang] = data[: 1 << 17]
    return out


def brute_language(text, dictionaries):
    body = re.sub(r"[\W\d_]+", " ", f" {text or ''} ".lower()).encode()
    if not body.strip() or not dictionaries:
        return "und", 0.0, True
    need = {}
    for lang, data in dictionaries.items():
        need[lang] = sum(len(zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(body[i : i + 4096])) for i in range(0, len(body), 4096))
    best = min(need, key=need.get)  # the first of equal ones is the more frequent language
    others = [n for lang, n in need.items() if lang != best]
    margin = (min(others) - need[best]) / min(others) if others else 1.0
    return best, 1 / sum(2.0 ** -min(60, (n - need[best]) / 2) for n in need.values()), margin < language_id.REJECT_MARGIN


def test_language_id_against_brute_force(spark, docs, real):
    for df in (docs, real.limit(80)):
        rows = df.select("doc_id", "text", "lang").collect()
        dictionaries = brute_dictionaries([(r.text, r.lang) for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 != 2])
        want = collections.Counter()
        for r in rows:
            lang, score, rejected = brute_language(r.text, dictionaries)
            want[r.doc_id, r.text, lang, round(score, 9), rejected] += 1
        got = language_id.identify(df).select("row.doc_id", "row.text", "lang_pred", "score", "rejected").collect()
        assert collections.Counter((r.doc_id, r.text, r.lang_pred, round(r.score, 9), r.rejected) for r in got) == want


def test_no_language_is_lost_to_copies_or_short_samples(spark):
    many = spark.range(12).select(F.concat(F.lit("l"), "id").alias("lang"), F.concat(F.lit("a text that stands in it often "), F.sha2(F.col("id").cast("string"), 256)).alias("text")).crossJoin(spark.range(20_000).select())
    short = spark.createDataFrame([("xx", "ab"), ("yy", "é"), ("zz", "12 34")], "lang string, text string")
    got = language_id.fit(many.unionByName(short))
    assert set(got) == {f"l{i}" for i in range(12)} | {"xx", "yy"} and min(map(len, got.values())) >= 8
    assert list(language_id.fit(many.unionByName(short), languages=2)) == ["l0", "l1"]
    asked = spark.createDataFrame([("ab",)], "text string").select(language_id.predict(F.col("text"), {"xx": got["xx"]}).alias("p")).first().p
    assert asked.lang_pred == "xx" and asked.margin == 1.0


def test_language_stage_compresses_once(spark, docs):
    plan = language_id.stage(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_language_stage_keeps_columns(spark, docs):
    out = language_id.stage(spark, docs, "")
    assert out.columns == docs.columns and out.where("row = 'r'").count() > 5


def test_sharding(docs, empty, real):
    assert sharding.shard(empty).count() == 0
    for df in (docs, real):
        got = sharding.shard(df, shards=5).collect()
        assert len(got) == df.count()
        want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.select("doc_id", "text").collect())
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
        for s in range(5):
            own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
            assert [r.slot for r in own] == list(range(len(own)))
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got) + 0.1 * sum(size.values()) / 5


def test_sharding_cuts_a_group_of_copies(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    sizes = sharding.shard(df, shards=10).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(sizes) == 10 and max(r.s for r in sizes) < 1.05 * min(r.s for r in sizes)


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "y" * 600_000), (6, "u", "\r\n\r\nWARC/1.1"), (6, "u", "\r\n\r\nWARC/1.1"), (None, "u", "z"), (None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.write(df, str(tmp_path / "w"), bundle_bytes=1000, frame_bytes=200)
    got = collections.Counter(map(tuple, warc.read(index).collect()))
    want = collections.Counter()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h in pages:
        data = (h or "").encode()
        refers = first.get(h or "") if first.get(h or "") != i else None
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers] += 1
    assert got == want
    assert [r.page_id for r in warc.lookup(index, [5]).collect()] == [5]
    assert warc.read(warc.write(df.limit(0), str(tmp_path / "e"))).count() == 0


def brute_components(texts, percent):
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        base = list(rng.choice(words, 90))
        for edits in (0, 0, 1, 2, 3, 6, 20):
            t = base.copy()
            for at in rng.choice(90, edits, replace=False):
                t[at] = "edit"
            out.append(" ".join(t))
    return list(enumerate([*out, None, "", " ", "a b", "A  b", "a b c"]))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_brute_force(spark, percent):
    texts = near_texts()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.group(df, percent=percent, block=8).collect()}
    assert got == brute_components(texts, percent)


def test_a_hot_group_against_brute_force(spark):
    """5,000 near copies meet in one bucket, with others that are like them but below the threshold."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]

    def edited(of, n):
        out = list(of)
        for at in rng.choice(len(of), n, replace=False):
            out[at] = f"e{rng.integers(1 << 30)}"
        return " ".join(out)

    texts = [edited(base, 1) for _ in range(5000)] + [edited(base, n) for n in (3, 4, 5, 6, 7, 8, 9, 12)] + [edited(base[:60] + [f"v{i}" for i in range(60)], 1) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.group(df, percent=85, wide=1024).collect()}
    sets = [neardup.shingles(t) for t in texts]
    assert all(got[i] == 0 for i in range(5000))  # two are .84 alike, or more where their edits are close: all link in chains
    for i in range(5000, 5008):
        linked = any(neardup._linked(sets[i], sets[j], 85) for j in range(5000))
        assert (got[i] == 0) == linked or any(got[j] == got[i] != 0 for j in range(5000, 5008))
    assert {got[i] for i in range(5008, 5308)} == {5008}


def test_components_that_meet_only_below_the_threshold(spark):
    """Chains: a links with b and b with c but a not with c, in buckets that others share; cut as if they were wide, in small blocks."""
    rng = np.random.default_rng(11)
    texts = []
    for f in range(25):
        words = [f"f{f}w{i}" for i in range(100)]
        for step in range(6):
            texts.append(" ".join(words))
            for at in range(step * 3, step * 3 + 2):
                words[at] = f"f{f}s{step}a{at}"
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    for wide, block in ((4, 4), (2048, 256)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.group(spark.createDataFrame(rows, "doc_id long, text string"), percent=85, block=block, wide=wide).collect()}
        assert got == brute_components(rows, 85)


def test_an_id_with_several_texts_links_by_any_of_them(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, "else"), (1, a)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in neardup.group(df).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_near_duplicates_edges(spark, docs, empty):
    got = neardup.group(docs).collect()
    assert len(got) == docs.count()
    assert all(r.component_id is None or r.component_id <= r.doc_id for r in got)
    assert neardup.group(empty).count() == 0
    out = neardup.stage(spark, docs, "")
    assert out.columns == docs.columns and {2, 17}.isdisjoint(r.doc_id for r in out.collect())


def test_search_against_brute_force(spark, docs, empty, real):
    rows = real.select("doc_id", "text").collect()
    found = {r.doc_id: search.terms(r.text) for r in rows}
    df, mean = collections.Counter(t for c in found.values() for t in c), sum(sum(c.values()) for c in found.values()) / len(found)
    got = collections.defaultdict(list)
    asked = real.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    for r in search.search(real, asked, shard_docs=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for q in (r.doc_id for r in rows if r.doc_id % 20 == 0):
        scores = {i: sum(n * math.log(1 + (len(found) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, n in found[q].items() if t in c) for i, c in found.items()}
        want = sorted(((i, s) for i, s in scores.items() if s), key=lambda x: (-x[1], x[0]))[:10]
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want])
    assert search.search(docs, docs.select(F.col("doc_id").alias("query_id"), "text").where("query_id is not null")).count() > 0
    assert search.search(empty, empty.select(F.col("doc_id").alias("query_id"), "text")).count() == 0


def test_search_merges_the_best_of_a_fixed_number_of_groups(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("v"), F.col("id") % 31)).alias("text"))
    index = search.written(search.build(docs.repartition(4), shard_docs=5), "index", maxRecordsPerFile=1)
    assert index.count() >= 80 and len(index.inputFiles()) == index.count()  # a shard a file
    term = lambda word: search.xxhash.xxh3_64_intdigest(word.encode()) - (1 << 64) * (search.xxhash.xxh3_64_intdigest(word.encode()) >> 63)
    packed = search.written(spark.createDataFrame([(q, [t for t, _ in some], [w for _, w in some]) for q in range(20) for some in [sorted([(term("word"), 0.1), (term(f"w{q % 7}"), 1.0)])]], "query_id long, terms array<long>, weights array<double>"), "queries")
    got = search._found(index, packed, 3.0, 10).toPandas()
    assert len(got) == 20 * 10 * search.GROUPS  # not of each of the shards
    every = search.search(docs, docs.where("doc_id < 20").withColumnRenamed("doc_id", "query_id"), shard_docs=1000).orderBy("query_id", "rank").collect()
    assert every == search.search(docs.repartition(4), docs.where("doc_id < 20").withColumnRenamed("doc_id", "query_id"), shard_docs=5).orderBy("query_id", "rank").collect()


def test_a_shard_is_opened_in_place():
    """Beyond what stays, opening a shard takes less than one more column of its postings."""
    rng = np.random.default_rng(3)
    shard = search._Shard()
    for i in range(2000):
        shard.add(i, collections.Counter(dict.fromkeys(rng.integers(0, 40_000, 200).tolist(), 2)))
    row = dict(zip(search.SHARD.replace(" long", "").replace(" binary", "").split(", "), shard.row()))
    tracemalloc.start()
    searcher = search._Searcher(row, 400.0)
    left, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert searcher.docs.dtype == np.uint32 and most - left < 8 * len(searcher.docs)


def test_blocks_are_pruned():
    """Documents of 40 topics that share common words: a query scores about half of the blocks, and finds what scoring all of them finds."""
    rng = np.random.default_rng(7)
    shard = search._Shard()
    texts = [" ".join(rng.choice([f"t{i % 40}w{j}" for j in range(200)], 60)) + " " + " ".join(rng.choice([f"c{j}" for j in range(30)], 20)) for i in range(4000)]
    for i, t in enumerate(texts):
        shard.add(i, search.terms(t))
    names = search.SHARD.replace(" long", "").replace(" binary", "").split(", ")
    searcher = search._Searcher(dict(zip(names, shard.row())), 80.0)
    asked = [search.terms(t) for t in texts[::100]]
    t, w = [np.fromiter(a, "uint64", len(a)) for a in asked], [np.ones(len(a)) for a in asked]
    got = [search._best(*found, 10) for found in searcher.search_all(t, w, 10, [0.0] * len(t))]
    assert searcher.scored < 0.6 * searcher.asked
    for (ids, scores), one, weight in zip(got, t, w):
        total = np.zeros(len(searcher.doc_ids))
        for k, x in zip(np.searchsorted(searcher.terms, one), weight):
            part = slice(searcher.starts[k], searcher.starts[k + 1])
            total[searcher.docs[part]] += searcher.impacts[part] * x
        want = search._best(searcher.doc_ids, np.round(total, search.DIGITS), 10)
        assert np.array_equal(ids, want[0]) and np.allclose(scores, want[1])


def test_secrets(spark, docs, empty):
    texts = ['secret=token: abcdefghijklmnop', 'PassWD : "a1b2c3d4e5f6g7" api-key=abcdefghijklm APIKEY=short', "AKIA" + "A" * 13 + " AKIA" + "B" * 14, "f" * 15 + "g" + "0" * 16, "ſecret = abcdefghijklmnop", "😀 token=abcdefghijklmnop", None, ""]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    paths = spark.createDataFrame(list(enumerate(texts)), "path long, text string")
    got = {r.path: r for r in secret_ledger.join_back(paths, secret_ledger.scan(paths)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = sorted([(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])
        text = ",".join(f"{secret_ledger.BASE[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
    paths = docs.select(F.col("doc_id").alias("path"), "text")
    assert secret_ledger.join_back(paths, secret_ledger.scan(paths)).count() == docs.count()
    paths = empty.select(F.col("doc_id").alias("path"), "text")
    assert secret_ledger.join_back(paths, secret_ledger.scan(paths)).count() == 0


def test_ledger_scans_only_what_is_new(spark):
    day1 = spark.createDataFrame([(1, "token=abcdefghijklmnop"), (2, "token=abcdefghijklmnop"), (3, "clean")], "path long, text string")
    ledger = secret_ledger.scan(day1).cache()
    assert ledger.count() == 2
    day2 = day1.unionByName(spark.createDataFrame([(3, "now token=qrstuvwxyzabcdef"), (4, "clean")], "path long, text string"))
    more = secret_ledger.scan(day2, ledger)
    assert [r.n_assign for r in more.collect()] == [1]
    assert secret_ledger.scan(day2, ledger, rule_version=2, broadcast_rows=0).count() == 3
    back = secret_ledger.join_back(day2, ledger.unionByName(more)).where("n_assign > 0")
    assert sorted(r.path for r in back.collect()) == [1, 2, 3]


def test_packing(spark, docs, empty, real):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    for df, capacity in ((docs, 16), (real, 2048)):
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
            for k in range(0, len(ids), capacity):
                want[r.doc_id, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(np.array(ids[k : k + capacity], "<u4").tobytes())] += 1
        got = packing.pack(packing.pieces(df, capacity), capacity).collect()
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = collections.defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            end = 0
            for at, n in sorted(b):
                assert at == end
                end += n
            assert end <= capacity
        assert len(bins) <= 1.1 * sum(r.length for r in got) / capacity + 1
    assert packing.stage(spark, empty, "").count() == 0


@pytest.mark.parametrize("counts", [{2048: 3}, {1025: 5, 1023: 2}, {683: 7}, {682: 7}, {1: 5000}, {1400: 3, 700: 5, 600: 4, 48: 9, 1: 3}, {}])
def test_plan_places_every_rank_once(counts):
    place, fill = {}, collections.defaultdict(list)
    for length, first, n, start, offset in packing.plan(counts):
        for i in range(n):
            assert (length, first + i) not in place
            place[length, first + i] = start + i
            fill[start + i].append((offset, length))
    assert len(place) == sum(counts.values())
    for b in fill.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and sum(b[-1]) <= 2048
        assert sum(3 * n > 2048 for _, n in b) <= 2
