"""Token files against the tokenizer itself: ids, places, access by id, damaged files."""

import glob
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import token_store as ts
from siftwell.llm import tokens
from siftwell.llm.tokens import tokenizer_path

from . import cases


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*tok.encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = [
    "don't  we'll\n\nstop", " lead", "trail ", "\n", "", "a\tb\rc d e", "<|endoftext|>x <|ENDOFTEXT|> <|start oftext|>", "ΣΑΣ İi ÉCOLE é ́ x", "你好 world😀\x00z", "1234 56", "it's'S 'T 're", "x" * 9000, " " * 50, "word\n" * 3000, "Ａ ﬁ", "don't!'t 's5's ''ll I'LL x'5", "E\u0301 K\u0301 A\u030a I\u0307x 1\u0301 !\u0301", "a|b <|startoftext|>A <|endoftext|>'s (<|endoftext|)", "—!x …?Y a—b!—c", "A1b2,C3_d-e.f@G", "\x85a\xa0b\u2028c\x1fd",
]


def test_encoder_equals_the_tokenizer(plain):
    encode = tokens.Encoder(tokenizer_path())
    for texts in (TEXTS, TEXTS[::-1], [""], ["", "a", ""], []):
        whole = pa.array(["skipped", *texts, "after"]).slice(1, len(texts))  # a slice of a larger buffer
        ids, at = encode(whole)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain(t) for t in texts]


def test_encoder_on_random_signs(plain):
    import random

    rng = random.Random(1)
    signs = [*"aZ'st|<>!.,-_ \n\t05é—²", "\u0301", "<|endoftext|>", "'ll", "你", "İ", "ſ", "\xa0"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(3000)]
    ids, at = tokens.Encoder(tokenizer_path())(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain(t) for t in texts]


def test_encoder_forgets(plain, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ROWS", 2)
    encode = tokens.Encoder(tokenizer_path())
    for t in TEXTS:
        assert encode(pa.array([t]))[0].tolist() == plain(t)


def expected(rows, plain):
    coded = sorted(((i is not None, i or 0, zlib.crc32(np.array(x, "<u4").tobytes()), x) for i, x in ((r[0], plain(r[1])) for r in rows)), key=lambda r: r[:3])
    out, start = [], 0
    for known, i, crc, ids in coded:
        out.append((i if known else None, start, len(ids), crc, ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("least", [1 << 20, 500])
def test_round_trip_of_odd_rows(spark, tmp_path, plain, least):
    rows = [*cases.rows(), *((100 - i, t, *cases.rows()[0][2:]) for i, t in enumerate(TEXTS)), *[(7, "same row", *cases.rows()[0][2:])] * 40]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    manifest = ts.write(docs, str(tmp_path / "ids"), least_bytes=least)
    got = sorted((tuple(r) for r in ts.read(manifest, ids=True).collect()), key=lambda r: r[1])
    assert got == expected(rows, plain)
    files = manifest.orderBy("part").collect()
    assert len(files) > 1 if least == 500 else len(files) >= 1
    assert sum(r["docs"] for r in files) == len(rows)
    for f in files:  # in ascending order within a file
        with pa.OSFile(f["file"].removeprefix("file://")) as file:
            index = ts.index_of(file)[2]
        assert (np.diff(index["doc_id"][index["known"] > 0]) >= 0).all() and (np.diff(index["start"]) > 0).all()


def test_access_by_id_reads_only_its_files(spark, tmp_path, plain):
    rows = [(i, f"document {i} says {'so ' * (i % 50)}") for i in range(500)]
    manifest = ts.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ids"), least_bytes=2000)
    want = {r[0]: r for r in expected(rows, plain)}
    got = ts.read(manifest, ids=True, only=[3, 499, 77, 1000]).collect()
    assert {r["doc_id"]: tuple(r) for r in got} == {i: want[i] for i in (3, 77, 499)}
    assert ts.read(manifest, only=[]).collect() == []


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ts.read(ts.write(docs, str(tmp_path / "ids"))).collect() == []


def test_the_dictionary_helps_short_documents(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000")
    with_it, without = (ts.write(docs, str(tmp_path / str(b)), dict_bytes=b).agg({"bytes": "sum"}).first()[0] for b in (ts.DICT_BYTES, 0))
    assert with_it < without


@pytest.mark.parametrize("what", ["frame", "dictionary"])
def test_damage_is_an_error(spark, tmp_path, what):
    rows = [(i, f"some words of document {i} and {i * 7} more of them " * 3) for i in range(300)]
    manifest = ts.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ids"))
    name = glob.glob(f"{tmp_path}/ids/*.{'ids' if what == 'frame' else 'dict'}")[0]
    data = bytearray(open(name, "rb").read())
    data[len(data) // 3] ^= 0x55
    open(name, "wb").write(bytes(data))
    with pytest.raises(Exception, match="ids that its index states|dictionary is not|ZstdError|decompress"):
        ts.read(manifest).collect()


def test_texts_are_encoded_in_small_blocks():
    held = [x.nbytes for _, x in tokens.blocks(pa.array(["word " * 20_000] * 60))]
    assert len(held) > 3 and max(held) < 2 << 20
