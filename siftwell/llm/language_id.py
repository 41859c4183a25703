"""Language identification by compression against per-language dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tidied, unwrapped, wrapped

_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Bounds of the fitted classifier, whatever the size of the corpus.
LANGUAGES, SAMPLE_ROWS, SLICE_CHARS, DICT_BYTES = 1000, 1000, 400, 1 << 17
#: Bytes from which Zstandard takes a raw dictionary at all; a shorter one is repeated.
_LEAST_BYTES = 8
LEVEL, WINDOW_BYTES = 7, 4096
#: A text is rejected if the runner-up needs less than this share more bytes than the best.
REJECT_MARGIN = 0.004


def letters(text: str) -> bytes:
    """Lower-case letters, every other run as one space."""
    return _NOT_LETTERS.sub(" ", f" {text} ".lower()).encode("utf-8", "replace")


def fit(labelled: DataFrame, *, languages: int = LANGUAGES, sample_rows: int = SAMPLE_ROWS, slice_chars: int = SLICE_CHARS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries by language from (text, lang), most frequent language first.

    The `languages` most frequent languages are learned (equal counts: the first by name). At most sample_rows different
    texts of each (those whose hashes are lowest in a share of the hash range that holds about twice as many different
    texts, so that no task reads more of a language however large the corpus; in the whole range if that share holds
    too few) give their first slice_chars characters, until dict_bytes are full. Copies count once, so a language of many
    copies is sampled like one of few. Rows with a null text or language teach nothing, and a language none of whose
    sampled texts has a letter has no dictionary. No usable row: no dictionaries. Other columns are not read.
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, slice_chars).alias("head"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    often = {r.lang: r.n for r in counts}
    shares = {r.lang: min(1.0, 2 * sample_rows / max(r.texts, 1)) for r in counts}
    heads: dict[str, list] = {}
    while shares:
        share = F.create_map(*(F.lit(x) for lang, part in shares.items() for x in (lang, int(part * (1 << 32)))))
        few = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 32)) < F.element_at(share, F.col("lang"))).groupBy("lang", "h").agg(F.min("head").alias("head"))
        ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample_rows)
        found: dict[str, list] = {}
        for lang, h, head in ranked.select("lang", "h", "head").collect():  # sample_rows a language
            found.setdefault(lang, []).append((h, head))
        heads |= found
        shares = {lang: 1.0 for lang, part in shares.items() if part < 1 and len(found.get(lang, ())) < sample_rows}
    out = {}
    for lang in sorted(heads, key=lambda x: (-often[x], x)):
        data = b"".join(dict.fromkeys(letters(head) for _, head in sorted(heads[lang])))
        if data.strip():
            out[lang] = (data * -(-_LEAST_BYTES // len(data)))[: max(dict_bytes, _LEAST_BYTES)]
    return out


def _compressors(dictionaries: dict[str, bytes], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, data in dictionaries.items():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def _classify(text: str | None, compressors: list, window: int) -> tuple[str, float, float]:
    """(language, score, margin); the whole text counts, a window at a time."""
    body = letters(text or "")
    if len(body) < 2 or not compressors or body.isspace():
        return "und", 0.0, 0.0
    parts = [body[i : i + window] for i in range(0, len(body), window)]
    sizes = [(sum(len(c.compress(p)) for p in parts), i) for i, (_, c) in enumerate(compressors)]
    (best, i), *rest = sorted(sizes)  # equal sizes: the more frequent language
    score = 1 / sum(2.0 ** -min(60, (s - best) / 2) for s, _ in sizes)
    return compressors[i][0], score, (rest[0][0] - best) / rest[0][0] if rest else 1.0


def predict(text: Column, dictionaries: dict[str, bytes], *, level: int = LEVEL, window: int = WINDOW_BYTES) -> Column:
    """struct(lang_pred, score, margin) of each whole text; `und`, 0, 0 without a letter or without dictionaries.

    Each text is compressed against each dictionary and takes the language of the smallest output; margin is
    the share of bytes that the runner-up needs more, score 2^-excess over all languages, normalised. A long text counts
    whole, `window` bytes at a time. Spark takes the column for nondeterministic, though it isn't, so that a filter on it
    does not compress every text twice.
    """

    @F.arrow_udf("lang_pred string, score double, margin double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(predicted)(batches)

    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = _compressors(dictionaries, level)
        for texts in batches:  # one text at a time is a Python string
            lang, score, margin = zip(*(_classify(t.as_py(), compressors, window) for t in texts), strict=True) if len(texts) else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], names=["lang_pred", "score", "margin"])

    return of.asNondeterministic()(text)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def taught(docs: DataFrame) -> DataFrame:
    """(text, lang) of the rows that may teach; a null doc_id teaches."""
    return docs.where(~F.coalesce(held_out(), F.lit(False))).select("text", "lang")


def identify(docs: DataFrame, *, reject_margin: float = REJECT_MARGIN, **how) -> DataFrame:
    """(row, lang_pred, score, margin, rejected) of docs (doc_id, text, lang, ...), a row per row of docs.

    Rejected: no letter (so every null, empty or blank text), or a margin under reject_margin. Equal texts get equal predictions, and
    repeated rows stay. Columns of docs stand in `row`, whatever their names. An empty table gives no rows.
    """
    out = wrapped(docs).withColumn("id", predict(F.col("row.text"), fit(taught(docs), **how)))
    return out.select("row", "id.*", ((F.col("id.lang_pred") == "und") | (F.col("id.margin") < reject_margin)).alias("rejected"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that language ID rejects; lang becomes the predicted language. Nulls, repeats, clashing names: as identify()."""
    return unwrapped(identify(docs).where(~F.col("rejected")), docs.columns, lang=F.col("lang_pred"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of the whole of `documents`, learned from the rows that are not held out: see fit(), predict()."""
    got = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return got.select("row.doc_id", "lang_pred", "score", "margin", "rejected").select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")
