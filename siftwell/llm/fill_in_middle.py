"""Fill-in-middle: a whole batch of texts cut and put together again on its Arrow UTF-8 buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, wrapped

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
#: Text bytes that the kernel works on at a time; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
PLAIN, PSM_FORM, SPM_FORM = 0, 1, 2

#: What a byte is: 0 goes on with a code point, 1 begins one, 2 begins one and ends a line.
_CLASS = np.ones(256, np.uint8)
_CLASS[0x80:0xC0] = 0
_CLASS[0x0A] = 2


def _starts(data: np.ndarray, begins: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(a unit starts at this byte, a code point starts there); begins: first bytes of the texts that have any."""
    kind = _CLASS[data]
    points = kind > 0
    if unit == "char":
        return points, points
    units = np.empty(len(data), bool)
    units[1:] = kind[:-1] == 2
    units[begins] = True
    return units, points


def _marked(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, marks: tuple[str, str, str]) -> np.ndarray:
    """Whether a text holds a mark within its own bytes."""
    out = np.zeros(len(lo), bool)
    for mark in {m.encode() for m in marks}:
        at = np.flatnonzero(data[: len(data) - len(mark) + 1] == mark[0])
        for k, byte in enumerate(mark[1:], 1):
            at = at[data[at + k] == byte]
        of = np.searchsorted(hi, at, "right")
        out[of[at + len(mark) <= hi[of]]] = True
    return out


def kernel(texts: pa.Array, h: list[np.ndarray], unit: str, rate: int, spm: int, marks: tuple[str, str, str]) -> pa.StructArray:
    """(n, form, prefix_chars, middle_chars, output) of each text; h: four random numbers of each.

    One pass looks every byte's class up; a unit starts behind a byte that ends one, and where a text begins. The running
    counts of both kinds of start, less what they are at a text's first byte, number the units and code points of each text,
    and one search in them finds the cuts of all texts. Prefix, middle and suffix are then slices of the same buffer.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    base, lo, hi = at[0], (at[:-1] - at[0]).astype(np.int64), (at[1:] - at[0]).astype(np.int64)
    data = np.frombuffer(values, np.uint8)[base : at[-1]] if at[-1] > base else np.zeros(0, np.uint8)
    units, points = _starts(data, lo[lo < hi], unit)
    run, chars = np.cumsum(units, dtype=np.int32), np.cumsum(points, dtype=np.int32)
    upto = lambda count, i: np.where(i > 0, count[i - 1], 0) if len(count) else np.zeros(len(i), np.int32)
    first = upto(run, lo).astype(np.int64)
    n = upto(run, hi) - first
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    cut = lambda k: np.minimum(np.searchsorted(run, first + k + 1), hi)  # noqa: E731  # the unit after k others; none: the end
    one, two = cut(np.minimum(a, b)), cut(np.maximum(a, b))
    form = np.where((n == 0) | _marked(data, lo, hi, marks) | (h[2] % 100 >= rate), PLAIN, np.where(h[3] % 100 < spm, SPM_FORM, PSM_FORM))
    edges = np.append(np.stack([lo, one, two], 1).ravel(), len(data)).astype(np.int32) + base
    parts = pa.Array.from_buffers(pa.string(), 3 * len(texts), [None, pa.py_buffer(edges), values])
    row, swap = 3 * np.arange(len(texts)), form == SPM_FORM
    part = lambda k: parts.take(pa.array(row + k))
    mark = lambda left, right: pc.if_else(pa.array(swap), pa.scalar(right), pa.scalar(left))
    whole = pa.scalar("")
    made = pc.binary_join_element_wise(mark(*marks[:2]), part(np.where(swap, 2, 0)), mark(*marks[1::-1]), part(np.where(swap, 0, 2)), pa.scalar(marks[2]), part(1), whole)
    plain = form == PLAIN
    length = lambda i, j: pa.array((upto(chars, j) - upto(chars, i)).astype(np.int64), mask=plain)
    names = pa.DictionaryArray.from_arrays(pa.array(form.astype(np.int8)), pa.array(["plain", "psm", "spm"])).cast(pa.string())
    return pa.StructArray.from_arrays(
        [pa.array(n.astype(np.int64)), names, length(lo, one), length(one, two), pc.if_else(pa.array(plain), texts, made)],
        ["n", "form", "prefix_chars", "middle_chars", "output"],
    )


def _blocks(texts: pa.Array, block_bytes: int) -> list[tuple[int, int]]:
    """Runs of rows of about block_bytes."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // block_bytes
    cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
    return list(zip(cuts, cuts[1:], strict=False))


def transformed(text: Column, key: Column, *, unit: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS, block_bytes: int = BLOCK_BYTES) -> Column:
    """A struct (n, form, prefix_chars, middle_chars, output) of each text; its random numbers are digits of the SHA-256 of `seed:key`.

    unit: `line` (to its line feed) or `char` (code point). rate: per cent of the texts that are transformed, spm: per cent of those with the suffix first.
    """
    if unit not in ("line", "char"):
        raise ValueError(f"no such unit: {unit}")

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *h in batches:
            words = [x.to_numpy(zero_copy_only=False) for x in h]
            made = [kernel(texts[i:j], [x[i:j] for x in words], unit, rate, spm, marks) for i, j in _blocks(texts, block_bytes)]
            yield pa.concat_arrays(made) if len(made) > 1 else made[0]

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return cut(text, *(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of an output: no transformed text holds a mark, so its marks are where the parts meet."""
    part = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with the column text transformed and, behind the others, (n, form, prefix_chars, middle_chars): see transformed().

    A null or empty text stays plain and becomes the empty one, as does a text that holds a mark; a null key draws as an empty one does. Repeated rows are
    transformed alike, rows of one key and other texts draw the same numbers. Very long texts count whole: a block of one text. Columns of docs with the names
    of new ones are replaced by these, other columns stay; no rows give none. Nothing is exchanged: Catalyst sees a projection with one Arrow kernel.
    """
    new = ("n", "form", "prefix_chars", "middle_chars")
    kept = [c for c in docs.columns if c not in new]
    rows = wrapped(docs).withColumn("made", transformed(F.col("row").getField(text), F.col("row").getField(key), **how))
    return rows.select(*((F.col("made.output") if c == text else F.col("row").getField(c)).alias(c) for c in kept), *(F.col(f"made.{c}").alias(c) for c in new))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of `documents`, by lines: see fill_in_middle(); the digest of its output, and of the text that is rebuilt from the output alone."""
    docs = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("text")).alias("output_sha256"), digest(restored(F.col("text"), F.col("form"))).alias("restored_sha256"))
