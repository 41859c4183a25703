"""What the corpus operators share: reading, and the sizes of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import kept, shared_dir, written
from ..operators.graph import components

__all__ = ["WORD", "components", "kept", "shared_dir", "table", "tidied", "unwrapped", "utf8_size", "word_count", "wrapped", "written"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    """Number of WORDs; null counts none. Every word but the last ends where white space follows."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def wrapped(docs: DataFrame, *more: Column) -> DataFrame:
    """Each row as the struct `row`, so that no column of docs can clash with those that an operator adds."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *more)


def unwrapped(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of `row` again, those in new replaced."""
    return rows.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns))


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def tidied(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f over a task's batches, which at the end gives back to the system what it has freed: Python workers outlive their tasks, and what idle ones hold counts against the executor all the same."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            _give_back()

    return run
