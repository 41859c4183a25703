"""Folders of image files as tables: listing, pairing, decoding through a function that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inventory import collisions, pair

#: Extensions by class.
RAW = ("cr2", "cr3", "nef", "arw", "raf", "orf", "rw2", "dng")
JPEG = ("jpg", "jpeg")
OTHER = ("png", "tif", "tiff", "bmp", "webp", "heic", "heif", "gif")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, dir, stem, ext, kind, length, modified) of image files under folder. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.when(ext.isin(*RAW), "raw").when(ext.isin(*JPEG), "jpg").when(ext.isin(*OTHER), "other")
    out = files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), ext.alias("ext"), kind.alias("kind"), "length", "modified")
    return out.where(F.col("kind").isNotNull())


def assets(files: DataFrame) -> DataFrame:
    """(asset, dir, stem, raw, jpg, primary): a raw file with its JPEG, leftovers alone; stems that meet again get a suffix."""
    named = files.withColumn("stem", F.lower("stem"))
    both = pair(named.where("kind <> 'other'"), ["dir", "stem"], "kind", ["path"], "raw", "jpg", "path")
    rest = named.where("kind = 'other'").select("dir", "stem", F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("jpg"), F.col("path").alias("primary"))
    out = both.withColumn("primary", F.coalesce("jpg", "raw")).unionByName(rest)
    return collisions(out, "stem", "primary").select("asset", "dir", "stem", "raw", "jpg", "primary")


def rating_targets(rows: DataFrame) -> DataFrame:
    """(asset, target): the raw and the JPEG file of an asset, or else its primary one."""
    targets = F.array_distinct(F.array_compact(F.array("raw", "jpg")))
    return rows.select("asset", F.explode(F.when(F.size(targets) > 0, targets).otherwise(F.array("primary"))).alias("target"))


def decoded(spark: SparkSession, folder: str, decode: Callable[[bytes], list[float] | None], width: Callable[[bytes], int | None]) -> DataFrame:
    """(path, pixels, width): gray images by the caller's decoder, a batch at a time on the executors. A file that it can't read has nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((path, decode(content), width(content)))
                except ValueError:
                    rows.append((path, None, None))
            yield pd.DataFrame(rows, columns=["path", "pixels", "width"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, pixels array<double>, width int")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ok) of content-addressed files: whether a file's name is the SHA-256 of its content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", (F.regexp_extract("path", r"([^/.]+)(\.[^/]*)?$", 1) == F.sha2("content", 256)).alias("ok"))
