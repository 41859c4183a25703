"""Metadata of photos from JSON files that a camera tool has written, and listings of stored sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import capture_time

#: Fields that are read; others are left alone. Unknown ones are null.
FIELDS = "SourceFile string, Make string, Model string, Orientation string, DateTimeOriginal string, CreateDate string, ModifyDate string, SubSecTimeOriginal string, FocusX double, FocusY double"


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(path, make, model, orientation, captured, focus_x, focus_y) of every record in the JSON files (arrays of objects) under folder.

    The capture time is the first of original, creation and modification that parses. A record without SourceFile is dropped.
    """
    raw = spark.read.schema(FIELDS).option("multiLine", True).option("recursiveFileLookup", True).json(folder).where("SourceFile is not null")
    captured = capture_time(F.col("DateTimeOriginal"), F.col("CreateDate"), F.col("ModifyDate"), subsecond=F.col("SubSecTimeOriginal"))
    orientation = F.when(F.col("Orientation").rlike("^[1-8]$"), F.col("Orientation").cast("int"))
    return raw.select(F.col("SourceFile").alias("path"), F.trim("Make").alias("make"), F.trim("Model").alias("model"), orientation.alias("orientation"), captured.alias("captured"), F.col("FocusX").alias("focus_x"), F.col("FocusY").alias("focus_y"))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """(session, path, modified, length) of the session files `<session>/session.json` under folder. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "session.json").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("session"), "path", F.col("modificationTime").alias("modified"), "length")
