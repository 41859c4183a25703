"""Tables and checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where none is set: a temporary one if all runs in one process, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            base = tempfile.mkdtemp(prefix="siftwell-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return base.rstrip("/")


#: What the scopes that are open have to remove.
_MADE: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that written() made in it. The result must be written, or collected, within it."""
    _MADE.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _MADE.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a Parquet table in the shared folder, written under the options: its lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    for made in _MADE:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; Spark removes its files once nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
