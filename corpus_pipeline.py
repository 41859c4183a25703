"""The corpus pipeline: each stage works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import language_id, mixing, neardup, packing, pii
from siftwell.llm.common import written

STAGES = [
    ("language_id", language_id.stage),
    ("near_dedup", neardup.stage),
    ("personal_data", pii.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]
#: Language ID compresses and packing tokenizes: SQL can't express either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:  # each is written once; the next reads that
        docs = written(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
