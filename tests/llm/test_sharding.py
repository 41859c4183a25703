"""The histogram sort against a plain sort: slots in key order, bytes by shard, repeated rows."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import sharding


def sizes(got):
    out = collections.Counter()
    for r in got:
        out[r.shard] += r.size
    return out


@pytest.mark.parametrize(("shards", "parts"), [(7, 1), (5, 8)])
def test_shards_and_slots_are_those_of_a_plain_sort(spark, shards, parts):
    rng = random.Random(1)
    texts = ["hot " * 20] * 700 + ["x" * rng.randrange(400) for _ in range(700)] + [None, ""] * 50
    df = spark.createDataFrame([(rng.randrange(2000), t) for t in texts], "doc_id long, text string").repartition(6)
    rows = sharding.keyed(df).collect()
    got = sharding.shard(df, shards, parts).collect()
    # the order of a plain sort by key, and of each shard's rows by slot, are one (up to rows of one key)
    key = {(r.doc_id, r.size, r.text_crc32): r.key for r in rows}
    order = [key[r.doc_id, r.size, r.text_crc32] for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(r.key for r in rows)
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # every boundary of shards has within tolerance as many bytes before it as its share
    upto, total, most = np.cumsum([sizes(got)[s] for s in range(shards)]), sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(shards - 1):
        assert abs(upto[s] - total * (s + 1) / shards) <= sharding.TOLERANCE * total / (shards * parts) + most


def test_repeated_rows_are_cut(spark):
    """A third of the rows are one row, which is longer than the others."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same words " * 28).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.lit(1).alias("key"), F.lit(2).alias("tie"))
    got = sharding.shard(df, 40).collect()
    by = sizes(got)
    assert len(by) == 40 and len(got) == 9000
    assert max(by.values()) <= 1.05 * sum(by.values()) / 40 and min(by.values()) >= 0.95 * sum(by.values()) / 40


def test_only_repeated_rows(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    by = sizes(sharding.shard(df, 8, 2).collect())
    assert len(by) == 8 and max(by.values()) <= 1.06 * min(by.values())


def test_one_long_row_is_not_cut(spark):
    df = spark.createDataFrame([(i, "y" * (100_000 if i == 50 else 10)) for i in range(300)], "doc_id long, text string")
    got = sharding.shard(df, 4, 2).collect()
    assert len(got) == 300 and all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(4))


def test_ranges_of_cuts():
    cuts = sorted([(5, 0), (9, 10), (9, 20), (12, 0)])
    key, tie = np.array([4, 5, 9, 9, 9, 9, 10, 12]), np.array([99, 0, 9, 10, 19, 20, 0, 0])
    assert sharding.range_of(cuts, key, tie).tolist() == [0, 1, 1, 2, 2, 3, 3, 4]
