"""Exact ranks and percentiles of groups of any size: rows are dealt into ranges, which count for themselves.

A range knows how many rows come before it from the counts of the others, one number a range (and group), so neither a
group nor the whole table is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """rows in a table of their own with `_part`, the number of their range; equal keys are in one range."""
    return written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def row_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `name`, from 1 in the order of all; nulls first, rows that are equal in order in any order. No rows: no result."""
    placed = _ranged(rows, *order)
    before, so_far = {}, 0
    for part, n in sorted(tuple(r) for r in placed.groupBy("_part").count().collect()):  # one row a range
        before[part], so_far = so_far, so_far + n
    offset = F.element_at(F.map_from_arrays(F.array(*map(F.lit, before)), F.array(*map(F.lit, before.values()))), F.col("_part")) if before else F.lit(0)
    return placed.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + offset).drop("_part")


def running(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, _k, _upto, _n): of each group's different values how often they stand, how many rows are not above them, and the group's rows.

    A null or NaN value counts nowhere. Null is a group.
    """
    values = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.struct(*by, F.lit(0)).alias("_by"), F.col(value).alias(value)).agg(F.count("*").alias("_k"))
    placed = _ranged(values, "_by", value)
    sums = placed.groupBy("_by", "_part").agg(F.sum("_k").alias("_s"))
    group = Window.partitionBy("_by")
    sums = sums.select("_by", "_part", F.coalesce(F.sum("_s").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_s").over(group).alias("_n"))
    out = placed.join(sums, ["_by", "_part"]).withColumn("_upto", F.col("_before") + F.sum("_k").over(Window.partitionBy("_by", "_part").orderBy(value)))
    return out.select(*(F.col(f"_by.{c}").alias(c) for c in by), value, "_k", "_upto", "_n")


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, _p): each group's exact percentiles of value, interpolated between neighbours. Groups without values have no row."""
    at = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    found = lambda i: F.max(F.when((F.col("_upto") > i) & (F.col("_upto") - F.col("_k") <= i), F.col(value).cast("double")))

    def between(p: float) -> Column:
        low, high = found(F.floor(at(p))), found(F.ceil(at(p)))
        pos = (F.max("_n") - 1) * F.lit(float(p))
        return F.when(F.floor(pos) == F.ceil(pos), low).otherwise((F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high)

    return running(rows, by, value).groupBy(*by).agg(F.array(*map(between, shares)).alias("_p"))
