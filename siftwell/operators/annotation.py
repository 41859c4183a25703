"""Registers of human ratings and of evaluation inputs: adjudication, status ladders, identities, disjoint splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .evaluation import latest
from .ranking import percentiles


def submitted(ratings: DataFrame, item: str, annotator: str, revision: str, status: str) -> DataFrame:
    """Each annotator's last rating of an item by revision, drafts aside; a withdrawn one removes them."""
    return latest(ratings.where(F.col(status).isin("submitted", "withdrawn")), [item, annotator], [revision]).where(F.col(status) == "submitted")


def adjudicated(ratings: DataFrame, adjudications: DataFrame, item: str, annotator: str, revision: str, status: str, field: str) -> DataFrame:
    """(item, raters, field, basis) of every item with a submitted rating.

    adjudications (item, revision, cites, field) settle an item if they cite exactly its
    submitted ratings, each as often as it stands there, and are later than its last change; of several the last counts. cites is an array of revisions, or one of them a row (null or an empty array cites none). Otherwise raters who agree
    give the value, and raters who don't leave it null: unresolved. Citations meet ratings as rows and are counted, so an item may have any number of raters.
    """
    now = submitted(ratings, item, annotator, revision, status)
    each = now.groupBy(item).agg(F.count("*").alias("raters"), F.countDistinct(F.coalesce(F.col(field).cast("string"), F.lit(""))).alias("_values"), F.min(field).alias("_v"))
    last = ratings.where(F.col(status).isin("submitted", "withdrawn")).groupBy(item).agg(F.max(revision).alias("_last"))
    state = each.join(last, item)
    single = isinstance(adjudications.schema["cites"].dataType, ArrayType)
    each_cited = adjudications.select(F.col(item).alias("_i"), F.col(revision).alias("_at"), F.col(field).alias("_f"), (F.explode_outer("cites") if single else F.col("cites")).alias("_c"))
    cited = each_cited.groupBy("_i", "_at", "_f", "_c").agg(F.count("_c").alias("_n"))
    current = now.groupBy(F.col(item).alias("_j"), F.col(revision).alias("_r")).agg(F.count("*").alias("_m"))
    met = cited.join(current, (F.col("_i") == F.col("_j")) & (F.col("_c") == F.col("_r")), "left")
    found = met.groupBy("_i", "_at", "_f").agg(F.sum(F.when(F.col("_n") == F.col("_m"), F.col("_m")).otherwise(0)).alias("_right"), F.sum("_n").alias("_all"))
    valid = state.join(found, F.col(item) == F.col("_i")).where((F.col("_right") == F.col("raters")) & (F.col("_all") == F.col("raters")) & (F.col("_at") > F.col("_last")))
    settled = valid.groupBy(F.col(item).alias("_i")).agg(F.max_by("_f", "_at").alias("_f"), F.lit(True).alias("_settled"))
    out = state.join(settled, F.col(item) == F.col("_i"), "left")
    agree = F.col("_values") == 1
    value = F.when(F.col("_settled"), F.col("_f")).when(agree, F.col("_v"))
    basis = F.when(F.col("_settled"), "adjudication").when(agree, "agreement").otherwise("unresolved")
    return out.select(item, "raters", value.alias(field), basis.alias("basis"))


def ladder(rungs: Sequence[tuple[str, str, Column]], ready: str = "ready") -> Column:
    """struct(status, problems): problems are the names of all (status, name, ok) that fail or are unknown, the status is that of the
    first of them, so rungs stand from the gravest down."""
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    status = F.coalesce(*(F.when(bad(ok), F.lit(s)) for s, _, ok in rungs), F.lit(ready))
    return F.struct(status.alias("status"), F.array_compact(F.array(*(F.when(bad(ok), F.lit(n)) for _, n, ok in rungs))).alias("problems"))


def identity(levels: Sequence[tuple[str, Column, Column]]) -> Column:
    """struct(level, id, version, problem): the first level with an (id, version) pair; half a pair there is a problem, and none at all too."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    nothing = F.struct(F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("version"), F.lit("missing").alias("problem"))
    out = nothing
    for name, i, v in reversed(levels):
        half = blank(i) | blank(v)
        pair = F.struct(F.lit(name).alias("level"), F.when(~half, i).alias("id"), F.when(~half, v).alias("version"), F.when(half, "incomplete").alias("problem"))
        out = F.when(i.isNotNull() | v.isNotNull(), pair).otherwise(out)
    return out


def filled(rows: DataFrame, known: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with missing fields from known (key, fields) and `conflicts`, the names of fields that both give differently; rows keep theirs."""
    k = known.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_k_{f}") for f in fields))
    out = rows.join(k, F.col(key) == F.col("_k"), "left")
    conflicts = F.array_compact(F.array(*(F.when(F.col(f) != F.col(f"_k_{f}"), F.lit(f)) for f in fields)))
    return out.withColumn("conflicts", conflicts).select(*(F.coalesce(c, f"_k_{c}").alias(c) if c in fields else F.col(c) for c in rows.columns), "conflicts")


def disjoint_split(subject: Column, shares: Sequence[tuple[str, float]]) -> Column:
    """The split of a row by the SHA-256 of its subject alone, so that no subject is in two; null subjects have none."""
    at = F.conv(F.substring(F.sha2(subject.cast("string"), 256), 1, 8), 16, 10).cast("long") / float(1 << 32)
    upto, out = 0.0, None
    for name, share in shares:
        upto += share
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return F.when(subject.isNotNull(), out.otherwise(shares[-1][0]))


def strata(rows: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """rows with stratum, from 0: how many of the group's n - 1 inner percentiles of value lie below. Null values have none."""
    cuts = percentiles(rows, [by], value, [i / n for i in range(1, n)]).select(F.col(by).alias("_b"), F.col("_p").alias("_cuts"))
    at = F.when(F.col(value).isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col(value))))
    return rows.join(cuts, F.col(by).eqNullSafe(F.col("_b")), "left").withColumn("stratum", at).drop("_b", "_cuts")


def codes(rows: DataFrame, key: str, reasons: str, catalog: list[str]) -> DataFrame:
    """(key, unknown): rows with reasons that the catalog lacks."""
    unknown = F.array_except(reasons, F.array(*map(F.lit, catalog)))
    return rows.select(key, unknown.alias("unknown")).where(F.size("unknown") > 0)


def statuses(samples: DataFrame, results: DataFrame, key: str, failure: str, current: Column) -> DataFrame:
    """(key, status): every sample ends in one: missing without a result, failed, stale or ok. A result seen twice is repeated."""
    r = results.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.max(failure).alias("_f"), F.bool_and(F.coalesce(current, F.lit(False))).alias("_c"))
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").when(F.col("_f").isNotNull(), "failed").when(~F.col("_c"), "stale").otherwise("ok")
    return samples.select(key).join(r, F.col(key) == F.col("_k"), "left").select(key, status.alias("status"))


def receipts(before: DataFrame, after: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, status): complete where an input's stamp is the same before and after a measurement; changed, or gone."""
    b, a = before.select(F.col(key).alias("_b"), F.col(stamp).alias("_sb")), after.select(F.col(key).alias("_a"), F.col(stamp).alias("_sa"))
    status = F.when(F.col("_a").isNull(), "gone").when(F.col("_sb") == F.col("_sa"), "complete").otherwise("changed")
    return b.join(a, F.col("_b") == F.col("_a"), "left").select(F.col("_b").alias(key), status.alias("status"))


def nearest_first(rows: DataFrame, group: list[str], position: str, reference: Column, located: Column) -> DataFrame:
    """Rows not yet located with turn, from 1: by distance from the group's reference position, then by position."""
    w = Window.partitionBy(*group).orderBy(F.abs(F.col(position) - reference), position)
    return rows.where(~F.coalesce(located, F.lit(False))).withColumn("turn", F.row_number().over(w))
