"""Change logs: replay, gaps, revisions and small state machines, as aggregations over the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import group_digests


def replay(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The latest patch of each key. A max_by, so a hot key is combined before the exchange."""
    rest = [c for c in log.columns if c not in (*keys, seq)]
    return log.groupBy(*keys).agg(F.max(seq).alias(seq), F.max_by(F.struct(*rest), seq).alias("_p")).select(*keys, seq, "_p.*")


def merged(log: DataFrame, keys: list[str], seq: str, fields: list[str]) -> DataFrame:
    """Each field's latest value that is not null, by key: patches that leave a field out don't clear it."""
    last = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f)
    return log.groupBy(*keys).agg(F.max(seq).alias(seq), *map(last, fields))


def gaps(log: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, after, before, missing): where the sequence of a key jumps. A repeated number is no gap."""
    w = Window.partitionBy(key).orderBy(seq)
    out = log.select(key, seq).distinct().withColumn("_next", F.lead(seq).over(w))
    return out.where(F.col("_next") > F.col(seq) + 1).select(key, F.col(seq).alias("after"), F.col("_next").alias("before"), (F.col("_next") - F.col(seq) - 1).alias("missing"))


def conflicts(log: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, payloads): sequence numbers that were written with more than one payload; equal repeats are harmless."""
    return log.groupBy(*keys).agg(F.countDistinct(F.coalesce(payload, F.lit(""))).alias("payloads")).where("payloads > 1")


def append(log: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """log and those rows of patch whose keys it lacks: appending again changes nothing."""
    return log.unionByName(patch.dropDuplicates(keys).join(log.select(*keys), keys, "left_anti"))


def outcome(log: DataFrame, key: str, order: list[str], begins: Column, ends: Column, state: Column) -> DataFrame:
    """(key, started, outcome): for each key its last beginning, and the first ending after it; none is 'pending', no beginning null."""
    at = F.struct(*order)
    started = log.groupBy(F.col(key).alias("_k")).agg(F.max(F.when(begins, at)).alias("_s"))
    after = log.join(started, F.col(key) == F.col("_k")).where(ends & (at > F.col("_s")))
    first = after.groupBy("_k").agg(F.min_by(state, at).alias("_o"))
    out = started.join(first, "_k", "left")
    return out.select(F.col("_k").alias(key), F.col(f"_s.{order[0]}").alias("started"), F.when(F.col("_s").isNotNull(), F.coalesce("_o", F.lit("pending"))).alias("outcome"))


def stale_groups(members: DataFrame, group: str, member: str, now: Column, stored: DataFrame) -> DataFrame:
    """(group, stale): whether a group's digest, as group_digests() makes it for groups of any size, differs from the stored (group, digest); one never stored is stale."""
    current = group_digests(members, group, F.col(member), now).withColumnRenamed("digest", "_now")
    return current.join(stored, group, "left").select(group, (~F.coalesce(F.col("_now") == F.col("digest"), F.lit(False))).alias("stale"))


def self_times(spans: DataFrame, key: str, parent: str, elapsed: str) -> DataFrame:
    """spans with own: their time less that of their children, 0 at least."""
    inner = spans.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_p")).agg(F.sum(elapsed).alias("_in"))
    return spans.join(inner, F.col(key) == F.col("_p"), "left").withColumn("own", F.greatest(F.col(elapsed) - F.coalesce("_in", F.lit(0.0)), F.lit(0.0))).drop("_p", "_in")


def operation_totals(rows: DataFrame, operations: str) -> DataFrame:
    """(operation, calls, seconds, photos, repeated) over a column map<string, struct<count, seconds>>: photos that used it, and that used it more than once."""
    each = rows.select(F.explode(operations).alias("operation", "o"))
    return each.groupBy("operation").agg(F.sum("o.count").alias("calls"), F.sum("o.seconds").alias("seconds"), F.count_if(F.col("o.count") > 0).alias("photos"), F.count_if(F.col("o.count") > 1).alias("repeated"))


def history(log: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """(keys, value, versions, before): the latest value, how many there were and the digest of those before it, oldest first.

    Only the digest leaves the group, but a key's whole history meets in one row: keys are single photos.
    """
    every = F.array_sort(F.collect_list(F.struct(seq, value)))
    out = log.groupBy(*keys).agg(every.alias("_h"))
    old = F.array_join(F.transform(F.slice("_h", 1, F.size("_h") - 1), lambda h: F.coalesce(h[value].cast("string"), F.lit(""))), ",")
    return out.select(*keys, F.element_at("_h", -1)[value].alias(value), F.size("_h").alias("versions"), F.sha2(old, 256).alias("before"))
