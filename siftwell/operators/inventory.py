"""Inventories: pairing of files, reconciliation of two listings, conditional upserts, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written


def pair(rows: DataFrame, keys: list[str], kind: str, order: list[str], first: str, second: str, value: str) -> DataFrame:
    """(keys, first, second): the first row of either kind by key, paired; every other row stands alone with a null partner."""
    w = Window.partitionBy(*keys, kind).orderBy(*order)
    ranked = rows.where(F.col(kind).isin(first, second)).withColumn("_r", F.row_number().over(w))
    at = lambda k: F.max(F.when(F.col(kind) == k, F.col(value)))
    paired = ranked.where("_r = 1").groupBy(*keys).agg(at(first).alias(first), at(second).alias(second))
    rest = ranked.where("_r > 1").select(*keys, F.when(F.col(kind) == first, F.col(value)).alias(first), F.when(F.col(kind) == second, F.col(value)).alias(second))
    return paired.unionByName(rest)


def collisions(rows: DataFrame, stem: str, path: str) -> DataFrame:
    """rows with asset: the stem, and two underscores and ten digits of the path's SHA-256 where other rows share the stem."""
    n = rows.groupBy(F.col(stem).alias("_s")).agg((F.count("*") > 1).alias("_many"))
    name = F.when(F.col("_many"), F.concat(F.col(stem), F.lit("__"), F.substring(F.sha2(F.col(path), 256), 1, 10))).otherwise(F.col(stem))
    return rows.join(n, F.col(stem) == F.col("_s")).withColumn("asset", name).drop("_s", "_many")


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added and removed keys of two inventories, each once."""
    added = after.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(before.select(key).distinct().join(after.select(key), key, "left_anti").withColumn("change", F.lit("removed")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and new by key; a field that new gives replaces the old one, a null leaves it. origin: old, new or both."""
    fields = [c for c in old.columns if c != key]
    a = old.select(F.col(key).alias("_a"), *(F.col(c).alias(f"_a_{c}") for c in fields))
    b = new.select(F.col(key).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in fields))
    out = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    origin = F.when(F.col("_b").isNull(), "old").when(F.col("_a").isNull(), "new").otherwise("both")
    return out.select(F.coalesce("_b", "_a").alias(key), *(F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) for c in fields), origin.alias("origin"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows that break a rule, with the names of all that they break; an unknown outcome is a breach."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.withColumn("broken", broken).where(F.size("broken") > 0)


def required(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows, once it is known that none breaks a rule; else an error that shows a few."""
    bad = violations(rows, rules).limit(5).collect()
    if bad:
        raise ValueError(f"rules broken: {bad}")
    return rows


def snapshot(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table of their own in the shared folder."""
    return written(rows, name)


def keep_manual(automatic: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """Automatic rows beside manual ones; where both have a key the manual row stays."""
    return manual.unionByName(automatic.join(manual.select(key), key, "left_anti"))


def memberships(rows: DataFrame, store: str, asset: str, group: str) -> DataFrame:
    """Rows of stores that are valid as a whole: one with an asset twice, or a blank asset or group, gives none of its rows."""
    each = rows.groupBy(store, asset).agg(F.count("*").alias("_n"), F.bool_and(F.coalesce(F.trim(F.col(asset).cast("string")) != "", F.lit(False)) & F.col(group).isNotNull()).alias("_ok"))
    good = each.groupBy(store).agg(F.bool_and((F.col("_n") == 1) & F.col("_ok")).alias("_ok")).where("_ok").select(store)
    return rows.join(good, store, "left_semi")


def relocated(sources: DataFrame, found: DataFrame, path: str, old: str, new: str, stamp: list[str]) -> DataFrame:
    """sources with now and status: those under the folder `old` are rebased to `new`, verified by their stamp among found (path, stamp).

    moved with the same stamp, changed with another, missing without a file; paths elsewhere are outside and stay.
    """
    here = F.col(path).startswith(old)
    out = sources.withColumn("now", F.when(here, F.concat(F.lit(new), F.substring(F.col(path), F.lit(len(old) + 1), F.length(path)))).otherwise(F.col(path)))
    f = found.select(F.col(path).alias("_f"), *(F.col(c).alias(f"_f_{c}") for c in stamp))
    same = F.lit(True)
    for c in stamp:
        same = same & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
    status = F.when(~here, "outside").when(F.col("_f").isNull(), "missing").when(same, "moved").otherwise("changed")
    return out.join(f, F.col("now") == F.col("_f"), "left").select(*sources.columns, "now", status.alias("status"))


def session(saved: DataFrame, files: DataFrame, key: str, stamp: str, keep_missing: bool = False) -> DataFrame:
    """saved rows with stale: their stamp is not that of files (key, stamp). Rows without a file go, or stay as stale with keep_missing."""
    f = files.select(F.col(key).alias("_f"), F.col(stamp).alias("_s"))
    out = saved.join(f, F.col(key) == F.col("_f"), "left" if keep_missing else "inner")
    return out.withColumn("stale", ~F.coalesce(F.col(stamp) == F.col("_s"), F.lit(False))).drop("_f", "_s")


def exported(rows: DataFrame, target: str, rating: str) -> DataFrame:
    """(target, ratings, problem): a target named twice or without a rating is a problem, and nothing may be written while there is one."""
    out = rows.groupBy(target).agg(F.count("*").alias("ratings"), F.bool_and(F.col(rating).isNotNull()).alias("_ok"))
    return out.select(target, "ratings", F.when(F.col("ratings") > 1, "repeated").when(~F.col("_ok"), "unrated").alias("problem"))


def unequal(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(key, only): keys of one side alone, `left` or `right`; two sets are equal if there is none. Repeats don't count, nulls are equal."""
    both = a.select(*key, F.lit(1).alias("_s")).unionByName(b.select(*key, F.lit(2).alias("_s")))
    sides = both.groupBy(*key).agg(F.bit_or("_s").alias("_s")).where("_s < 3")
    return sides.select(*key, F.when(F.col("_s") == 1, "left").otherwise("right").alias("only"))


def repeated_names(rows: DataFrame, path: str) -> DataFrame:
    """(name, n): file names, in lower case, that more than one path ends in."""
    name = F.lower(F.element_at(F.split(F.col(path), "/"), -1))
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def refreshed(cache: DataFrame, sources: DataFrame, key: str, stamp: str, derive) -> DataFrame:
    """cache rows (key, stamp, ...) whose source still has their stamp, and derive(rows) of sources that have none.

    derive takes the sources that changed or are new, whole rows, and returns the columns of cache: only they are
    computed. Rows of sources that are gone go too.
    """
    now = sources.select(F.col(key).alias("_k"), F.col(stamp).alias("_s"))
    current = cache.join(now, (F.col(key) == F.col("_k")) & (F.col(stamp) == F.col("_s")), "left_semi")
    known = cache.select(F.col(key).alias("_k"), F.col(stamp).alias("_s"))
    todo = sources.join(known, (F.col(key) == F.col("_k")) & (F.col(stamp) == F.col("_s")), "left_anti")
    return current.unionByName(derive(todo).select(*cache.columns))


def work(mode: str, dirty: Column, stale: Column, valid: Column, pending: Column, new: Column) -> Column:
    """Which rows a run in a mode takes: changed ones, those to be checked, new ones or all. Unknown flags count as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    of = {"rescan": yes(dirty) | yes(stale), "focus": ~yes(valid) & yes(pending), "new": yes(new), "scan": F.lit(True)}
    if mode not in of:
        raise ValueError(f"no mode {mode!r}")
    return of[mode]
