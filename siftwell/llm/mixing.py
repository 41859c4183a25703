"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, table, unwrapped, word_count, wrapped, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: A document's inclusion grows with this power of its size class (the whole logarithm of its size, of CLASSES at most).
GROWTH, CLASSES = 0.25, 48
#: Bits of a rank, and of the intervals in which words are counted: STEP bits at a time, LEVELS times.
BITS, STEP, LEVELS = 48, 12, 2
#: Documents a source that may fill what its cut leaves open.
FILLS = 2
#: Bytes up to which the rows that describe sources, one each, are broadcast; beyond, Spark joins by exchange.
BROADCAST_BYTES = 32 << 20


def _levelled(rows: DataFrame, by: list[str], total: Column) -> DataFrame:
    """rows (weight, cap, ...) with `amount`: total split by weight within `by`, none above its cap and the excess split again.

    The rows that reach their caps are those of least cap by weight, so one ordered pass finds the level.
    """
    every = Window.partitionBy(*by)
    up = Window.partitionBy(*by).orderBy("_full", "weight").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_full", F.col("cap") / F.col("weight"))
    before = lambda c: F.coalesce(F.sum(c).over(up), F.lit(0.0))
    out = out.withColumn("_stops", (total - before("cap")) / (F.sum("weight").over(every) - before("weight")) >= F.col("_full"))
    spent = lambda c: F.sum(F.when(F.col("_stops"), F.col(c)).otherwise(0.0)).over(every)
    level = F.coalesce((total - spent("cap")) / F.nullif(F.sum("weight").over(every) - spent("weight"), F.lit(0.0)), F.lit(0.0))
    return out.withColumn("amount", F.when(F.col("_stops"), F.col("cap")).otherwise(F.least(F.col("weight") * level, "cap"))).drop("_full", "_stops")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with target, one row a source.

    Sources by code point, null last, take the weights in turn and split share x all sizes by them. A target
    stops at most x its source's size and the excess goes to the rest by weight until none is above. A window over all
    sources, not over their documents, finds this. No sources: no rows.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("double")).withColumn("cap", F.col("source_size") * float(most))
    out = _levelled(out, [], F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
    return out.select("source", "source_size", F.col("amount").alias("target"))


def size_class(size: Column) -> Column:
    """The whole logarithm of a size to the base 2; -1 for an empty document."""
    return F.when(size > 0, F.least(F.length(F.bin(size)) - 1, F.lit(CLASSES - 1))).otherwise(-1)


def _order(inclusion: Column, seed: int) -> Column:
    """Pareto rank as a whole number: random odds divided by inclusion odds, mapped from (0, inf) to BITS bits."""
    u = (F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.lit(1 << 50)) + 0.5) / F.lit(float(1 << 50))
    p = F.least(F.greatest(inclusion, F.lit(1e-9)), F.lit(1 - 1e-9))
    q = (u / (1 - u)) / (p / (1 - p))
    return F.floor(q / (1 + q) * F.lit(float((1 << BITS) - 1))).cast("long")


def _join(rows: DataFrame, per_source: DataFrame, small: bool) -> DataFrame:
    right = per_source.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _left(rows: DataFrame, found: DataFrame) -> DataFrame:
    right = found.withColumnRenamed("source", "_source")
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def inclusions(rows: DataFrame, **how) -> DataFrame:
    """(source, source_size, target, copies, need), a row a source; copies[c] is how often a document of size class c is expected.

    Expected copies grow with size^GROWTH and stop at MOST; expected words sum up to the target. Whole parts are certain copies; need is what the
    certain ones leave of the target. A source without words has target 0.
    """
    classes = kept(rows.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words")))
    sizes = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), **how)
    most = how.get("most", MOST)
    own = _left(classes.where("class >= 0"), sizes).withColumn("weight", F.col("words") * F.pow(F.lit(2.0), GROWTH * F.col("class"))).withColumn("cap", F.col("words") * float(most))
    own = _levelled(own, ["source"], F.col("target")).withColumn("each", F.col("amount") / F.col("words"))
    each = own.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("class", "each"))).alias("each"), F.sum(F.floor("each") * F.col("words")).alias("certain"))  # CLASSES entries at most
    out = _left(sizes, each)
    copies = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: F.coalesce(F.element_at("each", c), F.lit(0.0)))
    return out.select("source", "source_size", "target", copies.alias("copies"), F.round(F.col("target") - F.coalesce("certain", F.lit(0))).cast("long").alias("need"))


def _expected() -> Column:
    return F.when(F.col("size") > 0, F.get("copies", size_class(F.col("size")))).otherwise(0.0)


def cuts(ranked: DataFrame, needs: DataFrame, small: bool, fills: int = FILLS) -> DataFrame:
    """(source, cut, picks): the extra copies are those of rank up to cut, and of the ranks in picks.

    A cut is the last rank up to which the words of ranked (source, size, rank) stay within the source's need, found by exact word counts
    of rank intervals that narrow 4096 fold twice, so that no source is sorted whole. What a cut leaves open, less than
    the next document, then goes to the largest one that fits, `fills` times; equal sizes: the first in Pareto order.
    """
    now = needs.select("source", "need", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("base"))
    for level in range(1, LEVELS + 1):
        shift = BITS - STEP * level
        inside = _join(ranked, now, small).where(F.shiftright("rank", shift + STEP) == F.col("at"))
        sums = inside.groupBy("source", "need", "base", F.shiftright("rank", shift).alias("bin")).agg(F.sum("size").alias("words"))
        upto = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("need"))
        now = over.groupBy("source").agg(F.min_by(F.struct("need", F.col("bin").alias("at"), (F.col("upto") - F.col("words")).alias("base")), "bin").alias("s")).select("source", "s.*")
        now = kept(now)  # one row a source
    last = _join(ranked, now, small).where(F.shiftright("rank", shift) == F.col("at"))
    last = last.withColumn("upto", F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("rank"))).where(F.col("upto") <= F.col("need"))  # equal ranks together
    found = _left(now, last.groupBy("source").agg(F.max("rank").alias("cut"), F.max("upto").alias("got"))).select("source", F.coalesce("cut", F.shiftleft("at", shift) - 1).alias("cut"), (F.col("need") - F.coalesce("got", "base")).alias("open"))
    # without a cut every document fits
    state = kept(_left(needs.select("source"), found).select("source", F.coalesce("cut", F.lit((1 << BITS) - 1)).alias("cut"), F.coalesce("open", F.lit(0)).alias("open"), F.expr("cast(array() as array<bigint>)").alias("picks")))
    for _ in range(fills):
        fit = _join(ranked, state.where("open > 0"), small).where((F.col("rank") > F.col("cut")) & (F.col("size") <= F.col("open")) & ~F.array_contains("picks", F.col("rank")))
        best = fit.groupBy("source").agg(F.max(F.struct("size", (-F.col("rank")).alias("rank"))).alias("best"))
        state = kept(_left(state, best).select("source", "cut", (F.col("open") - F.coalesce("best.size", F.lit(0))).alias("open"), F.when(F.col("best").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array(-F.col("best.rank")))).alias("picks")))
    return state.select("source", "cut", "picks")


def sample(rows: DataFrame, seed: int = 0, **how) -> DataFrame:
    """rows (doc_id, tie, source, size, ...) with source_size, target, copies.

    A document's expected copies depend on its source's target and on its size (inclusions()). It gets their whole part,
    and one more if it is among the first of its source in Pareto order: random odds divided by the odds of the rest. Empty documents
    get none. A null source is a source; rows equal in doc_id and tie rank alike and are chosen together, by so much a source may pass its
    target. A rank depends on doc_id, tie and seed only, so reruns agree. No rows: no result.
    """
    own = ["doc_id", "tie", "source", "size"]
    narrow = rows if set(rows.columns) == set(own) else written(rows.select(*own), "sizes")  # whatever else rows hold is read once more only
    per_source = kept(inclusions(narrow, **how))
    n, names = per_source.agg(F.count("*"), F.sum(F.octet_length("source"))).first()
    small = n * (64 + 8 * CLASSES) + (names or 0) <= BROADCAST_BYTES
    extra = _expected() - F.floor(_expected())
    ranked = _join(narrow.where("size > 0"), per_source.select("source", "copies"), small).where(extra > 0).select("source", "size", _order(extra, seed).alias("rank"))
    ranked = written(ranked, "ranked")
    plan = kept(_left(per_source.drop("need"), cuts(ranked, per_source.select("source", "need"), small)))
    out = _join(rows, plan, small)
    chosen = (extra > 0) & ((_order(extra, seed) <= F.col("cut")) | F.array_contains("picks", _order(extra, seed)))
    return out.withColumn("copies", F.floor(_expected()).cast("int") + F.when(chosen, 1).otherwise(0)).drop("cut", "picks")


def _sizes(text: str) -> list[Column]:
    return [word_count(F.col(text)).alias("size"), F.crc32(F.encode(F.col(text), "UTF-8")).alias("tie")]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those that it does not take go (empty ones do, as they have no words)."""
    rows = wrapped(docs, "doc_id", "source", *_sizes("text"))
    got = sample(rows).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unwrapped(got, docs.columns)


def op10_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the whole of `documents`: see sample(). Texts are read once, for their sizes."""
    rows = written(table(spark, sf_dir, "documents").select("doc_id", "source", *_sizes("text")), "sizes")
    return sample(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
