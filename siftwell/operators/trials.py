"""Trials against known truth: clusterings by pairs that are never listed, recognition by a gallery and probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written

#: References of a gallery that a task compares at once.
BLOCK = 1024
#: Scores are compared by so many decimals.
DIGITS = 9


def pair_scores(rows: DataFrame, by: list[str], cluster: str, truth: str) -> DataFrame:
    """(by, pairs, tp, fp, fn, tn, precision, recall, f1): of all pairs of rows, which a clustering puts together and which belong together.

    Pairs come from counts: n rows of a cell of the table of clusters and truths are n (n - 1) / 2 of them, so one pass counts the cells, the clusters, the truths and
    the whole, and a cluster of any size is a number. A row without a cluster is alone in one; rows without truth don't count. Counts are decimals, as they
    grow with the square. A share of nothing is null.
    """
    known = rows.where(F.col(truth).isNotNull()).select(*by, F.col(cluster).alias("_c"), F.col(truth).alias("_t"))
    sets = [[*by, "_c", "_t"], [*by, "_c"], [*by, "_t"], by]
    cells = known.groupingSets([[F.col(c) for c in s] for s in sets], *by, "_c", "_t").agg(F.count("*").cast("decimal(19,0)").alias("_n"), F.grouping("_c").alias("_no_c"), F.grouping("_t").alias("_no_t"))
    two = (F.col("_n") * (F.col("_n") - 1) / 2).cast("decimal(38,0)")
    alone = F.col("_c").isNull() & (F.col("_no_c") == 0)
    total = lambda c, t: F.coalesce(F.sum(F.when((F.col("_no_c") == c) & (F.col("_no_t") == t) & ~alone, two)), F.lit(0).cast("decimal(38,0)"))
    out = cells.groupBy(*by).agg(total(1, 1).alias("pairs"), total(0, 0).alias("tp"), total(0, 1).alias("_together"), total(1, 0).alias("_same"))
    out = out.withColumns({"fp": F.col("_together") - F.col("tp"), "fn": F.col("_same") - F.col("tp")})
    out = out.withColumn("tn", F.col("pairs") - F.col("tp") - F.col("fp") - F.col("fn"))
    share = lambda a, b: a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    rates = {"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)}
    return out.select(*by, *(F.col(c).cast("decimal(38,0)").alias(c) for c in ("pairs", "tp", "fp", "fn", "tn")), *(e.alias(n) for n, e in rates.items()))


def gallery_split(rows: DataFrame, subject: str, image: str, references: int, seed: int) -> DataFrame:
    """rows with part: `reference` for the first `references` images of each subject in seeded order, else `probe`. Rank limits apply before the exchange.

    Rows without a subject have no part. A subject of no more images than that has no probe.
    """
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(image).cast("string")), 256)
    ranked = rows.where(F.col(subject).isNotNull()).select(image, F.row_number().over(Window.partitionBy(subject).orderBy(order, image)).alias("_r")).where(F.col("_r") <= references)
    chosen = ranked.select(F.col(image).alias("_image")).distinct()
    part = F.when(F.col(subject).isNull(), F.lit(None)).when(F.col("_image").isNotNull(), "reference").otherwise("probe")
    return rows.join(chosen, F.col(image) == F.col("_image"), "left").withColumn("part", part).drop("_image")


def leaks(rows: DataFrame, digest: str) -> DataFrame:
    """(digest, references, probes): contents that stand on both sides, which a trial must not have."""
    side = lambda p: F.count_if(F.col("part") == p)
    return rows.groupBy(digest).agg(side("reference").alias("references"), side("probe").alias("probes")).where("references > 0 and probes > 0")


def recognised(rows: DataFrame, subject: str, image: str, vector: str) -> DataFrame:
    """(image, subject, own, other, other_score, rank) of every probe of rows (part, ...): its best cosine with its own subject's references, the best other subject, and its subject's place.

    A subject's score is that of its best reference; of equal ones the least subject counts as better, but never better than the probe's own. The gallery stands in the shared folder, ordered by subject, and every task reads it in
    blocks against its batch of probes, twice: once for the best, once for how many are better. So a probe is one row however large the gallery. A probe whose subject has no
    reference has no own score and no place; a vector of no length scores nothing.
    """
    import pyarrow.dataset as ds
    from pyarrow import fs

    names = rows.where("part = 'reference'").select(F.col(subject).alias("s"), F.col(vector).cast("array<double>").alias("v"))
    gallery = written(names.repartitionByRange("s").sortWithinPartitions("s"), "gallery")
    files = sorted(gallery.inputFiles())

    def unit(vectors) -> np.ndarray:
        m = np.array([np.asarray(v, "float64") for v in vectors])
        length = np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m
        return np.divide(m, length, out=np.full_like(m, -np.inf), where=length > 0) if len(m) else m

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(subjects, unit vectors), a subject's references never in two blocks: what may go on is held back."""
        held_s, held_v = [], []
        for file in files:
            store, path = fs.FileSystem.from_uri(file)
            for block in ds.dataset(path, filesystem=store, format="parquet").to_batches(batch_size=BLOCK):
                held_s += block["s"].to_pylist()
                held_v += block["v"].to_pylist()
                whole = next((i for i in range(len(held_s) - 1, 0, -1) if held_s[i] != held_s[i - 1]), 0)
                if whole:
                    yield np.array(held_s[:whole]), unit(held_v[:whole])
                    held_s, held_v = held_s[whole:], held_v[whole:]
        if held_s:
            yield np.array(held_s), unit(held_v)

    def best(probes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s, v in blocks():
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            with np.errstate(invalid="ignore"):
                score = np.nan_to_num(np.round(probes @ v.T, DIGITS), nan=-np.inf)
            yield s[first], np.maximum.reduceat(score, first, axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            n, mine, probes = len(pdf), pdf["s"].to_numpy(), unit(pdf["v"])
            own, top, who, better = np.full(n, -np.inf), np.full(n, -np.inf), np.full(n, None, object), np.zeros(n, np.int64)
            for s, score in best(probes):
                is_own = mine[:, None] == s[None]
                own = np.maximum(own, np.where(is_own, score, -np.inf).max(1))
                others = np.where(is_own, -np.inf, score)
                at = others.argmax(1)
                value = others[np.arange(n), at]
                who, top = np.where(value > top, s[at], who), np.maximum(top, value)
            for s, score in best(probes):
                better += ((mine[:, None] != s[None]) & (score > own[:, None])).sum(1)
            known, beside = np.isfinite(own), np.isfinite(top)
            yield pd.DataFrame({image: pdf["k"], subject: pdf["s"], "own": np.where(known, own, np.nan), "other": [w if b else None for w, b in zip(who, beside, strict=True)], "other_score": np.where(beside, top, np.nan), "rank": pd.array(np.where(known, better + 1, -1), "Int64")}).replace({"rank": {-1: pd.NA}})

    kind = lambda c: rows.schema[c].dataType.simpleString()
    probes = rows.where("part = 'probe'").select(F.col(image).alias("k"), F.col(subject).alias("s"), F.col(vector).alias("v"))
    got = probes.mapInPandas(run, f"`{image}` {kind(image)}, `{subject}` {kind(subject)}, own double, other {kind(subject)}, other_score double, rank long")
    return got.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("own", "other_score")})


def top_ranks(trial: DataFrame, most: int = 4) -> DataFrame:
    """(probes, top1 ... top<most>, unranked): how many probes have their subject among the first. One aggregation."""
    rank = F.col("rank")
    return trial.agg(F.count("*").alias("probes"), *(F.count_if(rank <= k).alias(f"top{k}") for k in range(1, most + 1)), F.count_if(rank.isNull()).alias("unranked"))


def swept(trial: DataFrame, bins: int = 20, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """(threshold, accepted, correct, false, missed) at the lower edges of equal bins of scores from lo to hi: what a trial gives that names its best subject at or above the threshold.

    A named subject is correct if it is the probe's own; with its subject's references gone it names the best other one: `false` counts those, over all probes. missed are probes whose own score lies below. Scores
    are counted by bin once and cumulated over bins, so a threshold costs no pass; scores beyond lo and hi belong to the end bins.
    """
    at = lambda c: F.when(c.isNotNull(), F.least(F.greatest(F.floor((c - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int"))
    own, other = F.col("own"), F.col("other_score")
    named = F.greatest(own, other)
    each = F.explode(F.array(F.struct(at(named).alias("bin"), F.lit("accepted").alias("what")), F.struct(F.when(F.coalesce(own >= other, own.isNotNull()), at(own)).alias("bin"), F.lit("correct").alias("what")), F.struct(at(other).alias("bin"), F.lit("false").alias("what")), F.struct(at(own).alias("bin"), F.lit("own").alias("what"))))
    counts = trial.select(each.alias("e")).where("e.bin is not null").groupBy("e.bin").agg(*(F.count_if(F.col("e.what") == w).alias(w) for w in ("accepted", "correct", "false", "own")))
    grid = trial.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    upwards = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # over bins
    total = lambda w: F.sum(F.coalesce(w, F.lit(0))).over(upwards)
    filled = grid.join(counts, "bin", "left").select("bin", *(total(w).alias(w) for w in ("accepted", "correct", "false", "own")))
    probes = trial.agg(F.count("*").alias("_n"))
    return filled.join(F.broadcast(probes)).select((F.lit(lo) + F.col("bin") * ((hi - lo) / bins)).alias("threshold"), "accepted", "correct", "false", (F.col("_n") - F.col("own")).alias("missed"))
