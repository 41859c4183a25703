"""Ranking of candidates against a few references of a person: thresholds, penalties, suppression and margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..functions.vectors import cosine
from .folds import fold

#: Eligibility on positive evidence, weight of the detector, penalty of negatives, overlap, candidates, references; margins of appearances and of identities.
ELIGIBLE, DETECTOR, PENALTY, OVERLAP, MOST, REFERENCES = 0.46, 0.10, 0.15, 0.38, 8, 6
AMBIGUOUS, MARGIN = 0.065, 0.05


def threshold(references: Column) -> Column:
    """The least likeness that counts, by the number of references; none for no references or over six."""
    return F.when(references == 1, 0.52).when(references.between(2, 3), 0.53).when(references.between(4, REFERENCES), 0.56)


def scored(candidates: DataFrame, references: DataFrame, person: str, eligible: float = ELIGIBLE) -> DataFrame:
    """candidates (person, candidate, vector, confidence) with appearance, reference, score and reasons: those whose best likeness to
    a positive reference (person, ref, vector, positive), mixed with the detector's, is `eligible` or more.

    At most REFERENCES of either sign count, the first by ref, so a candidate meets a bounded number of them.
    Likeness to a negative one lowers the score, but never what is eligible.
    """
    w = Window.partitionBy(person, "positive").orderBy("ref")
    few = references.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= REFERENCES).select(F.col(person).alias("_p"), "ref", F.col("vector").alias("_v"), "positive")
    likeness = candidates.join(few, F.col(person) == F.col("_p")).withColumn("_s", cosine(F.col("vector"), F.col("_v")))
    of = lambda sign, what: what(F.when(F.col("positive") == sign, F.struct("_s", (-F.col("ref")).alias("_r"))))
    best = likeness.groupBy(person, "candidate").agg(of(True, F.max).alias("_best"), F.max(F.when(~F.col("positive"), F.col("_s"))).alias("_worst"))
    out = candidates.join(best, [person, "candidate"]).withColumn("appearance", F.col("_best._s")).withColumn("reference", -F.col("_best._r"))
    positive = (1 - DETECTOR) * F.col("appearance") + DETECTOR * F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    out = out.withColumn("_positive", positive).where(F.col("_positive") >= eligible)
    reasons = F.array_compact(F.array(F.when(F.col("_positive") < eligible + AMBIGUOUS, "near_threshold"), F.when(F.col("_worst") >= F.col("appearance"), "negative_conflict")))
    return out.withColumn("score", F.greatest(F.col("_positive") - PENALTY * F.coalesce("_worst", F.lit(0.0)), F.lit(0.0))).withColumn("reasons", reasons).drop("_best", "_worst", "_positive")


def ranked(found: DataFrame, keys: list[str], order: list[str], least: float = OVERLAP, most: int = MOST) -> DataFrame:
    """found (keys, box, score, ...) without those that overlap a better one, at most `most` a key, with rank and ambiguous.

    The state of a key is the boxes that stay, so it is bounded whatever the number of candidates.
    """

    def step(kept: list, values: tuple) -> int:
        x, y, w, h = values
        if len(kept) >= most:
            return 0
        for a, b, c, d in kept:
            shared = max(0.0, min(x + w, a + c) - max(x, a)) * max(0.0, min(y + h, b + d) - max(y, b))
            if shared >= least * (w * h + c * d - shared):
                return 0
        kept.append(values)
        return len(kept)

    flat = found.select("*", *(F.col(f"box.{c}").alias(f"_{c}") for c in "xywh"), (-F.col("score")).alias("_falling"))
    out = fold(flat, keys, ["_falling", *order], list, step, ["_x", "_y", "_w", "_h"], "rank", "integer").where("rank > 0")
    w = Window.partitionBy(*keys).orderBy("rank")
    close = (F.col("rank") == 1) & F.coalesce(F.lead("score").over(w) >= F.col("score") - AMBIGUOUS, F.lit(False))
    return out.withColumn("ambiguous", close).drop("_x", "_y", "_w", "_h", "_falling")


def apart(boxes: DataFrame, others: DataFrame, key: str, least: float) -> DataFrame:
    """boxes (key, box, ...) that overlap none of the others (key, box) of their key by `least` or more: fallback detections beside better ones."""
    o = others.select(F.col(key).alias("_k"), F.col("box").alias("_o"))
    return boxes.join(o, (F.col(key) == F.col("_k")) & (iou(F.col("box"), F.col("_o")) >= least), "left_anti")


def identities(faces: DataFrame, references: DataFrame, person: str, consistent: float = 0.52) -> DataFrame:
    """(person, candidate, score, reference, reasons) of every face (person, candidate, vector) against its person's references
    (person, ref, vector, positive): the best positive one, with what speaks against it.

    below_threshold: under the limit for that number of references; negative: a negative one comes near; inconsistent: two
    positive references differ; close: the best face of a person leads the second by less than MARGIN. Faces of a person without references stay, without a score.
    """
    w = Window.partitionBy(person, "positive").orderBy("ref")
    few = references.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= REFERENCES)
    refs = few.groupBy(F.col(person).alias("_p")).agg(F.expr("array_sort(collect_list(struct(ref, vector)) filter (where positive))").alias("_pos"), F.expr("collect_list(vector) filter (where not positive)").alias("_neg"))
    differs = F.exists("_pos", lambda a: F.exists("_pos", lambda b: (a["ref"] < b["ref"]) & (cosine(a["vector"], b["vector"]) < consistent)))
    refs = refs.withColumn("_differs", differs)
    likeness = F.transform("_pos", lambda r: F.struct(F.round(cosine(F.col("vector"), r["vector"]), 9).alias("s"), (-r["ref"]).alias("r")))
    out = faces.join(refs, F.col(person) == F.col("_p"), "left").withColumn("_best", F.array_max(likeness)).withColumn("_worst", F.array_max(F.transform("_neg", lambda v: F.round(cosine(F.col("vector"), v), 9))))
    out = out.withColumn("score", F.col("_best.s")).withColumn("reference", -F.col("_best.r"))
    limit = threshold(F.size("_pos"))
    order = Window.partitionBy(person).orderBy(F.desc_nulls_last("score"), "candidate")
    out = out.withColumn("_first", F.row_number().over(order) == 1).withColumn("_next", F.lead("score").over(order))
    reasons = F.array_compact(F.array(F.when(F.col("_differs"), "inconsistent"), F.when(F.col("score") < limit, "below_threshold"), F.when((F.col("_worst") >= limit) | (F.col("_worst") >= F.col("score") - MARGIN), "negative"), F.when(F.col("_first") & (F.col("score") - F.col("_next") < MARGIN), "close")))
    return out.select(person, "candidate", "score", "reference", reasons.alias("reasons"))


def without_tombstones(samples: DataFrame, tombstones: DataFrame, identity: list[str]) -> DataFrame:
    """samples whose identity was never removed; null parts of an identity are equal."""
    t = tombstones.select(*(F.col(c).alias(f"_t_{c}") for c in identity)).distinct()
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    return samples.join(t, same, "left_anti")
