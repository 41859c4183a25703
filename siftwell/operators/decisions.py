"""Policies that turn states into keep, reject or review, and the precedence between who decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unanimous(state: Column, adequate: Column, clear: str, severe: str) -> Column:
    """Aggregate: all clear gives keep, all severe reject; none, any inadequate or unknown, or a mixture gives review."""
    sure = F.bool_and(F.coalesce(adequate, F.lit(False)))
    return F.when((F.count("*") == 0) | ~sure, "review").when(F.bool_and(state.eqNullSafe(F.lit(clear))), "keep").when(F.bool_and(state.eqNullSafe(F.lit(severe))), "reject").otherwise("review")


def any_severe(state: Column, adequate: Column, clear: list[str], severe: str) -> Column:
    """Aggregate: any severe and adequate part gives reject; all clear (or unseen) and adequate keep; the rest review."""
    sure = F.coalesce(adequate, F.lit(False))
    return F.when(F.bool_or(state.eqNullSafe(F.lit(severe)) & sure), "reject").when(F.bool_and(F.coalesce(state.isin(*clear), F.lit(False)) & sure), "keep").otherwise("review")


def region_verdict(rows: DataFrame, key: str, family: str, state: str, usable: str, core: str) -> DataFrame:
    """(key, verdict) over regions, in order: severe if three families are, or two with the core one;
    uncertain on any severe, borderline or unusable region; clear with two clear families; else uncertain."""
    of = lambda s: F.collect_set(F.when((F.col(state) == s) & F.col(usable), F.col(family)))
    out = rows.groupBy(key).agg(of("severe").alias("_s"), of("clear").alias("_c"), F.bool_or((F.col(state) == "borderline") | ~F.col(usable)).alias("_doubt"))
    severe = (F.size("_s") >= 3) | (F.array_contains("_s", core) & (F.size("_s") >= 2))
    return out.select(key, F.when(severe, "severe").when((F.size("_s") > 0) | F.col("_doubt"), "uncertain").when(F.size("_c") >= 2, "clear").otherwise("uncertain").alias("verdict"))


def tile_verdict(rows: DataFrame, key: str, clear: Column, textured: Column, least: int = 2) -> DataFrame:
    """(key, verdict, reliability): keep with `least` clear tiles, otherwise review, never reject; as many textured ones are adequate."""
    return rows.groupBy(key).agg(F.when(F.count_if(clear) >= least, "keep").otherwise("review").alias("verdict"), F.when(F.count_if(textured) >= least, "adequate").otherwise("insufficient").alias("reliability"))


def precedence(manual: Column, confirmed: Column, quality_reject: Column, selection: Column, focus: Column, local: Column) -> Column:
    """struct(decision, source): confirmed manual over a quality reject over the current selection over focus over local; null leaves all as it is."""
    of = lambda value, source: F.struct(value.alias("decision"), F.lit(source).alias("source"))
    return (
        F.when(F.coalesce(confirmed, F.lit(False)) & manual.isNotNull(), of(manual, "manual"))
        .when(F.coalesce(quality_reject, F.lit(False)), of(F.lit("reject"), "quality"))
        .when(selection.isNotNull(), of(selection, "selection"))
        .when(focus.isNotNull(), of(focus, "focus"))
        .otherwise(of(local, "local"))
    )


def exclusive_counts(rows: DataFrame, labels: list[tuple[str, Column]], subsets: dict[str, Column]) -> DataFrame:
    """(bucket, n): labels tried in order, each row in one; subsets overlap them and are counted beside."""
    label = F.coalesce(*(F.when(c, F.lit(n)) for n, c in labels), F.lit("other"))
    tagged = rows.select(F.explode(F.array_compact(F.array(label, *(F.when(c, F.lit(n)) for n, c in subsets.items())))).alias("bucket"))
    return tagged.groupBy("bucket").agg(F.count("*").alias("n"))


def whole_batches(rows: DataFrame, batch: str, valid: Column) -> DataFrame:
    """Rows of batches in which every member is valid: one bad or unknown member spoils its batch."""
    good = rows.groupBy(batch).agg(F.bool_and(F.coalesce(valid, F.lit(False))).alias("_ok")).where("_ok").select(batch)
    return rows.join(good, batch, "left_semi")


def tied(rows: DataFrame, group: str, keeps: Column) -> DataFrame:
    """rows with tied: whether a row is kept and others of its group are too. Counts are joined back, so a hot group is combined first."""
    n = rows.groupBy(F.col(group).alias("_g")).agg(F.count_if(keeps).alias("_n"))
    return rows.join(n, F.col(group).eqNullSafe(F.col("_g"))).withColumn("tied", F.coalesce(keeps, F.lit(False)) & (F.col("_n") > 1)).drop("_g", "_n")


def weaker_than_peers(rows: DataFrame, group: list[str], value: str, share: float = 0.45) -> DataFrame:
    """rows of groups with peer_median and weak: under share x the median of the two best others, where there are two.

    A group's three best values say what remains without oneself, so no row is joined with its peers.
    """
    def best(acc: Column, n: int) -> Column:
        return F.slice(F.sort_array(acc, asc=False), 1, n)

    # two steps, so that a hot group never gathers: the best three of each salt, then of those
    salted = rows.where(F.col(value).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(64)))
    part = Window.partitionBy(*group, "_salt").orderBy(F.desc(value))
    few = salted.withColumn("_r", F.row_number().over(part)).where("_r <= 3")
    top = few.groupBy(*group).agg(best(F.collect_list(value), 3).alias("_top"))
    out = rows.join(top, group).where(F.size("_top") >= 3)
    at = lambda i: F.get("_top", i)
    peer = F.when(F.col(value) >= at(0), at(1) + at(2)).when(F.col(value) >= at(1), at(0) + at(2)).otherwise(at(0) + at(1)) / 2
    return out.withColumn("peer_median", peer).withColumn("weak", F.col(value) < share * F.col("peer_median")).drop("_top")


def first_problem(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails or is unknown; null if all hold."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks))


def margin(rows: DataFrame, key: str, score: str, order: list[str], least: float) -> DataFrame:
    """The best row of each key with runner_up and ambiguous: the gap to the second best is under `least`."""
    w = Window.partitionBy(key).orderBy(F.desc(score), *order)
    best = rows.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    second = F.max(F.when(F.col("_r") == 2, F.col(score))).alias("runner_up")
    first = F.max(F.when(F.col("_r") == 1, F.struct(*(c for c in rows.columns if c != key)))).alias("_b")
    out = best.groupBy(key).agg(first, second).select(key, "_b.*", "runner_up")
    return out.withColumn("ambiguous", F.coalesce(F.col(score) - F.col("runner_up") < least, F.lit(False)))


#: Limits of a face's focus figures. Contrast of eye and core and eye distance come first; then severe, clear.
FACE = {
    "eye_distance": 56.0, "eye_contrast": 0.10, "core_contrast": 0.08,
    "severe": (0.00145, 0.00175, 0.16), "severe_coarse": (0.0032, 0.0034, 0.15, 0.0010),
    "clear": (0.0045, 0.0060, 0.18, 0.215, 0.25, 0.0008),
}


def face_focus(m: Column, landmarks: Column, supported: Column, noisy: Column, directional: Column) -> Column:
    """struct(state, reason) of a face from its figures m (eye_distance, eye_contrast, core_contrast, eye_lap, core_lap,
    eye_curvature, coarse_lap, native_curvature, eye_gradient). The first rule that applies decides; what is unknown fails its rule.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    of = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
    s, c, k = FACE["severe"], FACE["severe_coarse"], FACE["clear"]
    severe = ((m["eye_lap"] < s[0]) & (m["core_lap"] < s[1]) & (m["eye_curvature"] < s[2])) | ((m["eye_lap"] < c[0]) & (m["core_lap"] < c[1]) & (m["eye_curvature"] < c[2]) & (m["coarse_lap"] < c[3]))
    clear = (m["eye_lap"] >= k[0]) & (m["core_lap"] >= k[1]) & (m["eye_curvature"] >= k[2]) & (m["native_curvature"] >= k[3]) & (m["eye_gradient"] >= k[4]) & (m["coarse_lap"] >= k[5])
    return (
        F.when(~yes(landmarks), of("uncertain", "no_landmarks"))
        .when(~yes(m["eye_distance"] >= FACE["eye_distance"]), of("uncertain", "small_eyes"))
        .when(~yes((m["eye_contrast"] >= FACE["eye_contrast"]) & (m["core_contrast"] >= FACE["core_contrast"])), of("uncertain", "low_contrast"))
        .when(~yes(supported), of("uncertain", "outside_source"))
        .when(yes(noisy), of("uncertain", "noise"))
        .when(yes(severe), of("severe_blur", "weak_detail"))
        .when(yes(directional), of("uncertain", "smear"))
        .when(yes(clear), of("clear", "strong_detail"))
        .otherwise(of("uncertain", "borderline"))
    )


def local_recommendation(pending: Column, portrait: Column, current: Column, policy: Column, evidence: Column, state: Column, rejected: Column, reason: Column) -> Column:
    """keep, reject or review from local evidence alone. A portrait needs a current policy result; elsewhere evidence goes
    before its state, that before the screening flag, and a reason left by an expired model result gives review."""
    known = lambda c: F.when(c.isin("keep", "reject", "review"), c)
    of_state = F.when(state.isin("uncertain", "insufficient", "unavailable"), "review").when(state.isin("severe_blur", "blur"), "reject").when(state == "clear", "keep")
    plain = F.when(F.coalesce(reason.startswith("ai_focus_"), F.lit(False)), "review").when(F.coalesce(rejected, F.lit(False)), "reject").when(reason == "subject_not_obviously_blurred", "keep").otherwise("review")
    return (
        F.when(F.coalesce(pending, F.lit(False)), "review")
        .when(F.coalesce(portrait, F.lit(True)), F.when(F.coalesce(current, F.lit(False)), F.coalesce(known(policy), F.lit("review"))).otherwise("review"))
        .otherwise(F.coalesce(known(evidence), of_state, plain))
    )


def needs_review(pending: Column, portrait: Column, focus: Column, local: Column, settled: Column, doubtful: Column, evidence_state: Column) -> Column:
    """True, false, or null where nothing says: a pending person, an uncertain focus or a local review in portraits; else by settled and doubtful reasons."""
    by_evidence = F.when(evidence_state.isNotNull(), ~evidence_state.isin("clear", "severe_blur", "blur"))
    other = F.when(F.coalesce(settled, F.lit(False)), False).when(F.coalesce(doubtful, F.lit(False)), True).otherwise(by_evidence)
    return F.when(F.coalesce(pending, F.lit(False)), True).when(F.coalesce(portrait, F.lit(True)), F.when(focus.isNotNull(), focus == "uncertain").otherwise(F.coalesce(local == "review", F.lit(False)))).otherwise(other)


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """Readable text of each code of an array, in order and once; an unknown code stays as it is."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.array_distinct(F.transform(code, lambda c: F.coalesce(F.try_element_at(known, c), c)))


#: Overlap of appearance that a pair of photos needs: with a known camera, without one, and where people are unknown.
SAME_CAMERA, NO_CAMERA, STRONG = 0.64, 0.70, 0.80


def same_burst(camera: Column, framing_changed: Column, background_changed: Column, conflict: Column, matched: Column, unknown: Column, strong_identity: Column, appearance: Column, more_left: Column) -> Column:
    """Whether two photos may share a burst: camera is same, different or unknown.

    A different camera, an unknown one with changed framing or background, and a conflict of people each forbid it. Then
    people must match with enough appearance, or be unknown with strong appearance. Without a camera, fewer people
    than in the anchor need strong appearance and either a strong identity or unknown people. Unknown flags count as false.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    enough = lambda least: yes(appearance >= least)
    blind = yes(unknown) & enough(STRONG)
    with_camera = (yes(matched) & (enough(SAME_CAMERA) | yes(strong_identity))) | blind
    part = yes(more_left)
    without = (yes(matched) & F.when(part, enough(STRONG)).otherwise(enough(NO_CAMERA)) & (~part | yes(strong_identity) | yes(unknown))) | blind
    barred = (camera == "different") | ((camera == "unknown") & (yes(framing_changed) | yes(background_changed))) | yes(conflict)
    return F.when(yes(barred), False).when(camera == "same", with_camera).otherwise(without)


def framing(scales: Column, ratio: float = 1.7, spread: float = 1.35) -> Column:
    """unknown, compatible or different: scales of matched faces must agree within spread, and all lie beyond ratio to differ."""
    lo, hi = F.array_min(scales), F.array_max(scales)
    return F.when(F.coalesce(F.size(scales) == 0, F.lit(True)) | (hi / lo > spread), "unknown").when((lo > ratio) | (hi < 1 / ratio), "different").otherwise("compatible")


def first_step(steps: list[tuple[str, Column]], done: str) -> Column:
    """Aggregate-friendly: the name of the first step whose condition holds; unknown conditions don't; else done."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in steps), F.lit(done))


def replies(rows: DataFrame, scope: str, expected: DataFrame, subject: str, part: str, state: Column, supported: Column, absent: Column) -> DataFrame:
    """(scope, recommendation, first_issue) of model replies, one row a part, against expected (scope, subject, ordinal).

    One supported severe part rejects; all parts supported and clear (or allowed to be absent) keep; the rest is review. A
    subject without a reply, or a reply to none, makes the scope invalid. The first issue is that of the least ordinal. A null scope or subject meets none.
    What is expected and what came are grouped by subject, not joined, so a task sorts its rows once.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    severe, fine = yes(supported) & yes(state == "severe"), (yes(supported) & yes(state == "clear")) | yes(absent)
    e = expected.select(F.col(scope).alias("_s"), F.col(subject).alias("_u"), F.struct("ordinal").alias("_at"))
    got = rows.select(F.col(scope).alias("_s"), F.col(subject).alias("_u"), severe.alias("_bad"), F.when(~fine, F.struct(F.col(part).alias("part"))).alias("_part"), F.lit(True).alias("_reply"))
    both = e.unionByName(got, allowMissingColumns=True).repartition("_s", "_u")  # one sort of narrow rows, which serves both groupings
    each = both.groupBy("_s", "_u").agg(F.min("_at").alias("_at"), F.bool_or(yes(F.col("_reply"))).alias("_reply"), F.bool_or(yes(F.col("_bad"))).alias("_bad"), F.min("_part").alias("_part"))
    known = F.col("_at").isNotNull() & F.col("_reply") & F.col("_s").isNotNull() & F.col("_u").isNotNull()
    issue = F.when(F.col("_part").isNotNull(), F.struct(F.col("_at.ordinal"), F.col("_part.part").alias("part")))
    out = each.groupBy(F.col("_s").alias(scope)).agg(F.bool_and(known).alias("_whole"), F.bool_or("_bad").alias("_severe"), F.bool_and(F.col("_part").isNull()).alias("_clear"), F.min(issue).alias("_issue"))
    verdict = F.when(~F.col("_whole"), "invalid").when(F.col("_severe"), "reject").when(F.col("_clear"), "keep").otherwise("review")
    return out.select(scope, verdict.alias("recommendation"), F.when(F.col("_whole"), F.col("_issue.part")).alias("first_issue"))


def refused(gates: dict[str, Column]) -> Column:
    """The name of the first gate that does not hold (null does not); null if all do. The gates of an automatic selection are its provenance, in order."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(gates.items()):
        out = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def selection_origin(confirmed: Column, same_inputs: Column, reason: Column, stored_equal: Column) -> Column:
    """human for a confirmed selection whose inputs are the same; automatic for one that no gate refuses and that equals what was stored; else null.

    A confirmation that has lost its inputs never becomes an automatic selection.
    """
    return F.when(confirmed, F.when(same_inputs, "human")).when(reason.isNull() & stored_equal, "automatic")
