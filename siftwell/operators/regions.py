"""Regions of photos: overrides, selection, gates on detections, association of faces with bodies, projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_ok, iou
from ..functions.identity import clamp, digest

#: Limits of crop settings (low, high, default) and the ratios that are known, the first the default.
SCALE, SHIFT, CONFIDENCE = (0.6, 2.0, 1.0), (-5.0, 5.0, 0.0), (0.7, 0.95, 0.8)
RATIOS = ("124:150", "1:1", "3:4")
#: A face is linked with a head if it covers this share of the face and leads by this much.
COVERED, LEAD = 0.35, 0.30
#: A person is linked unless both overlap and distance fail, and leads by this much.
OVERLAP, AWAY, PERSON_LEAD = 0.05, 0.75, 0.08
#: Fixed value: a cohort of more members is not matched.
COHORT = 4


def override(face: Column, photo: Column, limits: tuple[float, float, float]) -> Column:
    """The most specific setting that is given, within its limits; the default where it is not finite."""
    return clamp(F.coalesce(face, photo, F.lit(limits[2])), *limits)


def ratio(face: Column, photo: Column) -> Column:
    value = F.coalesce(face, photo)
    return F.when(value.isin(*RATIOS), value).otherwise(RATIOS[0])


def box_key(box: Column) -> Column:
    """The name of a box: its four numbers with six decimals."""
    return F.format_string("%.6f,%.6f,%.6f,%.6f", box["x"], box["y"], box["w"], box["h"])


def resolved(faces: Column, bodies: Column, chosen_faces: Column, chosen_bodies: Column, hidden: Column, per_kind: Column) -> Column:
    """struct(faces, bodies, disabled, primary_face, primary_body, pending, digest) of a photo's regions.

    A chosen list replaces the automatic one, an empty one too; null means nothing was chosen. Without per_kind
    an empty choice of faces also drops automatic bodies. Hidden drops all. A kind with one region has it as
    primary; pending says that a kind has several.
    """
    none = F.slice(F.coalesce(chosen_faces, faces), 1, 0)
    no_faces = chosen_faces.isNotNull() & (F.size(chosen_faces) == 0)
    legacy = no_faces & ~F.coalesce(per_kind, F.lit(False)) & chosen_bodies.isNull()
    gone = F.coalesce(hidden, F.lit(False))
    f = F.when(gone, none).otherwise(F.coalesce(chosen_faces, faces))
    b = F.when(gone | legacy, none).otherwise(F.coalesce(chosen_bodies, bodies))
    named = F.array_compact(F.array(F.when(no_faces, "faces"), F.when(legacy, "automatic_bodies"), F.when(chosen_bodies.isNotNull() & (F.size(chosen_bodies) == 0), "bodies")))
    disabled = F.when(gone, F.array(F.lit("all"))).otherwise(named)
    only = lambda a: F.when(F.size(a) == 1, F.lit(0))
    text = lambda a: F.to_json(F.struct(a.alias("v")))
    return F.struct(f.alias("faces"), b.alias("bodies"), disabled.alias("disabled"), only(f).alias("primary_face"), only(b).alias("primary_body"), ((F.size(f) > 1) | (F.size(b) > 1)).alias("pending"), digest(text(f), text(b), text(disabled)).alias("digest"))


def selection(rows: DataFrame, photo: str, kind: str, name: str, box: str, valid: Column) -> DataFrame:
    """(photo, regions, usable): distinct (kind, name) regions; a bad box, or a name that stands for two boxes, spoils the whole photo."""
    each = rows.groupBy(photo, kind, name).agg(F.countDistinct(box).alias("_k"), F.bool_and(F.coalesce(valid, F.lit(False))).alias("_ok"))
    return each.groupBy(photo).agg(F.count("*").alias("regions"), F.bool_and((F.col("_k") == 1) & F.col("_ok")).alias("usable"))


def detection_ok(row: Column, width: Column, height: Column, least: float = 0.9) -> Column:
    """Whether a face detection (x, y, w, h, five points, score: 15 numbers) is plausible: its size and shape, its
    place in the image, its points near it, and eyes, nose and mouth in order. Null or not finite: no."""
    v = lambda i: F.get(row, i)
    x, y, w, h = map(v, range(4))
    points = [(v(i), v(i + 1)) for i in range(4, 14, 2)]
    finite = F.forall(row, lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")))
    inside = (x >= -0.1 * w) & (y >= -0.1 * h) & (x + w <= width + 0.1 * w) & (y + h <= height + 0.1 * h)
    near = reduce(lambda a, b: a & b, ((px >= x - 0.15 * w) & (py >= y - 0.15 * h) & (px <= x + 1.15 * w) & (py <= y + 1.15 * h) for px, py in points))
    mid = lambda a, b: tuple((p + q) / 2 for p, q in zip(points[a], points[b], strict=True))
    (ex, ey), (mx, my) = mid(0, 1), mid(3, 4)
    dx, dy = mx - ex, my - ey
    far, gap = F.hypot(dx, dy), F.hypot(points[0][0] - points[1][0], points[0][1] - points[1][1])
    nose = ((points[2][0] - ex) * dx + (points[2][1] - ey) * dy) / F.nullif(far * far, F.lit(0.0))
    ok = (F.size(row) == 15) & finite & (v(14) >= least) & (F.least(w, h) >= 12) & (w / F.nullif(h, F.lit(0.0))).between(0.4, 1.8) & inside & near & far.between(0.12 * h, 0.85 * h) & gap.between(0.08 * w, 1.1 * w) & nose.between(-0.2, 1.3)
    return F.coalesce(ok, F.lit(False))


def primary(box: Column, width: Column, height: Column) -> Column:
    """How much a face counts as the main one: its area, less the farther it is from the centre."""
    away = F.hypot(box["x"] + box["w"] / 2 - width / 2, box["y"] + box["h"] / 2 - height / 2) / F.greatest(F.hypot(width, height), F.lit(1.0))
    return box["w"] * box["h"] * (1.15 - F.least(away, F.lit(0.9)))


def _led(pairs: DataFrame, keys: list[str], score: str, other: str, least: float) -> DataFrame:
    """The best pair of each key with _clear: it leads the second by `least`, or is alone. Scores rank by nine decimals, so that ties are ties, and stay as they are."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_nine"), F.desc(other))
    out = pairs.withColumn("_nine", F.round(score, 9)).withColumn("_next", F.lead("_nine").over(w)).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return out.withColumn("_clear", F.col("_next").isNull() | (F.round(F.col("_nine") - F.col("_next"), 9) >= least)).drop("_r", "_next", "_nine")


def face_bodies(faces: DataFrame, bodies: DataFrame, photo: str) -> DataFrame:
    """(photo, body, face, association) for each body: faces (photo, face, box), bodies (photo, body, box, head).

    A face belongs to a body whose head it overlaps and leads clearly: pose_head_overlap. One that doesn't lead
    is ambiguous, one merely inside the body box unverified, and two bodies with one face are a reverse_conflict.
    """
    f, b = faces.alias("f"), bodies.alias("b")
    both = b.join(f, F.col(f"f.{photo}") == F.col(f"b.{photo}")).where(box_ok(F.col("f.box")))
    fb, hb, bb = F.col("f.box"), F.col("b.head"), F.col("b.box")
    cx, cy = fb["x"] + fb["w"] / 2, fb["y"] + fb["h"] / 2
    shared = F.greatest(F.least(fb["x"] + fb["w"], hb["x"] + hb["w"]) - F.greatest(fb["x"], hb["x"]), F.lit(0.0)) * F.greatest(F.least(fb["y"] + fb["h"], hb["y"] + hb["h"]) - F.greatest(fb["y"], hb["y"]), F.lit(0.0))
    covered = shared / F.greatest(fb["w"] * fb["h"], F.lit(1e-8))
    there = box_ok(hb) & (covered >= COVERED) & cx.between(hb["x"] - 0.2 * hb["w"], hb["x"] + 1.2 * hb["w"]) & cy.between(hb["y"] - 0.2 * hb["h"], hb["y"] + 1.2 * hb["h"])
    inside = cx.between(bb["x"], bb["x"] + bb["w"]) & cy.between(bb["y"], bb["y"] + bb["h"])
    pairs = both.select(F.col(f"b.{photo}").alias(photo), "b.body", "f.face", F.coalesce(there, F.lit(False)).alias("_there"), F.coalesce(inside, F.lit(False)).alias("_in"), (covered + iou(fb, hb)).alias("_score"))
    best = _led(pairs.where("_there"), [photo, "body"], "_score", "face", LEAD).select(photo, "body", "face", "_clear")
    held = pairs.groupBy(photo, "body").agg(F.bool_or("_in").alias("_in"))
    linked = Window.partitionBy(photo, F.when(F.col("_clear"), F.col("face")))
    out = bodies.select(photo, "body").join(best, [photo, "body"], "left").join(held, [photo, "body"], "left")
    clear = F.coalesce("_clear", F.lit(False))
    out = out.withColumn("_n", F.when(clear, F.count_if(clear).over(linked)))
    kind = F.when(F.col("_n") > 1, "reverse_conflict").when(F.col("_n") == 1, "pose_head_overlap").when(F.col("_clear").isNotNull(), "ambiguous").when(F.col("_in"), "unverified").otherwise("separate_body")
    return out.select(photo, "body", F.when(F.col("_n") == 1, F.col("face")).alias("face"), kind.alias("association"))


def face_person(faces: DataFrame, people: DataFrame, photo: str) -> DataFrame:
    """(photo, face, person, score): the best person of each face by overlap, nearness and detector score; null where none fits or two are close.

    faces (photo, face, box), people (photo, person, box, confidence).
    """
    f, p = faces.alias("f"), people.alias("p")
    both = f.join(p, F.col(f"f.{photo}") == F.col(f"p.{photo}"))
    fb, pb = F.col("f.box"), F.col("p.box")
    over = iou(fb, pb)
    root = lambda x, y: F.sqrt(x * x + y * y)  # noqa: E731  (as SQL says it: F.hypot differs in the last bit, which parts scores at a limit)
    away = root(pb["x"] + pb["w"] / 2 - fb["x"] - fb["w"] / 2, pb["y"] + pb["h"] / 2 - fb["y"] - fb["h"] / 2) / F.greatest(root(fb["w"], fb["h"]), F.lit(1.0))
    pairs = both.select(F.col(f"f.{photo}").alias(photo), "f.face", "p.person", over.alias("_over"), away.alias("_away"), (2 * over + F.greatest(1 - away, F.lit(0.0)) + 0.1 * F.col("p.confidence")).alias("score"))
    best = _led(pairs, [photo, "face"], "score", "person", PERSON_LEAD)
    fits = F.col("_clear") & ((F.col("_over") >= OVERLAP) | (F.col("_away") <= AWAY))
    return faces.select(photo, "face").join(best, [photo, "face"], "left").select(photo, "face", F.when(fits, F.col("person")).alias("person"), "score")


def letterbox(cx: Column, cy: Column, w: Column, h: Column, frame_w: Column, frame_h: Column, rect: list[Column]) -> Column:
    """struct(reason, x, y, left, top, right, bottom): a normalised point and area on the image rectangle rect (left, top, right, bottom).

    The first check that fails is the reason and leaves the rest null: rectangle, aspect, center, size, outside.
    A null area gives a point alone.
    """
    left, top, right, bottom = rect
    width, height = right - left, bottom - top
    some = w.isNotNull() | h.isNotNull()
    reason = (
        F.when(~F.coalesce((width > 0) & (height > 0), F.lit(False)), "rectangle")
        .when(~F.coalesce(F.abs(width / frame_w - height / frame_h) <= F.greatest(1 / frame_w, 1 / frame_h), F.lit(False)), "aspect")
        .when(~F.coalesce((cx > 0) & (cx < 1) & (cy > 0) & (cy < 1), F.lit(False)), "center")
        .when(some & ~F.coalesce((w > 0) & (w <= 1) & (h > 0) & (h <= 1), F.lit(False)), "size")
        .when(some & ((cx - w / 2 < 0) | (cy - h / 2 < 0) | (cx + w / 2 > 1) | (cy + h / 2 > 1)), "outside")
    )
    at = lambda v: F.when(reason.isNull(), v)
    return F.struct(reason.alias("reason"), at(left + cx * width).alias("x"), at(top + cy * height).alias("y"), at(left + (cx - w / 2) * width).alias("left"), at(top + (cy - h / 2) * height).alias("top"), at(left + (cx + w / 2) * width).alias("right"), at(top + (cy + h / 2) * height).alias("bottom"))


def spans(length: Column, parts: Column) -> Column:
    """array(struct(lo, hi)): balanced ranges that cover 0 to length."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(F.floor(i * length / parts).alias("lo"), F.floor((i + 1) * length / parts).alias("hi")))


def covers(rows: Column) -> Column:
    """Whether every row can have a column of its own: rows are bit masks of the columns that suit them (at most 30).

    The masks reachable after each row are kept, so no permutation is listed. No rows: false. More than COHORT rows:
    false, whatever suits them, so callers pass the whole cohort.
    """
    bits = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda b: F.call_function("shiftleft", F.lit(1), b))

    def step(found: Column, row: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(found, lambda m: F.transform(F.filter(bits, lambda b: (row.bitwiseAND(b) != 0) & (m.bitwiseAND(b) == 0)), lambda b: m.bitwiseOR(b)))))

    few = F.size(rows).between(1, COHORT)
    return F.when(few, F.size(F.aggregate(rows, F.array(F.lit(0)), step)) > 0).otherwise(F.lit(False))
