"""Whether two portraits are one pose in one scene: keypoints vote for a displacement, a similarity is fitted to what agrees, and gates decide in order.

A portrait's context is one row. Keypoints of a photo are as many as its detector gives at most, so they fit into an array; matches of a pair
are rows, and all that is fitted to them is sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import block_ssim, hamming
from .measurement import intersection
from .pixels import correlated


@dataclass(frozen=True)
class Preset:
    """Limits of the gates; areas, spans and translations are shares of the frame, rotation is in degrees."""

    face_hash: int
    face_ssim: float
    context_hash: int
    displacement: float
    area_ratio: float
    face_colour: float
    context_colour: float
    inliers: int
    inlier_share: float
    scale: tuple[float, float]
    rotation: float
    translation: float
    span: float
    area: float
    difference: float
    coverage: float


#: Fixed values of the presets; loose doesn't weaken what guards a person's identity.
STANDARD = Preset(face_hash=8, face_ssim=0.65, context_hash=10, displacement=0.06, area_ratio=1.25, face_colour=0.55, context_colour=0.55, inliers=12, inlier_share=0.55, scale=(0.94, 1.06), rotation=3.0, translation=0.06, span=0.12, area=0.03, difference=0.04, coverage=0.12)
STRICT = Preset(face_hash=6, face_ssim=0.72, context_hash=8, displacement=0.05, area_ratio=1.20, face_colour=0.62, context_colour=0.62, inliers=18, inlier_share=0.62, scale=(0.96, 1.04), rotation=2.0, translation=0.04, span=0.15, area=0.04, difference=0.035, coverage=0.15)
PRESETS = {"strict": STRICT, "standard": STANDARD, "loose": STANDARD}
#: A nearest descriptor counts below this share of the second nearest's distance; pixels within which a match fits.
RATIO, TOLERANCE = 0.78, 3.0
#: Half the side of a vote's window, in pixels; times that the fit chooses its matches anew.
CELL, ROUNDS = 20.0, 3


def context_problem(photo: dict[str, Column]) -> Column:
    """Why a photo has no portrait context, null if it has: the first of these that doesn't hold.

    photo: mode, decoded, checked, schema_ok (booleans but mode), faces and bodies (arrays of struct(box, hash, origin)), face, body (the primary boxes), primary_face,
    primary_body (places), must_select, face_hash (of the crop as it is now). One automatic face and body, each the primary one, with the stored boxes and the hash of today's pixels.
    """
    one = lambda c: F.size(photo[c]) == 1
    first = lambda c: F.get(photo[c], F.lit(0))
    rules = [
        ("not_a_portrait", photo["mode"] == "portrait"), ("not_decoded", photo["decoded"]), ("not_checked", photo["checked"]), ("old_schema", photo["schema_ok"]), ("primary_not_selected", ~photo["must_select"]),
        ("not_one_subject", one("faces") & one("bodies")), ("not_primary", (photo["primary_face"] == 0) & (photo["primary_body"] == 0)),
        ("not_automatic", (first("faces")["origin"] == "automatic") & (first("bodies")["origin"] == "automatic")), ("moved_box", (first("faces")["box"] == photo["face"]) & (first("bodies")["box"] == photo["body"])),
        ("changed_pixels", first("faces")["hash"] == photo["face_hash"]),
    ]
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules), F.lit(None).cast("string"))


def _cut(rows: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Elements of all of rows' lists, and where each list's begin, and the end; a null list has none."""
    return rows.flatten(), np.append(0, np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))


def _lists(rows: pa.Array) -> list[np.ndarray | None]:
    """Each row's list of numbers as a slice of one array, or None."""
    values, at = _cut(rows)
    values = values.to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for a, b, ok in zip(at, at[1:], rows.is_valid().to_pylist(), strict=False)]


_MATCHES = "array<struct<sx:double,sy:double,tx:double,ty:double,distance:int>>"
_ROWS = 256


def _nearest(a: np.ndarray, b: np.ndarray, ratio: float) -> list[tuple[int, int, int]]:
    """(i, j, distance) of descriptors (rows of whole numbers, compared bit by bit): the nearest b of each a that is clear of the second, once a b."""
    if len(a) < 1 or len(b) < 2:
        return []
    best: dict[int, tuple[int, int]] = {}
    for lo in range(0, len(a), _ROWS):
        d = np.bitwise_count(a[lo : lo + _ROWS, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
        j = d.argmin(1)
        near = d[np.arange(len(d)), j]
        d[np.arange(len(d)), j] = np.iinfo(np.int64).max
        for i in np.flatnonzero(near < ratio * d.min(1)):
            best[int(j[i])] = min(best.get(int(j[i]), (1 << 30, 0)), (int(near[i]), lo + int(i)))
    return sorted((i, j, n) for j, (n, i) in best.items())


def matches(pairs: DataFrame, points: DataFrame, photo: str = "photo", ratio: float = RATIO) -> DataFrame:
    """(left, right, sx, sy, tx, ty, distance): keypoints of points (photo, point, x, y, bits: an array of whole numbers) that match in pairs (left, right).

    The nearest of the right photo's descriptors, if nearer than `ratio` of the second nearest; of those that share it the nearest (then first) stays. Points of a photo
    stand in one array, ordered by point; distances are made in blocks in the task and never leave it. A photo of fewer than two points matches none.
    """

    @F.arrow_udf(_MATCHES)
    def near(left: pa.Array, right: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("sx", pa.float64()), ("sy", pa.float64()), ("tx", pa.float64()), ("ty", pa.float64()), ("distance", pa.int32())]))
        if not len(left):
            return pa.array([], kind)
        (one, a), (two, b) = _cut(left), _cut(right)
        (v, p), (w, q) = ((x.to_numpy(zero_copy_only=False), y) for x, y in (_cut(side.field("bits")) for side in (one, two)))
        first, second, apart, n = [], [], [], []
        for k in range(len(left)):  # slices of the batch's own buffers; no point becomes a Python object
            own, other = a[k + 1] - a[k], b[k + 1] - b[k]
            found = _nearest(v[p[a[k]] : p[a[k + 1]]].reshape(own, -1), w[q[b[k]] : q[b[k + 1]]].reshape(other, -1), ratio) if own and other else []
            first.extend(a[k] + i for i, _, _ in found)
            second.extend(b[k] + j for _, j, _ in found)
            apart.extend(d for _, _, d in found)
            n.append(len(found))
        first, second = pa.array(first, pa.int64()), pa.array(second, pa.int64())
        rows = [one.field("x").take(first), one.field("y").take(first), two.field("x").take(second), two.field("y").take(second), pa.array(apart, pa.int32())]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.StructArray.from_arrays(rows, fields=list(kind.value_type)))

    arrays = points.groupBy(F.col(photo).alias("_photo")).agg(F.sort_array(F.collect_list(F.struct("point", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("bits").cast("array<bigint>").alias("bits")))).alias("_points"))
    side = lambda name: arrays.select(F.col("_photo").alias(name), F.col("_points").alias(f"_{name}"))
    both = pairs.select("left", "right").join(side("left"), "left").join(side("right"), "right")
    return both.select("left", "right", F.explode(near("_left", "_right")).alias("_m")).select("left", "right", "_m.*")


def _hull(points: list[tuple[float, float]]) -> float:
    """Area of the convex hull."""
    some = sorted(set(points))

    def chain(order: list) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = chain(some) + chain(some[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def hull_area(points: Column) -> Column:
    """Area of the convex hull of an array of struct(x, y)."""

    @F.arrow_udf("double")
    def area(points: pa.Array) -> pa.Array:
        of, at = _cut(points)
        both = list(zip(of.field("x").to_pylist(), of.field("y").to_pylist(), strict=True)) if len(of) else []
        return pa.array([_hull(both[a:b]) if b > a else 0.0 for a, b in zip(at, at[1:], strict=False)], pa.float64())

    return area(points)


def aligned(found: DataFrame, cell: float = CELL, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """(left, right, matches, inliers, votes, a, b, p, q, source, target) of matches (left, right, sx, sy, tx, ty), a row a pair.

    Every match votes for the windows that its displacement lies in, which overlap by half; the fullest wins, of equal ones the first by dx, then dy. A similarity
    x' = a x - b y + p, y' = b x + a y + q is fitted to that window's matches by least squares, from sums, and again to all that it maps within `tolerance`, `rounds` times.
    source and target hold the inliers' spans, hull areas and means. One exchange by pair serves all of this. A pair of one place only has no fit: nulls and no inliers.
    """
    rows = found.select("left", "right", "sx", "sy", "tx", "ty").repartition("left", "right")
    pair = Window.partitionBy("left", "right")
    at = lambda s, t: F.floor((F.col(t) - F.col(s)) / cell)
    near = lambda s, t: F.array(at(s, t) - 1, at(s, t))
    votes = rows.withColumn("_dx", F.explode(near("sx", "tx"))).withColumn("_dy", F.explode(near("sy", "ty"))).groupBy("left", "right", "_dx", "_dy").agg(F.count("*").alias("_n"))
    peak = votes.groupBy("left", "right").agg(F.max(F.struct("_n", (-F.col("_dx")).alias("_dx"), (-F.col("_dy")).alias("_dy"))).alias("_peak"))
    inside = lambda s, t, d: (at(s, t) == -F.col(f"_peak.{d}")) | (at(s, t) == 1 - F.col(f"_peak.{d}"))
    out = rows.join(peak, ["left", "right"]).withColumn("_in", inside("sx", "tx", "_dx") & inside("sy", "ty", "_dy"))
    for _ in range(rounds):
        total = lambda e: F.sum(F.when(F.col("_in"), e)).over(pair)
        c = {k: total(F.col(k)) / total(F.lit(1.0)) for k in ("sx", "sy", "tx", "ty")}
        out = out.withColumns({f"_m_{k}": v for k, v in c.items()})
        away = lambda k: F.col(k) - F.col(f"_m_{k}")
        spread = total(away("sx") * away("sx") + away("sy") * away("sy"))
        over = lambda e: total(e) / F.nullif(spread, F.lit(0.0))
        out = out.withColumns({"_a": over(away("sx") * away("tx") + away("sy") * away("ty")), "_b": over(away("sx") * away("ty") - away("sy") * away("tx"))})
        out = out.withColumns({"_p": F.col("_m_tx") - F.col("_a") * F.col("_m_sx") + F.col("_b") * F.col("_m_sy"), "_q": F.col("_m_ty") - F.col("_b") * F.col("_m_sx") - F.col("_a") * F.col("_m_sy")})
        dx, dy = F.col("_a") * F.col("sx") - F.col("_b") * F.col("sy") + F.col("_p") - F.col("tx"), F.col("_b") * F.col("sx") + F.col("_a") * F.col("sy") + F.col("_q") - F.col("ty")
        out = out.withColumn("_in", F.coalesce(dx * dx + dy * dy <= tolerance * tolerance, F.lit(False)))

    def spread_of(x: str, y: str) -> Column:
        of = lambda f, c: f(F.when(F.col("_in"), F.col(c)))
        return F.struct((of(F.max, x) - of(F.min, x)).alias("span_x"), (of(F.max, y) - of(F.min, y)).alias("span_y"), F.collect_list(F.when(F.col("_in"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("points"))

    first = lambda c: F.first(c).alias(c.strip("_"))
    got = out.groupBy("left", "right").agg(F.count("*").alias("matches"), F.count_if("_in").alias("inliers"), F.first("_peak._n").alias("votes"), *map(first, ("_a", "_b", "_p", "_q")), spread_of("sx", "sy").alias("_s"), spread_of("tx", "ty").alias("_t"))
    part = lambda c: F.struct(F.col(f"{c}.span_x"), F.col(f"{c}.span_y"), F.col(f"{c}_area").alias("area"))
    got = got.withColumns({"_s_area": hull_area(F.col("_s.points")), "_t_area": hull_area(F.col("_t.points"))})
    return got.select("left", "right", "matches", "inliers", "votes", "a", "b", "p", "q", part("_s").alias("source"), part("_t").alias("target"))


def movement(fit: dict[str, Column], left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """struct(scale, rotation, translation) of a fit (a, b, p, q) between frames of (width, height), in shares of the frames: rotation in degrees, translation of the middle, along the axis where it is more."""
    (lw, lh), (rw, rh) = left, right
    a, b = fit["a"], fit["b"]
    x, y = (a * lw / 2 - b * lh / 2 + fit["p"]) / rw - 0.5, (b * lw / 2 + a * lh / 2 + fit["q"]) / rh - 0.5
    return F.struct(F.sqrt((a * a + b * b) * lw * lh / (rw * rh)).alias("scale"), F.abs(F.degrees(F.atan2(b * lw / rh, a * lw / rw))).alias("rotation"), F.greatest(F.abs(x), F.abs(y)).alias("translation"))


def unit_map(fit: dict[str, Column], left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """struct(xx, xy, x0, yx, yy, y0) of a fit between frames, from unit square to unit square: x' = xx x + xy y + x0, y' = yx x + yy y + y0."""
    (lw, lh), (rw, rh) = left, right
    a, b = fit["a"], fit["b"]
    return F.struct((a * lw / rw).alias("xx"), (-b * lh / rw).alias("xy"), (fit["p"] / rw).alias("x0"), (b * lw / rh).alias("yx"), (a * lh / rh).alias("yy"), (fit["q"] / rh).alias("y0"))


def background(left: Column, left_mask: Column, right: Column, right_mask: Column, width: Column, unit: Column, channels: int = 1) -> Column:
    """struct(coverage, difference): the share of a small picture that is background in both when the left is laid on the right, and the mean difference there, of 1.

    Pictures and masks (0 is a person) are square arrays of `width`; unit: unit_map(). A pixel of the right takes the left's pixel that its middle comes from. Null where a picture
    is missing or the map has no inverse.
    """

    @F.arrow_udf("coverage double, difference double")
    def laid(left: pa.Array, left_mask: pa.Array, right: pa.Array, right_mask: pa.Array, width: pa.Array, unit: pa.Array) -> pa.Array:
        out = []
        for l, lm, r, rm, w, u in zip(_lists(left), _lists(left_mask), _lists(right), _lists(right_mask), width.to_pylist(), unit.to_pylist(), strict=True):
            if any(c is None for c in (l, lm, r, rm, w, u)) or None in u.values() or not (det := u["xx"] * u["yy"] - u["xy"] * u["yx"]):
                out.append(None)
                continue
            middle = (np.arange(w) + 0.5) / w
            x, y = np.meshgrid(middle - u["x0"], middle - u["y0"])
            j, i = np.floor((u["yy"] * x - u["xy"] * y) / det * w).astype(int), np.floor((u["xx"] * y - u["yx"] * x) / det * w).astype(int)
            inside = (i >= 0) & (i < w) & (j >= 0) & (j < w)
            grid = lambda v, c=1: np.array(v, float).reshape(w, w, c)
            i, j = i.clip(0, w - 1), j.clip(0, w - 1)
            common = inside & (grid(lm)[i, j, 0] > 0) & (grid(rm)[:, :, 0] > 0)
            apart = np.abs(grid(l, channels)[i, j] - grid(r, channels))[common]
            out.append({"coverage": float(common.mean()), "difference": float(apart.mean() / 255) if apart.size else None})
        return pa.array(out, pa.struct([("coverage", pa.float64()), ("difference", pa.float64())]))

    return laid(left, left_mask, right, right_mask, width, unit)


def shifted(left: Column, right: Column, width: Column, most: int = 4) -> Column:
    """struct(dx, dy, response, agreement) of two gray square pictures: the shift of up to `most` pixels at which the left's middle fits the right best, and how alike they then are.

    response is the normalised cross-correlation of the middle, agreement the mean structural similarity of blocks of a quarter's side over all that both show. Null
    where a picture is missing or too small, or has no contrast.
    """

    @F.arrow_udf("dx int, dy int, response double, agreement double")
    def shift(left: pa.Array, right: pa.Array, width: pa.Array) -> pa.Array:
        out = []
        for l, r, w in zip(left.to_pylist(), right.to_pylist(), width.to_pylist(), strict=True):
            if l is None or r is None or not w or len(l) != w * w or len(r) != w * w or w <= 2 * most + 2:
                out.append(None)
                continue
            a, b = np.array(l, float).reshape(w, w), np.array(r, float).reshape(w, w)
            found = correlated(b, a[most : w - most, most : w - most])
            if np.isnan(found).all():
                out.append(None)
                continue
            y, x = (int(v) for v in np.unravel_index(np.nanargmax(np.round(found, 9)), found.shape))
            dx, dy, side = x - most, y - most, max(2, w // 4)
            one, two = a[max(0, -dy) : w - max(0, dy), max(0, -dx) : w - max(0, dx)], b[max(0, dy) : w - max(0, -dy), max(0, dx) : w - max(0, -dx)]
            scores = []
            for i in range(0, one.shape[0] - side + 1, side):
                for j in range(0, one.shape[1] - side + 1, side):
                    p, q = one[i : i + side, j : j + side], two[i : i + side, j : j + side]
                    light = (2 * p.mean() * q.mean() + 6.5025) / (p.mean() ** 2 + q.mean() ** 2 + 6.5025)
                    scores.append(light * (2 * ((p * q).mean() - p.mean() * q.mean()) + 58.5225) / (p.var() + q.var() + 58.5225))
            out.append({"dx": dx, "dy": dy, "response": float(found[y, x]), "agreement": float(np.mean(scores))})
        return pa.array(out, pa.struct([("dx", pa.int32()), ("dy", pa.int32()), ("response", pa.float64()), ("agreement", pa.float64())]))

    return shift(left, right, width)


#: Fixed values for a body that an automatic box has lost: share of the boxes in common, response and agreement of the shift, by preset.
DRIFTED = {"strict": (0.60, 0.80, 0.90), "standard": (0.60, 0.80, 0.86), "loose": (0.60, 0.80, 0.86)}


def same_person(left: dict[str, Column], right: dict[str, Column], preset: Preset) -> list[tuple[str, Column]]:
    """The gates on faces and what is around them, in order: (name, whether it holds).

    left, right: face (box), face_hash, face_blocks (gray, arrays of pixels of 0 to 255), face_colour, context_hash, context_colour (histograms).
    """
    (a, b), face = (left, right), lambda s: (s["face"]["x"] + s["face"]["w"] / 2, s["face"]["y"] + s["face"]["h"] / 2, s["face"]["w"] * s["face"]["h"])
    (ax, ay, area), (bx, by, other) = face(a), face(b)
    ratio = F.greatest(area, other) / F.greatest(F.least(area, other), F.lit(1e-9))
    return [
        ("face_moved", F.hypot(ax - bx, ay - by) <= preset.displacement), ("face_resized", ratio <= preset.area_ratio), ("face_hash", hamming(a["face_hash"], b["face_hash"]) <= preset.face_hash),
        ("face_structure", block_ssim(a["face_blocks"], b["face_blocks"], 255.0) + 1e-6 >= preset.face_ssim), ("face_colour", intersection(a["face_colour"], b["face_colour"]) >= preset.face_colour),
        ("context_hash", hamming(a["context_hash"], b["context_hash"]) <= preset.context_hash), ("context_colour", intersection(a["context_colour"], b["context_colour"]) >= preset.context_colour),
    ]


def same_scene(fit: dict[str, Column], moved: Column, behind: Column, left: tuple[Column, Column], right: tuple[Column, Column], preset: Preset) -> list[tuple[str, Column]]:
    """The gates on the scene, in order: enough matches and inliers, that are spread over both frames, hardly moved, before the same background."""

    def spread(side: Column, size: tuple[Column, Column]) -> Column:
        w, h = size
        return (side["span_x"] / w >= preset.span) & (side["span_y"] / h >= preset.span) & (side["area"] / (w * h) >= preset.area)

    still = moved["scale"].between(*preset.scale) & (moved["rotation"] <= preset.rotation) & (moved["translation"] <= preset.translation)
    return [
        ("few_matches", fit["matches"] >= preset.inliers), ("few_inliers", fit["inliers"] >= preset.inliers), ("low_share", fit["inliers"] / fit["matches"] >= preset.inlier_share),
        ("not_spread", spread(fit["source"], left) & spread(fit["target"], right)), ("frame_moved", still), ("little_background", behind["coverage"] >= preset.coverage), ("other_background", behind["difference"] <= preset.difference),
    ]


def same_drifted(left: dict[str, Column], right: dict[str, Column], shift: Column, preset: str) -> list[tuple[str, Column]]:
    """The gates on a pair whose automatic body boxes drifted apart: boxes that differ, with other hashes, yet frames that agree in full after a small shift.

    left, right: whole_hash, body_hash, body (box), aspect; shift: shifted() of the whole frames.
    """
    common, response, agreement = DRIFTED[preset]
    limit = 8 if preset == "strict" else 10
    a, b = left["body"], right["body"]
    part = lambda p, s: F.greatest(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]), F.lit(0.0))
    both = part("x", "w") * part("y", "h")
    apart = F.greatest(*(F.abs(a[c] - b[c]) for c in "xywh"))
    return [
        ("whole_hash", hamming(left["whole_hash"], right["whole_hash"]) <= limit), ("aspect", F.greatest(left["aspect"], right["aspect"]) / F.least(left["aspect"], right["aspect"]) <= 1.08), ("same_body_hash", hamming(left["body_hash"], right["body_hash"]) > limit),
        ("same_body_box", apart >= 0.01), ("body_overlap", both / F.nullif(a["w"] * a["h"] + b["w"] * b["h"] - both, F.lit(0.0)) >= common), ("no_shift", shift["response"] >= response), ("frames_differ", shift["agreement"] >= agreement),
    ]


def first_failed(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate that doesn't hold, or can't be told; null if all hold."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates), F.lit(None).cast("string"))


def compatible(person: list[tuple[str, Column]], scene: list[tuple[str, Column]], drifted: list[tuple[str, Column]] | None = None) -> Column:
    """struct(compatible, reason): all gates on the person, and all on the scene or else all on a drifted body; reason is the first that failed."""
    who, where = first_failed(person), first_failed(scene)
    rescue = first_failed(drifted).isNull() if drifted else F.lit(False)
    reason = F.coalesce(who, F.when(where.isNotNull() & ~rescue, where))
    return F.struct(reason.isNull().alias("compatible"), reason.alias("reason"))
