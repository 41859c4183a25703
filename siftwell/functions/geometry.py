"""Boxes in the unit square, as structs of x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_ok(box: Column, slack: float = 1e-9) -> Column:
    """Finite, of positive size, and within the unit square up to slack; null is not."""
    parts = [box[c] for c in ("x", "y", "w", "h")]
    finite = ~F.greatest(*(F.isnan(p) | (F.abs(p) == float("inf")) for p in parts))
    return F.coalesce(finite & (box["x"] >= -slack) & (box["y"] >= -slack) & (box["w"] > 0) & (box["h"] > 0) & (box["x"] + box["w"] <= 1 + slack) & (box["y"] + box["h"] <= 1 + slack), F.lit(False))


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area; 0 for boxes apart."""
    side = lambda p, s: F.greatest(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]), F.lit(0.0))
    both = side("x", "w") * side("y", "h")
    return F.coalesce(both / F.nullif(a["w"] * a["h"] + b["w"] * b["h"] - both, F.lit(0.0)), F.lit(0.0))


def crop(width: Column, height: Column, head: Column, ratio: Column, scale: Column, down: Column, aside: Column) -> Column:
    """struct(left, top, right, bottom) in whole pixels of a crop around a head box: its height is `scale` heads, its width that times `ratio`.

    Its centre lies `down` and `aside` heads from the box's. A crop larger than the frame shrinks to it, and one that
    leaves it is moved inside. Each edge is rounded for itself, halves to even.
    """
    unit = head["h"] * height
    h = unit * scale
    fit = F.least(F.lit(1.0), width / (h * ratio), height / h)
    w, h = h * ratio * fit, h * fit
    inside = lambda centre, part, whole: F.greatest(F.lit(0.0), F.least(centre - part / 2, whole - part))
    left = inside((head["x"] + head["w"] / 2) * width + aside * unit, w, width)
    top = inside((head["y"] + head["h"] / 2) * height + down * unit, h, height)
    return F.struct(*(F.bround(v).cast("long").alias(n) for n, v in (("left", left), ("top", top), ("right", left + w), ("bottom", top + h))))


def oriented(x: Column, y: Column, orientation: Column) -> Column:
    """struct(x, y) of a point under the eight EXIF orientations; others leave it."""
    table = {2: (1 - x, y), 3: (1 - x, 1 - y), 4: (x, 1 - y), 5: (y, x), 6: (1 - y, x), 7: (1 - y, 1 - x), 8: (y, 1 - x)}
    pick = lambda i, default: F.coalesce(*(F.when(orientation == k, v[i]) for k, v in table.items()), default)
    return F.struct(pick(0, x).alias("x"), pick(1, y).alias("y"))


def tiles(rows: Column, cols: Column) -> Column:
    """array(struct(row, col)) of a grid."""
    return F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.sequence(F.lit(0), cols - 1), lambda c: F.struct(r.alias("row"), c.alias("col")))))


def oriented_box(box: Column, orientation: Column) -> Column:
    """struct(x, y, w, h) of a box under the eight EXIF orientations, from its four corners."""
    at = lambda dx, dy: oriented(box["x"] + dx * box["w"], box["y"] + dy * box["h"], orientation)
    corners = F.array(at(0, 0), at(1, 0), at(0, 1), at(1, 1))
    xs, ys = F.transform(corners, lambda c: c["x"]), F.transform(corners, lambda c: c["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


#: Numbers that cameras write for "nothing".
SENTINELS = (65535.0, 16777216.0, 4294967295.0)


def focus_pair(x: Column, y: Column, is_size: bool = False) -> Column:
    """struct(status, reason, x, y) of a pair that a camera has written: never better than not_validated.

    Null or not finite, a sentinel, or beyond 0 to 1 (for a size also 0) is unknown and leaves the values null.
    """
    odd = lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True))
    nothing = lambda v: v.isin(*SENTINELS) | ((v >= 4194303.9) & (v < 4194304))
    beyond = lambda v: (v < 0) | (v > 1) | (F.lit(is_size) & (v == 0))
    reason = F.when(odd(x) | odd(y), "nonfinite").when(nothing(x) | nothing(y), "sentinel").when(beyond(x) | beyond(y), "out_of_range").otherwise("normalized_pair_only")
    ok = reason == "normalized_pair_only"
    return F.struct(F.when(ok, "not_validated").otherwise("unknown").alias("status"), reason.alias("reason"), F.when(ok, x).alias("x"), F.when(ok, y).alias("y"))
