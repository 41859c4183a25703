"""Focus points that cameras record, from their tags: a map of `Group:Name` to text. What comes out is geometry as written, never better than not_validated."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import oriented, oriented_box

#: The one camera of each maker whose records are read, and its focus modes that choose by themselves.
CANON, SONY, NIKON = ("Canon", "Canon EOS R3"), ("sony", "ILCE-6600"), ("NIKON CORPORATION", "NIKON Z5_2")
CANON_AUTO, SONY_AUTO, NIKON_AUTO, PANASONIC_MODES = (0, 1, 2, 256, 257, 258), (2, 3, 4), ("AF-A", "AF-S", "AF-C"), (1, 4, 5, 6, 7, 8)
NIKON_AREAS, NIKON_TRACKING, NIKON_SCHEMA, NIKON_HYBRID = (192, 193, 195, 196, 197, 204, 205, 206, 207, 208), (197, 207), "0402", 2
NIKON_PLACE = ("ImageWidth", "ImageHeight", "AreaXPosition", "AreaYPosition", "AreaWidth", "AreaHeight")
PANASONIC_SINGLE = ("16 0", "16 16", "128 0")
CANON_PARTS, CANON_MASKS = ("Widths", "Heights", "XPositions", "YPositions"), ("AFPointsSelected", "AFPointsInFocus")
#: Points of a record at most; words of a mask hold 16.
MOST_POINTS = 4096
POINT = "struct<index:int,role:string,x:double,y:double,w:double,h:double>"
NO_POINTS = f"array<{POINT}>"


def let(given: dict[str, Column], then: Callable[[dict[str, Column]], Column]) -> Column:
    """then() of the given columns, each made once a row however often it is used.

    They are an aggregate's start and then() its end: an item taken from a transformed array would ask all of then() for its type in each row.
    """
    row = F.struct(*(c.alias(n) for n, c in given.items()))
    return F.aggregate(F.array().cast("array<int>"), row, lambda s, _: s, lambda s: then({n: s[n] for n in given}))


def tag(tags: Column, name: str, groups: tuple[str, ...]) -> Column:
    """struct(value, issue) of the one tag of that name in one of the groups: missing, ambiguous_instances, or null if it is one."""
    within = lambda k: F.concat(F.lit(":"), k)
    grouped = lambda k: reduce(or_, (F.contains(within(k), F.lit(f":{g}:")) for g in groups))
    found = F.filter(F.map_keys(tags), lambda k: F.endswith(k, F.lit(f":{name}")) & grouped(k))

    def one(g: dict[str, Column]) -> Column:
        n = F.coalesce(F.size(g["found"]), F.lit(0))
        value = F.when(n == 1, F.element_at(tags, F.get(g["found"], F.lit(0))))
        return F.struct(value.alias("value"), F.when(n > 1, "ambiguous_instances").when(value.isNull(), "missing").alias("issue"))

    return let({"found": found}, one)


def whole(value: Column) -> Column:
    """The whole number that a text is, to six digits; null for any other."""
    number = lambda v: F.when(v.rlike(r"^\s*-?\d{1,6}(\.0*)?\s*$"), F.trim(v).cast("double").cast("int"))
    return let({"v": value}, lambda g: number(g["v"]))


def wholes(value: Column, count: Column | int) -> Column:
    """`count` whole numbers between white space; null for more, fewer or others."""
    each = F.transform(F.split(F.trim(value), r"\s+"), whole)
    return let({"each": each}, lambda g: F.when((F.size(g["each"]) == count) & F.forall(g["each"], lambda v: v.isNotNull()), g["each"]))


def _outcome(vendor: str, rules: list[tuple[Column, str]], good: str, points: Column) -> Column:
    """struct(vendor, status, reason, points): the first rule that holds rejects; one that can't be told holds."""
    reason = F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in rules), F.lit(None).cast("string"))
    return F.struct(F.lit(vendor).alias("vendor"), F.when(reason.isNull(), "not_validated").otherwise("unknown").alias("status"), F.coalesce(reason, F.lit(good)).alias("reason"), F.when(reason.isNull(), points).otherwise(F.array().cast(NO_POINTS)).cast(NO_POINTS).alias("points"))


def _point(index: Column | int, role: Column | str, x: Column, y: Column, w: Column, h: Column) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_column(index).cast("int").alias("index"), as_column(role).alias("role"), x.alias("x"), y.alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def _identity(tags: Column, make: str, model: str, plain: bool = False) -> Column:
    given = tag(tags, "Make", ("IFD0",))["value"]
    return F.coalesce(((F.lower(F.trim(given)) if plain else given) == make) & (tag(tags, "Model", ("IFD0",))["value"] == model), F.lit(False))


def sony(tags: Column) -> Column:
    """The playback location and frame. A location in the very middle is none: cameras write it where they have nothing to say."""
    given = {"known": _identity(tags, *SONY, plain=True), "focus": whole(tag(tags, "FocusMode", ("Sony",))["value"]), "place": tag(tags, "FocusLocation", ("Sony",)), "frame": tag(tags, "FocusFrameSize", ("Sony",))}
    return let(given, lambda g: let(g | {"at": wholes(g["place"]["value"], 4), "size": wholes(g["frame"]["value"], 3)}, _sony))


def _sony(g: dict[str, Column]) -> Column:
    place, size = g["place"], g["size"]
    w, h, x, y = (F.get(g["at"], F.lit(i)) for i in range(4))
    middle = (F.abs(2 * x - w) <= 1) & (F.abs(2 * y - h) <= 1)
    sized = F.coalesce((F.get(size, F.lit(2)) != 0) & (F.get(size, F.lit(0)).between(1, w)) & (F.get(size, F.lit(1)).between(1, h)), F.lit(False))
    bw, bh = (F.when(sized, F.get(size, F.lit(i)) / n) for i, n in ((0, w), (1, h)))
    outside = F.coalesce((x / w - bw / 2 < 0) | (y / h - bh / 2 < 0) | (x / w + bw / 2 > 1) | (y / h + bh / 2 > 1), F.lit(False))
    is_issue = lambda f, issue: F.coalesce(f["issue"] == issue, F.lit(False))
    rules = [
        (~g["known"], "unsupported_or_unknown_camera"), (~g["focus"].isin(*SONY_AUTO), "focus_mode_not_supported"), (is_issue(place, "missing"), "missing"), (is_issue(place, "ambiguous_instances"), "ambiguous_instances"), (g["at"].isNull() | (w <= 0) | (h <= 0), "invalid_focus_location"),
        ((x < 0) | (y < 0) | (x >= w) | (y >= h), "focus_location_outside_frame"), (middle, "camera_center_fallback_ambiguous"), (~sized & ~is_issue(g["frame"], "missing"), "invalid_or_ambiguous_focus_frame"), (outside, "area_extends_outside_frame"),
    ]
    return _outcome("sony", rules, "playback_location_geometry_only", F.array(_point(0, "playback_location", x / w, y / h, bw, bh)))


def nikon(tags: Column) -> Column:
    """The camera's focus area of one version of its record, its centre from the top left, its size if it is given whole."""
    texts = {n: tag(tags, n, ("Nikon",)) for n in ("AFInfo2Version", "FocusMode", "AFAreaMode", "AFDetectionMethod", "AFCoordinatesAvailable", *(f"AF{n}" for n in NIKON_PLACE))}
    numbers = lambda g: {f"_{n}": whole(g[n]["value"]) for n in texts if n not in ("AFInfo2Version", "FocusMode")}
    return let({"known": _identity(tags, *NIKON)} | texts, lambda g: let(g | numbers(g), _nikon))


def _nikon(g: dict[str, Column]) -> Column:
    w, h, x, y, bw, bh = (g[f"_AF{n}"] for n in NIKON_PLACE)
    area = g["_AFAreaMode"]
    unsized = F.coalesce((g["AFAreaWidth"]["issue"] == "missing") & (g["AFAreaHeight"]["issue"] == "missing"), F.lit(False))
    beyond = (2 * x - bw < 0) | (2 * y - bh < 0) | (2 * x + bw > 2 * w) | (2 * y + bh > 2 * h)
    rules = [
        (~g["known"], "unsupported_or_unknown_camera"), (g["AFInfo2Version"]["value"] != NIKON_SCHEMA, "af_info2_version_unsupported"),
        (~(F.rtrim(g["FocusMode"]["value"]).isin(*NIKON_AUTO) & area.isin(*NIKON_AREAS) & (g["_AFDetectionMethod"] == NIKON_HYBRID)), "focus_mode_not_supported"), (g["_AFCoordinatesAvailable"] != 1, "af_coordinates_unavailable_or_unsupported"),
        ((w <= 0) | (h <= 0), "missing_invalid_or_ambiguous_af_frame"), (x.isNull() | y.isNull(), "af_center_missing_invalid_or_ambiguous"), (area.isin(*NIKON_TRACKING) & (x == 0) & (y == 0), "auto_or_tracking_has_no_determined_target"), ((x < 0) | (y < 0) | (x >= w) | (y >= h), "af_center_outside_reference_frame"),
        (~unsized & ~F.coalesce((bw > 0) & (bh > 0), F.lit(False)), "af_area_size_partial_invalid_or_ambiguous"), (~unsized & F.coalesce(beyond, F.lit(False)), "af_area_extends_outside_reference_frame"),
    ]
    return _outcome("nikon", rules, "camera_AF_geometry_only", F.array(_point(0, F.when(unsized, "camera_reported_AF_point").otherwise("camera_reported_AF_area"), x / w, y / h, bw / w, bh / h)))


def panasonic(tags: Column) -> Column:
    """The focus point and area as shares of the frame, in the modes of a single area."""
    numbers = lambda c: F.transform(F.split(F.trim(c["value"]), r"\s+"), lambda v: v.try_cast("double"))
    given = {"maker": F.lower(F.trim(tag(tags, "Make", ("IFD0", "PanasonicRaw"))["value"])), **{n: tag(tags, n, ("Panasonic",)) for n in ("FocusMode", "AFAreaMode", "AFPointPosition", "AFAreaSize")}}
    return let(given, lambda g: let(g | {"at": numbers(g["AFPointPosition"]), "size": numbers(g["AFAreaSize"]), "focus": whole(g["FocusMode"]["value"])}, _panasonic))


def _panasonic(g: dict[str, Column]) -> Column:
    at, size, missing = g["at"], g["size"], F.coalesce(g["AFAreaSize"]["issue"] == "missing", F.lit(False))
    x, y, w, h = F.get(at, F.lit(0)), F.get(at, F.lit(1)), F.get(size, F.lit(0)), F.get(size, F.lit(1))
    within = lambda a, b, least: F.coalesce(~F.isnan(a) & ~F.isnan(b) & a.between(0, 1) & b.between(0, 1) & (a > least) & (b > least), F.lit(False))
    areas = F.regexp_replace(F.trim(g["AFAreaMode"]["value"]), r"\s+", " ")
    outside = F.coalesce((x - w / 2 < 0) | (y - h / 2 < 0) | (x + w / 2 > 1) | (y + h / 2 > 1), F.lit(False))
    rules = [
        (~F.coalesce(g["maker"].isin("panasonic", "panasonic corporation"), F.lit(False)), "unsupported_or_unknown_camera"), (~F.coalesce(g["focus"].isin(*PANASONIC_MODES) & areas.isin(*PANASONIC_SINGLE), F.lit(False)), "focus_mode_not_supported"),
        ((F.size(at) != 2) | ~within(x, y, -1), "invalid_or_ambiguous_point"), (~missing & ((F.coalesce(F.size(size), F.lit(0)) != 2) | ~within(w, h, 0)), "invalid_or_ambiguous_area"), (~missing & outside, "area_extends_outside_frame"),
    ]
    return _outcome("panasonic", rules, "normalized_geometry_only", F.array(_point(0, "camera_reported_AF_point", x, y, F.when(~missing, w), F.when(~missing, h))))


def canon(tags: Column) -> Column:
    """All points that the camera selected or reported in focus, or none: one record that doesn't fit rejects the collection.

    Points have the frame's middle as origin, y upwards. Those of no size are not used; as many others must be there as the record says. Masks are words of
    16 points, the lowest bit first; a bit beyond the points, or of one that isn't used, makes the record invalid.
    """
    own = ("Canon", "Track4")
    numbers = {n: whole(tag(tags, n, own)["value"]) for n in ("NumAFPoints", "ValidAFPoints", "AFImageWidth", "AFImageHeight", "FocusMode", "AFAreaMode", "CanonImageWidth", "CanonImageHeight")}
    texts = {n: tag(tags, n, own) for n in (*(f"AFArea{p}" for p in CANON_PARTS), *CANON_MASKS)}
    exif = {n: whole(tag(tags, n, ("ExifIFD",))["value"]) for n in ("ExifImageWidth", "ExifImageHeight")}
    arrays = lambda g: {p: wholes(g[f"AFArea{p}"]["value"], g["NumAFPoints"]) for p in CANON_PARTS} | {f"_{m}": wholes(g[m]["value"], F.floor((g["NumAFPoints"] + 15) / 16).cast("int")) for m in CANON_MASKS}
    return let({"known": _identity(tags, *CANON)} | numbers | texts | exif, lambda g: let(g | arrays(g), lambda h: let(h | _canon_points(h), _canon)))


def _canon_points(g: dict[str, Column]) -> dict[str, Column]:
    """used: points of a size; and the places of the bits in each mask."""
    fw, fh = g["AFImageWidth"], g["AFImageHeight"]
    bits = F.sequence(F.lit(0), F.lit(15))
    points = F.transform(F.arrays_zip(*(g[p].alias(p) for p in CANON_PARTS)), lambda p, i: F.struct(i.alias("i"), p["Widths"].alias("w"), p["Heights"].alias("h"), (fw / 2 + p["XPositions"]).alias("cx"), (fh / 2 - p["YPositions"]).alias("cy")))
    places = lambda m: F.flatten(F.transform(g[f"_{m}"], lambda v, k: F.transform(F.filter(bits, lambda b: F.call_function("getbit", v.cast("long").bitwiseAND(F.lit(0xFFFF)), b) == 1), lambda b: k * 16 + b)))
    return {"used": F.filter(points, lambda p: (p["w"] != 0) | (p["h"] != 0)), **{f"at_{m}": places(m) for m in CANON_MASKS}}


def _canon(g: dict[str, Column]) -> Column:
    count, valid, fw, fh, used = g["NumAFPoints"], g["ValidAFPoints"], g["AFImageWidth"], g["AFImageHeight"], g["used"]
    odd = F.exists(used, lambda p: (p["w"] <= 0) | (p["h"] <= 0) | (p["cx"] < 0) | (p["cy"] < 0) | (p["cx"] >= fw) | (p["cy"] >= fh))
    beyond = F.exists(used, lambda p: (p["cx"] - p["w"] / 2 < 0) | (p["cy"] - p["h"] / 2 < 0) | (p["cx"] + p["w"] / 2 > fw) | (p["cy"] + p["h"] / 2 > fh))
    wrong = lambda m: ~F.coalesce(g[m]["issue"] == "missing", F.lit(False)) & F.coalesce(g[f"at_{m}"].isNull() | F.exists(g[f"at_{m}"], lambda b: b >= count) | (F.size(F.array_except(g[f"at_{m}"], F.transform(used, lambda p: p["i"]))) > 0), F.lit(True))
    chosen, sharp = (g[f"at_{m}"] for m in CANON_MASKS)
    on = lambda places, p: F.coalesce(F.array_contains(places, p["i"]), F.lit(False))
    active = F.filter(used, lambda p: on(chosen, p) | on(sharp, p))
    role = lambda p: F.when(on(chosen, p) & on(sharp, p), "selected_and_camera_reported_in_focus").when(on(sharp, p), "camera_reported_in_focus").otherwise("selected")
    same = lambda w, h: F.coalesce((g[w] == fw) & (g[h] == fh), F.lit(False))
    rules = [
        (~g["known"], "unsupported_or_unknown_camera"), ((count <= 0) | (count > MOST_POINTS) | (valid < 0) | (valid > count), "point_counts_missing_invalid_or_conflicting"), ((fw <= 0) | (fh <= 0), "missing_invalid_or_conflicting_af_frame"),
        (F.greatest(*(g[p].isNull() for p in CANON_PARTS)), "point_arrays_missing_invalid_or_conflicting"), (odd, "valid_point_geometry_outside_frame_or_nonpositive"), (beyond, "valid_point_area_extends_outside_frame"), (F.size(used) != valid, "valid_point_count_does_not_match_positive_areas"),
        (wrong(CANON_MASKS[0]) | wrong(CANON_MASKS[1]), "point_state_invalid_or_conflicting"), (F.size(active) == 0, "no_reported_active_AF_point"), (~g["FocusMode"].isin(*CANON_AUTO) | (g["AFAreaMode"] == 0), "focus_mode_not_supported"),
        (~same("CanonImageWidth", "CanonImageHeight") | ~same("ExifImageWidth", "ExifImageHeight"), "recorded_dimensions_mismatch"),
    ]
    return _outcome("canon", rules, "active_camera_AF_geometry_only", F.transform(active, lambda p: _point(p["i"], role(p), p["cx"] / fw, p["cy"] / fh, p["w"] / fw, p["h"] / fh)))


def focus_points(tags: Column) -> Column:
    """struct(vendor, status, reason, points) by the maker's rules; a camera of no known maker is read as the last one, and so is unsupported unless it is that maker's."""
    return F.when(_identity(tags, *CANON), canon(tags)).when(_identity(tags, *SONY, plain=True), sony(tags)).when(_identity(tags, *NIKON), nikon(tags)).otherwise(panasonic(tags))


def upright(points: Column, orientation: Column) -> Column:
    """Points with their place and box as the photo is shown; null orientations and those beyond 1 to 8 give none."""

    def turned(p: Column) -> Column:
        at = oriented(p["x"], p["y"], orientation)
        box = oriented_box(F.struct((p["x"] - p["w"] / 2).alias("x"), (p["y"] - p["h"] / 2).alias("y"), p["w"].alias("w"), p["h"].alias("h")), orientation)
        return _point(p["index"], p["role"], at["x"], at["y"], F.when(p["w"].isNotNull(), box["w"]), F.when(p["h"].isNotNull(), box["h"]))

    return F.when(orientation.between(1, 8), F.transform(points, turned))
