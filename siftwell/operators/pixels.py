"""Regions of gray and colour images, which are row-major arrays: summed-area tables, descriptors, hashes of parts, template search.

Pixels are whole numbers. Boxes are structs of x, y, w, h in the unit square and cover at least a pixel; no box reaches beyond
its image. Kernels are Arrow functions over a batch, what follows from their tables is Catalyst's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import digest, group_digests
from ..functions.storage import written
from .measurement import dhash

LONGS = "array<bigint>"
#: What the tables of summed() add up: a pixel, its square, the squared differences across and down, and the squared Laplacian.
TABLES = ("value", "square", "across", "down", "laplacian")


def image_ok(pixels: Column, width: Column, channels: int = 1) -> Column:
    """Whether pixels are whole rows of width x channels, at least one, none of them null."""
    part = width * channels
    return F.coalesce((width > 0) & (F.size(pixels) > 0) & (F.size(pixels) % F.nullif(part, F.lit(0)) == 0) & ~F.exists(pixels, lambda p: p.isNull()), F.lit(False))


def _stated(box: Column) -> Column:
    """Whether a box has all four numbers; the least and greatest of columns pass over nulls."""
    return box["x"].isNotNull() & box["y"].isNotNull() & box["w"].isNotNull() & box["h"].isNotNull()


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """struct(x0, y0, x1, y1) in whole pixels, the ends exclusive: all that a unit box touches; null for a box that is null or touches none."""
    low = lambda p, n: F.greatest(F.floor(box[p] * n), F.lit(0)).cast("int")
    high = lambda p, s, n: F.least(F.ceil((box[p] + box[s]) * n), n).cast("int")
    out = F.struct(low("x", width).alias("x0"), low("y", height).alias("y0"), high("x", "w", width).alias("x1"), high("y", "h", height).alias("y1"))
    return F.when(_stated(box) & width.isNotNull() & height.isNotNull() & (out["x0"] < out["x1"]) & (out["y0"] < out["y1"]), out)


def _shapes(pixels: pa.Array, width: pa.Array) -> tuple[list, list[tuple[int, int, np.ndarray]]]:
    """(a place for each row, (width, rows of that shape, their images)): images of one shape are worked on together."""
    flat, at, wide = pixels.values.to_numpy(zero_copy_only=False), pixels.offsets.to_numpy(), width.to_numpy(zero_copy_only=False)
    known, size = ~pixels.is_null().to_numpy(zero_copy_only=False), np.diff(at)
    groups = []
    for length, w in {(int(a), int(b)) for a, b, ok in zip(size, wide, known, strict=True) if ok}:
        rows = np.flatnonzero(known & (size == length) & (wide == w))
        groups.append((w, rows, np.stack([flat[at[r] : at[r] + length] for r in rows]).astype(np.int64)))
    return [None] * len(pixels), groups


def _sums(images: np.ndarray) -> np.ndarray:
    """Summed-area tables of images (n, height, width), with a row and a column of zeros before them."""
    out = np.zeros((len(images), images.shape[1] + 1, images.shape[2] + 1), images.dtype)
    np.cumsum(np.cumsum(images, 1), 2, out=out[:, 1:, 1:])
    return out


def summed(pixels: Column, width: Column) -> Column:
    """struct of TABLES, each an array of (height + 1) x (width + 1) sums over all pixels above and left of a place; null for what is no image.

    Differences are central and need both neighbours: at an image's edge they are 0. All sums are exact.
    """

    @F.arrow_udf(",".join(f"{t} {LONGS}" for t in TABLES))
    def tables(pixels: pa.Array, width: pa.Array) -> pa.Array:
        out, groups = _shapes(pixels, width)
        held = {t: list(out) for t in TABLES}
        for w, rows, flat in groups:
            g = flat.reshape(len(rows), -1, w)
            across, down, laplacian = np.zeros_like(g), np.zeros_like(g), np.zeros_like(g)
            inner = np.s_[:, 1:-1, 1:-1]
            across[inner], down[inner] = (g[:, 1:-1, 2:] - g[:, 1:-1, :-2]) ** 2, (g[:, 2:, 1:-1] - g[:, :-2, 1:-1]) ** 2
            laplacian[inner] = (4 * g[inner] - g[:, :-2, 1:-1] - g[:, 2:, 1:-1] - g[:, 1:-1, :-2] - g[:, 1:-1, 2:]) ** 2
            for name, part in zip(TABLES, (g, g * g, across, down, laplacian), strict=True):
                for r, table in zip(rows, _sums(part), strict=True):
                    held[name][r] = table.ravel()
        arrays = [pa.array(held[t], pa.list_(pa.int64())) for t in TABLES]
        return pa.StructArray.from_arrays(arrays, list(TABLES), mask=arrays[0].is_null())

    ok = image_ok(pixels, width)
    return tables(F.when(ok, pixels).cast(LONGS), F.when(ok, width).otherwise(1).cast("int"))


def box_sum(table: Column, width: Column, box: Column) -> Column:
    """The sum over a pixel box (x0, y0, x1, y1): four reads, whatever its size; 0 for an empty one."""
    at = lambda y, x: F.get(table, (y * (width + 1) + x).cast("int"))
    full = (box["x1"] > box["x0"]) & (box["y1"] > box["y0"])
    return F.when(full, at(box["y1"], box["x1"]) - at(box["y0"], box["x1"]) - at(box["y1"], box["x0"]) + at(box["y0"], box["x0"])).when(box.isNotNull(), 0).cast("long")


#: Fixed limits of region_state(): pixels and contrast (of 1) for a region to count, detail and curvature under both of which it is
#: blurred, and over both of which it is clear. Detail is the Laplacian's energy over the variance, curvature over the gradient's.
LIMITS = {"pixels": 16, "contrast": 0.02, "blurred": (0.35, 0.5), "clear": (1.2, 1.5)}


def region_figures(tables: Column, width: Column, box: Column, deepest: int = 255) -> Column:
    """struct(pixels, mean, contrast, detail, curvature, anisotropy) of a pixel box, from summed() alone.

    contrast is the standard deviation as a share of `deepest`. detail, curvature and anisotropy are of the pixels that have all their neighbours, in the image or
    the region alike; they are null where there is none, or nothing to divide by.
    """
    height = F.floor(F.size(tables["value"]) / (width + 1)).cast("int") - 1
    n = ((box["x1"] - box["x0"]) * (box["y1"] - box["y0"])).cast("double")
    inner = F.struct(F.greatest(box["x0"], F.lit(1)).alias("x0"), F.greatest(box["y0"], F.lit(1)).alias("y0"), F.least(box["x1"], width - 1).alias("x1"), F.least(box["y1"], height - 1).alias("y1"))
    of = lambda name: box_sum(tables[name], width, box)
    variance = of("square") / n - (of("value") / n) * (of("value") / n)
    m = F.greatest(inner["x1"] - inner["x0"], F.lit(0)) * F.greatest(inner["y1"] - inner["y0"], F.lit(0))
    energy = lambda name: box_sum(tables[name], width, inner) / F.nullif(m.cast("double"), F.lit(0.0))
    gradient = (energy("across") + energy("down")) / 4
    ratio = lambda a, b: a / F.nullif(b, F.lit(0.0))
    return F.struct(
        n.cast("long").alias("pixels"), (of("value") / n).alias("mean"), (F.sqrt(F.greatest(variance, F.lit(0.0))) / deepest).alias("contrast"),
        ratio(energy("laplacian"), variance).alias("detail"), ratio(energy("laplacian"), gradient).alias("curvature"),
        ratio(F.greatest(energy("across"), energy("down")), F.least(energy("across"), energy("down"))).alias("anisotropy"),
    )


def region_state(figures: Column, limits: dict = LIMITS) -> Column:
    """struct(state, reason): insufficient before blurred before clear before uncertain; anisotropy is told, and decides nothing."""
    f = lambda name: F.coalesce(figures[name], F.lit(0.0))
    low, high = limits["blurred"], limits["clear"]
    few = figures.isNull() | (f("pixels") < limits["pixels"]) | figures["detail"].isNull()
    cases = ((few, "insufficient", "too_few_pixels"), (f("contrast") < limits["contrast"], "insufficient", "low_contrast"), ((f("detail") < low[0]) & (f("curvature") < low[1]), "severe_blur", "little_detail"), ((f("detail") >= high[0]) & (f("curvature") >= high[1]), "clear", "consistent_detail"))
    pick = lambda i, rest: F.coalesce(*(F.when(c[0], c[i]) for c in cases), F.lit(rest))
    return F.struct(pick(1, "uncertain").alias("state"), pick(2, "borderline_detail").alias("reason"))


def measured(images: DataFrame, regions: DataFrame, key: str, pixels: str = "pixels", width: str = "width", box: str = "box", limits: dict = LIMITS) -> DataFrame:
    """regions with figures and state of their box in the image of the same key.

    The image's tables are made once, not once a region, and joined to the regions; an image with many of them is split by Spark, as nothing
    is grouped. A region without an image, or of a box that touches none, is insufficient.
    """
    tables = images.select(F.col(key).alias("_key"), F.col(width).alias("_width"), summed(F.col(pixels), F.col(width)).alias("_tables"))
    height = F.floor(F.size(F.col("_tables.value")) / (F.col("_width") + 1)).cast("int") - 1
    rows = regions.join(tables, F.col(key) == F.col("_key"), "left").withColumn("_box", pixel_box(F.col(box), F.col("_width"), height))
    found = rows.withColumn("figures", F.when(F.col("_box").isNotNull() & F.col("_tables").isNotNull(), region_figures(F.col("_tables"), F.col("_width"), F.col("_box"))))
    return found.drop("_key", "_width", "_tables", "_box").withColumn("state", region_state(F.col("figures"), limits))


def cropped(pixels: Column, width: Column, box: Column, channels: int = 1) -> Column:
    """The pixels of a pixel box, still row-major: slices of rows, so that only they travel on."""
    rows = F.sequence(box["y0"], box["y1"] - 1)
    return F.flatten(F.transform(rows, lambda y: F.slice(pixels, (y * width + box["x0"]) * channels + 1, (box["x1"] - box["x0"]) * channels)))


#: Colour bins (hues x saturations), octants of the gradient, levels of gray; shares trimmed of a region's sides; the weights of colour and texture.
HUES, SATURATIONS, OCTANTS, LEVELS = 12, 5, 8, 8
TRIM = (0.08, 0.05)
COLOUR_WEIGHT, TEXTURE_WEIGHT = 0.68, 0.32


def _descriptors(rgb: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(colour, texture, achromatic, flat) of images (n, height, width, 3) of one shape."""
    n, h, w, _ = rgb.shape
    if min(h, w) < least:
        return None
    apart = (rgb.max(3) - rgb.min(3)).reshape(n, -1)
    tx, ty = (int(np.rint(side * share)) for side, share in ((w, TRIM[0]), (h, TRIM[1])))
    gray = (299 * rgb[..., 0] + 587 * rgb[..., 1] + 114 * rgb[..., 2]) / 1000
    flat = gray.reshape(n, -1).std(1)
    if w - 2 * tx >= least and h - 2 * ty >= least:
        rgb, gray = rgb[:, ty : h - ty, tx : w - tx], gray[:, ty : h - ty, tx : w - tx]
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    most, span = rgb.max(3).astype(np.int64), (rgb.max(3) - rgb.min(3)).astype(np.int64)
    # 6 x hue x span as whole numbers, so that no bin depends on rounding
    six = np.where(span == 0, 0, np.where(most == r, (g - b) % np.maximum(6 * span, 1), np.where(most == g, b - r + 2 * span, r - g + 4 * span)))
    hue = six * HUES // np.maximum(6 * span, 1)
    saturation = np.minimum(span * SATURATIONS // np.maximum(most, 1), SATURATIONS - 1)
    image = np.arange(n)[:, None, None]
    count = lambda bins, many, weight=None: np.bincount((image * many + bins).ravel(), None if weight is None else weight.ravel(), n * many).reshape(n, many).astype(float)
    share = lambda x: x / np.maximum(x.sum(1, keepdims=True), 1e-6)
    padded = np.pad(gray, ((0, 0), (1, 1), (1, 1)), mode="edge")
    gx, gy = padded[:, 1:-1, 2:] - padded[:, 1:-1, :-2], padded[:, 2:, 1:-1] - padded[:, :-2, 1:-1]
    steep = np.abs(gy) >= np.abs(gx)
    upper = np.where(gx > 0, np.where(steep, 1, 0), np.where(steep, 2, 3))  # octants of gy > 0, or of gy = 0 and gx >= 0
    octant = np.where((gy > 0) | ((gy == 0) & (gx >= 0)), upper, np.where(gx < 0, np.where(steep, 5, 4), np.where(steep, 6, 7)))
    level = np.minimum((gray * LEVELS // 256).astype(np.int64), LEVELS - 1)
    texture = np.concatenate([share(count(octant, OCTANTS, np.hypot(gx, gy))), share(count(level, LEVELS))], 1)
    return share(count(hue * SATURATIONS + saturation, HUES * SATURATIONS)), texture, apart.max(1) <= 2, flat < 2


def described(rgb: Column, width: Column, least: int = 8) -> Column:
    """struct(colour, texture, achromatic, flat) of the pixels of a colour region (three numbers of 0 to 255 a pixel): two histograms and what they can't tell.

    Null for a region whose sides are under `least`. Colour counts hues by saturations, texture the octants of the gradient by its length, and levels of gray;
    each sums to 1. Of a region's sides a small part is trimmed, which is background more often than not.
    """

    @F.arrow_udf("colour array<double>, texture array<double>, achromatic boolean, flat boolean")
    def kernel(rgb: pa.Array, width: pa.Array) -> pa.Array:
        out, groups = _shapes(rgb, width)
        held = [list(out) for _ in range(4)]
        for w, rows, flat in groups:
            if (found := _descriptors(flat.reshape(len(rows), -1, w, 3), least)) is not None:
                for part, values in zip(held, found, strict=True):
                    for r, v in zip(rows, values, strict=True):
                        part[r] = v
        arrays = [pa.array(part, kind) for part, kind in zip(held, (pa.list_(pa.float64()), pa.list_(pa.float64()), pa.bool_(), pa.bool_()), strict=True)]
        return pa.StructArray.from_arrays(arrays, ["colour", "texture", "achromatic", "flat"], mask=arrays[0].is_null())

    ok = image_ok(rgb, width, 3)
    return kernel(F.when(ok, rgb).cast(LONGS), F.when(ok, width).otherwise(1).cast("int"))


#: The head's and the upper body's box from a face's, as (left of its middle, below its top, width, height), in its widths and heights.
AROUND = {"face": (0.5, 0.0, 1.0, 1.0), "head": (0.70, -0.28, 1.40, 1.58), "upper_body": (1.25, 0.78, 2.50, 3.15)}


def around(box: Column, kind: str) -> Column:
    """The box of a kind of AROUND from a face's box, clipped to the unit square; null if nothing of it is left."""
    left, down, w, h = AROUND[kind]
    x, y = box["x"] + box["w"] / 2 - left * box["w"], box["y"] + down * box["h"]
    x0, y0, x1, y1 = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0)), F.least(x + w * box["w"], F.lit(1.0)), F.least(y + h * box["h"], F.lit(1.0))
    return F.when(_stated(box) & (x1 - x0 > 1e-5) & (y1 - y0 > 1e-5), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))


def references(images: DataFrame, faces: DataFrame, key: str, rgb: str = "rgb", width: str = "width", box: str = "box", least: int = 8) -> DataFrame:
    """faces with face, head and upper_body, a descriptor each (null where it is too small), and flags: what a reference built on the box can't tell.

    `achromatic`: neither head nor body has a colour; `low_texture`: neither has texture, or neither is there. Rows are cut from the image before
    Python sees them. Faces without an image have null descriptors.
    """
    rows = faces.join(images.select(F.col(key).alias("_key"), F.col(rgb).alias("_rgb"), F.col(width).cast("int").alias("_width")), F.col(key) == F.col("_key"), "left")
    height = F.floor(F.size("_rgb") / F.nullif(F.col("_width") * 3, F.lit(0))).cast("int")
    ok = image_ok(F.col("_rgb"), F.col("_width"), 3)
    for kind in AROUND:
        at = F.when(ok, pixel_box(around(F.col(box), kind), F.col("_width"), height))
        rows = rows.withColumn(f"_{kind}_box", at)
    for kind in AROUND:
        at = F.col(f"_{kind}_box")
        rows = rows.withColumn(kind, described(F.when(at.isNotNull(), cropped(F.col("_rgb"), F.col("_width"), at, 3)), at["x1"] - at["x0"], least))
    seen = F.filter(F.array("head", "upper_body"), lambda d: d.isNotNull())
    flag = lambda name, when: F.when(when, F.lit(name))
    achromatic = (F.size(seen) > 0) & F.forall(seen, lambda d: d["achromatic"])
    flags = F.array_compact(F.array(flag("achromatic", achromatic), flag("low_texture", F.forall(seen, lambda d: d["flat"]))))
    return rows.withColumn("flags", flags).drop("_key", "_rgb", "_width", *(f"_{k}_box" for k in AROUND))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: shared colour and the cosine of textures, weighed; null if either descriptor is."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = lambda p, q: total(F.zip_with(p, q, lambda x, y: x * y))
    length = F.sqrt(dot(a["texture"], a["texture"])) * F.sqrt(dot(b["texture"], b["texture"]))
    cosine = F.when(length > 1e-8, dot(a["texture"], b["texture"]) / length).otherwise(0.0)
    within = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    shared = total(F.zip_with(a["colour"], b["colour"], lambda x, y: F.least(x, y)))
    return F.when(a.isNotNull() & b.isNotNull(), within(COLOUR_WEIGHT * shared + TEXTURE_WEIGHT * within(cosine)))


#: How much the likeness of a part weighs.
WEIGHTS = {"face": 0.25, "head": 0.35, "upper_body": 0.47}


def appearance(a: dict[str, Column], b: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Mean likeness of the parts that both have, by weight; 0 where they share none."""
    each = {k: likeness(a[k], b[k]) for k in weights}
    add = lambda value: sum((F.when(each[k].isNotNull(), value(k)).otherwise(0.0) for k in weights), F.lit(0.0))
    return F.coalesce(add(lambda k: each[k] * weights[k]) / F.nullif(add(lambda k: F.lit(weights[k])), F.lit(0.0)), F.lit(0.0))


def part_hash(pixels: Column, width: Column, box: Column, across: int = 9, down: int = 8) -> Column:
    """64 signs of neighbouring differences of a pixel box, as a bigint, read at across x down places in the middles of its equal parts; the first is the highest bit."""
    places = lambda n, lo, hi: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (lo + F.floor((2 * i + 1) * (hi - lo) / (2 * n))).cast("int"))
    columns = places(across, box["x0"], box["x1"])
    read = F.flatten(F.transform(places(down, box["y0"], box["y1"]), lambda y: F.transform(columns, lambda x: F.get(pixels, y * width + x))))
    return F.when(box.isNotNull(), F.get(F.transform(F.array(read), lambda p: dhash(p, across, down)), F.lit(0)))  # read once, not at every sign


def region_features(images: DataFrame, regions: DataFrame, stored: DataFrame | None, key: str, region: str, pixels: str = "pixels", width: str = "width", box: str = "box", schema: str = "1") -> DataFrame:
    """(key, region, inputs, hash, recomputed, root): the hash of every region, taken from stored (key, region, inputs, hash) where its inputs are still the same.

    inputs is the digest of what a hash depends on: schema, the image's own digest, its width and the box. root binds a photo's hashes and inputs as the digest of its
    regions' digests, so that any change shows in it; it is made in parts, so a photo may have any number of regions. Only regions whose inputs differ meet
    the pixels, and the rows are written once. A region is one row of regions; one without an image keeps no hash. Regions that are stored but no longer given are dropped.
    """
    image = images.select(F.col(key).alias("_key"), F.col(pixels).alias("_pixels"), F.col(width).cast("int").alias("_width"))
    pictures = image.select("_key", digest(F.to_json("_pixels"), F.col("_width")).alias("_image"))
    b = F.col(box)
    now = regions.join(pictures, F.col(key) == F.col("_key"), "left").select(key, region, box, digest(F.lit(schema), F.col("_image"), *(b[c] for c in "xywh")).alias("inputs"))
    if stored is not None:
        old = stored.select(F.col(key).alias("_k"), F.col(region).alias("_r"), F.col("inputs").alias("_inputs"), F.col("hash"), F.lit(True).alias("_known"))
        known = now.join(old, (F.col(key) == F.col("_k")) & (F.col(region) == F.col("_r")) & (F.col("inputs") == F.col("_inputs")), "left").drop("_k", "_r", "_inputs")
    else:
        known = now.withColumns({"hash": F.lit(None).cast("long"), "_known": F.lit(None).cast("boolean")})
    height = F.floor(F.size("_pixels") / F.nullif(F.col("_width"), F.lit(0))).cast("int")
    at = F.when(image_ok(F.col("_pixels"), F.col("_width")), pixel_box(b, F.col("_width"), height))
    met = known.join(image, (F.col(key) == F.col("_key")) & F.col("_known").isNull(), "left").withColumn("_box", at)
    made = F.when(F.col("_known").isNull(), part_hash(F.col("_pixels"), F.col("_width"), F.col("_box"))).otherwise(F.col("hash"))
    rows = written(met.select(key, region, "inputs", made.alias("hash"), F.col("_known").isNull().alias("recomputed")), "features")
    roots = group_digests(rows, key, F.col(region), digest(F.col("inputs"), F.col("hash"))).select(F.col(key).alias("_key"), F.col("digest").alias("root"))
    return rows.join(roots, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


#: The sizes at which a template is sought, how gray and edges weigh, the least response, peaks a size, overlap at which the weaker of two goes, anchors kept.
SCALES = (0.55, 0.75, 1.0, 1.3, 1.7)
GRAY_WEIGHT, EDGE_WEIGHT, RESPONSE, PEAKS, OVERLAP, ANCHORS = 0.42, 0.58, 0.42, 2, 0.35, 2
#: Responses rank by so many decimals, so that equal ones are equal whichever way they are added up.
DIGITS = 9


def _edges(gray: np.ndarray) -> np.ndarray:
    """Lengths of the central differences; beyond its edge an image goes on as there."""
    p = np.pad(gray.astype(float), 1, mode="edge")
    return np.hypot(p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1])


def _resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal parts of the area, pixels at a part's border by their share."""

    def weights(n: int, m: int) -> np.ndarray:
        lo = np.maximum(np.arange(m)[:, None] * n / m, np.arange(n)[None])
        hi = np.minimum((np.arange(m)[:, None] + 1) * n / m, np.arange(n)[None] + 1)
        return np.maximum(hi - lo, 0) * m / n

    return weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T


def correlated(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at every offset where the template lies within the image; NaN where either has no contrast.

    The products come from one Fourier transform, the sums and squares of all windows from two summed-area tables.
    """
    h, w = template.shape
    t = template - template.mean()
    image = image - image.mean()  # changes no correlation and keeps the squares small
    shape = (image.shape[0] + h - 1, image.shape[1] + w - 1)
    both = np.fft.irfft2(np.fft.rfft2(image, shape) * np.fft.rfft2(t[::-1, ::-1], shape), shape)[h - 1 : image.shape[0], w - 1 : image.shape[1]]

    def windows(values: np.ndarray) -> np.ndarray:
        s = _sums(values[None])[0]
        return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]

    spread = np.maximum(windows(image * image) - windows(image) ** 2 / (h * w), 0)
    spread, own = np.where(spread < 1e-9 * max(float((image * image).mean()), 1e-30) * h * w, 0, spread), float((t * t).sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((spread > 0) & (own > 1e-12), both / np.sqrt(spread * own), np.nan)


def _peaks(image: np.ndarray, template: np.ndarray, box: tuple[float, float], scales: tuple[float, ...], least: tuple[int, int]) -> list[dict]:
    """Up to PEAKS places a size, best first; behind one, half a template around it is closed. Of equal responses the first row, then column, counts."""
    edge, edges, (height, width) = _edges(image), _edges(template), image.shape
    base_w, base_h = (max(least[0], int(np.rint(side * n))) for side, n in zip(box, (width, height), strict=True))
    out = []
    for scale in scales:
        w, h = (max(least[1], int(np.rint(side * scale))) for side in (base_w, base_h))
        if w >= width or h >= height:
            continue
        response = GRAY_WEIGHT * correlated(image.astype(float), _resized(template, h, w)) + EDGE_WEIGHT * correlated(edge, _resized(edges, h, w))
        response = np.round(np.nan_to_num(response, nan=-1.0), DIGITS)
        for nth in range(PEAKS):
            y, x = np.unravel_index(response.argmax(), response.shape)
            if response[y, x] < RESPONSE:
                break
            out.append({"scale": scale, "nth": nth, "score": float(response[y, x]), "x": x / width, "y": y / height, "w": w / width, "h": h / height})
            response[max(0, y - h // 2) : y + h, max(0, x - w // 2) : x + w] = -1
    return out


def template_peaks(rows: DataFrame, pixels: str = "pixels", width: str = "width", template: str = "template", template_width: str = "template_width", box: str = "box", scales: tuple[float, ...] = SCALES, least: tuple[int, int] = (12, 10)) -> DataFrame:
    """rows beside each of their peaks (scale, nth, score, x, y, w, h): where the image looks like the row's template, at sizes that are multiples of box's.

    least: the shortest side of the box in pixels, and of a resized template. A row whose image or template is none, or whose template
    is as large as its image at every size, has no peak.
    """
    kind = "array<struct<scale:double,nth:int,score:double,x:double,y:double,w:double,h:double>>"

    @F.arrow_udf(kind)
    def search(pixels: pa.Array, width: pa.Array, template: pa.Array, template_width: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        arrow = pa.list_(pa.struct([("scale", pa.float64()), ("nth", pa.int32()), ("score", pa.float64()), ("x", pa.float64()), ("y", pa.float64()), ("w", pa.float64()), ("h", pa.float64())]))
        out = []
        for p, a, t, b, x, y in zip(pixels, width.to_pylist(), template, template_width.to_pylist(), w.to_pylist(), h.to_pylist(), strict=True):
            if not p.is_valid or not t.is_valid or x is None or y is None:
                out.append([])
                continue
            grid = lambda v, wide: v.values.to_numpy().reshape(-1, wide)
            out.append(_peaks(grid(p, a), grid(t, b), (x, y), scales, least))
        return pa.array(out, arrow)

    good = lambda p, w: F.when(image_ok(F.col(p), F.col(w)), F.col(p)).cast(LONGS)
    side = lambda w: F.coalesce(F.col(w), F.lit(1)).cast("int")
    found = search(good(pixels, width), side(width), good(template, template_width), side(template_width), F.col(box)["w"], F.col(box)["h"])
    return rows.select("*", F.explode(found).alias("_peak")).select(*rows.columns, "_peak.*")


def anchors(peaks: DataFrame, keys: list[str], overlap: float = OVERLAP, most: int = ANCHORS) -> DataFrame:
    """The peaks of each key that greedy suppression keeps: by falling score, one that covers a kept one by `overlap` or more goes, and so do those beyond the first `most`.

    A key has as many peaks as template_peaks() gives, so they are folded as one array in the JVM.
    """
    fields = ("score", "x", "y", "w", "h", "scale", "nth")
    ranked = F.sort_array(F.collect_list(F.struct(*fields)), asc=False)
    area = lambda b: b["w"] * b["h"]
    side = lambda a, b, p, s: F.greatest(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]), F.lit(0.0))

    def shared(a: Column, b: Column) -> Column:
        both = side(a, b, "x", "w") * side(a, b, "y", "h")
        return both / F.greatest(area(a) + area(b) - both, F.lit(1e-9))

    none = F.slice(F.col("_ranked"), 1, 0)
    keep = lambda kept, b: F.when((F.size(kept) < most) & F.forall(kept, lambda k: shared(b, k) < overlap), F.concat(kept, F.array(b))).otherwise(kept)
    return peaks.groupBy(*keys).agg(ranked.alias("_ranked")).select(*keys, F.explode(F.aggregate("_ranked", none, keep)).alias("_b")).select(*keys, "_b.*")
