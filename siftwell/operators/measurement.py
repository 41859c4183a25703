"""Measurements over arrays: robust statistics, histograms and focus figures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import percentiles


def contrast(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, p5, p95, contrast): exact percentiles, interpolated; a group of any size is counted in ranges."""
    out = percentiles(rows, [by], value, [0.05, 0.95])
    return out.select(by, F.get("_p", 0).alias("p5"), F.get("_p", 1).alias("p95"), (F.get("_p", 1) - F.get("_p", 0)).alias("contrast"))


def noise_sigma(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, sigma): the median absolute deviation from the median, scaled to a standard deviation."""
    middle = percentiles(rows, [by], value, [0.5]).select(F.col(by).alias("_b"), F.get("_p", 0).alias("_m"))
    away = rows.join(middle, F.col(by).eqNullSafe(F.col("_b"))).select(by, F.abs(F.col(value) - F.col("_m")).alias("_d"))
    return percentiles(away, [by], "_d", [0.5]).select(by, (F.get("_p", 0) / 0.67448975).alias("sigma"))


def histogram(rows: DataFrame, by: str, vector: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(by, bin, n): counts of vector components in equal bins; those outside go to the end bins."""
    at = F.least(F.greatest(F.floor((F.col("_x") - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    each = rows.select(by, F.explode(vector).alias("_x")).withColumn("_x", F.col("_x").cast("double")).where("_x is not null and not isnan(_x)")
    return each.groupBy(by, at.alias("bin")).agg(F.count("*").alias("n"))


def intersection(a: Column, b: Column) -> Column:
    """Shared mass of two histograms, as a share of the first; null if that is empty."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.nullif(total, F.lit(0.0))


def focus(images: DataFrame, key: str, pixels: str, width: str) -> DataFrame:
    """(key, laplacian, gradient): variance of the Laplacian and 90th percentile of the gradient of gray images (row-major arrays).

    An image under 3 x 3, or whose length is no multiple of its width, has nulls.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, p, w in zip(pdf[key], pdf[pixels], pdf[width], strict=True):
                g = np.asarray(p if p is not None else [], "float64")
                w = 0 if pd.isna(w) else int(w)
                if w < 3 or len(g) % w or len(g) // w < 3:
                    rows.append((k, None, None))
                    continue
                g = g.reshape(-1, w)
                lap = 4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]
                gx, gy = (g[1:-1, 2:] - g[1:-1, :-2]) / 2, (g[2:, 1:-1] - g[:-2, 1:-1]) / 2
                rows.append((k, float(lap.var()), float(np.percentile(np.hypot(gx, gy), 90))))
            yield pd.DataFrame(rows, columns=[key, "laplacian", "gradient"])

    return images.select(key, pixels, width).mapInPandas(measure, f"{key} {images.schema[key].dataType.simpleString()}, laplacian double, gradient double")


#: A preview is blurred if any pair of (Laplacian, gradient) lies under both of these limits.
BLURRED = ((4.5, 27.0), (3.5, 31.0), (20.0, 22.0))


def blurred(laplacian: Column, gradient: Column) -> Column:
    """Whether either of the limit pairs holds; null if a figure is unknown."""
    out = F.lit(False)
    for l, g in BLURRED:
        out = out | ((laplacian < l) & (gradient < g))
    return F.when(laplacian.isNotNull() & gradient.isNotNull(), out)


def dhash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """64 signs of neighbouring differences of a width x height gray array, as a bigint; the first is the highest bit."""
    at = lambda i: F.get(pixels, i)
    bits = F.transform(F.sequence(F.lit(0), F.lit((width - 1) * height - 1)), lambda i: F.when(at(F.floor(i / (width - 1)).cast("int") * width + i % (width - 1) + 1) > at(F.floor(i / (width - 1)).cast("int") * width + i % (width - 1)), 1).otherwise(0).cast("long"))
    return F.when(F.size(pixels) == width * height, F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x)))
