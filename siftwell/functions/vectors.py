"""Vectors as arrays: products, sign hashes and structural similarity, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C1, C2 = 0.01**2, 0.03**2


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def sign_hash(v: Column) -> Column:
    """64 signs as a bigint, the first component the lowest bit; components beyond 64 don't count."""
    bits = F.transform(F.slice(v, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _moments(blocks: Column) -> Column:
    """Of each block its mean and population variance."""
    mean = lambda b: F.aggregate(b, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(b)
    return F.transform(blocks, lambda b: F.struct(mean(b).alias("mean"), (dot(b, b) / F.size(b) - mean(b) * mean(b)).alias("var")))


def _mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def block_ssim_bound(a: Column, b: Column, range: float = 1.0) -> Column:
    """The most that block_ssim() of the same blocks can be, from means and variances alone: no covariance passes the product of the deviations."""
    c1, c2 = (0.01 * range) ** 2, (0.03 * range) ** 2
    light = lambda x, y: (2 * x["mean"] * y["mean"] + c1) / (x["mean"] * x["mean"] + y["mean"] * y["mean"] + c1)
    each = lambda x, y: (light(x, y) * c2 + F.abs(light(x, y)) * 2 * F.sqrt(F.greatest(x["var"] * y["var"], F.lit(0.0)))) / (x["var"] + y["var"] + c2)
    return _mean_of(F.zip_with(_moments(a), _moments(b), each))


def block_ssim(a: Column, b: Column, range: float = 1.0) -> Column:
    """Mean structural similarity of blocks that stand in the same places, population moments, kept within -1 and 1."""
    c1, c2 = (0.01 * range) ** 2, (0.03 * range) ** 2
    joint = F.zip_with(F.zip_with(a, b, lambda x, y: dot(x, y) / F.size(x)), F.zip_with(_moments(a), _moments(b), lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda xy, m: F.struct(xy.alias("xy"), m["p"].alias("p"), m["q"].alias("q")))
    light = lambda s: (2 * s["p"]["mean"] * s["q"]["mean"] + c1) / (s["p"]["mean"] * s["p"]["mean"] + s["q"]["mean"] * s["q"]["mean"] + c1)
    each = lambda s: light(s) * (2 * (s["xy"] - s["p"]["mean"] * s["q"]["mean"]) + c2) / (s["p"]["var"] + s["q"]["var"] + c2)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _mean_of(F.transform(joint, each))))


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity of two blocks of equal size, population moments, dynamic range 1."""
    n = F.size(a)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    ma, mb = mean(a), mean(b)
    va, vb, cov = dot(a, a) / n - ma * ma, dot(b, b) / n - mb * mb, dot(a, b) / n - ma * mb
    return ((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))
