"""Identities, digests and normalised values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def photo_id(path: Column) -> Column:
    """P and 12 upper-case hexadecimal digits of the SHA-256 of the lower-case path."""
    return F.concat(F.lit("P"), F.upper(F.substring(F.sha2(F.lower(path), 256), 1, 12)))


def digest(*parts: Column) -> Column:
    """SHA-256 of parts joined by a line feed; null and empty differ."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts)), 256)


def group_digest(member: Column, fingerprint: Column) -> Column:
    """Aggregate: SHA-256 over the sorted member:fingerprint pairs of a group."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(member.cast("string"), F.lit(":"), fingerprint))), ","), 256)


def group_digests(rows: DataFrame, by: str, member: Column, fingerprint: Column) -> DataFrame:
    """(by, digest) of groups of any size: members are digested by the first four digits of their MD5, and these 65,536 digests at most once more.

    No array holds more than a group's share of one part or its parts. Rows without `by` are a group of their own.
    """
    member = member.cast("string")
    parts = rows.groupBy(by, F.substring(F.md5(member), 1, 4).alias("_part")).agg(group_digest(member, fingerprint).alias("_digest"))
    return parts.groupBy(by).agg(group_digest(F.col("_part"), F.col("_digest")).alias("digest"))


def is_current(stored: Column, now: Column) -> Column:
    """A stored fingerprint that is null is never current."""
    return F.coalesce(stored == now, F.lit(False))


def mode(value: Column, known: tuple[str, ...], default: str) -> Column:
    """Trimmed lower case; null is the default, an unknown value is null."""
    plain = F.lower(F.trim(F.coalesce(value, F.lit(default))))
    return F.when(plain.isin(*known), plain)


def clamp(value: Column, low: float, high: float, default: float) -> Column:
    """value kept within low and high; the default where it is null or not finite."""
    bad = value.isNull() | F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(default)).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def version_key(version: Column) -> Column:
    """Numbers of a dotted version, which compare in order."""
    return F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def capture_time(*candidates: Column, subsecond: Column | None = None, fallback: Column | None = None) -> Column:
    """The first candidate that parses (yyyy:MM:dd or yyyy-MM-dd, HH:mm:ss) plus a subsecond padded to microseconds; else fallback."""
    parsed = F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for c in candidates for f in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")))
    if subsecond is not None:
        micros = F.rpad(F.substring(F.regexp_replace(F.coalesce(subsecond, F.lit("")), r"\D", ""), 1, 6), 6, "0").cast("long")
        parsed = F.timestamp_micros(F.unix_micros(parsed) + micros)
    return F.coalesce(parsed, fallback) if fallback is not None else parsed
