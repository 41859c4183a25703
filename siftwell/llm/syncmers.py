"""Document fingerprints from closed syncmers, with DataFrame functions only.

Tokens are the words of every text, whatever its length; a word too long to be one (of a script without spaces, or of
encoded data) gives its characters. A closed syncmer is a run of tokens that is decided by its own tokens, so a passage has the same anchors
wherever it stands, and anchors of two texts match by where they stand.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Tokens of a k-mer and of its inner s-mer; characters of the longest word that is one token.
K, S, LONG = 4, 1, 20
#: Tokens by which two shared anchors may differ in displacement and still confirm each other.
BAND = 8
#: Rows of a range in which neighbours are found, ranges at most, and how many range ends are one step of a row's search.
RANGE_ROWS, RANGES, STEP = 256, 65_536, 256
#: An anchor is a whole number: its place times 2^32, and its hash; in the order of hashes: the hash, one bit for the side, the place.
HASH, PLACE, SIDE = (1 << 32) - 1, 30, 31
_GAP = r"[\x20\x09-\x0D]+"
_NONE = "cast(array() as array<bigint>)"


def _bind(value: Column, f) -> Column:
    """f(value) with value computed once, however often f's lambdas read it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _at(anchor: Column) -> Column:
    return F.shiftrightunsigned(anchor, 32)


def _name(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(HASH))


def _least(m: Column, upto: int, then, size: int = 1) -> Column:
    """then(low), low[i] being the least of the `upto` (a power of two) elements of m from i on."""
    return then(m) if size == upto else _bind(F.transform(m, lambda x, i: F.least(x, F.get(m, i + size))), lambda low: _least(low, upto, then, 2 * size))


def tokens(text: Column, long: int = LONG) -> Column:
    """The words between ASCII white space, in order; one of more than `long` characters gives its characters."""
    words = F.filter(F.split(text, _GAP), lambda w: w != "")
    apart = lambda w: F.when(F.length(w) > long, F.split(w, "")).otherwise(F.array(w))
    return _bind(words, lambda ws: F.when(F.exists(ws, lambda w: F.length(w) > long), F.flatten(F.transform(ws, apart))).otherwise(ws))


def _joined(h: Column, s: int, then) -> Column:
    """then(m), m being the hashes of the s-mers of hashed tokens h; fewer than s tokens are left as they are."""
    return then(h) if s == 1 else _bind(F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + d) for d in range(1, s)))), then)


def closed(found: Column, k: int = K, s: int = S) -> Column:
    """The anchors of all closed syncmers of an array of tokens, in order; fewer than k tokens have none.

    A k-mer is a closed syncmer if the least hash of its k - s + 1 s-mers is that of its first or of its last one. So
    the next one starts at most k - s tokens on, and 2 in k - s + 1 tokens start one on average.
    """
    span = k - s
    if s < 1 or span < 2:
        raise ValueError("k is at least s + 2")
    inner = span - 1
    wide = 1 << (inner.bit_length() - 1)  # two runs of so many cover the s-mers between the first and the last

    def made(h: Column) -> Column:
        def picked(m: Column, low: Column) -> Column:
            name = lambda i: F.pmod(F.xxhash64(*(F.get(h, i + d) for d in range(k))), F.lit(1 << 32))
            edge = lambda x, i: F.least(x, F.get(m, i + span)) <= F.least(F.get(low, i + 1), F.get(low, i + span - wide))
            one = lambda x, i: F.when((i <= F.size(h) - k) & edge(x, i), F.shiftleft(i.cast("long"), 32) + name(i))
            return F.filter(F.transform(m, one), lambda a: a.isNotNull())

        return _joined(h, s, lambda m: _least(m, wide, lambda low: picked(m, low)))

    return _bind(F.transform(found, lambda x: F.xxhash64(x)), made)


def whole(found: Column, text: Column) -> Column:
    """found, or for a text without a closed syncmer (a short one) the one anchor that is its own hash; an empty text has none."""
    return F.when((F.size(found) == 0) & (F.length(text) > 0), F.array(F.pmod(F.xxhash64(text), F.lit(1 << 32)))).otherwise(found)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<long>: the anchors of a text in order, each its place (of tokens) x 2^32 + its hash. A null text is empty."""
    return _bind(F.coalesce(text, F.lit("")), lambda t: _bind(closed(tokens(t), k, s), lambda a: whole(a, t)))


def by_hash(found: Column) -> Column:
    """hash x 2^31 + place, sorted; of an anchor that a text repeats the first place."""
    order = F.sort_array(F.transform(found, lambda a: F.shiftleft(_name(a), SIDE) + _at(a)))
    return _bind(order, lambda o: F.filter(o, lambda x, i: (i == 0) | (F.shiftright(F.get(o, i - 1), SIDE) != F.shiftright(x, SIDE))))


def likeness(a: Column, b: Column, band: int = BAND) -> Column:
    """Share of two texts' different anchors (by_hash()) that match in hash and place, of all that they have. Two empty ones: 1.

    A shared anchor matches if another shared one is displaced between the texts by as much, give or take `band`
    tokens: what was inserted before a passage moves it whole, while a hash that the texts share by chance stands
    alone. Where one of the texts has but one anchor, that it is shared is enough.
    """
    place = (1 << PLACE) - 1
    pair = lambda both: lambda x, i: F.when(F.shiftright(x, SIDE) == F.shiftright(F.get(both, i + 1), SIDE), F.get(both, i + 1).bitwiseAND(F.lit(place)) - x.bitwiseAND(F.lit(place)))
    moved = lambda both: F.sort_array(F.filter(F.transform(both, pair(both)), lambda d: d.isNotNull()))
    near = lambda d: lambda x, i: (x - F.get(d, i - 1) <= band) | (F.get(d, i + 1) - x <= band)
    few = F.least(F.size(a), F.size(b)) == 1
    matched = lambda d: F.when(few, F.size(d)).otherwise(F.size(F.filter(d, near(d))))
    share = lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n))
    sides = F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(1 << PLACE)))))
    return _bind(_bind(sides, lambda both: _bind(moved(both), matched)), share)


def printed(found: Column, k: int = K, s: int = S) -> Column:
    """Of each anchor its distance from the one before (from the start, for the first), then eight digits of its hash, in hexadecimal.

    A distance is at most k - s, so each anchor has the same number of digits.
    """
    width = 8 + len(f"{k - s:x}")
    padded = lambda x: F.substring(F.hex(x + (1 << 4 * width)), 2, width)
    apart = lambda a, i: _at(a) - F.coalesce(_at(F.get(found, i - 1)), F.lit(0))
    return F.lower(F.array_join(F.transform(found, lambda a, i: padded(F.shiftleft(apart(a, i).cast("long"), 32) + _name(a))), ""))


def ranged(docs: DataFrame, key: str, rows: int = RANGE_ROWS) -> DataFrame:
    """docs with `_range` and `_wrap`, exchanged by _range: every row, and beside each range's rows the one that follows them.

    Ranges of about `rows` rows are cut at keys which occur, found by an approximate percentile (any cut is right, an even
    one is fast); beyond RANGES of them they grow. The greatest key of a range is also sent to the range above, and the
    greatest of all to the range of the least, as rows with `_wrap` 0 and 1; other rows have -1. Rows without a key are in
    the lowest range.
    """
    kind = docs.schema[key].dataType.simpleString()
    n = min(RANGES, max(1, docs.count() // rows))
    found = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 4 * max(n, 2500)), F.min(key), F.max(key)).first()
    cuts = sorted({*(found[0] or ()), *([found[2]] if found[2] is not None else [])})  # upper ends of ranges; the last is the greatest key
    if not cuts:
        return docs.select("*", F.lit(0).alias("_range"), F.lit(-1).alias("_wrap")).repartition("_range")
    literal = lambda ends: F.from_json(F.lit(json.dumps(ends)), f"array<{kind}>")  # noqa: E731  folded to one constant
    under = lambda some: F.size(F.filter(some, lambda e: e < F.col(key)))
    step = (under(literal(cuts[STEP - 1 :: STEP])) if len(cuts) >= STEP else F.lit(0)) * STEP
    placed = docs.withColumn("_step", step).withColumn("_range", F.col("_step") + under(F.slice(literal(cuts), F.col("_step") + 1, F.lit(STEP))))  # the range whose upper end is the least one not below the key
    is_end = F.col(key) == F.get(literal(cuts), F.col("_range"))
    least = sum(c < found[1] for c in cuts)
    to = lambda at, wrap: F.struct(at.alias("_range"), F.lit(wrap).alias("_wrap"))
    ghosts = F.when(F.col(key) == found[2], F.array(to(F.col("_range"), -1), to(F.lit(least), 1))).when(is_end, F.array(to(F.col("_range"), -1), to(F.col("_range") + 1, 0)))
    placed = placed.withColumn("_to", F.explode(F.coalesce(ghosts, F.array(to(F.col("_range"), -1)))))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(cuts))  # stated, so that small tables aren't one task
    return placed.select(*(F.col(c) for c in docs.columns), "_to._range", "_to._wrap").repartition(parts, "_range")


def fingerprints(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """The columns of op9 for docs (doc_id, text); other columns are not read.

    A null text is empty: no anchors, an empty fingerprint. Long texts count whole. Equal doc_ids are ordered by
    their texts, rows without doc_id come after all others, and equal rows follow each other; a single row is its own next one,
    and of rows none of which has a doc_id the last has an empty next text. No rows: no result. Texts
    are exchanged once, to ranges of the doc_id (the edited text needs its own and the next one's); anchors are found there and never exchanged.
    """
    near = ranged(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", rows).withColumn("own", anchors(F.col("text")))
    # Of a greatest key's repeated rows each has a ghost; the first of them, as ordered, is the one that follows.
    order = Window.partitionBy("_range").orderBy(F.col("_wrap") == 1, F.desc_nulls_last("doc_id"), F.desc("text"))
    near = near.select("*", F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text"), F.coalesce(F.lead("own").over(order), F.expr(_NONE)).alias("next")).where("_wrap = -1")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    near = near.select("doc_id", n.cast("long").alias("n_chars"), "own", "next", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)).alias("edited"))
    near = near.withColumn("mixed", anchors(F.col("edited"))).withColumn("own_sorted", by_hash(F.col("own")))
    return near.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("own")).alias("fingerprint"), printed(F.col("mixed")).alias("edited_fingerprint"),
        likeness(F.col("own_sorted"), by_hash(F.col("mixed"))).alias("near_edited"), likeness(F.col("own_sorted"), by_hash(F.col("next"))).alias("near_next"),
    )


def op9_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the whole of `documents`: see fingerprints()."""
    return fingerprints(table(spark, sf_dir, "documents"))
