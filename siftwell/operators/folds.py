"""Ordered folds: each key's rows go to one task in order and pass through a small state; nothing is gathered.

Rows are exchanged by key and sorted in their partition, and Python sees them a batch at a time, so a key of any
size needs the memory of its state only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ranking import row_numbers


def fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], object], inputs: list[str], output: str, kind: str) -> DataFrame:
    """rows with output: step(state, values of inputs) of each row in order; the state begins anew with each key."""
    spark_schema = StructType(list(rows.schema.fields)).add(output, kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in batches:
            got = []
            for key, values in zip(zip(*(pdf[k] for k in keys), strict=True), zip(*(pdf[c] for c in inputs), strict=True), strict=True):
                if key != at:
                    at, state = key, start()
                got.append(step(state, values))
            yield pdf.assign(**{output: got})

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, spark_schema)


def bursts(rows: DataFrame, keys: list[str], ts: str, order: list[str], gap: float, span: float, output: str = "burst") -> DataFrame:
    """rows with the number, from 0, of their burst of the key: a row joins the last burst if it is within gap seconds of the
    row before and span seconds of the burst's first row, which never moves; else it opens one. ts is in seconds.
    """

    class State:
        burst, anchor, last = -1, 0.0, 0.0

    def step(s: State, values: tuple) -> int:
        (t,) = values
        if s.burst < 0 or t - s.last > gap or t - s.anchor > span:
            s.burst, s.anchor = s.burst + 1, t
        s.last = t
        return s.burst

    return fold(rows, keys, [ts, *order], State, step, [ts], output, "long")


def split_bursts(rows: DataFrame, keys: list[str], ts: str, order: list[str], gap: float, span: float) -> DataFrame:
    """rows with burst as tight bursts inside the bursts they have in `wide`: a tighter rule only splits."""
    return bursts(rows, [*keys, "wide"], ts, order, gap, span, "part")


def merged_bursts(bounds: DataFrame, keys: list[str], gap: float, span: float) -> DataFrame:
    """bounds (keys, burst, first, last) with merged: neighbouring whole bursts join while the gap between them and the
    span of all of them stay within limits. A looser rule only merges.
    """

    class State:
        group, anchor, last = -1, 0.0, 0.0

    def step(s: State, values: tuple) -> int:
        first, last = values
        if s.group < 0 or first - s.last > gap or last - s.anchor > span:
            s.group, s.anchor = s.group + 1, first
        s.last = last
        return s.group

    return fold(bounds, keys, ["burst"], State, step, ["first", "last"], "merged", "long")


def batches(groups: DataFrame, keys: list[str], order: list[str], size: str, limit: int, output: str = "batch") -> DataFrame:
    """groups with the batch, from 0, that holds each whole: a batch closes when the next group would pass limit. A group above it is alone."""

    class State:
        batch, used = -1, 0

    def step(s: State, values: tuple) -> int:
        (n,) = values
        if s.batch < 0 or s.used + n > limit:
            s.batch, s.used = s.batch + 1, 0
        s.used += n
        return s.batch

    return fold(groups, keys, order, State, step, [size], output, "long")


def pages(groups: DataFrame, keys: list[str], order: list[str], size: str, columns: int = 4, height: int = 2800, cell: int = 452, head: int = 48, top: int = 110) -> DataFrame:
    """groups with the page, from 0, they begin on: each takes a header and its rows of cells, and a page closes when it is full.

    A group higher than a page runs over as many pages as it needs, and the next begins where it ends.
    """
    per_page = max(1, (height - top - head) // cell)

    class State:
        page, left = 0, height - top

    def step(s: State, values: tuple) -> int:
        (n,) = values
        rows = -(-int(n) // columns)
        if head + min(rows, 1) * cell > s.left:
            s.page, s.left = s.page + 1, height - top
        began, fit = s.page, (s.left - head) // cell
        if rows <= fit:
            s.left -= head + rows * cell
        else:
            more = rows - fit
            s.page += -(-more // per_page)
            s.left = height - top - head - ((more - 1) % per_page + 1) * cell
        return began

    return fold(groups, keys, order, State, step, [size], output="page", kind="long")


def suppressed(rows: DataFrame, keys: list[str], score: str, order: list[str], lo: str, hi: str, least: float) -> DataFrame:
    """The rows that greedy suppression keeps: by falling score, one overlapping a kept interval by `least` or more (shared length over joint) goes."""

    def start() -> list:
        return []

    def step(kept: list, values: tuple) -> bool:
        a, b = values
        for x, y in kept:
            shared = min(b, y) - max(a, x)
            if shared > 0 and shared >= least * ((b - a) + (y - x) - shared):
                return False
        kept.append((a, b))
        return True

    ranked = rows.withColumn("_falling", -F.col(score))
    return fold(ranked, keys, ["_falling", *order], start, step, [lo, hi], "_stays", "boolean").where("_stays").drop("_stays", "_falling")


def leaders(rows: DataFrame, keys: list[str], order: list[str], vector: str, row: str, least: float, protected: str | None = None) -> DataFrame:
    """rows with leader: the first earlier leader of the key with a cosine of `least` or more, else the row itself.

    Members are compared with leaders only, never in a chain, and leaders never move. A protected row always leads.
    The state is a key's leaders, so a key with many of them is the limit of this operator.
    """
    import numpy as np

    class State:
        def __init__(self):
            self.ids, self.units = [], None

    def step(s: State, values: tuple) -> int:
        i, v, keep = values
        u = np.asarray(v, "float64")
        u = u / (np.linalg.norm(u) or 1.0)
        if s.ids and not keep:
            hit = np.flatnonzero(s.units[: len(s.ids)] @ u >= least)
            if len(hit):
                return s.ids[hit[0]]
        if s.units is None or len(s.ids) == len(s.units):
            more = np.zeros((max(16, 2 * len(s.ids)), len(u)))
            more[: len(s.ids)] = s.units[: len(s.ids)] if s.ids else 0
            s.units = more
        s.units[len(s.ids)] = u
        s.ids.append(i)
        return i

    given = rows.withColumn("_protected", F.col(protected) if protected else F.lit(False))
    return fold(given, keys, order, State, step, [row, vector, "_protected"], "leader", "long").drop("_protected")


def retained(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """rows with retained: the last `most` of each key stay, older ones are marked. Rank limits apply before the exchange."""
    newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("retained", F.row_number().over(newest) <= most)


def numbered(rows: DataFrame, group: str, position: str) -> DataFrame:
    """rows with number, from 1, of their group by first appearance. Only groups are ranked, not rows."""
    first = rows.groupBy(F.col(group).alias("_g")).agg(F.min(position).alias("_p"))
    order = row_numbers(first, ["_p", "_g"], "number")
    return rows.join(order.select("_g", "number"), F.col(group) == F.col("_g")).drop("_g")


def open_bursts(rows: DataFrame, keys: list[str], ts: str, order: list[str], vector: str, gap: float, span: float, least: float, seed: str | None = None) -> DataFrame:
    """rows with burst: several bursts of a key may be open at once, and a row joins the one whose anchor is most like it.

    Open are bursts whose last row lies within gap seconds before and whose first, the anchor, within span seconds;
    a cosine of `least` with the anchor is needed, ties go to the earlier burst, and without any a new one opens.
    Anchors never move. A row with a burst in `seed` keeps that number and later rows may join it, so a second run
    after an import renumbers nothing. The state is the bursts still open.
    """
    import numpy as np

    class State:
        def __init__(self):
            self.next, self.open = 0, []

    def step(s: State, values: tuple) -> int:
        t, v, given, reserved = values
        u = np.asarray(v, "float64")
        u = u / (np.linalg.norm(u) or 1.0)
        s.next = max(s.next, int(reserved) + 1)
        s.open = [b for b in s.open if t - b[2] <= gap and t - b[1] <= span]
        if given is not None and not pd.isna(given):
            mine = [b for b in s.open if b[0] == int(given)]
        else:
            best = max(((float(b[3] @ u), -b[0], b) for b in s.open), default=None, key=lambda x: x[:2])
            mine = [best[2]] if best and best[0] >= least else []
        if mine:
            mine[0][2] = t
            return mine[0][0]
        number = int(given) if given is not None and not pd.isna(given) else s.next
        s.next = max(s.next, number + 1)
        s.open.append([number, t, t, u])
        return number

    seeded = rows.withColumn("_seed", F.col(seed).cast("double") if seed else F.lit(None).cast("double"))
    top = seeded.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.coalesce(F.max("_seed"), F.lit(-1.0)).alias("_top"))
    given = seeded.join(top, [F.col(k) == F.col(f"_k_{k}") for k in keys]).drop(*(f"_k_{k}" for k in keys))
    return fold(given, keys, [ts, *order], State, step, [ts, vector, "_seed", "_top"], "burst", "long").drop("_seed", "_top")


def guarded_merge(pairs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """members (keys, id, part) with root: pairs (keys, a, b: compatible) merge parts, in order, only if all their cross pairs are compatible too.

    A merge is checked by counting compatible pairs between two parts, so no cross pair is listed. Pairs are counted by their two parts first, and only these counts, with the first pair of
    each, are folded: parts that can't merge when they first meet never can, as what they then are made of stays in them. A key's parts are one task's work, as the order of merges
    matters; its members are not, and keys run side by side.
    """

    def run(key: tuple, p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        size = dict(zip(m["part"], m["_size"], strict=True))
        between: dict = {}
        for x, y, n in zip(p["_x"], p["_y"], p["_n"], strict=True):
            between.setdefault(x, {})[y] = n
            between.setdefault(y, {})[x] = n
        into = {x: x for x in size}

        def find(x):
            while into[x] != x:
                x = into[x]
            return x

        for x, y in p.sort_values(["_a", "_b"])[["_x", "_y"]].itertuples(index=False):
            x, y = sorted((find(x), find(y)))
            if x != y and between.get(x, {}).get(y, 0) == size[x] * size[y]:
                into[y] = x
                size[x] += size[y]
                for z, n in between.pop(y, {}).items():
                    between[z].pop(y, None)
                    if z != x:
                        between[x][z] = between[x].get(z, 0) + n
                        between[z][x] = between[x][z]
        return m.assign(root=[find(x) for x in m["part"]])[[*keys, "part", "root"]]

    once = pairs.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()

    def of(rows: DataFrame, right: DataFrame, on: str, to: str, value: str, how: str = "inner") -> DataFrame:
        """rows with value of right (keys, to, value) where `on` is `to`; null keys are keys."""
        named = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(to).alias("_to"), F.col(value).alias(f"_{on}"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        return rows.join(named, [*same, F.col(on).eqNullSafe(F.col("_to"))], how).drop("_to", *(f"_k{i}" for i in range(len(keys))))

    crossing = of(of(once, members, "a", "id", "part"), members, "b", "id", "part").where("_a <> _b")
    counts = crossing.groupBy(*keys, F.least("_a", "_b").alias("_x"), F.greatest("_a", "_b").alias("_y")).agg(F.count("*").alias("_n"), F.min(F.struct("a", "b")).alias("_first"))
    counts = counts.select(*keys, "_x", "_y", "_n", F.col("_first.a").alias("_a"), F.col("_first.b").alias("_b"))
    sizes = members.groupBy(*keys, "part").agg(F.count("*").alias("_size"))
    sizes = sizes.select(*(F.col(c).alias(c) for c in sizes.columns))  # columns of its own, as pairs may come from members
    schema = StructType([members.schema[k] for k in keys] + [members.schema["part"]]).add("root", members.schema["part"].dataType)
    roots = counts.groupBy(*keys).cogroup(sizes.groupBy(*keys)).applyInPandas(run, schema)
    return of(members, roots, "part", "part", "root", "left").select(*members.columns, F.col("_part").alias("root"))


def cliques(rows: DataFrame, keys: list[str], row: str, vector: str, least: float) -> DataFrame:
    """rows with root: what guarded_merge gives where every row is a part of its own and those with a cosine of `least` or more are compatible.

    Pairs in order then merge each row, by rising id, into the first group all of whose members it suits, so no pair is made: the state of a key is its rows' vectors and groups.
    A vector of no length suits nothing.
    """
    import numpy as np

    class State:
        def __init__(self):
            self.roots, self.of, self.units = [], np.zeros(16, "int64"), None
            self.n = 0

    def step(s: State, values: tuple) -> int:
        i, v = values
        u = np.asarray(v, "float64")
        length = np.linalg.norm(u)
        u = u / length if length > 0 else np.full(len(u), np.nan)
        if s.units is None or s.n == len(s.units):
            grown = np.zeros((max(16, 2 * s.n), len(u)))
            grown[: s.n] = s.units[: s.n] if s.n else 0
            s.units, s.of = grown, np.concatenate([s.of[: s.n], np.zeros(len(grown) - s.n, "int64")])
        suits = np.ones(len(s.roots) + 1, "bool")
        suits[s.of[: s.n][~(s.units[: s.n] @ u >= least)]] = False
        group = int(np.argmax(suits))  # the last is a new one
        if group == len(s.roots):
            s.roots.append(i)
        s.units[s.n], s.of[s.n] = u, group
        s.n += 1
        return s.roots[group]

    return fold(rows, keys, [row], State, step, [row, vector], "root", "long")


def matched(pairs: DataFrame, keys: list[str], left: str, right: str, score: str) -> DataFrame:
    """The pairs that greedy matching keeps: by falling score, a pair stays if neither side is taken. Ties go to the greater ids."""

    def step(taken: set, values: tuple) -> bool:
        a, b = values
        if ("l", a) in taken or ("r", b) in taken:
            return False
        taken.update((("l", a), ("r", b)))
        return True

    order = ["_falling", "_fl", "_fr"]
    ranked = pairs.select("*", (-F.col(score)).alias("_falling"), (-F.col(left)).alias("_fl"), (-F.col(right)).alias("_fr"))
    return fold(ranked, keys, order, set, step, [left, right], "_stays", "boolean").where("_stays").drop("_stays", *order)


def revisions(log: DataFrame, keys: list[str], order: list[str], expected: str) -> DataFrame:
    """log with accepted and revision: a write is taken if it expects the key's current revision, from 0, and then raises it."""

    def step(state: list, values: tuple) -> int:
        if values[0] is not None and values[0] == state[0]:
            state[0] += 1
            return state[0]
        return -state[0] - 1

    out = fold(log, keys, order, lambda: [0], step, [expected], "_r", "long")
    return out.withColumn("accepted", F.col("_r") > 0).withColumn("revision", F.when(F.col("_r") > 0, F.col("_r")).otherwise(-F.col("_r") - 1)).drop("_r")


def split_at(rows: DataFrame, group: str, position: str, at: Column, new: Column) -> DataFrame:
    """rows whose group is split from the position `at` on, the rest going to the group `new`; a split at a group's first row does nothing."""
    first = rows.groupBy(F.col(group).alias("_g")).agg(F.min(position).alias("_first"))
    moved = (F.col(position) >= at) & (at > F.col("_first"))
    return rows.join(first, F.col(group) == F.col("_g")).withColumn(group, F.when(F.coalesce(moved, F.lit(False)), new).otherwise(F.col(group))).drop("_g", "_first")


def merge_adjacent(rows: DataFrame, group: str, position: str, wanted: DataFrame) -> DataFrame:
    """rows in which wanted (first, second) groups are one, the earlier; only groups that follow each other by first position merge."""
    order = row_numbers(rows.groupBy(F.col(group).alias("_g")).agg(F.min(position).alias("_p")), ["_p", "_g"], "_n").select("_g", "_n")
    a, b = order.select(F.col("_g").alias("first"), F.col("_n").alias("_a")), order.select(F.col("_g").alias("second"), F.col("_n").alias("_b"))
    both = wanted.join(a, "first").join(b, "second").where(F.abs(F.col("_a") - F.col("_b")) == 1)
    moves = both.select(F.when(F.col("_a") < F.col("_b"), F.col("second")).otherwise(F.col("first")).alias("_source"), F.when(F.col("_a") < F.col("_b"), F.col("first")).otherwise(F.col("second")).alias("_target"))
    return rows.join(moves, F.col(group) == F.col("_source"), "left").withColumn(group, F.coalesce("_target", group)).drop("_source", "_target")
