"""Whitening of vectors by TSQR: the covariance is never formed.

Rows are centred with their exact sums, each task reduces its rows to the R factor of their QR decomposition, the
factors merge in a tree, and the singular value decomposition of the last one gives the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, wrapped, written

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Factors that one task merges; rows that a task holds as doubles.
FAN_IN, ROWS = 16, 4096
#: Whole numbers beyond this are held at it, so that a sum with SHIFT stays a long.
_MOST = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """n vectors of len(sums) dimensions; components: one a row, of falling variance; trace: of all dimensions' variances."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = float("nan")


def _usable(vector: Column) -> Column:
    """Whether a vector has entries, and all of them are finite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def _whole(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE x c) + SHIFT of each entry, a row a vector."""
    c = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore"):
        x = np.floor(c * SCALE)
    large = np.abs(x) >= _MOST
    return np.where(large, np.sign(x).astype(np.int64) * _MOST, np.where(large, 0, x).astype(np.int64)) + SHIFT


def _difference(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, exact: longs where that can't overflow, else Python's whole numbers."""
    if len(x) and n * int(max(x.max(), -int(x.min()))) + max(map(abs, sums)) < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            some = batch.slice(i, ROWS)
            yield some, _whole(some["vector"], dims)


def _state(*parts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"state": [np.concatenate([np.ravel(p) for p in parts])]}, schema=pa.schema([("state", pa.list_(pa.float64()))]))


def merged(states: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray], fan_in: int = FAN_IN) -> np.ndarray | None:
    """One state (an array of doubles) of the many in states (state), a row a task: groups of fan_in merge in tasks of their own, level by level."""
    rows = written(states.withColumn("nth", F.monotonically_increasing_id()), "factors")
    left = rows.count()
    # the numbers of rows have gaps, so that the groups of the first level may be smaller than fan_in
    keyed = rows.select((F.shiftright("nth", 33)).alias("nth"), "state")

    def fold(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"nth": [key[0]], "state": [merge([np.asarray(s) for s in group["state"]])]})

    most = (keyed.agg(F.max("nth")).first()[0] or 0) + 1
    while left and most > 1:
        keyed = keyed.select(F.floor(F.col("nth") / fan_in).alias("nth"), "state").groupBy("nth").applyInPandas(fold, "nth long, state array<double>")
        most = -(-most // fan_in)
    found = [np.asarray(r["state"]) for r in keyed.select("state").collect()]
    return None if not found else found[0] if len(found) == 1 else merge(found)


def _r(rows: np.ndarray) -> np.ndarray:
    """The R factor of rows, square: fewer rows than columns leave zeros."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def sums(vectors: DataFrame) -> tuple[int, tuple[int, ...]] | None:
    """(n, sum of each dimension), exact, of vectors (vector) that are usable; those of another length than most have (the longest, if tied) don't count."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            size = pc.list_value_length(batch["vector"]).to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                for _, x in _batches(iter([batch.filter(pa.array(size == d))]), int(d)):
                    small = len(x) * int(max(x.max(), -int(x.min()))) < 1 << 63
                    total = [int(v) for v in (x.sum(0) if small else x.astype(object).sum(0))]
                    n, before = held.get(int(d), (0, [0] * int(d)))
                    held[int(d)] = [n + len(x), [a + b for a, b in zip(before, total, strict=True)]]
        rows = [(d, n, i, str(v)) for d, (n, total) in held.items() for i, v in enumerate(total)]
        yield pa.RecordBatch.from_pydict(dict(zip(("dims", "n", "i", "total"), zip(*rows, strict=True) if rows else [[]] * 4, strict=True)), schema=pa.schema([("dims", pa.int64()), ("n", pa.int64()), ("i", pa.int64()), ("total", pa.string())]))

    part = vectors.mapInArrow(add, "dims long, n long, i long, total string").select("dims", "n", "i", F.col("total").cast("decimal(38,0)").alias("total"))
    by_length = part.groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).groupBy("dims").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", F.col("total").cast("string").alias("total")))).alias("sums"))
    best = by_length.orderBy(F.desc("n"), F.desc("dims")).first()
    return None if best is None else (best["n"], tuple(int(r["total"]) for r in best["sums"]))


def fit(vectors: DataFrame, components: int = COMPONENTS, fan_in: int = FAN_IN) -> Whitening | None:
    """The whitening of vectors (vector), all usable ones; None without any.

    Components have a variance that isn't zero to double precision: fewer than asked for where the vectors don't span as many dimensions, none
    where all are equal. Each one's largest entry is positive (the first of equal ones).
    """
    vectors = vectors.where(_usable(F.col("vector"))).select("vector")
    counted = sums(vectors)
    if counted is None:
        return None
    n, total = counted
    d = len(total)
    same = vectors.where(F.size("vector") == d)
    centred = lambda x: (_difference(x, n, total) / n).astype(np.float64)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for _, x in _batches(batches, d):
            r = np.linalg.qr(np.vstack([r, centred(x)]), mode="r")
        if len(r):
            yield _state(_r(r))

    r = merged(same.mapInArrow(factor, "state array<double>"), lambda found: _r(np.vstack([f.reshape(d, d) for f in found])).ravel(), fan_in)
    _, values, right = np.linalg.svd(r.reshape(d, d))
    some = values[:components]
    some = some[some > max(n, d) * np.finfo(float).eps * values[0]]
    right = right[: len(some)]
    right = right * np.sign(right[np.arange(len(right)), np.abs(right).argmax(1)])[:, None] if len(right) else right
    variances, trace = some**2 / n, float((values**2).sum() / n)
    model = Whitening(n, total, right, variances, trace)
    k = len(some)
    if not k:
        return model

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, x in _batches(batches, d):
            w = whitened(model, x)
            state = np.concatenate([[len(w)], w.mean(0), ((w - w.mean(0)).T @ (w - w.mean(0))).ravel()])
            held = state if held is None else join([held, state])
        if held is not None:
            yield _state(held)

    def join(found: list[np.ndarray]) -> np.ndarray:
        """Counts, means and products of what is centred, of rows that stand apart."""
        count = np.array([f[0] for f in found])
        means, products = np.array([f[1 : k + 1] for f in found]), np.array([f[k + 1 :].reshape(k, k) for f in found])
        mean = count @ means / count.sum()
        return np.concatenate([[count.sum()], mean, (products.sum(0) + (means - mean).T @ (count[:, None] * (means - mean))).ravel()])

    state = merged(same.mapInArrow(moments, "state array<double>"), join, fan_in)
    error = float(np.abs(state[k + 1 :].reshape(k, k) / n - np.eye(k)).max())
    return Whitening(n, total, right, variances, trace, error)


def whitened(model: Whitening, x: np.ndarray) -> np.ndarray:
    """A column a component, of rows of whole numbers."""
    return (_difference(x, model.n, model.sums) / model.n).astype(np.float64) @ model.components.T / np.sqrt(model.variances)


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, fan_in: int = FAN_IN) -> DataFrame:
    """rows with usable vectors, and behind their columns: component, n, deviation (decimal), whitened, explained, identity_error; a row a component.

    Dropped are rows whose vector is null, empty or holds an entry that is null or not finite, and those of another length than most have. An entry of
    over 2^62 after scaling counts as that, and a deviation of over 38 digits is null. Repeated rows, ties and null keys count as rows of their own. Columns with the names of new ones are replaced by these,
    others stay. No usable rows, or vectors that are all equal: no rows. The model that reaches the driver is dimensions x components large.
    """
    new = {"component": "int", "n": "long", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}
    columns = [c for c in rows.columns if c not in new]
    inner = wrapped(rows.select(*(F.col(f"`{c}`") for c in columns)), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    model = fit(inner.select("vector"), components, fan_in)
    if model is None or not len(model.variances):
        return rows.select(*(F.col(f"`{c}`") for c in columns), *(F.lit(None).cast(t).alias(c) for c, t in new.items())).limit(0)
    d, k = len(model.sums), len(model.variances)

    @F.arrow_udf("struct<deviation:string,whitened:array<double>>")
    def project(vectors: pa.Array) -> pa.Array:
        deviation, out = [], []
        for i in range(0, len(vectors), ROWS):
            x = _whole(vectors.slice(i, ROWS), d)
            apart = _difference(x, model.n, model.sums)
            if apart.dtype != object and d * float(np.abs(apart).max()) ** 2 >= 2.0**62:
                apart = apart.astype(object)
            deviation += map(str, (apart * apart).sum(1).tolist())
            out.append(whitened(model, x))
        flat = pa.array(np.concatenate(out).ravel()) if out else pa.array([], pa.float64())
        return pa.StructArray.from_arrays([pa.array(deviation, pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(vectors) + 1, k), pa.int32()), flat)], ["deviation", "whitened"])

    usable = inner.where(_usable(F.col("vector")) & (F.size("vector") == d)).withColumn("found", project("vector"))
    long = usable.select("row", "found.deviation", F.posexplode("found.whitened").alias("at", "whitened"))
    explained = F.element_at(F.lit((model.variances / model.trace).tolist()), F.col("at") + 1)
    values = {"component": F.col("at") + 1, "n": F.lit(model.n), "deviation": F.when(F.length("deviation") <= 38, F.col("deviation")), "whitened": F.col("whitened"), "explained": explained, "identity_error": F.lit(model.identity_error)}
    return long.select(*(F.col("row").getField(c).alias(c) for c in columns), *(values[c].cast(t).alias(c) for c, t in new.items()))


def op13_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of `embeddings`: see whiten(). A deviation beyond a long is null."""
    rows = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.select("vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained", "identity_error")
