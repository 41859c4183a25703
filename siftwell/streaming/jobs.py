"""Streams: bursts with carried state, change logs merged by micro-batch, review state machines, session windows.

The operators' own semantics need sorted input. On a stream, rows of a micro-batch are sorted, a row that is
older than its key's state joins as if it came at the state's last time, and a watermark ends a key's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.journal import replay


def bursts(rows: DataFrame, key: str, ts: str, row: str, gap: float, span: float, late: str = "1 hour") -> DataFrame:
    """(key, row, burst): as folds.bursts, with the last burst of each key carried from batch to batch."""
    kind = rows.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        burst, anchor, last = state.get if state.exists else (-1, 0.0, 0.0)
        pdf = pd.concat(list(batches)).sort_values(["t", row])
        out = []
        for t, r in zip(pdf["t"], pdf[row], strict=True):
            t = max(t, last) if burst >= 0 else t
            if burst < 0 or t - last > gap or t - anchor > span:
                burst, anchor = burst + 1, t
            last = t
            out.append((k[0], r, burst))
        state.update((burst, anchor, last))
        state.setTimeoutTimestamp(int((last + gap) * 1000) + 1 if int((last + gap) * 1000) + 1 > state.getCurrentWatermarkMs() else state.getCurrentWatermarkMs() + 1)
        yield pd.DataFrame(out, columns=[key, row, "burst"])

    timed = rows.withColumn("t", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).withColumn("_event", F.col(ts).cast("timestamp")).withWatermark("_event", late)
    schema = f"{key} {kind}, {row} {rows.schema[row].dataType.simpleString()}, burst long"
    return timed.select(key, row, "t", "_event").groupBy(key).applyInPandasWithState(step, schema, "burst long, anchor double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(rows: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): session windows; in append mode a session comes out once the watermark has passed it."""
    timed = rows.withColumn("_event", F.col(ts).cast("timestamp")).withWatermark("_event", late)
    return timed.groupBy(key, F.session_window("_event", gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def review(rows: DataFrame, key: str, ts: str, begins: str, ends: dict[str, str], event: str) -> DataFrame:
    """(key, outcome): one pending review per key; the first ending after a beginning closes it, endings without one are stale and ignored."""
    kind = rows.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get[0] if state.exists else False
        out = []
        for e in pd.concat(list(batches)).sort_values(ts)[event]:
            if e == begins:
                pending = True
            elif pending and e in ends:
                pending = False
                out.append((k[0], ends[e]))
        state.update((pending,))
        yield pd.DataFrame(out, columns=[key, "outcome"])

    return rows.select(key, ts, event).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, outcome string", "pending boolean", "append", GroupStateTimeout.NoTimeout)


def merge_log(path: str, keys: list[str], seq: str):
    """A foreachBatch function that keeps the latest patch of each key as a table of versions under path.

    Each batch writes version <batch id + 1> from the one before, so a batch that runs again after a failure
    writes the same version again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        before = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/version={batch_id}") if batch_id else batch.limit(0)
        replay(before.unionByName(batch), keys, seq).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/version={batch_id + 1}")

    return merge
