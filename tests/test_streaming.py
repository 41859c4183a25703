import pytest
from pyspark.sql import functions as F

from siftwell.operators import folds, journal
from siftwell.streaming import jobs


@pytest.fixture
def stream(spark, tmp_path):
    """events in files by time, one file a micro-batch."""

    def make(rows, schema, parts=3):
        df = spark.createDataFrame(rows, schema)
        n = -(-len(rows) // parts)
        for i in range(parts):
            spark.createDataFrame(rows[i * n : (i + 1) * n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, tmp=tmp_path / "ck"):
        out = []
        q = df.writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return out

    return make, run


def times(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_bursts_carry_over_batches(spark, stream):
    make, run = stream
    rows = [("a" if i % 2 else "b", i, times(i * 5 + (100 if i > 20 else 0))) for i in range(36)]
    df, live = make(rows, "k string, i long, ts timestamp")
    got = {(k, i): b for k, i, b in run(jobs.bursts(live, "k", "ts", "i", 12, 90))}
    want = folds.bursts(df.withColumn("t", F.unix_micros("ts") / 1e6), ["k"], "t", ["i"], 12, 90).collect()
    assert got == {(r.k, r.i): r.burst for r in want}


def test_sessions_come_out_behind_the_watermark(stream):
    make, run = stream
    _, live = make([("a", times(0)), ("a", times(5)), ("a", times(500)), ("a", times(5000))], "k string, ts timestamp", 2)
    got = run(jobs.sessions(live, "k", "ts", "60 seconds", "10 seconds"))
    assert sorted(n for _, _, _, n in got)[-1] == 2


def test_review_ignores_stale_endings(stream):
    make, run = stream
    events = ["done", "ask", "done", "done", "ask", "fail"]
    _, live = make([("a", times(i), e) for i, e in enumerate(events)], "k string, ts timestamp, e string")
    assert sorted(run(jobs.review(live, "k", "ts", "ask", {"done": "completed", "fail": "failed"}, "e"))) == [("a", "completed"), ("a", "failed")]


def test_log_merge_equals_replay(spark, stream, tmp_path):
    make, _ = stream
    rows = [(f"k{i % 4}", i, f"v{i}") for i in range(30)]
    df, live = make(rows, "k string, n long, v string")
    q = live.writeStream.foreachBatch(jobs.merge_log(str(tmp_path / "t"), ["k"], "n")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "t").iterdir())
    got = spark.read.parquet(str(tmp_path / "t" / f"version={last}"))
    assert sorted(map(tuple, got.select("k", "n", "v").collect())) == sorted(map(tuple, journal.replay(df, ["k"], "n").select("k", "n", "v").collect()))
