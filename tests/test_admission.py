"""Admission under a rolling limit: batch against a plain queue, stream against batch."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cuelake.operators import admission, inverted, retrieval
from cuelake.streaming import usage


def plain(calls: list[tuple], limit: int, window: int, slack: int) -> list[tuple]:
    """One call after the other; each looks at all admissions so far."""
    through, out = defaultdict(list), []
    for bucket, call, t in sorted((c for c in calls if c[2] is not None), key=lambda c: (c[2], c[1])):
        at = max([t, *through[bucket][-1:]])
        while len(inside := [x for x in through[bucket] if x >= at - window]) >= limit:
            at = inside[0] + window + slack
        through[bucket].append(at)
        out.append((bucket, call, t, at, at - t))
    return sorted(out, key=str)


@pytest.mark.parametrize(("limit", "window", "spread"), [(1, 60_000_000, 400), (2, 180_000_000, 300), (5, 60_000_000, 15), (3, 60_000_000, 60), (4, 7_000_000_000, 2_000), (1, 1, 60)])
def test_batch(spark, limit, window, spread):
    rng = random.Random(limit)
    calls = [(rng.choice(["a", "a", "a", "b", None]), k, 1_700_000_000_000_000 + rng.randint(0, spread * 400) * 1_000_000) for k in range(400)] + [("a", 1000, None), ("z", 1001, 5)]
    frame = spark.createDataFrame(calls, "bucket string, call bigint, t bigint")
    found = sorted(map(tuple, admission.admitted(frame, limit, window, 50_000).collect()), key=str)
    assert found == plain(calls, limit, window, 50_000)


def test_quiet_times_begin_sessions(spark):
    second = 1_000_000
    calls = [("a", k, t * second) for k, t in enumerate([0, 1, 2, 3, 70, 250, 251, 400, 9_000, 9_001])]
    found = {r.call: r.session for r in admission.sessions(spark.createDataFrame(calls, "bucket string, call bigint, t bigint"), 2).collect()}
    assert found[0] == 1 and len(set(found.values())) >= 4 and found[8] == found[9] == 9
    assert admission.admitted(spark.createDataFrame([], "bucket string, call bigint, t bigint"), 2).count() == 0


def test_the_sixth_call_waits_for_the_window(spark):
    calls = spark.createDataFrame([("b", k, 1_000_000_000) for k in range(7)], "bucket string, call bigint, t bigint")
    waited = [r.waited for r in admission.admitted(calls, 5).orderBy("call").collect()]
    assert waited == [0] * 5 + [60_050_000] * 2


def test_stream_gives_the_batchs_rows(spark, tmp_path):
    rng = random.Random(8)
    base = 1_700_000_000
    calls = [(rng.choice("ab"), k, base + rng.randint(0, 600) + rng.random()) for k in range(120)] + [("a", 500, base + 100.0), ("a", 501, base + 100.0)]
    ddl = "bucket string, call bigint, s double"
    batches = [calls[:50], calls[50:], [("z", 999, base + 9_000.0)], [("z", 1000, base + 90_000.0)]]  # out of order within the watermark, then time passes
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")))
        run = usage.admissions(stream, "bucket", "call", "ts", 4, late="30 minutes").writeStream.format("memory").queryName("admissions").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        run.awaitTermination(300)
        assert run.exception() is None
        got = sorted((tuple(r) for r in spark.table("admissions").collect() if r.bucket != "z"), key=str)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    frame = spark.createDataFrame(calls, ddl).withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")))
    want = sorted(map(tuple, usage.admissions(frame, "bucket", "call", "ts", 4).collect()), key=str)
    assert got == want and any(r[4] > 0 for r in want)


def test_a_stream_of_chunks_is_indexed(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(10 * k + i, f"river {i} lamp" if i % 2 else "bridge") for i in range(5)], "id int, text string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    index = inverted.Index(spark, str(tmp_path / "index"), "id int", 4)
    stream = spark.readStream.schema("id int, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    usage.index_postings(stream, index, "text", str(tmp_path / "check")).awaitTermination(300)
    asked = spark.createDataFrame([(0, "river bridge")], "q int, text string")
    everything = spark.read.schema("id int, text string").parquet(str(tmp_path / "in" / "*"))
    rows = lambda x: {r.id: round(r.score, 9) for r in x.collect()}
    assert rows(index.bm25(["0", "1"], asked, "q", "text")) == rows(retrieval.bm25(everything, ["id"], "text", asked, "q", "text")) != {}
