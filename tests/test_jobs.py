"""Lives of jobs: what is stale or impossible changes nothing, silence is a failure, and a stream gives the batch's rows."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from cuelake.operators import jobs
from cuelake.streaming import usage

DDL = "job string, version bigint, t bigint, status string"


def test_any_order_of_arrival_gives_one_life(spark):
    snapshots = [("j", 1, 10, "queued"), ("j", 2, 20, "running"), ("j", 3, 30, "done"), ("j", 2, 25, "running")]
    want = [(10, "queued"), (20, "running"), (30, "done")]
    for order in itertools.islice(itertools.permutations(snapshots), 0, 24, 5):
        found = jobs.transitions(spark.createDataFrame(list(order), DDL), now=100).orderBy("t").collect()
        assert [(r.t, r.status) for r in found] == want


def test_what_cannot_follow_and_silence(spark):
    rows = [("back", 1, 1, "done"), ("back", 2, 2, "running"), ("skip", 1, 1, "queued"), ("skip", 2, 2, "done"), ("lost", 1, 5, "running"), ("lost", 2, 500, "running"), ("late", 1, 5, "queued"), ("odd", 1, 1, "lost"), ("odd", None, 2, "done"), (None, 1, 3, "failed"), ("after", 1, 999, "queued"), ("alive", 1, 880, "running")]
    found = jobs.transitions(spark.createDataFrame(rows, DDL), now=900, timeout=100)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("back", 1, "done", 1), ("skip", 1, "queued", 1), ("skip", 101, "failed", 1), ("lost", 5, "running", 1), ("lost", 105, "failed", 1), ("late", 5, "queued", 1), ("late", 105, "failed", 1), (None, 3, "failed", 1), ("alive", 880, "running", 1)], key=str)
    assert jobs.transitions(spark.createDataFrame([], DDL), now=9).count() == 0


def test_stream_gives_the_batchs_rows(spark, tmp_path):
    rng, base = random.Random(5), 1_700_000_000
    rows = [(rng.choice("abcdef"), k, float(base + rng.randint(0, 3000)), rng.choice(["queued", "running", "running", "done", "failed"])) for k in range(60)]
    ddl = "job string, version bigint, s double, status string"
    files = [rows[:25], rows[25:], [("z", 1, float(base + 50_000), "done")], [("z", 2, float(base + 90_000), "done")]]
    for k, part in enumerate(files):
        spark.createDataFrame(part, ddl).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    timed = lambda x: x.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = timed(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")))
        run = usage.job_transitions(stream, "job", "version", "ts", "status", timeout=600_000_000, late="2 hours").writeStream.format("memory").queryName("lives").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        run.awaitTermination(300)
        assert run.exception() is None
        got = sorted((tuple(r) for r in spark.table("lives").collect() if r.job != "z"), key=str)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = usage.job_transitions(timed(spark.createDataFrame(rows, ddl)), "job", "version", "ts", "status", (base + 80_000) * 1_000_000, 600_000_000)
    assert got == sorted(map(tuple, want.collect()), key=str) and {"failed", "queued"} <= {r[2] for r in got}
