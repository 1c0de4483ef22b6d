"""Operators that SQL can't express, against plain code on small tables."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.functions import numbers, texts, times
from cuelake.operators import intervals, metrics, mutation, ranking, retrieval, selection, sequences
from cuelake.sources import transcripts
from cuelake.streaming import usage


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "back"),
    [("He told me", True), ("So he told me", True), ("It's been three years", False), ("It changed everything", True), ("It rained", False), ("This week I talk", False), ("This is why", True), ("That's why we left", True), ("I said so", False), ("", False), ("They're here", True), ("So it turns out fine", False), ("and but so he left", True), ("These videos", True), ("This week's episode", False), ("So and but then he left", False)],
)
def test_points_back(spark, text, back):
    assert one(spark, texts.points_back(F.col("t")), t=text) is back


def test_hook_cues(spark):
    assert one(spark, texts.hook_lexical(F.col("t")), t="Why do you never stop?") == pytest.approx(0.30 + 0.20 + 0.15 + 0.10)
    assert one(spark, texts.hook_lexical(F.col("t")), t="The weather was mild") == 0.0


def test_texts(spark):
    assert one(spark, texts.terms(F.col("t")), t="They don't know; I'd say we've won") == ["they", "do", "not", "know", "i", "would", "say", "we", "have", "won"]
    assert one(spark, texts.without_phrases(F.col("t"), ["game changer", "c++"]), t="A game changer , in C++ or game changers") == "A, in or game changers"
    assert one(spark, texts.video_id(F.col("t")), t="https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=3") == "dQw4w9WgXcQ"
    assert one(spark, texts.video_id(F.col("t")), t="dQw4w9WgXcQ") == "dQw4w9WgXcQ" and one(spark, texts.video_id(F.col("t")), t="no") is None
    assert one(spark, texts.title_of(F.col("t")), t="my_first-clip.mp4") == "My First Clip"


def test_times(spark):
    assert [one(spark, f(F.col("s")), s=3725.9) for f in (times.clock, times.minutes_clock, times.duration)] == ["01:02:05", "62:05", "1:02:05"]
    assert one(spark, times.parse_cue_clock(F.col("t")), t="01:02:03,500") == 3723.5 and one(spark, times.parse_cue_clock(F.col("t")), t="02:03.5") == 123.5 and one(spark, times.parse_cue_clock(F.col("t")), t="x") is None


def test_unknown_is_not_zero(spark):
    assert one(spark, numbers.pause_score(F.col("g").cast("double")), g=None) == 1.0 and one(spark, numbers.pause_score(F.col("g")), g=0.0) == 0.0
    assert one(spark, selection.self_containedness(F.col("t"), F.lit(None).cast("int")), t="A plain line") == 1.0
    same = {k: F.lit(0.5) for k in selection.WEIGHTS}
    assert one(spark, selection.composite(same, F.lit(None).cast("double")), t=1) == 0.5 and one(spark, selection.composite(same, F.lit(1.0)), t=1) == pytest.approx(0.575)


def test_timed_text(spark):
    srt = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hello</i>\r\nthere\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\nHello there\r\n\r\n4\r\n00:00:07,000 --> 00:00:08,000\r\nBye"
    vtt = "WEBVTT\n\nNOTE a comment\n00:01.000 --> 00:02.000\nno\n\n00:02.000 --> 00:03.000 align:start\nlater\n\n00:01.000 --> 00:01.500\nfirst"
    files = spark.createDataFrame([("a", srt), ("b", vtt), ("c", "plain"), ("d", None)], "video_id string, raw string")
    found = [tuple(r) for r in transcripts.timed_text(files).orderBy("video_id", "pos").collect()]
    assert found == [("a", 0, 1.0, 2.5, "Hello there"), ("a", 1, 7.0, 8.0, "Bye"), ("b", 0, 1.0, 1.5, "first"), ("b", 1, 2.0, 3.0, "later")]


def test_suppression_and_islands(spark):
    rows = [(1, 0, 0.9, 0.0, 10.0), (1, 1, 0.8, 4.0, 14.0), (1, 2, 0.7, 6.0, 30.0), (1, 3, 0.6, 15.0, 16.0), (2, 4, 0.1, 0.0, 10.0)]
    table = spark.createDataFrame(rows, "v int, item bigint, score double, start_sec double, end_sec double")
    assert sorted(r.item for r in ranking.suppress_overlapping(table, ["v"], "item").collect()) == [0, 2, 4]
    spans = spark.createDataFrame([(1, 0, 1, 0, 40, 0.1), (1, 2, 3, 40, 80, 0.5), (1, 4, 5, 80, 120, 0.2), (1, 9, 9, 200, 210, 0.3)], "v int, first bigint, last bigint, start_sec bigint, end_sec bigint, score double")
    assert sorted(tuple(r) for r in sequences.islands(spans, ["v"]).collect()) == [(1, 0, 3, 0, 80, 0.5), (1, 4, 5, 80, 120, 0.2), (1, 9, 9, 200, 210, 0.3)]


def test_display_gates(spark):
    rows = [(1, "a", 0.518), (2, "a", 0.123), (3, "b", 0.5), (4, "a", 0.4), (5, "a", 0.39), (6, "c", 0.05)]
    table = spark.createDataFrame(rows, "item int, v string, score double")
    assert sorted(r.item for r in ranking.display_gates(table, "v", ["item"]).collect()) == [1, 3, 4]
    assert ranking.display_gates(table.limit(0), "v", ["item"]).count() == 0


def test_diversity(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    table = spark.createDataFrame([("x", k, c, v[k]) for k, c in enumerate((0.9, 0.89, 0.8))], "g string, item bigint, composite double, vector array<double>")
    found = {r.place: (r.item, r.max_similarity) for r in ranking.diversify(table, "g", "item", 2).collect()}
    assert found == {0: (0, 0.0), 1: (2, 0.0)}


def test_topic_segments(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(40):
        v = np.eye(3)[k // 20] + rng.normal(0, 0.02, 3)
        rows.append(("v", k, [float(x) for x in v / np.linalg.norm(v)]))
    table = spark.createDataFrame(rows + [("short", 0, [1.0, 0.0, 0.0])], "video string, i bigint, vec array<double>")
    found = {(r.video, r.i): r.segment for r in selection.topic_segments(table, "video", "i", "vec").collect()}
    assert all(found[("v", k)] == k // 20 for k in range(40)) and found[("short", 0)] == 0


def test_beats_and_candidates(spark):
    said = ["Opening line here", "What is it?", "It is an answer", "Plain words", "But then it broke", "The end"]
    table = spark.createDataFrame([(1, k, t, 10 * k, 10 * k + 10) for k, t in enumerate(said)], "video_id bigint, sentence_idx bigint, text string, start_sec bigint, end_sec bigint")
    beats = selection.heuristic_beats(table)
    assert sorted((r.beat_type, r.first, r.last, r.needs) for r in beats.collect() if r.beat_type != "hook") == [("payoff", 1, 2, 1), ("turning_point", 4, 4, 3)]
    found = spark.createDataFrame([(1, 1, 2, 10, 30), (1, 3, 4, 30, 50), (1, 3, 5, 30, 60)], "video_id bigint, first bigint, last bigint, start_sec bigint, end_sec bigint")
    assert sorted((r.first, r.last) for r in selection.merge_candidates(found).collect()) == [(1, 2), (3, 5)]


def test_as_of_is_the_plain_search(spark):
    rng = random.Random(3)
    points = [(k, rng.randint(0, 3), rng.uniform(0, 20_000)) for k in range(200)] + [(500, 9, 5.0), (501, 1, 3600.0)]
    facts = [(rng.randint(0, 3), rng.uniform(0, 20_000)) for _ in range(150)] + [(1, 3600.0)]
    left, right = spark.createDataFrame(points, "id int, key int, t double"), spark.createDataFrame(facts, "key int, at double")
    for forward in (False, True):
        found = {r.id: r.x for r in intervals.as_of(left, "t", right, "key", "at", "x", forward).collect()}
        for k, key, t in points:
            side = [a for b, a in facts if b == key and (a >= t if forward else a <= t)]
            assert found[k] == ((min(side) if forward else max(side)) if side else None)


def test_auc_and_percentiles(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(80)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    table = spark.createDataFrame(rows, "y int, s double")
    assert metrics.auc(table, "y", "s").first()["auc"] == pytest.approx(want)
    assert metrics.auc(table.filter("y = 1"), "y", "s").first()["auc"] is None
    values = spark.createDataFrame([("k", float(v)) for v in range(4)], "k string, v double")
    assert {r.percent: r.v for r in metrics.nearest_rank(values, "k", "v", [50, 95]).collect()} == {50: 2.0, 95: 3.0}


def test_bm25_scores_terms_of_queries_only(spark):
    chunks = spark.createDataFrame([(1, "the red fox"), (2, "the blue fox ran"), (3, "nothing here"), (4, "the end"), (5, "of it")], "id int, text string")
    asked = spark.createDataFrame([(7, "red fox"), (8, "")], "q int, text string")
    found = {(r.q, r.id): r.score for r in retrieval.bm25(chunks, ["id"], "text", asked, "q", "text").collect()}
    assert set(found) == {(7, 1), (7, 2)} and found[(7, 1)] > found[(7, 2)] > 0


def test_windows_by_count_and_time(spark):
    table = spark.createDataFrame([("a", k) for k in range(23)], "g string, i int")
    found = {}
    for r in sequences.count_windows(table, "g", "i", 10, 3).collect():
        found.setdefault(r.window, []).append(r.i)
    assert {k: (min(v), max(v)) for k, v in found.items()} == {0: (0, 9), 1: (7, 16), 2: (14, 22)}
    timed = sequences.time_windows(spark.createDataFrame([(0,), (36,), (50,)], "s int"), "s", 45, 35)
    assert sorted((r.s, r.window) for r in timed.collect()) == [(0, 0), (36, 0), (36, 1), (50, 1)]


def test_mutations(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(2, 4, "late"), (3, 1, "c"), (1, 2, "d")], "k int, v int, x string")
    assert sorted((r.k, r.x) for r in mutation.upsert(old, new, ["k"], ["v"]).collect()) == [(1, "d"), (2, "b"), (3, "c")]
    assert sorted(r.k for r in mutation.append_new(old, new, ["k"]).collect()) == [1, 2, 3]
    jobs = spark.createDataFrame([(1, "running"), (2, "done"), (3, None)], "id int, status string")
    assert {r.id: r.status for r in mutation.fail_interrupted(jobs, "cut").collect()} == {1: "failed", 2: "done", 3: None}


def test_streams_give_the_batch_rows(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 3).cast("string").alias("bucket"), F.timestamp_seconds(F.col("id") * 97).alias("ts"), "id")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = usage.job_states(stream, "bucket", "ts", "bucket").writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = usage.job_states(rows, "bucket", "ts", "bucket")
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(map(tuple, want.collect()))
    q = usage.window_counts(stream, "bucket", "ts").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, usage.window_counts(rows, "bucket", "ts").collect()))
    q = usage.index_incrementally(stream, str(tmp_path / "index"), str(tmp_path / "check"), lambda b: b.select("id"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "index")).count() == 200


def test_whether_a_long_text_points_back_takes_one_look_at_its_words(spark):
    """The words were found anew for each word, in time that grew with the square of a text's length."""
    long = " the old bridge over the river" * 3000
    said = [("So it happened." + long, False), ("And they left." + long, True), ("But now that bridge" + long, True), ("This week" + long, False), ("Well it ate" + long, True), ("So and but it ate" + long, True), ("So and but now it ate" + long, False), ("so", False), ("", False), (None, False)]
    began = time.monotonic()
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(said)], "k int, text string")
    got = {r.k: r.b for r in rows.select("k", texts.points_back(F.col("text")).alias("b")).collect()}
    assert [got[k] for k in range(len(said))] == [b for _, b in said]
    assert time.monotonic() - began < 30


def test_spans_of_any_length_meet_their_points_in_few_cells(spark):
    """A span's cells were as many as its hours, and a small table of long spans was broadcast with all of them."""
    rng = random.Random(5)
    spans = [("ab"[k % 2], k, s := rng.choice([0.0, 3600.0, rng.uniform(0, 1e6)]), s + rng.choice([0.0, -1.0, 30.0, 3600.0, 28_800.0, rng.uniform(0, 1e6)])) for k in range(60)] + [("a", 60, None, 5.0)]
    points = [("abc"[k % 3], k, rng.choice([0.0, 3600.0, rng.uniform(0, 1.5e6)])) for k in range(300)]
    p, s = spark.createDataFrame(points, "key string, p int, at double"), spark.createDataFrame(spans, "key string, s int, start double, end double")
    found = intervals.range_join(p, "at", s, "key", "start", "end", 3600.0, mixed=True)
    want = sorted((i, j) for key, i, t in points for k, j, a, b in spans if key == k and a is not None and a <= t <= b)
    assert sorted((r.p, r.s) for r in found.collect()) == want and want
    for x in (found, intervals.range_join(p, "at", s, "key", "start", "end", 3600.0)):
        assert "Broadcast" not in x._jdf.queryExecution().executedPlan().toString()
    long = spark.createDataFrame([("a", 0, 0.0, 864_000.0)], "key string, s int, start double, end double")
    plan = intervals.range_join(p, "at", long, "key", "start", "end", 3600.0, mixed=True)
    assert plan.count() == sum(k == "a" and t <= 864_000 for k, _, t in points)
