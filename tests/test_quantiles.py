"""Order statistics by cells against sorted lists, with one key that holds nearly everything."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import metrics, quantiles


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    hot = [("hot", rng.choice([rng.gauss(0, 1), rng.expovariate(1e-6), 5.0, 5.0, -1e300 * rng.random(), 1e-300 * rng.random()])) for _ in range(3000)]
    return hot + [("tied", 7.0)] * 400 + [("tied", 8.0)] * 3 + [(None, float(k)) for k in range(300)] + [("one", 2.5), ("none", None), ("two", 1.0), ("two", 4.0)]


def by_key(rows):
    out = {}
    for k, v in rows:
        if v is not None:
            out.setdefault(k, []).append(v)
    return {k: sorted(v) for k, v in out.items()}


def test_values_at_ranks(spark, rows):
    lists = by_key(rows)
    ranks = [(k, r) for k, v in lists.items() for r in {0, 1, len(v) // 3, len(v) // 2, len(v) - 1} if r < len(v)] + [("hot", 999_999), ("absent", 0), ("hot", -1)]
    frame, wanted = spark.createDataFrame(rows, "key string, x double"), spark.createDataFrame(ranks, "key string, rank bigint")
    got = {(r.key, r["rank"]): r.x for r in quantiles.at_ranks(frame, "key", "x", wanted, few=20).collect()}
    assert got == {(k, r): lists[k][r] for k, r in ranks if k in lists and 0 <= r < len(lists[k])}
    assert quantiles.at_ranks(frame.limit(0), "key", "x", wanted).count() == 0
    whole = spark.createDataFrame([("a", 2**62 + k) for k in range(200)], "key string, x bigint")
    assert quantiles.at_ranks(whole, "key", "x", spark.createDataFrame([("a", 150)], "key string, rank bigint"), few=5).first().x == 2**62 + 150


def test_nearest_rank_and_percentiles(spark, rows):
    lists, frame = by_key([r for r in rows if r[0] != "hot"] + [("hot", float(k % 97)) for k in range(2000)]), None
    frame = spark.createDataFrame([(k, v) for k, vs in lists.items() for v in vs], "key string, x double")
    got = {(r.key, r.percent): r.x for r in quantiles.nearest_rank(frame, "key", "x", [5, 50, 95], few=30).collect()}
    assert got == {(k, p): v[round(p / 100 * (len(v) - 1))] for k, v in lists.items() for p in (5, 50, 95)}
    shares = {"a": 0.1, "m": 0.5, "z": 0.9}
    mine = {r.key: (r.a, r.m, r.z) for r in quantiles.percentiles(frame, "key", "x", shares, few=30).collect()}
    spark_s = {r.key: (r.a, r.m, r.z) for r in frame.groupBy("key").agg(*[F.percentile("x", s).alias(n) for n, s in shares.items()]).collect()}
    assert mine.keys() == spark_s.keys() and all(mine[k] == pytest.approx(spark_s[k]) for k in mine)


def test_no_task_sorts_more_than_few(spark):
    """One key holds all rows: what is left between the bounds before the last sort is few."""
    frame = spark.range(200_000).select(F.lit("all").alias("key"), (F.hash("id") / 7).alias("x"))
    want = sorted(r[0] for r in frame.select("x").collect())
    got = {r.percent: r.x for r in quantiles.nearest_rank(frame, "key", "x", [1, 50, 99], few=500).collect()}
    assert got == {p: want[round(p / 100 * (len(want) - 1))] for p in (1, 50, 99)}


def test_auc_by_cells(spark):
    rng = random.Random(3)
    for n, distinct in ((400, 10_000), (400, 7), (50, 1)):
        pairs = [(rng.randint(0, 1), rng.randint(0, distinct) / 3 - 10) for _ in range(n)]
        pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
        area = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        row = metrics.auc(spark.createDataFrame(pairs, "y int, s double"), "y", "s").first()
        assert row.auc == pytest.approx(area) and (row.n_pos, row.n_neg) == (len(pos), len(neg))
    assert metrics.auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first().auc is None
    assert metrics.auc(spark.createDataFrame([], "y int, s double"), "y", "s").first().n_pos in (0, None)
