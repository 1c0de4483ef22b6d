"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch
from .quantiles import nearest_rank, of_groups, percentiles  # noqa: F401


def auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """One row with the ROC area by rank sums, ties at their mean rank: (auc, n_pos, n_neg). Null if a class is missing.

    Rows are counted by score, and the scores dealt to ranges that Spark samples: running sums go over a range's scores, and over
    the ranges, of which there are as many as partitions, so that no task holds all scores.
    """
    counted = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.count("*").alias("n"))
    # written, as which scores a range has must be the same for both sums
    by_score = scratch.written(counted.repartitionByRange("s").withColumn("part", F.spark_partition_id()), scratch.folder(scored.sparkSession, "scores"))
    parts = by_score.groupBy("part").agg(F.sum("n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = by_score.withColumn("_inside", inside).join(F.broadcast(parts.drop("_n")), "part").withColumn("rank", F.col("_before") + F.col("_inside") + (F.col("n") + 1) / 2)
    total = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    area = (F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    return total.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), area).alias("auc"), F.col("pos").cast("bigint").alias("n_pos"), F.col("neg").cast("bigint").alias("n_neg"))


def recall_at(rank: Column, k: int) -> Column:
    return F.avg(F.coalesce((rank <= k).cast("double"), F.lit(0.0)))


def mean_reciprocal_rank(rank: Column) -> Column:
    return F.avg(F.coalesce(1.0 / rank, F.lit(0.0)))


def retrieval_report(results: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of how results (query, rank, video_id, start_sec, end_sec, words) answer expected queries (query, video_id, a, b); a null video_id expects nothing.

    The first result that meets the window in its video, both ends closed, is the hit. A seek error is how far its start
    lies outside the window. A query without a hit counts zero for recall and reciprocal rank and has no seek error; a
    result for a query that expects nothing makes it a false positive.
    """
    met = results.join(expected.withColumnRenamed("query", "_q"), (F.col("query") == F.col("_q")) & results["video_id"].eqNullSafe(expected["video_id"])).filter("start_sec <= b AND a <= end_sec")
    hit = met.groupBy("_q").agg(F.min(F.struct("rank", "start_sec", "a", "b")).alias("h"))
    counts = results.groupBy(F.col("query").alias("_c")).agg(F.count("*").alias("n"), F.sum("words").alias("w"), F.max("words").alias("longest"))
    each = expected.join(hit, F.col("query") == F.col("_q"), "left").join(counts, F.col("query") == F.col("_c"), "left")
    positive, rank = F.col("video_id").isNotNull(), F.col("h.rank")
    seek = F.when(rank.isNotNull(), F.greatest(F.col("h.a") - F.col("h.start_sec"), F.col("h.start_sec") - F.col("h.b"), F.lit(0)))
    of = lambda c: F.when(positive, c)
    recall = [F.avg(of(F.coalesce((rank <= k).cast("double"), F.lit(0.0)))).alias(f"recall_{k}") for k in (1, 3, 5)]
    n = F.coalesce("n", F.lit(0))
    return each.agg(
        F.count_if(positive).alias("n_positive"), F.count_if(~positive).alias("n_negative"), *recall, F.avg(of(F.coalesce(1 / rank, F.lit(0.0)))).alias("mrr"), F.avg(of(seek)).alias("seek_error"),
        F.avg(F.when(~positive, (n > 0).cast("double"))).alias("false_positive_rate"), F.avg(of(n)).alias("mean_results"), (F.sum(of(F.col("w"))) / F.sum(of(F.col("n")))).alias("mean_quote_words"), F.max(of(F.col("longest"))).alias("max_quote_words"),
    )


def clip_report(candidates: DataFrame, examples: DataFrame, starts: DataFrame, width: float = 60.0) -> DataFrame:
    """One row of how candidates (video_id, first, start_sec, end_sec) cover examples (example, video_id, a, b, setup): coverage, and of the covered
    the mean overlap, boundary error and share whose setup, if one is needed, is inside; and the share of candidates that start at none of the sentences' starts (video_id, start_sec).

    An example's best candidate has the largest intersection over union, the earlier on a tie; both meet by cells of time.
    """
    cell = lambda a, b: F.explode(F.sequence(F.floor(a / width).cast("bigint"), F.floor(b / width).cast("bigint")))
    met = examples.withColumn("_c", cell(F.col("a"), F.col("b"))).join(candidates.withColumn("_c", cell(F.col("start_sec"), F.col("end_sec"))), ["video_id", "_c"]).drop("_c").distinct()
    shared = F.greatest(F.lit(0), F.least("end_sec", "b") - F.greatest("start_sec", "a"))
    iou = shared / (F.greatest("end_sec", "b") - F.least("start_sec", "a"))
    best = met.withColumn("iou", iou).filter("iou > 0").groupBy("example").agg(F.max(F.struct("iou", (-F.col("start_sec")).alias("s"), (-F.col("end_sec")).alias("e"), (-F.col("first")).alias("f"), "a", "b", "setup")).alias("x"))
    error = (F.abs(-F.col("x.s") - F.col("x.a")) + F.abs(-F.col("x.e") - F.col("x.b"))) / 2
    inside = F.when(F.col("x.setup").isNotNull(), (-F.col("x.f") <= F.col("x.setup")).cast("double"))
    found = best.agg(F.count("*").alias("covered"), F.avg("x.iou").alias("mean_iou"), F.avg(error).alias("boundary_error"), F.avg(inside).alias("setup_containment"))
    at = starts.select("video_id", "start_sec", F.lit(True).alias("_at")).distinct()
    loose = candidates.join(at, ["video_id", "start_sec"], "left").agg(F.count("*").alias("candidates"), F.avg(F.col("_at").isNull().cast("double")).alias("mid_sentence_starts"))
    n = examples.agg(F.count("*").alias("examples"))
    return n.join(F.broadcast(found)).join(F.broadcast(loose)).select("examples", "candidates", (F.col("covered") / F.col("examples")).alias("coverage"), "mean_iou", "boundary_error", "setup_containment", "mid_sentence_starts")


def ablation(reports: dict[str, DataFrame], base: str) -> DataFrame:
    """(variant, metrics, and each metric less the base's): one-row reports side by side."""
    out = None
    for name, report in reports.items():
        row = report.select(F.lit(name).alias("variant"), *report.columns)
        out = row if out is None else out.unionByName(row)
    columns = reports[base].columns
    first = reports[base].toDF(*[f"_{c}" for c in columns])
    return out.join(F.broadcast(first)).select("variant", *columns, *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in columns])


def suggested_bounds(rows: DataFrame, positive: Column, raw: Column, scored: Column) -> DataFrame:
    """(floor, ceiling, delta): the raw score's 5th percentile of the negatives and 95th of the positives, between which a score should run, and the difference of the classes' medians of another form of it, so that forms can be compared."""
    bounds = percentiles(of_groups(rows, {"neg": ~positive, "pos": positive}, raw), "k", "v", {"low": 0.05, "high": 0.95})
    middles = percentiles(of_groups(rows, {"neg": ~positive, "pos": positive}, scored), "k", "v", {"m": 0.5})
    of = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))  # noqa: E731  # two rows each
    one = bounds.agg(F.round(of("low", "neg"), 6).alias("floor"), F.round(of("high", "pos"), 6).alias("ceiling"))
    return one.join(F.broadcast(middles.agg(F.round(of("m", "pos") - of("m", "neg"), 6).alias("delta"))))
