"""Ordered operations over a video's sentences, words or events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_MERGED_SECONDS = 90


def context(sentences: DataFrame, around: int = 1) -> DataFrame:
    """Each sentence with the text and times of those around it."""
    w = W.partitionBy("video_id").orderBy("sentence_idx").rowsBetween(-around, around)
    return sentences.select("video_id", "sentence_idx", F.array_join(F.collect_list("text").over(w), " ").alias("text"), F.min("start_sec").over(w).alias("start_sec"), F.max("end_sec").over(w).alias("end_sec"))


def islands(ranges: DataFrame, group: list[str], seconds: int = MOST_MERGED_SECONDS) -> DataFrame:
    """Adjacent or overlapping ranges (first, last, start_sec, end_sec, score) of a group merged in order of their first sentence, as long as a merged one spans no more than so many seconds; the best score stays.

    The limit makes each merge depend on those before: a fold over the group's ranges, which a top-k bounds.
    """
    kind = "array<struct<first:bigint,last:bigint,s:bigint,e:bigint,score:double>>"
    row = F.struct(F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), F.col("start_sec").cast("bigint").alias("s"), F.col("end_sec").cast("bigint").alias("e"), F.col("score").cast("double").alias("score"))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(F.least(last["first"], x["first"]).alias("first"), F.greatest(last["last"], x["last"]).alias("last"), F.least(last["s"], x["s"]).alias("s"), F.greatest(last["e"], x["e"]).alias("e"), F.greatest(last["score"], x["score"]).alias("score"))
        fits = (x["first"] <= last["last"] + 1) & (joined["e"] - joined["s"] <= seconds)
        return F.when(F.size(done) == 0, F.array(x)).when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    folded = ranges.groupBy(*group).agg(F.aggregate(F.array_sort(F.collect_list(row)).cast(kind), F.array().cast(kind), step).alias("m"))
    return folded.select(*group, F.explode("m").alias("m")).select(*group, "m.first", "m.last", F.col("m.s").alias("start_sec"), F.col("m.e").alias("end_sec"), "m.score")


def count_windows(rows: DataFrame, key: str, order: str, size: int, overlap: int) -> DataFrame:
    """(key, window, order): windows of ``size`` rows, each ``size - overlap`` after the one before, until one reaches the last row."""
    step = size - overlap
    w = W.partitionBy(key)
    placed = rows.select(key, order, (F.row_number().over(w.orderBy(order)) - 1).alias("p"), F.count("*").over(w).alias("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("bigint")
    low = F.greatest(F.lit(0), F.ceil((F.col("p") - size + 1) / step)).cast("bigint")
    high = F.least(F.floor(F.col("p") / step).cast("bigint"), last)
    return placed.select(key, order, F.explode(F.when(low <= high, F.sequence(low, high))).alias("window"))


def time_windows(rows: DataFrame, at: str, size: int, step: int) -> DataFrame:
    """Rows with each window [k * step, k * step + size) that holds their time, as ``window``."""
    high = F.floor(F.col(at) / step).cast("bigint")
    low = F.greatest(F.lit(0), F.floor((F.col(at) - size) / step).cast("bigint") + 1)
    return rows.withColumn("window", F.explode(F.sequence(low, high)))


def groups_of(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Rows with the number of their group of n in order, as ``cue``."""
    return rows.withColumn("cue", F.floor((F.row_number().over(W.partitionBy(key).orderBy(order)) - 1) / n).cast("bigint"))
