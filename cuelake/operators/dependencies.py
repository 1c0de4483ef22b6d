"""What sentences and clips need from before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch

#: Seconds that a clip may last, and how many sentences are taken in for what points back.
MAX_CLIP, MOST_STEPS = 75, 8


def earliest_needed(needs: DataFrame) -> DataFrame:
    """(video_id, sentence_idx, earliest): the earliest sentence that each reaches over needs (video_id, sentence_idx, needs), one at most a sentence.

    Paths double each round, so that as many rounds do as the largest video's sentences have binary digits; fewer where
    all paths have ended. A cycle ends there as well: going round it again changes no minimum. Each round is a join of what
    the one before wrote: its plan is as long as that of the first, and a lost executor repeats a part of one round.
    """
    folder = scratch.folder(needs.sparkSession, "reach")
    first = needs.filter(F.col("needs").isNotNull()).select("video_id", "sentence_idx", F.col("needs").alias("to"), F.col("needs").alias("earliest"))
    path = scratch.written(first, f"{folder}/0")
    most = path.groupBy("video_id").count().agg(F.max("count")).first()[0] or 0
    for k in range(1, int(most).bit_length() + 1):
        there = path.select("video_id", F.col("sentence_idx").alias("to"), F.col("to").alias("on"), F.col("earliest").alias("more"))
        # paths that have ended join nothing and stay as they are
        further = path.join(there, ["video_id", "to"], "left").select("video_id", "sentence_idx", F.col("on").alias("to"), F.least("earliest", F.coalesce("more", "earliest")).alias("earliest"))
        path = scratch.written(further, f"{folder}/{k}")
        if path.filter("to IS NOT NULL").isEmpty():
            break
    return path.select("video_id", "sentence_idx", "earliest")


def dangling(clips: DataFrame, needs: DataFrame) -> DataFrame:
    """Clips (video_id, first, last, ..) with their sentences that need one before the clip, in order, as ``dangling``; clips are short, so that their sentences are listed and joined."""
    each = clips.select("video_id", "first", "last").distinct().withColumn("sentence_idx", F.explode(F.sequence("first", "last")))
    open_ = each.join(needs, ["video_id", "sentence_idx"]).filter(F.col("needs") < F.col("first")).groupBy("video_id", "first", "last").agg(F.array_sort(F.collect_set("sentence_idx")).alias("dangling"))
    return clips.join(open_, ["video_id", "first", "last"], "left").withColumn("dangling", F.coalesce("dangling", F.array().cast("array<bigint>")))


def resolved(clips: DataFrame, sentences: DataFrame) -> DataFrame:
    """Clips (video_id, first, last, ..) from which nothing points back before them, as ``first``, as far as MAX_CLIP seconds and MOST_STEPS sentences allow; ``steps`` says how many were taken in.

    Sentences are (video_id, sentence_idx, start_sec, end_sec, back), where one that points back needs the one before it.
    Inside a clip that one is there, so that only a run of such sentences at its start matters: each sentence has the
    MOST_STEPS before it listed, and the run's length follows from a fold over that list.
    """
    w = W.partitionBy("video_id").orderBy("sentence_idx")
    earlier = F.collect_list(F.struct("sentence_idx", F.col("start_sec").cast("double").alias("start_sec"), "back")).over(w.rowsBetween(-MOST_STEPS, -1))
    listed = sentences.select("video_id", F.col("sentence_idx").cast("bigint").alias("first"), F.col("back").alias("_back"), F.reverse(earlier).alias("_earlier"))
    ends = sentences.select("video_id", F.col("sentence_idx").cast("bigint").alias("last"), F.col("end_sec").cast("double").alias("_end"))
    both = clips.join(listed, ["video_id", "first"]).join(ends, ["video_id", "last"])
    state = F.struct(F.col("first").alias("first"), F.col("_back").alias("back"), F.lit(0).cast("bigint").alias("steps"), F.col("_end").alias("until"))

    def step(done: Column, x: Column) -> Column:
        taken = F.struct(x["sentence_idx"].cast("bigint").alias("first"), x["back"].alias("back"), (done["steps"] + 1).alias("steps"), done["until"].alias("until"))
        # one that is not taken in ends the run for good
        return F.when(done["back"] & (done["until"] - x["start_sec"] <= MAX_CLIP), taken).otherwise(F.struct(done["first"].alias("first"), F.lit(False).alias("back"), done["steps"].alias("steps"), done["until"].alias("until")))

    found = both.withColumn("_r", F.aggregate("_earlier", state, step))
    return found.select("video_id", F.col("_r.first").alias("first"), "last", *[c for c in clips.columns if c not in ("video_id", "first", "last")], F.col("_r.steps").alias("steps"))
