"""Transcripts from timed text, plain text and silence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import clock, parse_cue_clock

CHUNK_WORDS = 120
SCENE_SECONDS = 15
_TAG = "<[^>]+>"


def timed_text(files: DataFrame, key: str = "video_id", raw: str = "raw") -> DataFrame:
    """(key, pos, start, end, text) of the cues in SRT or WebVTT files, one file a row.

    Byte-order marks and CRLF go, NOTE blocks and cue numbers are skipped, tags are stripped, cues left without text are
    dropped, and of consecutive cues with equal text the first stays. Cues go by start time.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(raw), "^﻿", ""), "\r\n?", "\n")
    blocks = files.select(key, F.posexplode(F.split(clean, r"\n[ \t]*\n+")).alias("block", "body"))
    cue = F.regexp_extract("body", r"(?m)^[ \t]*([0-9:.,]+)[ \t]*-->[ \t]*([0-9:.,]+)[^\n]*$", 0)
    start, end = (F.regexp_extract("body", r"(?m)^[ \t]*([0-9:.,]+)[ \t]*-->[ \t]*([0-9:.,]+)[^\n]*$", k) for k in (1, 2))
    said = F.trim(F.regexp_replace(F.regexp_replace(F.split_part(F.col("body"), F.col("cue"), F.lit(2)), _TAG, ""), r"\s+", " "))
    timed = blocks.filter(~F.col("body").rlike(r"^\s*NOTE\b")).withColumn("cue", cue).filter("cue <> ''")
    cues = timed.select(key, "block", parse_cue_clock(start).alias("start"), parse_cue_clock(end).alias("end"), said.alias("text")).filter("text <> '' AND start IS NOT NULL AND end IS NOT NULL")
    order = W.partitionBy(key).orderBy("start", "block")
    kept = cues.withColumn("before", F.lag("text").over(order)).filter("before IS NULL OR before <> text")
    return kept.withColumn("pos", (F.row_number().over(order) - 1).cast("bigint")).select(key, "pos", "start", "end", "text")


def plain_chunks(docs: DataFrame, key: str, text: str = "text", words: int = CHUNK_WORDS) -> DataFrame:
    """(key, pos, text, start, end): untimed chunks of so many words; the times are null, not zero."""
    said = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1, F.lit(words)))
    split = docs.select(key, said.alias("w")).select(key, "w", F.posexplode(starts).alias("pos", "at"))
    none = F.lit(None).cast("double")
    return split.select(key, F.col("pos").cast("bigint").alias("pos"), F.array_join(F.slice("w", F.col("at") + 1, words), " ").alias("text"), none.alias("start"), none.alias("end"))


def silent_scenes(videos: DataFrame, key: str, seconds: str, step: int = SCENE_SECONDS) -> DataFrame:
    """(key, start, end, text): what stands for the sentences of a video without speech, a scene each so many seconds."""
    starts = F.when(F.col(seconds) > 0, F.sequence(F.lit(0).cast("bigint"), (F.col(seconds) - 1).cast("bigint"), F.lit(step).cast("bigint")))
    rows = videos.select(key, seconds, F.explode(starts).alias("start")).withColumn("end", F.least(F.col("start") + step, F.col(seconds).cast("bigint")))
    return rows.select(key, "start", "end", F.concat(F.lit("[Visual Scene "), clock(F.col("start")), F.lit(" - "), clock(F.col("end")), F.lit("]")).alias("text"))
