"""Loudness and pitch of speech, and what they do within a clip."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import clamp01, normalise, semitones
from .intervals import range_join

RATE, FRAME, HOP = 16_000, 1024, 512
LOWEST, HIGHEST = 60.0, 400.0
VOICING, SILENCE = 0.45, 0.02
LEAST_VOICED, MEDIAN, BATCH = 30, 5, 8192
#: Frames that are given back at a time; seconds of a cell by which words meet clips.
FRAMES, CELL = 65_536, 3600.0
ACOUSTIC = {"pitch_range": 0.40, "energy_delta": 0.30, "pitch_delta": 0.15, "rate_delta": 0.15}


def contour(pcm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rms, f0) of each frame; f0 is 0 where there is no voice. Frames go through the FFT in batches, which bounds memory."""
    pcm = np.asarray(pcm, np.float32)
    if len(pcm) < FRAME:
        return np.empty(0, np.float32), np.empty(0, np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME)[::HOP]
    rms = np.sqrt(np.mean(frames.astype(np.float64) ** 2, axis=1))
    low, high = int(RATE / HIGHEST), int(RATE / LOWEST)
    f0 = np.zeros(len(frames))
    for at in range(0, len(frames), BATCH):
        part = frames[at : at + BATCH] - frames[at : at + BATCH].mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(part, 2 * FRAME, axis=1)) ** 2
        same = np.fft.irfft(power, axis=1)[:, : high + 2]
        near = same / np.maximum(same[:, :1], 1e-10)
        lag = low + np.argmax(near[:, low : high + 1], axis=1)
        rows = np.arange(len(part))
        peak = near[rows, lag]
        inside = (lag > low) & (lag < high) & (peak > near[rows, lag - 1]) & (peak > near[rows, lag + 1])
        f0[at : at + BATCH] = np.where(inside & (peak >= VOICING) & (same[:, 0] > 1e-10), RATE / lag, 0)
    f0[rms <= SILENCE * max(rms.max(), 1e-10)] = 0
    return rms.astype(np.float32), smoothed(f0).astype(np.float32)


def smoothed(f0: np.ndarray) -> np.ndarray:
    """The voiced track through a median of MEDIAN frames, gaps bridged in a line and zeros beyond the ends; too few voiced frames stay as they are."""
    voiced = np.flatnonzero(f0 > 0)
    if len(voiced) < MEDIAN:
        return f0
    bridged = np.pad(np.interp(np.arange(len(f0)), voiced, f0[voiced]), MEDIAN // 2)
    return np.where(f0 > 0, np.median(np.lib.stride_tricks.sliding_window_view(bridged, MEDIAN), axis=1), 0)


def frames(signals: DataFrame, key: str = "video_id", pcm: str = "pcm") -> DataFrame:
    """(key, frame, rms, f0) from (key, array of samples)."""
    kind = dict(signals.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, x in zip(pdf[key], pdf[pcm], strict=True):
                rms, f0 = contour(x)
                for at in range(0, len(rms), FRAMES):
                    part = slice(at, at + FRAMES)
                    yield pd.DataFrame({key: k, "frame": np.arange(len(rms))[part], "rms": rms[part], "f0": f0[part]})

    return signals.select(key, pcm).mapInPandas(run, f"{key} {kind}, frame bigint, rms float, f0 float")


def clip_features(found: DataFrame, clips: DataFrame, key: str = "video_id", clip: str = "clip_id") -> DataFrame:
    """(clip, pitch_reliable, pitch_range_st, pitch_delta_st, energy_delta, energy_mean, voiced_fraction) of (key, clip, start_sec, end_sec); clips of fewer than four frames have no row: not measured.

    Only frames of the clips are joined: clips are exploded to frame numbers, an equi-join.
    """
    base = found.groupBy(key).agg(F.percentile(F.when(F.col("f0") > 0, F.col("f0")), 0.5).alias("base"), F.max("rms").alias("top"), (F.max("frame") + 1).alias("n"))
    hop = HOP / RATE
    first, last = F.greatest(F.lit(0), F.floor(F.col("start_sec") / hop)), F.least(F.col("n"), F.floor(F.col("end_sec") / hop) + 1)
    spans = clips.join(base, key).select(key, clip, "base", "top", first.alias("lo"), last.alias("hi")).filter("hi - lo >= 4")
    inside = spans.withColumn("frame", F.explode(F.sequence("lo", F.col("hi") - 1))).join(found, [key, "frame"])
    half = F.col("frame") < F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)
    st = semitones(F.col("f0"), F.col("base"))
    of = lambda f, c, when: f(F.when(when, c))
    middle = lambda when: F.percentile(F.when(when, F.col("st")), 0.5)
    g = inside.withColumn("st", F.when(F.col("f0") > 0, st)).groupBy(clip).agg(
        (F.count("st") >= LEAST_VOICED).alias("pitch_reliable"), (F.percentile("st", 0.9) - F.percentile("st", 0.1)).alias("r"), (middle(~half) - middle(half)).alias("d"),
        of(F.avg, F.col("rms"), half).alias("a"), of(F.avg, F.col("rms"), ~half).alias("b"), (F.avg("rms") / F.max("top")).alias("energy_mean"), F.avg((F.col("f0") > 0).cast("double")).alias("voiced_fraction"))
    sure = lambda c: F.when(F.col("pitch_reliable"), F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
    return g.select(clip, "pitch_reliable", sure("r").alias("pitch_range_st"), sure("d").alias("pitch_delta_st"), (F.abs(F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-10))).alias("energy_delta"), "energy_mean", "voiced_fraction")


def acoustic(rate_delta: Column, energy_delta: Column, pitch_range: Column, pitch_delta: Column) -> Column:
    """The weighted mean of the terms that were measured (not null), null if none was."""
    terms = {"rate_delta": rate_delta, "energy_delta": normalise(energy_delta, 0.01, 0.39), "pitch_range": normalise(pitch_range, 5.26, 23.25), "pitch_delta": normalise(F.abs(pitch_delta), 0.12, 8.84)}
    known = {k: F.when({"rate_delta": rate_delta, "energy_delta": energy_delta, "pitch_range": pitch_range, "pitch_delta": pitch_delta}[k].isNotNull(), F.lit(w)).otherwise(0.0) for k, w in ACOUSTIC.items()}
    total = sum(known.values(), F.lit(0.0))
    return F.when(total > 0, clamp01(sum((F.coalesce(terms[k], F.lit(0.0)) * known[k] for k in ACOUSTIC), F.lit(0.0)) / total))


def emotional_delta(arc: Column, measured: Column) -> Column:
    """35 % of whether the beats' arc moves, 65 % of what was measured; without a measurement the arc's part, or 0.3."""
    moved = F.when(arc, 1.0).otherwise(0.0)
    return F.when(measured.isNull(), F.when(arc, 0.35).otherwise(0.3)).otherwise(clamp01(0.35 * moved + 0.65 * measured))


def rate_delta(words: DataFrame, clips: DataFrame, key: str = "video_id", clip: str = "clip_id") -> DataFrame:
    """(clip, rate_delta): how much the rate of words changes between a clip's halves; no row of fewer than four words."""
    inside = range_join(words, "start", clips.select(key, clip, "start_sec", "end_sec"), key, "start_sec", "end_sec", CELL, mixed=True)
    w = W.partitionBy(clip)
    placed = inside.withColumn("p", F.row_number().over(w.orderBy("start", "end")) - 1).withColumn("n", F.count("*").over(w)).filter("n >= 4").withColumn("h", F.floor(F.col("n") / 2))
    g = placed.groupBy(clip, "n", "h").agg(F.min("start").alias("first"), F.min(F.when(F.col("p") == F.col("h"), F.col("start"))).alias("mid"), F.max(F.when(F.col("p") == F.col("n") - 1, F.col("end"))).alias("last"))
    pace = lambda c, a, b: c / (F.greatest(b - a, F.lit(0.01)) / 60)
    two = g.select(clip, pace(F.col("h"), F.col("first"), F.col("mid")).alias("x"), pace(F.col("n") - F.col("h"), F.col("mid"), F.col("last")).alias("y"))
    return two.select(clip, clamp01(F.abs(F.col("y") - F.col("x")) / F.greatest("x", "y", F.lit(1.0))).alias("rate_delta"))
