"""Captions: cues of words, and what is on screen at each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import range_join
from .sequences import groups_of


def cues(words: DataFrame, most: int, upper: bool = False, key: str = "video_id") -> DataFrame:
    """(key, cue, start, end, text): consecutive groups of words."""
    w = groups_of(words.withColumn("_at", F.struct("start", "pos")), key, "_at", most)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "pos", "word"))), lambda x: x["word"]), " ")
    return w.groupBy(key, "cue").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.upper(said) if upper else said).alias("text"))


def frame_states(found: DataFrame, ticks: DataFrame, key: str = "video_id", width: float = 10.0) -> DataFrame:
    """(key, at, cue, changed): the first cue on screen at each tick (null: none), and whether that differs from the tick before, where alone a frame is drawn anew."""
    shown = range_join(ticks.select(key, "at"), "at", found.select(key, "cue", "start", "end"), key, "start", "end", width).groupBy(key, "at").agg(F.min("cue").alias("cue"))
    state = ticks.select(key, "at").join(shown, [key, "at"], "left")
    before = F.lag("cue").over(W.partitionBy(key).orderBy("at"))
    first = F.row_number().over(W.partitionBy(key).orderBy("at")) == 1
    return state.withColumn("changed", first | ~F.col("cue").eqNullSafe(before))


# Sizes of captions as shares of the picture's height, and how they shrink.
SIZES = {"small": 0.032, "medium": 0.045, "large": 0.062}
LEAST_FONT, SMALLEST_FONT, SHRINK, SHRINKS, WIDEST = 18, 14, 0.9, 8, 0.92


def layout(text: Column, width: int, height: int, size: str = "medium", position: str = "bottom-center", margins: tuple[float, float] = (0.12, 0.18), advance: float = 0.5) -> Column:
    """A struct (font, text_width, x, y) of a caption's line: its font shrinks step by step while the line is wider than the
    picture allows. A letter is ``advance`` times the font wide; margins are the top's and the bottom's shares of the height."""
    letters = F.length(text) * advance
    fits = lambda font: letters * font <= width * WIDEST
    smaller = lambda font: F.greatest(F.lit(SMALLEST_FONT), F.floor(font * SHRINK).cast("int"))
    start = F.lit(max(LEAST_FONT, int(height * SIZES.get(size, SIZES["medium"]))))
    font = F.aggregate(F.sequence(F.lit(1), F.lit(SHRINKS)), start, lambda f, _: F.when(fits(f) | (f <= SMALLEST_FONT), f).otherwise(smaller(f)))
    y = {"bottom-center": int(height * (1 - margins[1])), "top-center": int(height * margins[0])}.get(position, int(height * 0.5))
    wide = F.floor(letters * font).cast("int")
    return F.struct(font.alias("font"), wide.alias("text_width"), F.greatest(F.lit(0), F.floor((width - wide) / 2).cast("int")).alias("x"), F.lit(y).alias("y"))
