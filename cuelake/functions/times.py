"""Times in seconds to and from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on; null stays null."""
    s = F.floor(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60
    return F.when(h > 0, F.concat_ws(":", _two(h), _two(m), _two(r))).when(s.isNotNull(), F.concat_ws(":", _two(m), _two(r)))


def minutes_clock(seconds: Column) -> Column:
    """MM:SS with as many minutes as there are."""
    s = F.floor(seconds).cast("bigint")
    m = F.floor(s / 60).cast("bigint")
    return F.concat_ws(":", F.when(m < 100, _two(m)).otherwise(m.cast("string")), _two(s % 60))


def duration(seconds: Column) -> Column:
    """M:SS, or H:MM:SS with an unpadded hour."""
    s = F.floor(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), _two(m), _two(r))).otherwise(F.concat_ws(":", m.cast("string"), _two(r)))


def hours_minutes(seconds: Column) -> Column:
    """``Xh Ym``."""
    s = F.floor(seconds).cast("bigint")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m"))


def cue_clock(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm as subtitles write it."""
    ms = F.round(seconds * 1000).cast("bigint")
    h, m, s = F.floor(ms / 3_600_000).cast("bigint"), F.floor(ms % 3_600_000 / 60_000).cast("bigint"), F.floor(ms % 60_000 / 1000).cast("bigint")
    return F.concat(F.concat_ws(":", _two(h), _two(m), _two(s)), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))


def parse_cue_clock(text: Column) -> Column:
    """Seconds of MM:SS.mmm or HH:MM:SS,mmm; null if it is neither."""
    parts = F.split(F.regexp_replace(F.trim(text), ",", "."), ":")
    n = F.size(parts)
    number = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    return F.when(n == 3, number(0) * 3600 + number(1) * 60 + number(2)).when(n == 2, number(0) * 60 + number(1))
