"""Scores, vectors and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalise(x: Column, floor: float, ceil: float) -> Column:
    """Where x stands between floor and ceil, 0 if they leave no room."""
    return clamp01((x - floor) / (ceil - floor)) if ceil > floor else F.lit(0.0)


def sigmoid(x: Column) -> Column:
    return F.round(1 / (1 + F.exp(-x)), 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def rank_share(rank: Column, k: int = 60) -> Column:
    """One ranker's share in a reciprocal rank fusion."""
    return 1 / (rank + k)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The length that two intervals share, negative if they are apart."""
    return F.least(a1, b1) - F.greatest(a0, b0)


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared over covered length of two intervals, 0 if they are apart."""
    shared = F.greatest(overlap(a0, a1, b0, b1).cast("double"), F.lit(0.0))
    covered = (a1 - a0) + (b1 - b0) - shared
    return F.when(covered > 0, shared / covered).otherwise(0.0)


def pause_score(gap: Column, target: float = 0.6) -> Column:
    """How much of a full pause a gap is; no adjacent speech (null) is a perfect boundary."""
    return F.when(gap.isNull(), 1.0).otherwise(clamp01(gap / target))


def semitones(f: Column, base: Column) -> Column:
    return F.when((f > 0) & (base > 0), 12 * F.log2(f / base))


def saturation(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(high > 0, (high - low) / high).otherwise(0.0)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(x.cast("bigint")), 2, "0")) for x in (r, g, b)])
