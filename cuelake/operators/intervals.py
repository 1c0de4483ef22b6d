"""As-of, nearest and range joins on times, by merged windows or cells instead of comparing all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a cell: what a key's times are salted by, so that no key's whole history is one partition.
CELL = 3600.0
#: Cells that a span may touch before it takes wider ones.
REACH = 8


def as_of(left: DataFrame, at: str, right: DataFrame, key: str, time: str, name: str, forward: bool = False) -> DataFrame:
    """Left rows with the right's last ``time`` at or before their own (first at or after, if forward), as ``name``; null if there is none.

    Both sides are merged in order of time. Keys are cut into cells: within a cell a running maximum gives the answer,
    and what comes from cells before is a maximum over the key's cells, of which there are few.
    """
    cell = F.floor(F.col("_t") / CELL).cast("bigint")
    here = left.withColumn("_id", F.monotonically_increasing_id()) if "_id" not in left.columns else left
    both = here.withColumn("_t", F.col(at)).withColumn("_v", F.lit(None).cast("double")).unionByName(right.select(key, F.col(time).alias("_t"), F.col(time).alias("_v")), allowMissingColumns=True).withColumn("_c", cell)
    # at equal times the right's rows count as seen in both directions
    side = F.when(F.col("_v").isNotNull(), 0).otherwise(1)
    order = [F.col("_t").desc(), side] if forward else [F.col("_t"), side]
    best = F.min if forward else F.max
    inside = W.partitionBy(key, "_c").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    cells = both.groupBy(key, "_c").agg(best("_v").alias("_m"))
    across = W.partitionBy(key).orderBy(F.col("_c").desc() if forward else F.col("_c")).rowsBetween(W.unboundedPreceding, -1)
    carried = cells.select(key, "_c", best("_m").over(across).alias("_before"))
    found = both.withColumn("_own", best("_v").over(inside)).filter("_v IS NULL").join(carried, [key, "_c"])
    return found.withColumn(name, F.coalesce("_own", "_before")).select(*left.columns, name)


def cells_of(start: Column, end: Column, width: float | Column) -> Column:
    """The cells that an interval touches."""
    return F.sequence(F.floor(start / width).cast("bigint"), F.floor(end / width).cast("bigint"))


def range_join(points: DataFrame, at: str, spans: DataFrame, key: str, start: str, end: str, width: float, mixed: bool = False) -> DataFrame:
    """Points with the spans of their key that hold them (start <= at <= end): an equi-join on the key and a cell of time, then the exact test.

    Mixed spans may be many cells long: those of more than REACH are dealt by cells REACH times as wide, or that many
    times again, so that each touches a few, and points once for each width in use. No side is broadcast: the number of cells
    that a small table makes is not in its estimated size.
    """
    lengths = (F.col(end) - F.col(start)) / width
    level = F.greatest(F.lit(0), F.ceil(F.log(lengths) / math.log(REACH)) - 1) if mixed else F.lit(0)
    leveled = spans.withColumn("_level", level.cast("int")).filter(F.col(start) <= F.col(end))
    levels = [r[0] for r in leveled.select("_level").distinct().collect()] if mixed else [0]
    size = F.pow(F.lit(float(REACH)), F.col("_level")) * width
    dealt = leveled.withColumn("_cell", F.explode(cells_of(F.col(start), F.col(end), size)))
    placed = points.withColumn("_level", F.explode(F.lit(levels).cast("array<int>"))).withColumn("_cell", F.floor(F.col(at) / size).cast("bigint"))
    return placed.join(dealt.hint("merge"), [key, "_level", "_cell"]).filter((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop("_cell", "_level")
