"""Exact order statistics without sorting a key's values in one task.

A key of few values is sorted as it is. Of a large one, values are counted in cells between its least and its largest, where
they lie; running sums over the cells tell which of them holds a wanted rank, and that cell alone is looked at again, until
few values or a single one are left in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch

#: Cells of a round, values that one task sorts, and ranks that are broadcast.
CELLS, FEW, MOST_RANKS = 1024, 100_000, 1_000_000


def at_ranks(values: DataFrame, key: str, value: str, ranks: DataFrame, few: int = FEW) -> DataFrame:
    """(key, rank, value): of each key's values in order that at each rank (key, rank; the first is 0); none for a rank that a key doesn't have.

    Null values are left out; a null key is a key; NaN comes last, as in Spark's order. Rounds write what they found, a row a rank.
    """
    kind = dict(values.dtypes)[value]
    rows = values.select(F.col(key).alias("k"), F.col(value).alias("v")).filter("v IS NOT NULL")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    path = scratch.folder(values.sparkSession, "ranks")
    asked = ranks.select(F.col(key).alias("_k"), F.col("rank").cast("bigint").alias("rank")).distinct()
    # of each wanted rank the bounds between which its value lies, how many lie below them, and how many between
    state = scratch.written(sizes.join(asked, sizes["k"].eqNullSafe(asked["_k"])).filter((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))).select("k", "rank", "lo", "hi", F.lit(0).cast("bigint").alias("below"), "n"), f"{path}/0")
    small = F.broadcast if state.limit(MOST_RANKS + 1).count() <= MOST_RANKS else (lambda x: x)
    spans = W.partitionBy("k", "lo", "hi", "below")
    number = 0
    while True:
        number += 1
        open_ = (F.col("n") > few) & (F.col("lo") < F.col("hi"))
        if state.filter(open_).isEmpty():
            break
        mine = _between(rows, state.filter(open_).select("k", "lo", "hi", "below").distinct(), small)
        share = _less("v", "lo", kind) / _less("hi", "lo", kind)
        cell = F.when(F.isnan(share), CELLS - 1).otherwise(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))
        # the least and the largest have cells of their own, so that each round gets on, whatever lies between them
        dealt = mine.withColumn("cell", F.when(F.col("v") == F.col("hi"), CELLS).when(F.col("v") == F.col("lo"), -1).otherwise(cell))
        counted = dealt.groupBy("k", "lo", "hi", "below", "cell").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("c").over(spans.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)) + F.col("below")
        cells = counted.withColumn("until", upto).select(*[F.col(c).alias(f"_{c}") for c in ("k", "lo", "hi", "below")], "c", "least", "most", "until")
        meets = state["k"].eqNullSafe(cells["_k"]) & (state["lo"] == cells["_lo"]) & (state["hi"] == cells["_hi"]) & (state["below"] == cells["_below"])
        found = state.filter(open_).join(cells, meets).filter((F.col("rank") < F.col("until")) & (F.col("rank") >= F.col("until") - F.col("c")))
        narrowed = found.select("k", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("until") - F.col("c")).alias("below"), F.col("c").alias("n"))
        state = scratch.written(state.filter(~open_).unionByName(narrowed), f"{path}/{number}")
    alone = state.filter("lo = hi").select("k", "rank", F.col("lo").alias("v"))
    rest = state.filter("lo < hi")
    placed = _between(rows, rest.select("k", "lo", "hi", "below").distinct(), small).withColumn("rank", F.row_number().over(spans.orderBy("v")) - 1 + F.col("below"))
    wanted = small(rest.select(F.col("k").alias("_k"), F.col("rank").alias("_rank")))
    picked = placed.join(wanted, F.col("k").eqNullSafe(F.col("_k")) & (F.col("rank") == F.col("_rank")), "left_semi").select("k", "rank", "v")
    return alone.unionByName(picked).select(F.col("k").alias(key), "rank", F.col("v").alias(value))


def _less(a: str, b: str, kind: str) -> Column:
    """The difference of two values as a double; whole numbers are taken from each other exactly, and halves where that of large ones would overflow."""
    x, y = F.col(a), F.col(b)
    if kind not in ("float", "double"):
        return (x.cast("decimal(38,0)") - y.cast("decimal(38,0)")).cast("double") if kind in ("tinyint", "smallint", "int", "bigint") else x.cast("double") - y.cast("double")
    x, y = x.cast("double"), y.cast("double")
    large = F.greatest(F.abs(F.col("hi")), F.abs(F.col("lo"))) > 1e300
    return F.when(large, x / 2 - y / 2).otherwise(x - y)


def _between(rows: DataFrame, spans: DataFrame, small) -> DataFrame:
    """Values with the bounds (k, lo, hi, below) of their key that hold them."""
    of = small(spans.withColumnRenamed("k", "_k"))
    return rows.join(of, F.col("k").eqNullSafe(F.col("_k")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("_k")


def nearest_rank(values: DataFrame, key: str, value: str, percents: list[int], few: int = FEW) -> DataFrame:
    """(key, percent, value): the value at place round(percent / 100 * (n - 1)), halves to even, of each key's sorted values."""
    n = values.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    if n.filter(F.col("_n") > few).isEmpty():  # each key is one that a task sorts
        w = W.partitionBy(key)
        sorted_ = values.filter(F.col(value).isNotNull()).select(key, value, (F.row_number().over(w.orderBy(value)) - 1).alias("_p"), F.count("*").over(w).alias("_n"))
        at = F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.bround(F.lit(p / 100.0) * (F.col("_n") - 1)).cast("bigint").alias("rank")) for p in percents]))
        return sorted_.withColumn("_w", at).filter(F.col("_p") == F.col("_w.rank")).select(key, F.col("_w.percent").alias("percent"), value)
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.bround(F.lit(p / 100.0) * (F.col("_n") - 1)).cast("bigint").alias("rank")) for p in percents])).alias("w")
    asked = n.select(key, wanted).select(key, "w.percent", "w.rank")
    found = at_ranks(values, key, value, asked, few).withColumnRenamed(key, "_k").withColumnRenamed("rank", "_rank")
    return asked.join(found, asked[key].eqNullSafe(found["_k"]) & (asked["rank"] == found["_rank"])).select(key, "percent", value)


def percentiles(values: DataFrame, key: str, value: str, shares: dict[str, float], few: int = FEW) -> DataFrame:
    """(key, a column for each name): the values at shares of each key's sorted ones, between two of them in proportion; as F.percentile gives them."""
    n = values.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    if n.filter(F.col("_n") > few).isEmpty():
        return values.filter(F.col(value).isNotNull()).groupBy(key).agg(*[F.percentile(value, s).alias(name) for name, s in shares.items()])
    place = lambda s: F.lit(float(s)) * (F.col("_n") - 1)
    sides = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank"), (1 - F.abs(place(s) - rank)).alias("part")) for name, s in shares.items() for rank in (F.floor(place(s)), F.ceil(place(s)))])).alias("w")
    asked = n.select(key, sides).select(key, "w.*").distinct()  # both sides are one where a share falls on a value
    found = at_ranks(values, key, value, asked, few).withColumnRenamed(key, "_k").withColumnRenamed("rank", "_rank")
    each = asked.join(found, asked[key].eqNullSafe(found["_k"]) & (asked["rank"] == found["_rank"]))
    of = lambda name: F.sum(F.when(F.col("name") == name, F.col(value).cast("double") * F.col("part"))).alias(name)
    return each.groupBy(key).agg(*map(of, shares))


def of_groups(rows: DataFrame, groups: dict[str, Column], value: Column) -> DataFrame:
    """(k, v): the value of each row once for each group, by name, whose condition holds."""
    each = F.array(*[F.when(where, F.lit(name)) for name, where in groups.items()])
    return rows.select(value.alias("v"), F.explode(F.filter(each, lambda g: g.isNotNull())).alias("k"))
