"""Gates, caps, suppression and diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DISPLAY_FLOOR, RELATIVE_FLOOR, PER_VIDEO = 0.10, 0.35, 2
OVERLAP = 0.5
DOMINANCE, MOMENTS = 0.6, 15
MMR_LAMBDA = 0.85


def cap(df: DataFrame, key: str | list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key in the order."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def display_gates(scored: DataFrame, video: str, ties: list[str], floor: float | None = DISPLAY_FLOOR, per: list[str] | None = None) -> DataFrame:
    """What is worth showing of scored candidates: at least the floor, at least a share of the best score (of each query's, by ``per``), then so many a video.

    The best score is an aggregate joined back, not a window over all rows.
    """
    kept = scored.filter(F.col("score") >= floor) if floor is not None else scored
    if per:
        best = kept.groupBy(*per).agg(F.max("score").alias("_top"))
        kept = kept.join(best, per)
    else:
        kept = kept.join(F.broadcast(kept.agg(F.max("score").alias("_top"))))
    near = kept.filter((F.col("_top") <= 0) | (F.col("score") >= F.col("_top") * RELATIVE_FLOOR)).drop("_top")
    return cap(near, [*(per or []), video], [F.desc("score"), *ties], PER_VIDEO)


def suppress_overlapping(scored: DataFrame, group: list[str], item: str, start: str = "start_sec", end: str = "end_sec", threshold: float = OVERLAP) -> DataFrame:
    """Greedy suppression within each group: from the best score on, a row goes if it shares at least ``threshold`` of the shorter's length with a kept one.

    A fold over each group's sorted candidates; meant behind a top-k, which bounds the group.
    """
    row = F.struct((-F.col("score")).alias("o"), F.col(item).alias("item"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"))
    kind = "array<struct<o:double,item:bigint,s:double,e:double>>"

    def step(kept: Column, x: Column) -> Column:
        def clash(k: Column) -> Column:
            short = F.least(k["e"] - k["s"], x["e"] - x["s"])
            return (short > 0) & ((F.least(k["e"], x["e"]) - F.greatest(k["s"], x["s"])) / short >= threshold)

        return F.when(F.exists(kept, clash), kept).otherwise(F.concat(kept, F.array(x)))

    folded = scored.groupBy(*group).agg(F.aggregate(F.array_sort(F.collect_list(row)).cast(kind), F.array().cast(kind), step).alias("kept"))
    return folded.select(*group, F.explode("kept").alias("k")).select(*group, F.col("k.item").alias(item), (-F.col("k.o")).alias("score"), F.col("k.s").alias(start), F.col("k.e").alias(end))


def limit_dominance(moments: DataFrame, group: list[str], kind: str, order: list[Column], share: float = DOMINANCE, most: int = MOMENTS) -> DataFrame:
    """At most max(1, int(share * n)) moments of the commonest kind in each group, if it has more than that share; then the first ``most`` in order."""
    sizes = moments.groupBy(*group, kind).agg(F.count("*").alias("c"))
    totals = sizes.groupBy(*group).agg(F.sum("c").alias("n"), F.max(F.struct("c", F.col(kind).alias("k"))).alias("top"))
    placed = moments.withColumn("_p", F.row_number().over(W.partitionBy(*group, kind).orderBy(*order))).join(totals, group)
    over = (F.col(kind) == F.col("top.k")) & (F.col("top.c") > F.col("n") * share) & (F.col("_p") > F.greatest(F.lit(1), F.floor(F.col("n") * share)))
    return cap(placed.filter(~over).drop("_p", "n", "top"), group, order, most)


def diversify(candidates: DataFrame, group: str, item: str, most: int, weight: float = MMR_LAMBDA) -> DataFrame:
    """Greedy maximal marginal relevance within each group over (item, composite, vector): (group, item, place, max_similarity).

    The best composite goes first; then the largest weight * composite - (1 - weight) * nearest similarity, ties to the
    better composite, then the smaller item. Each choice depends on those before: Arrow-batched code over a group, which is one video's candidates.
    """
    import numpy as np
    import pandas as pd

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["composite", item], ascending=[False, True], kind="stable").reset_index(drop=True)
        vectors = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        composite, near = pdf["composite"].to_numpy(), np.full(len(pdf), -np.inf)
        chosen, seen = [0], [0.0]
        while len(chosen) < min(most, len(pdf)):
            near = np.maximum(near, vectors @ vectors[chosen[-1]])
            value = weight * composite - (1 - weight) * near
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
            seen.append(float(near[chosen[-1]]))
        out = pdf.loc[chosen, [group, item]].assign(place=range(len(chosen)), max_similarity=np.round(seen, 4))
        return out.astype({"place": "int64"})

    kinds = dict(candidates.dtypes)
    return candidates.groupBy(group).applyInPandas(choose, f"{group} {kinds[group]}, {item} {kinds[item]}, place bigint, max_similarity double")
