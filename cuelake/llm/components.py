"""Connected components of links between ids: by alternating large and small stars, or by union-find where the links are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Each round shortens the longest path by a constant factor, so that this many always do; more would mean a bug.
MOST_ROUNDS = 64
#: Up to so many links one task finds the components (16 MB of ids); more go through the rounds, with the same result.
FEW = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, root) of all ids in the links."""
    parts = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) for b in batches]
    links = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
    ids, at = np.unique(links, return_inverse=True)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in at.reshape(-1, 2).tolist():
        low, high = sorted((find(a), find(b)))
        parent[high] = low  # places go by id, so that a root is its component's smallest
    roots = ids[np.array([find(x) for x in range(len(ids))], np.int64)]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], names=["u", "root"])


def components(links: DataFrame) -> DataFrame:
    """(u, root) of every id in the links (u, v), the root being the smallest id that it reaches.

    Links may go either way and repeat; ids linked to themselves or nothing else don't matter. Minima are combined
    before the shuffle and the joins hold no group in one task, so a star with most of the links is no hot spot.
    """
    edges = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.count() <= FEW:
        return edges.coalesce(1).mapInArrow(_union_find, "u bigint, root bigint")
    for _ in range(MOST_ROUNDS):
        ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if ends.groupBy("u").agg(F.sum("out").alias("o"), F.max("into").alias("i")).filter("o > 1 OR o = 1 AND i = 1").isEmpty():
            break
        edges = cut(_small_star(_large_star(edges)))
    else:
        raise RuntimeError("the components did not settle")
    return edges.select("u", F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
