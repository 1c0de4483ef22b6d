"""Tables after appends, upserts, deletes and retention. Nothing is changed in place: the result is written as the next version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows and the new ones whose key is new."""
    return old.unionByName(new.join(old.select(keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """For each key the row with the largest version, ties by the other columns; combined before the shuffle."""
    rest = [c for c in old.columns if c not in keys and c not in version]
    row = F.struct(*version, *rest)
    return old.unionByName(new).groupBy(*keys).agg(F.max(row).alias("_r")).select(*keys, "_r.*")


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone, keys, "left_anti")


def replace(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the new rows' keys replaced by them."""
    return rows.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


def update(rows: DataFrame, where, **values) -> DataFrame:
    """Columns set where the condition holds; a null condition changes nothing."""
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def retain_newest(old: DataFrame, new: DataFrame, order: list[str], most: int) -> DataFrame:
    """The newest rows of both: a top-k of each partition before they meet."""
    return old.unionByName(new).orderBy(*[F.desc(c) for c in order]).limit(most)


#: What is known of a sentence's picture, each better than those before; null is never tried.
VISUAL = ("failed", "video-level", "ok")


def raised(old: DataFrame, new: DataFrame, keys: list[str], status: str, levels: tuple[str, ...] = VISUAL) -> DataFrame:
    """For each key the row of the best state, of equal ones that with the larger other columns: no write lowers a state, and writes that are repeated or come in another order give the same table.

    States that aren't known are below all. Rows are combined before the shuffle.
    """
    level = F.array_position(F.array(*map(F.lit, levels)), F.col(status))
    rest = [c for c in old.columns if c not in keys]
    row = F.struct(F.coalesce(level, F.lit(0)).alias("_level"), *rest)
    return old.unionByName(new.select(old.columns)).groupBy(*keys).agg(F.max(row).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) if c in rest else c for c in old.columns])


def to_retry(rows: DataFrame, media: DataFrame, key: str, status: str, gave_up: str) -> DataFrame:
    """Rows whose picture is to be tried: those never tried, and those with a picture of the whole video alone where there is a medium by the key, unless that was given up. What failed for good, or is ok, stays."""
    there = media.select(key, F.lit(True).alias("_media")).distinct()
    better = (F.col(status) == "video-level") & F.coalesce("_media", F.lit(False)) & ~F.coalesce(gave_up, F.lit(False))
    return rows.join(there, key, "left").filter(F.col(status).isNull() | better).drop("_media")


def fail_interrupted(jobs: DataFrame, why: str) -> DataFrame:
    """Running and queued jobs as failed, with the reason."""
    cut = F.col("status").isin("running", "queued")
    return jobs.withColumn("error", F.when(cut, why)).withColumn("status", F.when(cut, "failed").otherwise(F.col("status")))


def over_defaults(stored: DataFrame, defaults: dict) -> DataFrame:
    """Stored settings, and the default where one is null."""
    return stored.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
