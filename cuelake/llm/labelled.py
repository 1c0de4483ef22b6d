"""The bounded, deterministic sample of labelled documents that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most, and characters of their texts at most.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 24_000_000


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 1 modulo 3."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, target: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of labelled rows that aren't held out, the first by a hash of the id within both bounds, sorted by that hash.

    Ids with several labels take the largest, rows without a label or id are left out, a null text counts as empty. A text
    (with its repeated rows) that is longer than what is left of the bound is passed over for later ones; if every one is, there
    is nothing to learn from and a ValueError says so. The ids are bounded before the join, so what is broadcast and collected has a fixed bound.
    """
    by_id = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(target).cast("int").alias("_label"))
    ids = by_id.withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(rows)
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(ids), "doc_id")
    sizes = slim.groupBy("_order", "doc_id").agg(F.sum(F.length("_text")).alias("n")).orderBy("_order", "doc_id").collect()
    taken, total = [], 0
    for r in sizes:
        if total + r["n"] <= chars:
            taken.append((r["doc_id"],))
            total += r["n"]
    if not taken:
        if sizes:
            raise ValueError(f"each of {len(sizes)} labelled texts is longer than {chars} characters")
        return []
    kept = docs.sparkSession.createDataFrame(taken, docs.select("doc_id").schema)
    found = slim.join(F.broadcast(kept), "doc_id").select("_order", "doc_id", "_text", "_label").collect()
    return [(r["doc_id"], r["_text"], r["_label"]) for r in sorted(found, key=lambda r: (r["_order"], r["doc_id"], r["_text"]))]
