"""Search from rankings to what is shown: fusion with its fallbacks, the sentences around, gates and near misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch
from . import ranking, retrieval, sequences

# Least scores of relevant and of strong results, of a reranker and of pictures.
RELEVANT, STRONG, VISUAL_RELEVANT, VISUAL_STRONG = 0.08, 0.35, 0.20, 0.28
NEAR_MISSES = 3
#: What texts of scenes without speech begin with.
SCENE = "[Visual Scene"


def fused(lexical: DataFrame | None, dense: DataFrame | None, query: str, keys: list[str], most: int = retrieval.POOL) -> DataFrame | None:
    """(query, keys, score, rank): each query's best by reciprocal ranks of both rankings, or by the score of the one that there is; None without any.

    Every rank counts, however late. A query's first ``most`` of one ranking have 1 / (K + most) at least, so that who is
    beyond rank 2 * (K + most) - K in both can't be among its best: the others are ranked exactly by ``ranks_of``.
    """
    there = [x.withColumn("score", F.round("score", 8)) for x in (dense, lexical) if x is not None]
    if not there:
        return None
    both = there[0]
    if len(there) == 2:
        reach = 2 * (retrieval.RECIPROCAL + most) - retrieval.RECIPROCAL
        first = [retrieval.top(x, query, keys, reach + 1).select(query, *keys, "rank", F.lit(k).alias("_side")) for k, x in enumerate(there)]
        tops = scratch.written(first[0].unionByName(first[1]), scratch.folder(first[0].sparkSession, "tops"))
        known = tops.filter(F.col("rank") <= reach).select(query, *keys).distinct()
        # a ranking that ends before has shown all its ranks
        longer = {r[0] for r in tops.filter(F.col("rank") > reach).select("_side").distinct().collect()}
        ranks = [retrieval.ranks_of(known, x, query, keys, 2 * reach) if k in longer else tops.filter(F.col("_side") == k).drop("_side") for k, x in enumerate(there)]
        both = retrieval.fuse(ranks, query, keys)
    return retrieval.top(both.withColumn("score", F.round("score", 8)), query, keys, most)


def spans(chunks: DataFrame) -> DataFrame:
    """Each sentence's range with its neighbours: (video_id, sentence_idx, first, last, start_sec, end_sec)."""
    w = W.partitionBy("video_id").orderBy("sentence_idx")
    around = lambda f, c: F.coalesce(f(c).over(w), F.col(c)).alias
    return chunks.select("video_id", "sentence_idx", around(F.lag, "sentence_idx")("first"), around(F.lead, "sentence_idx")("last"), around(F.lag, "start_sec")("start_sec"), around(F.lead, "end_sec")("end_sec"))


def merged(pool: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """(query, video_id, first, last, start_sec, end_sec, score, text): the pool's sentences with those around, adjacent ones of a video as one while it stays short."""
    wide = pool.select(query, "video_id", "sentence_idx", "score").join(spans(chunks), ["video_id", "sentence_idx"])
    found = sequences.islands(wide, [query, "video_id"])
    each = found.withColumn("sentence_idx", F.explode(F.sequence("first", "last")))
    said = each.join(chunks.select("video_id", F.col("sentence_idx").cast("bigint").alias("sentence_idx"), "text"), ["video_id", "sentence_idx"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_idx", "text"))), lambda x: x["text"]), " ")
    return said.groupBy(found.columns).agg(text.alias("text"))


def decide(candidates: DataFrame, query: str, most: int, scored: bool = True, relevant: float = RELEVANT, strong: float = STRONG, floor: float | None = ranking.DISPLAY_FLOOR) -> DataFrame:
    """(query, kind, place, video_id, first, score, start_sec, end_sec, confidence) of candidates (query, video_id, first, start_sec, end_sec, score).

    Results are the best of those that are relevant, don't overlap better ones and pass the display gates. A query
    without results has near misses instead: its best relevant candidates, or if none is relevant its best of all.
    Scores that no gate is calibrated for (``scored`` false) give unranked results alone.
    """
    kept = ranking.suppress_overlapping(candidates, [query, "video_id"], "first")  # a better row is never suppressed by a worse one: the relevant of these are those that relevant rows alone would leave
    mine, score = W.partitionBy(query), F.col("score")
    at = mine.orderBy(F.desc("score"), "video_id", "first")
    if not scored:
        return kept.select(query, F.lit("result").alias("kind"), F.row_number().over(at).alias("place"), "video_id", "first", "score", "start_sec", "end_sec", F.lit("unranked").alias("confidence")).filter(F.col("place") <= most)
    good = score >= relevant
    passed = good & (score >= floor) if floor is not None else good
    top = kept.withColumn("_good", good).withColumn("_passed", passed).withColumn("_top", F.max(F.when(passed, score)).over(mine))
    near = top.withColumn("_near", F.col("_passed") & ((F.col("_top") <= 0) | (score >= F.col("_top") * ranking.RELATIVE_FLOOR)))
    nth = F.row_number().over(W.partitionBy(query, "video_id", "_near").orderBy(F.desc("score"), "first"))
    capped = near.withColumn("_shown", F.col("_near") & (nth <= ranking.PER_VIDEO))
    any_ = lambda c: F.max(F.col(c).cast("int")).over(mine) == 1
    judged = capped.withColumn("_results", any_("_shown")).withColumn("_relevant", any_("_good"))
    picked = judged.filter(F.when(F.col("_results"), F.col("_shown")).when(F.col("_relevant"), F.col("_good")).otherwise(True)).withColumn("place", F.row_number().over(at))
    few = picked.filter(F.col("place") <= F.when(F.col("_results"), most).otherwise(NEAR_MISSES))
    kind = F.when(F.col("_results"), "result").otherwise("near_miss")
    confidence = F.when(~F.col("_results"), "weak").when(score >= strong, "strong").otherwise("possible")
    return few.select(query, kind.alias("kind"), "place", "video_id", "first", "score", "start_sec", "end_sec", confidence.alias("confidence"))


def reason(topic: Column, concepts: Column, visual: bool = False) -> Column:
    """Why a result matched, by its concepts or its topic."""
    if visual:
        return F.concat(F.lit("Matched visual scene frame for '"), topic, F.lit("'"))
    first, second = F.get(concepts, 0), F.get(concepts, 1)
    return F.when(second.isNotNull(), F.concat(F.lit("Matched: "), first, F.lit(" & "), second)).when(first.isNotNull(), F.concat(F.lit("Matched: "), first)).otherwise(F.concat(F.lit("Matched topic: "), topic))
