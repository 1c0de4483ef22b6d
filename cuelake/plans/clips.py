"""Clip selection: segments, beats, candidates, bounds and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, texts
from ..operators import retrieval, selection, solver
from ..operators.intervals import as_of
from ..sources.library import SENTENCES_SQL, WORDS_SQL, sentences, table, words
from .aggregates import TERMS_SQL
from .registry import query


@query("n01_topic_segments")
def topics(spark, sf_dir):
    """Topic segments of each label's vectors in order."""
    return selection.topic_segments(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query("n05_heuristic_beats", """SELECT video_id, 'hook' AS beat_type, min(sentence_idx) AS first, min(sentence_idx) AS last, CAST(NULL AS BIGINT) AS needs FROM sent GROUP BY 1
UNION ALL SELECT video_id, 'payoff', sentence_idx, after, sentence_idx FROM (SELECT *, lead(sentence_idx) OVER (PARTITION BY video_id ORDER BY sentence_idx) AS after, lag(asks AND has) OVER (PARTITION BY video_id ORDER BY sentence_idx) AS prior FROM (
  SELECT *, regexp_matches(lower(trim(text)), '(\\?$)|^(what|why|how|when|where|who|which)') AS asks, lead(sentence_idx) OVER (PARTITION BY video_id ORDER BY sentence_idx) IS NOT NULL AS has FROM sent)) WHERE asks AND after IS NOT NULL AND NOT coalesce(prior, false)
UNION ALL SELECT video_id, 'turning_point', sentence_idx, sentence_idx, coalesce(lag, sentence_idx) FROM (SELECT *, lag(sentence_idx) OVER (PARTITION BY video_id ORDER BY sentence_idx) AS lag FROM sent) WHERE regexp_matches(lower(text), 'but then|here''s the thing|what nobody tells you|turns out|and then|the truth is|what i realized|looking back|here''s what happened|little did i know|the crazy part')""", SENTENCES_SQL)
def beats(spark, sf_dir):
    """Beats by the heuristics."""
    return selection.heuristic_beats(sentences(spark, sf_dir))


@query("n07_candidates")
def candidates(spark, sf_dir):
    """Merged clip candidates of allowed length by the solver: users' turns with their answers, which need the turn before."""
    s = sentences(spark, sf_dir)
    at = F.col("sentence_idx")
    beats = s.filter("role = 'user'").select("video_id", F.lit("payoff").alias("beat_type"), at.alias("first"), (at + 1).alias("last"), F.when(at > 0, at - 1).alias("needs"))
    return selection.merge_candidates(solver.solve(s, beats.unionByName(selection.heuristic_beats(s))))


@query("n11_snapped", """SELECT o_orderkey, CASE WHEN abs(after - t) <= 1.2 THEN greatest(0.0, after - 0.12) ELSE t END AS new_start, CASE WHEN abs(before - e) <= 1.2 THEN before + 0.25 ELSE e END AS new_end FROM (
  SELECT o_orderkey, t, t + 30 AS e, (SELECT min(w.start) FROM wrd w WHERE w.video_id = o.v AND w.start >= o.t) AS after, (SELECT max(w."end") FROM wrd w WHERE w.video_id = o.v AND w."end" <= o.t + 30) AS before
  FROM (SELECT o_orderkey, o_custkey AS v, CAST(o_orderkey * 173 % 2592000 AS DOUBLE) AS t FROM orders) o)""", WORDS_SQL)
def snap(spark, sf_dir):
    """Clip bounds moved onto the words next to them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("video_id"), (F.col("o_orderkey") * 173 % 2592000).cast("double").alias("start_sec")).withColumn("end_sec", F.col("start_sec") + 30)
    w = words(spark, sf_dir)
    both = as_of(as_of(o, "start_sec", w, "video_id", "start", "onset", forward=True), "end_sec", w, "video_id", "end", "offset")
    return selection.snapped(both, "onset", "offset").select("o_orderkey", "new_start", "new_end")


@query("g02_self_contained", """SELECT video_id, sentence_idx, round(greatest(0.0, least(1.0, 1 - 0.08::DOUBLE * len([w for w in list_slice(regexp_extract_all(lower(text), '[a-z'']+'), 1, 10) if list_contains(['he','she','it','they','him','her','them','his','hers','its','their','theirs','himself','herself','itself','themselves','this','that','these','those'], split_part(w, '''', 1))]) - 0.35::DOUBLE * (sentence_idx % 2))), 6) AS score FROM sent""", SENTENCES_SQL)
def self_contained(spark, sf_dir):
    """Self-containedness of opening lines."""
    s = sentences(spark, sf_dir)
    return s.select("video_id", "sentence_idx", F.round(selection.self_containedness(F.col("text"), F.col("sentence_idx") % 2), 6).alias("score"))


@query("g04_quotability", """SELECT video_id, sentence_idx, round(coalesce(greatest(0.0, least(1.0, (avg(idf) - 4.0) / 2.3)), 0.2), 5) AS score FROM terms JOIN (SELECT term, ln((n + 1.0) / (count(*) + 1)) + 1 AS idf FROM (SELECT DISTINCT video_id, sentence_idx, term FROM terms), (SELECT count(*) AS n FROM sent) GROUP BY term, n) USING (term) GROUP BY 1, 2""", SENTENCES_SQL, TERMS_SQL)
def quotability(spark, sf_dir):
    """The mean inverse frequency of a sentence's terms, between 4.0 and 6.3."""
    s = sentences(spark, sf_dir)
    each = s.select("video_id", "sentence_idx", F.explode(texts.terms(F.col("text"))).alias("term"))
    mean = each.join(retrieval.idf(s, "text"), "term").groupBy("video_id", "sentence_idx").agg(F.avg("idf").alias("m"))
    return mean.select("video_id", "sentence_idx", F.round(numbers.normalise(F.col("m"), 4.0, 6.3), 5).alias("score"))


@query("g07_composite", """SELECT l_orderkey, l_linenumber, round(0.25 * (l_quantity / 50) + 0.2 * (l_discount * 10) + 0.2 * (l_tax * 10) + 0.2 * (l_linenumber / 7.0) + 0.15 * 0.5, 4) AS composite FROM lineitem""")
def composite(spark, sf_dir):
    """The weighted sum of five signals."""
    signals = {"hook_strength": F.col("l_quantity") / 50, "self_containedness": F.col("l_discount") * 10, "emotional_delta": F.col("l_tax") * 10, "quotability": F.col("l_linenumber") / 7.0, "boundary_cleanliness": F.lit(0.5)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", selection.composite(signals).alias("composite"))


@query("g05_boundaries", """SELECT video_id, pos, round((CASE WHEN b IS NULL THEN 1.0 ELSE least(1.0, greatest(0.0, b) / 0.6) END + CASE WHEN a IS NULL THEN 1.0 ELSE least(1.0, greatest(0.0, a) / 0.6) END) / 2, 6) AS score FROM (SELECT video_id, pos, start - lag("end") OVER w AS b, lead(start) OVER w - "end" AS a FROM wrd WINDOW w AS (PARTITION BY video_id ORDER BY start, pos))""", WORDS_SQL)
def boundaries(spark, sf_dir):
    """How clean a cut around each word is: the mean of both pauses."""
    from .windows import phrase_gaps

    g = phrase_gaps(spark, sf_dir)
    return g.select("video_id", "pos", F.round((numbers.pause_score(F.col("gap_before")) + numbers.pause_score(F.col("gap_after"))) / 2, 6).alias("score"))
