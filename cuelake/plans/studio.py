"""Segmentation, concepts, prosody, the solver, captions, checks on generated rows, settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import captions, concepts, config, dependencies, prosody, retrieval, selection, solver, studio
from ..sources.library import SENTENCES_SQL, SPOKEN_SQL, WORDS_SQL, sentences, spoken, table, words
from ..sources.segmenting import segment
from .registry import query


@query("w06_sentences")
def segmented(spark, sf_dir):
    """Sentences of documents' lines as segments of five seconds."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return segment(lines.select("video_id", "text", (F.col("p") * 5.0).alias("start"), F.lit(5.0).alias("duration")))


@query("t08_concepts")
def sentence_concepts(spark, sf_dir):
    """Concepts, topic and questions of each sentence."""
    s = sentences(spark, sf_dir)
    return concepts.concepts(s, ["video_id", "sentence_idx"], "text", retrieval.idf(s, "text"))


@query("f07_enriched")
def enriched(spark, sf_dir):
    """The text that is embedded: behind its topic."""
    s = sentences(spark, sf_dir)
    c = concepts.concepts(s, ["video_id", "sentence_idx"], "text", retrieval.idf(s, "text"))
    return s.join(c, ["video_id", "sentence_idx"]).select("video_id", "sentence_idx", concepts.enriched(F.col("text"), F.col("section_topic")).alias("enriched_text"))


@query("t07_suggested_queries")
def suggested(spark, sf_dir):
    """Suggested queries from sentences' concepts."""
    s = sentences(spark, sf_dir)
    idf = retrieval.idf(s, "text")
    return concepts.suggested_queries(concepts.concepts(s, ["video_id", "sentence_idx"], "text", idf), idf, ["people", "thing", "really"])


@query("s12_prosody_frames")
def pitch(spark, sf_dir):
    """Loudness and pitch of a synthetic second of voice for each supplier."""
    n = F.sequence(F.lit(0), F.lit(15_999))
    tone = F.transform(n, lambda i: (F.sin(i * (2 * 3.141592653589793 / 16_000) * (100 + F.col("s_suppkey") % 8 * 25)) * 0.5).cast("float"))
    return prosody.frames(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video_id"), tone.alias("pcm")))


@query("g03_rate_delta", """SELECT video_id AS clip_id, round(greatest(0.0, least(1.0, abs(w2 - w1) / greatest(w1, w2, 1.0))), 6) AS rate_delta FROM (
  SELECT video_id, (n // 2) / (greatest(mid - first, 0.01) / 60) AS w1, (n - n // 2) / (greatest(last - mid, 0.01) / 60) AS w2 FROM (
    SELECT video_id, n, min(start) AS first, min(start) FILTER (p = n // 2) AS mid, max("end") FILTER (p = n - 1) AS last FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, "end") - 1 AS p, count(*) OVER (PARTITION BY video_id) AS n FROM wrd WHERE start <= 864000) WHERE n >= 4 GROUP BY 1, 2))""", WORDS_SQL)
def rate(spark, sf_dir):
    """How the rate of words changes within each user's first ten days."""
    w = words(spark, sf_dir)
    clips = w.select("video_id").distinct().select("video_id", F.col("video_id").alias("clip_id"), F.lit(0.0).alias("start_sec"), F.lit(864_000.0).alias("end_sec"))
    return prosody.rate_delta(w, clips).withColumn("rate_delta", F.round("rate_delta", 6))


@query("n10_solved_clips")
def solved(spark, sf_dir):
    """Clips under all constraints, seeded by users' turns and what answers them."""
    s = sentences(spark, sf_dir)
    at = F.col("sentence_idx")
    own = s.filter("role = 'user'").select("video_id", F.lit("payoff").alias("beat_type"), at.alias("first"), (at + 1).alias("last"), F.when(at > 0, at - 1).alias("needs"))
    return solver.solve(s, own.unionByName(selection.heuristic_beats(s)))


_PAIRS_SQL = """pair AS (SELECT a.video_id, a.sentence_idx AS first, a.sentence_idx + 1 AS last FROM sent a JOIN sent b ON b.video_id = a.video_id AND b.sentence_idx = a.sentence_idx + 1 WHERE a.role = 'user')"""
_POINTS_SQL = """begins AS (SELECT *, CASE WHEN o IS NOT NULL AND x IS NOT NULL THEN round(greatest(0.0::DOUBLE, o - x), 6) END AS pause FROM (SELECT *, (SELECT max(w."end") FROM spoken w WHERE w.video_id = s.video_id AND w."end" <= s.o) AS x FROM (SELECT video_id, sentence_idx AS idx, start_sec AS at, (SELECT min(w.start) FROM spoken w WHERE w.video_id = t.video_id AND w.start >= t.start_sec) AS o FROM sent t) s)),
ends AS (SELECT *, CASE WHEN o IS NOT NULL AND x IS NOT NULL THEN round(greatest(0.0::DOUBLE, x - o), 6) END AS pause FROM (SELECT *, (SELECT min(w.start) FROM spoken w WHERE w.video_id = s.video_id AND w.start >= s.o) AS x FROM (SELECT video_id, sentence_idx AS idx, end_sec AS at, (SELECT max(w."end") FROM spoken w WHERE w.video_id = t.video_id AND w."end" <= t.end_sec) AS o FROM sent t) s)),
bounds AS (SELECT p.*, b.idx AS nf, e.idx AS nl, (CASE WHEN b.pause IS NULL THEN 1.0 ELSE least(1.0, b.pause / 0.6) END + CASE WHEN e.pause IS NULL THEN 1.0 ELSE least(1.0, e.pause / 0.6) END)::DOUBLE / 2 AS score, (p.first - b.idx) + (e.idx - p.last) AS wider
  FROM pair p JOIN begins b ON b.video_id = p.video_id AND b.idx BETWEEN p.first - 3 AND p.first JOIN ends e ON e.video_id = p.video_id AND e.idx BETWEEN p.last AND p.last + 2 WHERE e.at - b.at BETWEEN 12 AND 75),
judged AS (SELECT *, max(CASE WHEN wider = 0 THEN score END) OVER (PARTITION BY video_id, first, last) AS own FROM bounds)"""


@query("n09_pause_aligned", """SELECT video_id, first, last, nf AS new_first, nl AS new_last, round(score - own, 4) AS gain FROM judged WHERE own IS NOT NULL AND (wider = 0 OR score >= own + 0.15) QUALIFY row_number() OVER (PARTITION BY video_id, first, last ORDER BY score DESC, wider, nf DESC, nl DESC) = 1""", SENTENCES_SQL, SPOKEN_SQL, _PAIRS_SQL, _POINTS_SQL)
def pause_aligned(spark, sf_dir):
    """Each user's turn and the one after it as a clip, on the cleanest pauses near by."""
    s = sentences(spark, sf_dir)
    after = s.select("video_id", (F.col("sentence_idx") - 1).alias("sentence_idx"))
    pairs = s.filter("role = 'user'").join(after, ["video_id", "sentence_idx"], "left_semi").select("video_id", F.col("sentence_idx").alias("first"), (F.col("sentence_idx") + 1).alias("last"))
    return selection.pause_aligned(pairs, s, spoken(spark, sf_dir)).drop("score")


@query("w17_resolved_starts", """, run AS (SELECT p.video_id, p.first, p.last, p.first AS reached, 0 AS steps FROM pair p
  UNION ALL SELECT r.video_id, r.first, r.last, b.sentence_idx, r.steps + 1 FROM run r JOIN sent s ON s.video_id = r.video_id AND s.sentence_idx = r.reached JOIN sent b ON b.video_id = r.video_id AND b.sentence_idx = r.reached - 1 JOIN sent e ON e.video_id = r.video_id AND e.sentence_idx = r.last WHERE s.n_words % 3 <> 0 AND r.steps < 8 AND e.end_sec - b.start_sec <= 75)
SELECT video_id, first AS was, last, min(reached) AS first, CAST(max(steps) AS BIGINT) AS steps FROM run GROUP BY run.video_id, run.first, run.last""", SENTENCES_SQL, _PAIRS_SQL)
def resolved_starts(spark, sf_dir):
    """From where such clips must begin where sentences of some lengths point back."""
    s = sentences(spark, sf_dir).withColumn("back", F.col("n_words") % 3 != 0)
    after = s.select("video_id", (F.col("sentence_idx") - 1).alias("sentence_idx"))
    pairs = s.filter("role = 'user'").join(after, ["video_id", "sentence_idx"], "left_semi").select("video_id", F.col("sentence_idx").alias("first"), (F.col("sentence_idx") + 1).alias("last"), F.col("sentence_idx").alias("was"))
    return dependencies.resolved(pairs, s)


@query("n14_ranked_clips")
def ranked(spark, sf_dir):
    """Solved clips on clean pauses and whole words, with their five signals, by composite, start and id."""
    s = sentences(spark, sf_dir)
    found = selection.ranked_clips(solved(spark, sf_dir), s, spoken(spark, sf_dir), retrieval.idf(s, "text"), selection.heuristic_beats(s))
    return found.select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in found.dtypes]).orderBy(F.desc("composite"), "start_sec", "video_id", "first")


@query("j16_active_cues", """SELECT t.video_id, t.at, min(c.cue) AS cue FROM (SELECT user_id AS video_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 + 0.1 AS at FROM events) t LEFT JOIN (
  SELECT video_id, cue, min(start) AS s, max("end") AS e FROM (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY start, pos) - 1) // 4 AS cue FROM wrd) GROUP BY 1, 2) c ON t.video_id = c.video_id AND t.at BETWEEN c.s AND c.e GROUP BY 1, 2""", WORDS_SQL)
def active_cues(spark, sf_dir):
    """The cue on screen a tenth of a second into each word."""
    w = words(spark, sf_dir)
    states = captions.frame_states(captions.cues(w, 4), w.select("video_id", (F.col("start") + 0.1).alias("at")).distinct(), width=86_400.0)
    return states.select("video_id", "at", "cue")


@query("p12_citations", "SELECT doc_id, list_sort(list_distinct([x for x in [doc_id % 7, doc_id % 5, doc_id % 3] if x >= 1 and x <= 5]))::INTEGER[] AS cited FROM documents")
def citations(spark, sf_dir):
    """Citations in range, each once, in order."""
    d = F.col("doc_id")
    found = F.array(*[(d % k).cast("string") for k in (7, 5, 3)], F.lit("x"))
    return table(spark, sf_dir, "documents").select("doc_id", studio.citations(found, F.lit(5)).alias("cited"))


@query("p16_kit_errors", "SELECT c_custkey, [x for x in [CASE WHEN c_custkey % 3 = 0 THEN 'primary' END, CASE WHEN c_custkey % 13 NOT BETWEEN 1 AND 10 THEN 'max_words' END, CASE WHEN c_custkey % 10 / 20.0 > 0.45 THEN 'margin' END] if x IS NOT NULL] AS errors FROM customer")
def kit_errors(spark, sf_dir):
    """Settings with their bad fields."""
    k = F.col("c_custkey")
    kits = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, "#12").otherwise("#a0B1c2").alias("primary"), F.lit(None).cast("string").alias("accent"), (k % 13).alias("max_words"), (k % 10 / 20.0).alias("margin"))
    return config.kit_errors(kits).select("c_custkey", "errors")


@query("p17_error_kinds", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'context_length' WHEN 2 THEN 'model_not_found' ELSE 'other' END AS kind FROM events""")
def error_kinds(spark, sf_dir):
    """What providers' messages mean."""
    m = F.element_at(F.array(*map(F.lit, ("HTTP 429: rate limit", "maximum context length is 8192", "The model x was not found", "boom"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", studio.error_kind(m).alias("kind"))


@query("t12_moments", """SELECT m.first, m.video_id, m.last, m.type, m.score, (SELECT min(b.sentence_idx) FROM sent b WHERE b.video_id = m.video_id AND b.start_sec BETWEEN a.start_sec - 15 AND a.start_sec) AS lead_in FROM (
  SELECT * FROM (SELECT good.*, t.n, t.c, t.k, row_number() OVER (PARTITION BY good.video_id, type ORDER BY score DESC, first) AS p FROM good JOIN (SELECT video_id, sum(c) AS n, max(c) AS c, arg_max(type, struct_pack(c := c, t := type)) AS k FROM (SELECT video_id, type, count(*) AS c FROM good GROUP BY 1, 2) GROUP BY 1) t ON t.video_id = good.video_id)
  WHERE NOT (type = k AND c > n * 0.6 AND p > greatest(1, floor(n * 0.6))) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, first) <= 15) m JOIN sent a ON a.video_id = m.video_id AND a.sentence_idx = m.first""", SENTENCES_SQL,
  "good AS (SELECT video_id, sentence_idx AS first, sentence_idx + 1 AS last, CASE WHEN n_words % 4 = 0 THEN 'story' ELSE 'insight' END AS type, n_words % 10 AS score FROM sent s WHERE EXISTS (SELECT 1 FROM sent b WHERE b.video_id = s.video_id AND b.sentence_idx = s.sentence_idx + 1))")
def moments(spark, sf_dir):
    """Moments on known sentences, once a range, no type over its share, with their lead-in."""
    s = sentences(spark, sf_dir)
    found = s.select("video_id", F.col("sentence_idx").alias("first"), (F.col("sentence_idx") + 1).alias("last"), F.when(F.col("n_words") % 4 == 0, "story").otherwise("insight").alias("type"), (F.col("n_words") % 10).alias("score"))
    return studio.moments(found, s, ("story", "insight"))


@query("m05_admission", """SELECT event_id, n < 60 AS admitted FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS n FROM events)""")
def admission(spark, sf_dir):
    """Runs admitted by the hour before."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return studio.admitted(e, F.lit(10), "ts", "event_type").select("event_id", "admitted")


@query("f30_numbered", r"""SELECT video_id, string_agg('[' || sentence_idx || '] ' || array_to_string(list_slice(w, 1, 12), ' ') || CASE WHEN len(w) > 12 THEN '...' ELSE '' END, chr(10) ORDER BY sentence_idx) AS prompt FROM (SELECT *, [x for x in regexp_split_to_array(text, '\s+') if x <> ''] AS w FROM sent) GROUP BY 1""", SENTENCES_SQL)
def numbered(spark, sf_dir):
    """A video's lines by number."""
    return studio.numbered(sentences(spark, sf_dir), "video_id", 12)


@query("a17_palette")
def palette(spark, sf_dir):
    """Five colours of the parts' pixels."""
    k = F.col("p_partkey")
    return config.palette(table(spark, sf_dir, "part").select((k % 256).cast("double").alias("r"), (k * 7 % 256).cast("double").alias("g"), (F.col("p_size") * 5 % 256).cast("double").alias("b")))


@query("w04_packed_windows")
def packed(spark, sf_dir):
    """Windows of whole topic segments, up to sixty sentences each."""
    topics = selection.topic_segments(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return selection.packed_windows(topics, "label", "vec_id")
