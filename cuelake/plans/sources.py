"""Scans, projections and filters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, texts, times
from ..sources.library import SENTENCES_SQL, sentences, table
from ..sources.transcripts import plain_chunks, silent_scenes, timed_text
from .registry import query

_VIDEOS_SQL = "vids AS (SELECT video_id, max(end_sec) AS total_seconds, count(*) AS n FROM sent GROUP BY video_id)"


@query("s01_json_scan", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CAST(props->>'$.absent' AS VARCHAR) AS absent FROM events")
def json_scan(spark, sf_dir):
    """JSON documents by a schema: an absent key is null."""
    x = F.from_json("props", "k bigint, absent string")
    return table(spark, sf_dir, "events").select("event_id", x.alias("x")).select("event_id", "x.k", "x.absent")


@query("s05_timed_text", "SELECT video_id, sentence_idx AS pos, CAST(start_sec AS DOUBLE) AS start, CAST(end_sec AS DOUBLE) AS \"end\", trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM sent", SENTENCES_SQL)
def timed(spark, sf_dir):
    """Sentences written as subtitles and parsed back."""
    cue = F.concat(F.col("sentence_idx").cast("string"), F.lit("\r\n"), times.cue_clock(F.col("start_sec")), F.lit(" --> "), times.cue_clock(F.col("end_sec")), F.lit(" align:start\r\n<i>"), F.regexp_replace("text", r"\s+", " "), F.lit("</i>"))
    rows = sentences(spark, sf_dir).select("video_id", F.struct("sentence_idx", cue.alias("cue")).alias("c"))
    files = rows.groupBy("video_id").agg(F.concat(F.lit("﻿NOTE made here\r\n\r\n"), F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["cue"]), "\r\n\r\n")).alias("raw"))
    return timed_text(files)


@query("s06_plain_chunks", r"""SELECT doc_id, CAST(i AS BIGINT) AS pos, array_to_string(list_slice(w, i * 120 + 1, i * 120 + 120), ' ') AS text, CAST(NULL AS DOUBLE) AS start, CAST(NULL AS DOUBLE) AS "end"
FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 119) // 120)) AS i FROM (SELECT doc_id, [x for x in regexp_split_to_array(text, '\s+') if x <> ''] AS w FROM documents))""")
def chunks(spark, sf_dir):
    """Untimed chunks of 120 words."""
    return plain_chunks(table(spark, sf_dir, "documents"), "doc_id")


@query("s10_silent_scenes", """SELECT video_id, s AS start, least(s + 15, total_seconds) AS "end",
  '[Visual Scene ' || lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || ' - ' || lpad(CAST(least(s + 15, total_seconds) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(least(s + 15, total_seconds) % 60 AS VARCHAR), 2, '0') || ']' AS text
FROM (SELECT video_id, total_seconds, unnest(range(CAST(0 AS BIGINT), total_seconds, CAST(15 AS BIGINT))) AS s FROM vids)""", SENTENCES_SQL, _VIDEOS_SQL)
def scenes(spark, sf_dir):
    """Scenes of 15 seconds over each video."""
    videos = sentences(spark, sf_dir).groupBy("video_id").agg(F.max("end_sec").alias("total_seconds"))
    return silent_scenes(videos, "video_id", "total_seconds")


@query("s18_library_transcript", "SELECT video_id, sentence_idx, text, start_sec, end_sec FROM sent WHERE video_id = 3", SENTENCES_SQL)
def transcript(spark, sf_dir):
    """One video's indexed sentences, in order."""
    return sentences(spark, sf_dir).filter(F.col("video_id") == 3).select("video_id", "sentence_idx", "text", "start_sec", "end_sec").orderBy("sentence_idx")


@query("s17_eval_set", "SELECT item_id, array_to_string(list_slice([x for x in regexp_split_to_array(text, '\\s+') if x <> ''], 1, 6), ' ') || CASE WHEN len([x for x in regexp_split_to_array(text, '\\s+') if x <> '']) > 6 THEN '...' ELSE '' END AS query FROM benchmark")
def eval_set(spark, sf_dir):
    """Evaluation queries: the first six words of each benchmark item."""
    return table(spark, sf_dir, "benchmark").select("item_id", texts.first_words(F.col("text"), 6).alias("query"))


@query("p01_chunks", """SELECT 'chunk-' || video_id || '-' || (sentence_idx + 1) AS id, video_id, 'Untitled' AS video_title, sentence_idx, start_sec, end_sec,
  lpad(CAST(start_sec // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_sec % 60 AS VARCHAR), 2, '0') AS start_timestamp, starts_with(text, '[Visual Scene') AS is_visual_only FROM sent""", SENTENCES_SQL)
def chunk_rows(spark, sf_dir):
    """Chunk rows with derived ids, stamps and defaults."""
    s = sentences(spark, sf_dir)
    return s.select(F.format_string("chunk-%d-%d", "video_id", F.col("sentence_idx") + 1).alias("id"), "video_id", F.lit("Untitled").alias("video_title"), "sentence_idx", "start_sec", "end_sec", times.clock(F.col("start_sec")).alias("start_timestamp"), F.col("text").startswith("[Visual Scene").alias("is_visual_only"))


@query("p06_display_gates", """SELECT doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM (
  SELECT doc_id, source, n_chars / 40000.0 AS score, max(n_chars / 40000.0) OVER () AS top FROM documents WHERE n_chars / 40000.0 >= 0.10) WHERE score >= top * 0.35) WHERE r <= 2""")
def display_gates(spark, sf_dir):
    """Absolute floor, then the share of the best score, then two a source."""
    from ..operators.ranking import display_gates as gates

    scored = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") / 40000.0).alias("score"))
    return gates(scored, "source", ["doc_id"])


@query("p13_clip_words", """SELECT video_id, pos, greatest(0.0, start - 3600.0) AS start, "end" - 3600.0 AS "end" FROM (SELECT user_id AS video_id, event_id AS pos, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS start, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 + 0.25 AS "end" FROM events) WHERE "end" > 3600 AND start < 90000""")
def clip_words(spark, sf_dir):
    """Words that overlap a clip, in the clip's time."""
    from ..sources.library import words

    return words(spark, sf_dir).filter("end > 3600 AND start < 90000").select("video_id", "pos", F.greatest(F.lit(0.0), F.col("start") - 3600.0).alias("start"), (F.col("end") - 3600.0).alias("end"))


@query("f01_tokens", "SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t, len(regexp_extract_all(lower(text), '[a-z0-9'']+'))::BIGINT AS n FROM conversations")
def search_tokens(spark, sf_dir):
    """Search tokens."""
    t = texts.tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"), F.size(t).cast("bigint").alias("n"))


@query("f08_clocks", """SELECT o_orderkey, s // 3600 AS h,
  CASE WHEN s >= 3600 THEN lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock,
  CASE WHEN s // 60 < 100 THEN lpad(CAST(s // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS minutes,
  CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s % 3600 // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration,
  (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' AS spent
FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) AS s FROM orders)""")
def clocks(spark, sf_dir):
    """The four ways to write a time."""
    s = F.floor(F.col("o_totalprice") / 10).alias("s")
    o = table(spark, sf_dir, "orders").select("o_orderkey", s)
    c = F.col("s")
    return o.select("o_orderkey", F.floor(c / 3600).alias("h"), times.clock(c).alias("clock"), times.minutes_clock(c).alias("minutes"), times.duration(c).alias("duration"), times.hours_minutes(c).alias("spent"))


@query("f12_scores", """SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_quantity - 25) / 5)), 4) AS sigmoid, round(greatest(0.0, least(1.0, (l_quantity - 5.26) / (23.25 - 5.26))), 6) AS normalised,
  CASE WHEN l_quantity > 45 THEN 1.0 ELSE greatest(0.0, least(1.0, round((l_quantity / 100) / 0.6, 6))) END AS pause, round(12 * log2(l_quantity / 10), 6) AS semitones FROM lineitem""")
def scores(spark, sf_dir):
    """Sigmoid, range, pause score and semitones."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.sigmoid((q - 25) / 5).alias("sigmoid"), F.round(numbers.normalise(q, 5.26, 23.25), 6).alias("normalised"), F.round(numbers.pause_score(F.when(q <= 45, q / 100)), 6).alias("pause"), F.round(numbers.semitones(q, F.lit(10.0)), 6).alias("semitones"))


@query("f13_vectors", """SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS own, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings""")
def vectors(spark, sf_dir):
    """Dot product and norm."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(numbers.dot(e, e), 6).alias("own"), F.round(numbers.norm(e), 6).alias("norm"))


@query("f18_interval_iou", """SELECT a.video_id, a.sentence_idx AS i, b.sentence_idx AS j, CASE WHEN least(a.end_sec, b.end_sec) > greatest(a.start_sec, b.start_sec) THEN (least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec)) / ((a.end_sec - a.start_sec) + (b.end_sec - b.start_sec) - (least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec)))::DOUBLE ELSE 0.0 END AS iou
FROM sent a JOIN sent b ON a.video_id = b.video_id AND b.sentence_idx = a.sentence_idx + 1""", SENTENCES_SQL)
def interval_iou(spark, sf_dir):
    """How much neighbouring sentences overlap."""
    s = sentences(spark, sf_dir)
    w = W.partitionBy("video_id").orderBy("sentence_idx")
    n = s.select("video_id", F.col("sentence_idx").alias("i"), "start_sec", "end_sec", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("sentence_idx", "start_sec", "end_sec")]).filter("n_sentence_idx = i + 1")
    return n.select("video_id", "i", F.col("n_sentence_idx").alias("j"), numbers.iou(F.col("start_sec"), F.col("end_sec"), F.col("n_start_sec"), F.col("n_end_sec")).alias("iou"))


@query("f21_content_id", "SELECT page_id, 'local-' || substr(sha1(html), 1, 12) AS id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages")
def content_id(spark, sf_dir):
    """Ids from content, and hosts of addresses."""
    return table(spark, sf_dir, "pages").select("page_id", texts.content_id(F.col("html")).alias("id"), texts.host(F.col("url")).alias("host"))


@query("f28_colours", """SELECT p_partkey, '#' || printf('%02x', r) || printf('%02x', g) || printf('%02x', b) AS hex, round(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)::DOUBLE ELSE 0 END, 6) AS saturation, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) AS luminance
FROM (SELECT p_partkey, p_partkey % 256 AS r, (p_partkey * 7) % 256 AS g, CAST(p_size AS BIGINT) * 5 % 256 AS b FROM part)""")
def colours(spark, sf_dir):
    """Hex, saturation and luminance."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 256).alias("r"), (F.col("p_partkey") * 7 % 256).alias("g"), (F.col("p_size").cast("bigint") * 5 % 256).alias("b"))
    c = [F.col(x) for x in "rgb"]
    return p.select("p_partkey", numbers.hex_colour(*c).alias("hex"), F.round(numbers.saturation(*c), 6).alias("saturation"), F.round(numbers.luminance(*c), 6).alias("luminance"))


@query("f29_first_words", r"SELECT conv_id, turn, array_to_string(list_slice(w, 1, 9), ' ') || CASE WHEN len(w) > 9 THEN '...' ELSE '' END AS head FROM (SELECT conv_id, turn, [x for x in regexp_split_to_array(text, '\s+') if x <> ''] AS w FROM conversations)")
def heads(spark, sf_dir):
    """The first nine words with a mark."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.first_words(F.col("text"), 9).alias("head"))
