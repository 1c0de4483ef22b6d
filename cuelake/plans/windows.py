"""Windows and sequences over sentences, words and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import sequences
from ..sources.library import SENTENCES_SQL, WORDS_SQL, sentences, table, words
from .registry import query


@query("w02_time_windows", """SELECT video_id, k AS "window", string_agg(text, ' ' ORDER BY sentence_idx) AS text, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM (
  SELECT *, unnest(range(greatest(0, floor((start_sec - 45) / 35.0)::BIGINT + 1), floor(start_sec / 35.0)::BIGINT + 1)) AS k FROM sent) GROUP BY 1, 2 HAVING sum(n_words) >= 4""", SENTENCES_SQL)
def time_windows(spark, sf_dir):
    """Windows of 45 seconds that overlap by 10, of four words at least."""
    w = sequences.time_windows(sentences(spark, sf_dir), "start_sec", 45, 35)
    parts = w.groupBy("video_id", "window").agg(F.array_sort(F.collect_list(F.struct("sentence_idx", "text"))).alias("t"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.sum("n_words").alias("n"))
    return parts.filter("n >= 4").select("video_id", "window", F.array_join("t.text", " ").alias("text"), "start_sec", "end_sec")


@query("w03_count_windows", """SELECT source, k AS "window", doc_id FROM (SELECT source, doc_id, p, n, unnest(range(greatest(0, CAST(ceil((p - 60 + 1) / 50.0) AS BIGINT)), least(p // 50, greatest(0, CAST(ceil((n - 60) / 50.0) AS BIGINT))) + 1)) AS k
  FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents))""")
def count_windows(spark, sf_dir):
    """Windows of 60 rows that overlap by 10, until the tail is covered."""
    return sequences.count_windows(table(spark, sf_dir, "documents"), "source", "doc_id", 60, 10)


@query("w05_islands", """SELECT video_id, g, min(sentence_idx) AS first, max(sentence_idx) AS last, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM (SELECT *, sentence_idx - row_number() OVER (PARTITION BY video_id ORDER BY sentence_idx) AS g FROM sent WHERE n_words <= 40) GROUP BY 1, 2 HAVING max(end_sec) - min(start_sec) <= 90""", SENTENCES_SQL)
def island_merge(spark, sf_dir):
    """Runs of neighbouring short sentences."""
    s = sentences(spark, sf_dir).filter("n_words <= 40")
    g = F.col("sentence_idx") - F.row_number().over(W.partitionBy("video_id").orderBy("sentence_idx"))
    runs = s.withColumn("g", g).groupBy("video_id", "g").agg(F.min("sentence_idx").alias("first"), F.max("sentence_idx").alias("last"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"))
    return runs.filter("end_sec - start_sec <= 90")


@query("w05_capped_islands", """, steps AS (SELECT *, 1 AS g FROM ordered WHERE k = 1
  UNION ALL SELECT o.video_id, o.k, CASE WHEN fits THEN least(p.first, o.first) ELSE o.first END, CASE WHEN fits THEN greatest(p.last, o.last) ELSE o.last END, CASE WHEN fits THEN least(p.s, o.s) ELSE o.s END, CASE WHEN fits THEN greatest(p.e, o.e) ELSE o.e END, CASE WHEN fits THEN greatest(p.score, o.score) ELSE o.score END, p.g + CASE WHEN fits THEN 0 ELSE 1 END
  FROM (SELECT a.*, b.first <= a.last + 1 AND greatest(a.e, b.e) - least(a.s, b.s) <= 90 AS fits FROM steps a JOIN ordered b ON b.video_id = a.video_id AND b.k = a.k + 1) p JOIN ordered o ON o.video_id = p.video_id AND o.k = p.k + 1)
SELECT video_id, first, last, s AS start_sec, e AS end_sec, score FROM steps QUALIFY row_number() OVER (PARTITION BY video_id, g ORDER BY k DESC) = 1""", SENTENCES_SQL, "ordered AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY greatest(0, sentence_idx - 1), sentence_idx) AS k, greatest(0, sentence_idx - 1) AS first, sentence_idx + 1 AS last, start_sec AS s, end_sec AS e, n_words / 100 AS score FROM sent)")
def capped_islands(spark, sf_dir):
    """Ranges merged in order while the whole spans 90 seconds at most."""
    s = sentences(spark, sf_dir).select("video_id", F.greatest(F.lit(0), F.col("sentence_idx") - 1).alias("first"), (F.col("sentence_idx") + 1).alias("last"), "start_sec", "end_sec", (F.col("n_words") / 100).alias("score"))
    return sequences.islands(s, ["video_id"])


@query("w07_phrase_gaps", """SELECT video_id, pos, round(start - before, 6) AS gap_before, round(after - "end", 6) AS gap_after FROM (SELECT video_id, pos, start, "end", lag("end") OVER w AS before, lead(start) OVER w AS after FROM wrd WINDOW w AS (PARTITION BY video_id ORDER BY start, pos))""", WORDS_SQL)
def phrase_gaps(spark, sf_dir):
    """Silence before and after each word; null at a recording's ends."""
    w = W.partitionBy("video_id").orderBy("start", "pos")
    s = words(spark, sf_dir).withColumn("before", F.lag("end").over(w)).withColumn("after", F.lead("start").over(w))
    return s.select("video_id", "pos", F.round(F.col("start") - F.col("before"), 6).alias("gap_before"), F.round(F.col("after") - F.col("end"), 6).alias("gap_after"))


@query("w09_rolling_admission", """SELECT event_id, n, n <= 25 AS admitted FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS n FROM events)""")
def rolling_admission(spark, sf_dir):
    """Calls of a bucket's last 60 seconds against its limit; buckets are cut into hours with the minute before, so that none is one partition."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", us.alias("t"))
    hour = 3_600_000_000
    cell = F.floor(F.col("t") / hour)
    cells = F.explode(F.sequence(cell, F.floor((F.col("t") + 60_000_000) / hour)))
    w = W.partitionBy("event_type", "cell").orderBy("t").rangeBetween(-60_000_000, 0)
    counted = e.withColumn("own", cell).withColumn("cell", cells).withColumn("n", F.count("*").over(w)).filter("cell = own")
    return counted.select("event_id", "n", (F.col("n") <= 25).alias("admitted"))


@query("w10_hourly_limit", """SELECT user_id, max(n) AS most, max(n) >= 3 AS limited FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1""")
def hourly_limit(spark, sf_dir):
    """The busiest hour of each user against the limit."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").select("user_id", us.alias("t"))
    n = F.count("*").over(W.partitionBy("user_id").orderBy("t").rangeBetween(-3_600_000_000, 0))
    return e.withColumn("n", n).groupBy("user_id").agg(F.max("n").alias("most"), (F.max("n") >= 3).alias("limited"))


@query("w11_speech_rate", """SELECT video_id, round(least(1.0, abs(w2 - w1) / greatest(w1, w2, 1.0)), 6) AS delta FROM (
  SELECT video_id, (n // 2) / (greatest(mid - first, 0.01) / 60) AS w1, (n - n // 2) / (greatest(last - mid, 0.01) / 60) AS w2 FROM (
    SELECT video_id, n, min(start) AS first, min(start) FILTER (p = n // 2) AS mid, max("end") FILTER (p = n - 1) AS last FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, pos) - 1 AS p, count(*) OVER (PARTITION BY video_id) AS n FROM wrd) WHERE n >= 4 GROUP BY 1, 2))""", WORDS_SQL)
def speech_rate(spark, sf_dir):
    """How much the rate of words changes between a video's halves; none of fewer than four words."""
    w = W.partitionBy("video_id")
    p = words(spark, sf_dir).withColumn("p", F.row_number().over(w.orderBy("start", "pos")) - 1).withColumn("n", F.count("*").over(w)).filter("n >= 4").withColumn("h", F.floor(F.col("n") / 2))
    g = p.groupBy("video_id", "n", "h").agg(F.min("start").alias("first"), F.min(F.when(F.col("p") == F.col("h"), F.col("start"))).alias("mid"), F.max(F.when(F.col("p") == F.col("n") - 1, F.col("end"))).alias("last"))
    rate = lambda c, a, b: c / (F.greatest(b - a, F.lit(0.01)) / 60)
    r = g.select("video_id", rate(F.col("h"), F.col("first"), F.col("mid")).alias("w1"), rate(F.col("n") - F.col("h"), F.col("mid"), F.col("last")).alias("w2"))
    return r.select("video_id", F.round(F.least(F.lit(1.0), F.abs(F.col("w2") - F.col("w1")) / F.greatest("w1", "w2", F.lit(1.0))), 6).alias("delta"))


@query("w13_median_filter", """SELECT event_id, list_sort([coalesce(lag(value, 2) OVER w, 0), coalesce(lag(value) OVER w, 0), value, coalesce(lead(value) OVER w, 0), coalesce(lead(value, 2) OVER w, 0)])[3] AS smooth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def median_filter(spark, sf_dir):
    """The median of five neighbours, zeros beyond the ends."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    around = [F.coalesce(f("value", k).over(w), F.lit(0.0)) for f, k in ((F.lag, 2), (F.lag, 1), (F.lead, 1), (F.lead, 2))]
    return table(spark, sf_dir, "events").select("event_id", F.get(F.array_sort(F.array(*around, "value")), F.lit(2)).alias("smooth"))


@query("w15_lead_in", """SELECT a.video_id, a.sentence_idx, min(b.sentence_idx) AS first FROM sent a JOIN sent b ON a.video_id = b.video_id AND b.sentence_idx <= a.sentence_idx AND b.start_sec >= a.start_sec - 15 GROUP BY 1, 2""", SENTENCES_SQL)
def lead_in(spark, sf_dir):
    """The earliest sentence that begins within 15 seconds before each."""
    w = W.partitionBy("video_id").orderBy("start_sec").rangeBetween(-15, 0)
    return sentences(spark, sf_dir).select("video_id", "sentence_idx", F.min("sentence_idx").over(w).alias("first"))


@query("w16_dependencies", """SELECT video_id, sentence_idx, coalesce(max(sentence_idx) OVER (PARTITION BY video_id ORDER BY sentence_idx RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS needs FROM sent QUALIFY sentence_idx > min(sentence_idx) OVER (PARTITION BY video_id) AND length(text) % 3 = 0""", SENTENCES_SQL)
def dependencies(spark, sf_dir):
    """The nearest sentence before each that needs one."""
    w = W.partitionBy("video_id").orderBy("sentence_idx")
    s = sentences(spark, sf_dir).withColumn("needs", F.max("sentence_idx").over(w.rangeBetween(W.unboundedPreceding, -1)))
    return s.filter(F.col("needs").isNotNull() & (F.length("text") % 3 == 0)).select("video_id", "sentence_idx", "needs")


@query("w18_answers", """SELECT video_id, sentence_idx, answer FROM (SELECT video_id, sentence_idx, role, text, lead(sentence_idx) OVER (PARTITION BY video_id ORDER BY sentence_idx) AS answer FROM sent) WHERE role = 'user' AND answer IS NOT NULL""", SENTENCES_SQL)
def answers(spark, sf_dir):
    """Each question with the sentence after it."""
    s = sentences(spark, sf_dir).withColumn("answer", F.lead("sentence_idx").over(W.partitionBy("video_id").orderBy("sentence_idx")))
    return s.filter("role = 'user' AND answer IS NOT NULL").select("video_id", "sentence_idx", "answer")


@query("w19_caption_cues", """SELECT video_id, cue, string_agg(word, ' ' ORDER BY start, pos) AS text, min(start) AS start, max("end") AS "end" FROM (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY start, pos) - 1) // 4 AS cue FROM wrd) GROUP BY 1, 2""", WORDS_SQL)
def caption_cues(spark, sf_dir):
    """Captions of four words."""
    w = words(spark, sf_dir).withColumn("at", F.struct("start", "pos"))
    cues = sequences.groups_of(w, "video_id", "at", 4).groupBy("video_id", "cue").agg(F.array_sort(F.collect_list(F.struct("start", "pos", "word"))).alias("w"), F.min("start").alias("start"), F.max("end").alias("end"))
    return cues.select("video_id", "cue", F.array_join("w.word", " ").alias("text"), "start", "end")


@query("w20_state_changes", "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NULL OR was <> event_type")
def state_changes(spark, sf_dir):
    """Events that differ from the user's one before."""
    e = table(spark, sf_dir, "events").withColumn("was", F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.filter("was IS NULL OR was <> event_type").select("user_id", "event_id", "event_type")


@query("w22_time_estimate", """SELECT conv_id, turn, round(600.0 * before / greatest(total, 1), 1) AS at FROM (SELECT conv_id, turn, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY conv_id) AS total FROM (SELECT conv_id, turn, len([x for x in regexp_split_to_array(text, '\\s+') if x <> '']) AS n FROM conversations))""")
def time_estimate(spark, sf_dir):
    """Times in proportion to the words before, of ten minutes in all."""
    w = W.partitionBy("conv_id")
    n = table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.word_count("text").alias("n"))
    before = F.coalesce(F.sum("n").over(w.orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return n.select("conv_id", "turn", F.round(F.lit(600.0) * before / F.greatest(F.sum("n").over(w), F.lit(1)), 1).alias("at"))
