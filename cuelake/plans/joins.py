"""Joins of chunks, videos, words and labels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import dependencies
from ..operators.intervals import as_of, range_join
from ..operators.sequences import context
from ..sources.library import SENTENCES_SQL, WORDS_SQL, sentences, table, words
from .registry import query


@query("j01_video_counts", "SELECT n_nationkey, n_name, coalesce(c, 0)::BIGINT AS chunk_count, coalesce(v, 0)::BIGINT AS visual_count FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c, count(*) FILTER (c_mktsegment = 'BUILDING') AS v FROM customer GROUP BY 1) ON n_nationkey = c_nationkey")
def video_counts(spark, sf_dir):
    """Counts of chunks beside their dimension, zero where there are none."""
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("v"))
    n = table(spark, sf_dir, "nation")
    return n.join(counts, n.n_nationkey == counts.c_nationkey, "left").select("n_nationkey", "n_name", F.coalesce("c", F.lit(0)).alias("chunk_count"), F.coalesce("v", F.lit(0)).alias("visual_count"))


@query("j02_keyed_vectors", "SELECT d.doc_id, e.label, CAST(len(e.embedding) AS BIGINT) AS dim FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def keyed_vectors(spark, sf_dir):
    """Vectors by key, null where a chunk has none."""
    d, e = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings")
    return d.join(e, d.doc_id == e.vec_id, "left").select("doc_id", "label", F.size("embedding").cast("bigint").alias("dim")).withColumn("dim", F.when(F.col("dim") >= 0, F.col("dim")))


@query("j03_neighbours", """SELECT video_id, sentence_idx, array_to_string(list(text) OVER w, ' ') AS text, min(start_sec) OVER w AS start_sec, max(end_sec) OVER w AS end_sec FROM sent
WINDOW w AS (PARTITION BY video_id ORDER BY sentence_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""", SENTENCES_SQL)
def neighbours(spark, sf_dir):
    """Each sentence with the one before and the one after."""
    return context(sentences(spark, sf_dir))


@query("j04_range_text", """SELECT a.video_id, a.sentence_idx, string_agg(b.text, ' ' ORDER BY b.sentence_idx) AS text FROM sent a JOIN sent b ON a.video_id = b.video_id AND b.sentence_idx BETWEEN a.sentence_idx AND a.sentence_idx + 2 GROUP BY 1, 2""", SENTENCES_SQL)
def range_text(spark, sf_dir):
    """The text of the range of three sentences from each, by an equi-join on the exploded range."""
    s = sentences(spark, sf_dir)
    wanted = s.select("video_id", F.col("sentence_idx").alias("first"), F.explode(F.sequence(F.col("sentence_idx"), F.col("sentence_idx") + 2)).alias("sentence_idx"))
    joined = wanted.join(s.select("video_id", "sentence_idx", "text"), ["video_id", "sentence_idx"]).groupBy("video_id", "first").agg(F.array_sort(F.collect_list(F.struct("sentence_idx", "text"))).alias("t"))
    return joined.select("video_id", F.col("first").alias("sentence_idx"), F.array_join(F.col("t.text"), " ").alias("text"))


@query("j05_overlap_pairs", """SELECT a.video_id, a.pos AS i, b.pos AS j FROM wrd a JOIN wrd b ON a.video_id = b.video_id AND a.pos < b.pos AND b.start < a."end" + 600 AND a.start < b."end" + 600""", WORDS_SQL)
def overlap_pairs(spark, sf_dir):
    """Pairs of a video's words within ten minutes, met by cells of time."""
    w = words(spark, sf_dir).select("video_id", "pos", "start", (F.col("end") + 600).alias("reach"))
    a = w.select("video_id", F.col("pos").alias("i"), F.col("start").alias("s"), F.col("reach").alias("e"))
    met = range_join(w.withColumnRenamed("pos", "j"), "start", a, "video_id", "s", "e", 3600.0).filter("i <> j AND start < e")
    return met.select("video_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


@query("j06_covering_beat", """SELECT video_id, sentence_idx, min(first) AS first FROM (SELECT s.video_id, s.sentence_idx, b.sentence_idx AS first FROM sent s JOIN sent b ON s.video_id = b.video_id AND b.role = 'user' AND s.sentence_idx BETWEEN b.sentence_idx AND b.sentence_idx + 2) GROUP BY 1, 2""", SENTENCES_SQL)
def covering(spark, sf_dir):
    """The first beat, of those that begin with a user's turn and last three, that covers each sentence."""
    s = sentences(spark, sf_dir)
    beats = s.filter("role = 'user'").select("video_id", F.col("sentence_idx").alias("first"), F.explode(F.sequence(F.col("sentence_idx"), F.col("sentence_idx") + 2)).alias("sentence_idx"))
    return s.select("video_id", "sentence_idx").join(beats, ["video_id", "sentence_idx"]).groupBy("video_id", "sentence_idx").agg(F.min("first").alias("first"))


@query("j07_beat_type", """SELECT user_id, arg_min(event_type, struct_pack(p := CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, e := event_id)) AS kind FROM events GROUP BY 1""")
def beat_type(spark, sf_dir):
    """The preferred kind of each group, then the first."""
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct(rank, "event_id")).alias("kind"))


@query("j08_dependency_closure", """, reach AS (SELECT video_id, sentence_idx, needs FROM need WHERE needs IS NOT NULL UNION SELECT r.video_id, r.sentence_idx, n.needs FROM reach r JOIN need n ON n.video_id = r.video_id AND n.sentence_idx = r.needs WHERE n.needs IS NOT NULL)
SELECT video_id, sentence_idx, min(needs) AS earliest FROM reach GROUP BY 1, 2""", SENTENCES_SQL, "need AS (SELECT video_id, sentence_idx, CASE WHEN role = 'user' OR n_words % 3 = 0 THEN (sentence_idx * 7 + n_words) % count(*) OVER (PARTITION BY video_id) END AS needs FROM sent)")
def closure(spark, sf_dir):
    """The earliest turn that each needs, over all that those need in turn, cycles among them."""
    size = F.count("*").over(W.partitionBy("video_id"))
    i = F.col("sentence_idx")
    needs = F.when((F.col("role") == "user") | (F.col("n_words") % 3 == 0), (i * 7 + F.col("n_words")) % size)
    return dependencies.earliest_needed(sentences(spark, sf_dir).select("video_id", "sentence_idx", needs.alias("needs")))


@query("j09_as_of", """SELECT o_orderkey, (SELECT max(e."end") FROM wrd e WHERE e.video_id = o.v AND e."end" <= o.t) AS before, (SELECT min(e.start) FROM wrd e WHERE e.video_id = o.v AND e.start >= o.t) AS after
FROM (SELECT o_orderkey, o_custkey AS v, CAST(o_orderkey * 173 % 2592000 AS DOUBLE) AS t FROM orders) o""", WORDS_SQL)
def as_of_words(spark, sf_dir):
    """The last word that ended by a time, and the first that began from it on."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("video_id"), (F.col("o_orderkey") * 173 % 2592000).cast("double").alias("t"))
    w = words(spark, sf_dir)
    both = as_of(as_of(o, "t", w, "video_id", "end", "before"), "t", w, "video_id", "start", "after", forward=True)
    return both.select("o_orderkey", "before", "after")


@query("j10_nearest", """SELECT o_orderkey, CASE WHEN b IS NULL AND a IS NULL THEN NULL WHEN a IS NULL OR t - b <= a - t THEN b ELSE a END AS nearest FROM (
  SELECT o_orderkey, t, (SELECT max(e.start) FROM wrd e WHERE e.video_id = o.v AND e.start <= o.t AND e.start >= o.t - 7200) AS b, (SELECT min(e.start) FROM wrd e WHERE e.video_id = o.v AND e.start >= o.t AND e.start <= o.t + 7200) AS a
  FROM (SELECT o_orderkey, o_custkey AS v, CAST(o_orderkey * 173 % 2592000 AS DOUBLE) AS t FROM orders) o)""", WORDS_SQL)
def nearest(spark, sf_dir):
    """The nearest word start within two hours, the earlier on a tie."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("video_id"), (F.col("o_orderkey") * 173 % 2592000).cast("double").alias("t"))
    w = words(spark, sf_dir)
    both = as_of(as_of(o, "t", w, "video_id", "start", "b"), "t", w, "video_id", "start", "a", forward=True)
    b, a = F.when(F.col("t") - F.col("b") <= 7200, F.col("b")), F.when(F.col("a") - F.col("t") <= 7200, F.col("a"))
    near = both.select("o_orderkey", "t", b.alias("b"), a.alias("a"))
    return near.select("o_orderkey", F.when(F.col("a").isNull() | (F.col("t") - F.col("b") <= F.col("a") - F.col("t")), F.col("b")).otherwise(F.col("a")).alias("nearest"))


@query("j12_result_hits", """SELECT s.video_id, s.sentence_idx, e.event_id FROM sent s JOIN (SELECT event_id, user_id % 100 AS video_id, event_id % 200 AS a, event_id % 200 + 10 AS b FROM events) e ON s.video_id = e.video_id AND s.start_sec <= e.b AND e.a <= s.end_sec""", SENTENCES_SQL)
def hits(spark, sf_dir):
    """Sentences that meet an expected window of their video (both ends closed), by cells."""
    s = sentences(spark, sf_dir).select("video_id", "sentence_idx", "start_sec", "end_sec")
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 100).alias("video_id"), (F.col("event_id") % 200).alias("a"), (F.col("event_id") % 200 + 10).alias("b"))
    cell = lambda x, y: F.explode(F.sequence(F.floor(x / 30), F.floor(y / 30)))
    met = s.withColumn("cell", cell(F.col("start_sec"), F.col("end_sec"))).join(e.withColumn("cell", cell(F.col("a"), F.col("b"))), ["video_id", "cell"])
    return met.filter("start_sec <= b AND a <= end_sec").select("video_id", "sentence_idx", "event_id").distinct()


@query("j13_best_iou", """SELECT doc_id, arg_max(j, struct_pack(iou := iou, o := -j)) AS best, max(iou) AS iou FROM (
  SELECT a.doc_id, b.doc_id AS j, greatest(0, least(a.doc_id % 50 + 20, b.doc_id % 60 + 30) - greatest(a.doc_id % 50, b.doc_id % 60)) / CAST(20 + 30 - greatest(0, least(a.doc_id % 50 + 20, b.doc_id % 60 + 30) - greatest(a.doc_id % 50, b.doc_id % 60)) AS DOUBLE) AS iou
  FROM documents a JOIN documents b ON a.source = b.source AND a.lang = b.lang) GROUP BY 1""")
def best_iou(spark, sf_dir):
    """The candidate of the same source and language that overlaps an expected window most, the first on a tie."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 50).alias("s"), (F.col("doc_id") % 50 + 20).alias("e"))
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("j"), "source", "lang", (F.col("doc_id") % 60).alias("cs"), (F.col("doc_id") % 60 + 30).alias("ce"))
    # windows repeat: one candidate, the first, stands for all of its bounds
    c = c.groupBy("source", "lang", "cs", "ce").agg(F.min("j").alias("j"))
    pairs = d.join(c, ["source", "lang"]).withColumn("iou", numbers.iou(F.col("s"), F.col("e"), F.col("cs"), F.col("ce")))
    return pairs.groupBy("doc_id").agg(F.max_by("j", F.struct("iou", -F.col("j"))).alias("best"), F.max("iou").alias("iou"))


@query("j14_labels", "SELECT l.quality, count(*) AS labels, count(*) FILTER (d.doc_id IS NULL) AS unmatched, coalesce(sum(d.n_chars), 0)::BIGINT AS chars FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang <> 'de') d ON l.doc_id = d.doc_id GROUP BY 1")
def labels(spark, sf_dir):
    """Labels by document; those without one are counted."""
    d = table(spark, sf_dir, "documents").filter("lang <> 'de'").select("doc_id", "n_chars")
    j = table(spark, sf_dir, "labels").join(d.withColumn("found", F.lit(True)), "doc_id", "left")
    return j.groupBy("quality").agg(F.count("*").alias("labels"), F.count_if(F.col("found").isNull()).alias("unmatched"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


@query("j15_dangling", """SELECT c.video_id, c.sentence_idx AS first, c.sentence_idx + 3 AS last, coalesce(list_sort(list(n.sentence_idx) FILTER (n.needs < c.sentence_idx)), []) AS dangling
FROM sent c LEFT JOIN need n ON n.video_id = c.video_id AND n.sentence_idx BETWEEN c.sentence_idx AND c.sentence_idx + 3 GROUP BY 1, 2""", SENTENCES_SQL, "need AS (SELECT video_id, sentence_idx, sentence_idx - 1 - n_words % 3 AS needs FROM sent WHERE role = 'assistant' AND sentence_idx > 2)")
def dangling(spark, sf_dir):
    """Of clips of four turns from each on, the turns that need one before the clip."""
    s = sentences(spark, sf_dir)
    i = F.col("sentence_idx")
    needs = s.filter("role = 'assistant' AND sentence_idx > 2").select("video_id", "sentence_idx", (i - 1 - F.col("n_words") % 3).alias("needs"))
    return dependencies.dangling(s.select("video_id", i.alias("first"), (i + 3).alias("last")), needs)


@query("j17_orphans", "SELECT doc_id, 'no label' AS why FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'no document' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def orphans(spark, sf_dir):
    """What either side lacks of the other."""
    d, label = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(label, "doc_id", "left_anti").withColumn("why", F.lit("no label")).unionByName(label.join(d, "doc_id", "left_anti").withColumn("why", F.lit("no document")))
