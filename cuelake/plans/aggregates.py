"""Library statistics, term statistics, usage and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import metrics, retrieval
from ..sources.library import SENTENCES_SQL, sentences, table
from .registry import query

TERMS_SQL = r"""terms AS (SELECT * FROM (
  SELECT video_id, sentence_idx, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'n''t\b', ' not', 'gi'), '''re\b', ' are', 'gi'), '''ve\b', ' have', 'gi'), '''ll\b', ' will', 'gi'), '''d\b', ' would', 'gi'), '''m\b', ' am', 'gi'), '[\p{L}\p{N}_]+')) AS term
  FROM sent) WHERE regexp_full_match(term, '[a-zA-Z]+'))"""


@query("a01_library_stats", "SELECT count(*) FILTER (o_orderstatus = 'F') AS indexed, count(*) FILTER (o_orderstatus = 'O') AS indexing, count(*) FILTER (o_orderstatus = 'P') AS failed, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice / 100) ELSE 0 END) AS BIGINT) AS seconds, count(*) FILTER (o_orderstatus = 'F') = count(*) AS is_fully_indexed FROM orders")
def library_stats(spark, sf_dir):
    """Counts by status and the indexed length, in one pass."""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(F.count_if(s == "F").alias("indexed"), F.count_if(s == "O").alias("indexing"), F.count_if(s == "P").alias("failed"), F.sum(F.when(s == "F", F.floor(F.col("o_totalprice") / 100)).otherwise(0)).alias("seconds"), (F.count_if(s == "F") == F.count("*")).alias("is_fully_indexed"))


@query("a02_idf", "SELECT term, count(*) AS df, round(ln((n + 1.0) / (count(*) + 1)) + 1, 6) AS idf FROM (SELECT DISTINCT video_id, sentence_idx, term FROM terms), (SELECT count(*) AS n FROM sent) GROUP BY term, n", SENTENCES_SQL, TERMS_SQL)
def idf(spark, sf_dir):
    """Each term's sentences and inverse frequency."""
    return retrieval.idf(sentences(spark, sf_dir), "text").select("term", "df", F.round("idf", 6).alias("idf"))


@query("a03_bm25_stats", """SELECT (SELECT count(*) FROM sent) AS n, (SELECT round(avg(len(regexp_extract_all(lower(text), '[a-z0-9'']+'))), 6) FROM sent) AS avgdl, count(DISTINCT t) AS terms FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS t FROM sent)""", SENTENCES_SQL)
def bm25_stats(spark, sf_dir):
    """Documents, mean length and terms."""
    t = texts.tokens(F.col("text"))
    s = sentences(spark, sf_dir)
    return s.agg(F.count("*").alias("n"), F.round(F.avg(F.size(t)), 6).alias("avgdl")).crossJoin(s.select(F.explode(t).alias("t")).agg(F.countDistinct("t").alias("terms")))


@query("a04_concepts", """SELECT concept, sum(w)::BIGINT AS weight FROM (SELECT lower(trim(unnest(string_split(p_name, ' ')))) AS concept, 1 AS w FROM part UNION ALL SELECT lower(trim(unnest(string_split(p_type, ' ')))), 2 FROM part) WHERE length(concept) >= 3 GROUP BY 1""")
def concepts(spark, sf_dir):
    """Concepts by weight: twice for a topic's part, once for a concept."""
    p = table(spark, sf_dir, "part")
    part = lambda c, w: p.select(F.explode(F.split(F.lower(c), " ")).alias("concept"), F.lit(w).alias("w"))
    return part("p_name", 1).unionByName(part("p_type", 2)).filter(F.length("concept") >= 3).groupBy("concept").agg(F.sum("w").alias("weight"))


@query("a05_ngrams", """SELECT g, n, count(*) AS c FROM (SELECT unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g, 2 AS n FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM conversations)
 UNION ALL SELECT unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]), 3 FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM conversations)) GROUP BY 1, 2 HAVING count(*) > 1""")
def ngrams(spark, sf_dir):
    """Bigrams and trigrams that occur twice or more."""
    w = table(spark, sf_dir, "conversations").select(texts.tokens(F.col("text")).alias("w"))
    each = F.explode(F.concat(_tagged(2), _tagged(3)))
    return w.select(each.alias("x")).groupBy("x.g", "x.n").agg(F.count("*").alias("c")).filter("c > 1")


def _tagged(n):
    return F.transform(texts.ngrams(F.col("w"), n), lambda g: F.struct(g.alias("g"), F.lit(n).alias("n")))


@query("a07_usage_summary", """SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 1 HOUR) AS hour, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY) AS day, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 30 DAY) AS month,
  CAST(coalesce(sum(CAST(props->>'$.k' AS BIGINT)) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 30 DAY), 0) AS BIGINT) AS tokens, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS last_model FROM events GROUP BY 1""")
def usage_summary(spark, sf_dir):
    """Trailing hour, day and month, tokens and the last model, in one pass."""
    e = table(spark, sf_dir, "events")
    since = lambda span: F.expr(f"ts >= TIMESTAMP_NTZ'2024-01-30 00:00:00' - INTERVAL {span}")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.groupBy("user_id").agg(F.count_if(since("1 HOUR")).alias("hour"), F.count_if(since("1 DAY")).alias("day"), F.count_if(since("30 DAYS")).alias("month"), F.coalesce(F.sum(F.when(since("30 DAYS"), k)), F.lit(0)).alias("tokens"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_model"))


@query("a08_dominance", "SELECT user_id, arg_max(event_type, struct_pack(c := c, t := event_type)) AS kind, round(max(c) / sum(c)::DOUBLE, 6) AS share, max(c) / sum(c)::DOUBLE > 0.6 AS dominates FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1")
def dominance(spark, sf_dir):
    """The commonest kind and whether it has more than 60 %."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    share = F.max("c") / F.sum("c")
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("c", "event_type")).alias("kind"), F.round(share, 6).alias("share"), (share > 0.6).alias("dominates"))


@query("a09_centroid", """SELECT label, d, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 5) AS v FROM (SELECT label, d, avg(x) AS v FROM (SELECT label, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2)""")
def centroid(spark, sf_dir):
    """Each label's mean vector at length one."""
    means = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("v"))
    size = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("label")))
    return means.select("label", F.col("d").cast("bigint").alias("d"), F.round(F.col("v") / size, 5).alias("v"))


@query("a10_contour", """SELECT user_id, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) AS range, round(avg(value), 6) AS mean, max(value) AS peak, round(count(*) FILTER (value > 20)::DOUBLE / count(*), 6) AS voiced FROM events GROUP BY 1""")
def contour(spark, sf_dir):
    """A contour's median, spread, mean, peak and voiced share."""
    e, v = table(spark, sf_dir, "events"), F.col("value")
    sums = e.groupBy("user_id").agg(F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("peak"), F.round(F.count_if(v > 20) / F.count("*"), 6).alias("voiced"))
    spread = metrics.percentiles(e, "user_id", "value", {"low": 0.1, "middle": 0.5, "high": 0.9})
    return sums.join(spread, "user_id").select("user_id", F.round("middle", 6).alias("median"), F.round(F.col("high") - F.col("low"), 6).alias("range"), "mean", "peak", "voiced")


_RESULTS_SQL = "res AS (SELECT item_id AS query, row_number() OVER (PARTITION BY item_id ORDER BY (video_id * 31 + item_id * 17 + sentence_idx) % 101, video_id, sentence_idx) AS rank, video_id, start_sec, end_sec, n_words AS words FROM benchmark b JOIN sent ON video_id % 10 = item_id % 10 QUALIFY rank <= 5)"
_EXPECTED_SQL = "exp AS (SELECT item_id AS query, CASE WHEN item_id % 4 < 3 THEN item_id % 10 END AS video_id, CASE WHEN item_id % 4 < 3 THEN item_id % 7 * 10 END AS a, CASE WHEN item_id % 4 < 3 THEN item_id % 7 * 10 + 15 END AS b FROM benchmark)"


def _results(spark, sf_dir):
    """Five results a benchmark item from every tenth video, in an order by numbers, and windows that three of four items expect."""
    b, s = table(spark, sf_dir, "benchmark"), sentences(spark, sf_dir)
    met = b.select("item_id", (F.col("item_id") % 10).alias("m")).join(s.withColumn("m", F.col("video_id") % 10), "m")
    order = W.partitionBy("item_id").orderBy((F.col("video_id") * 31 + F.col("item_id") * 17 + F.col("sentence_idx")) % 101, "video_id", "sentence_idx")
    found = met.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select(F.col("item_id").alias("query"), "rank", "video_id", "start_sec", "end_sec", F.col("n_words").alias("words"))
    i = F.col("item_id")
    of = lambda c: F.when(i % 4 < 3, c)
    return found, b.select(i.alias("query"), of(i % 10).alias("video_id"), of(i % 7 * 10).alias("a"), of(i % 7 * 10 + 15).alias("b"))


@query("a12_retrieval_metrics", """SELECT count(video_id) AS n_positive, count(*) - count(video_id) AS n_negative, round(avg(CASE WHEN coalesce(rank, 9) <= 1 THEN 1.0 ELSE 0 END) FILTER (pos), 6) AS recall_1, round(avg(CASE WHEN coalesce(rank, 9) <= 3 THEN 1.0 ELSE 0 END) FILTER (pos), 6) AS recall_3, round(avg(CASE WHEN coalesce(rank, 9) <= 5 THEN 1.0 ELSE 0 END) FILTER (pos), 6) AS recall_5,
  round(avg(coalesce(1.0 / rank, 0)) FILTER (pos), 6) AS mrr, round(avg(greatest(0, a - s, s - b)) FILTER (pos AND rank IS NOT NULL), 6) AS seek_error, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0 END) FILTER (NOT pos), 6) AS false_positive_rate, round(avg(n) FILTER (pos), 6) AS mean_results, round(sum(w) FILTER (pos) / sum(n) FILTER (pos), 6) AS mean_quote_words, max(longest) FILTER (pos) AS max_quote_words
FROM (SELECT e.*, e.video_id IS NOT NULL AS pos, h.rank, h.s, coalesce(c.n, 0) AS n, c.w, c.longest FROM exp e
  LEFT JOIN (SELECT r.query, min(rank) AS rank, arg_min(start_sec, rank) AS s FROM res r JOIN exp e ON r.query = e.query AND r.video_id = e.video_id AND r.start_sec <= e.b AND e.a <= r.end_sec GROUP BY 1) h USING (query)
  LEFT JOIN (SELECT query, count(*) AS n, sum(words) AS w, max(words) AS longest FROM res GROUP BY 1) c USING (query))""", SENTENCES_SQL, _RESULTS_SQL, _EXPECTED_SQL)
def retrieval_metrics(spark, sf_dir):
    """Recall, reciprocal rank, seek error, false positives and volume of a search's results."""
    report = metrics.retrieval_report(*_results(spark, sf_dir))
    return report.select([F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in report.dtypes])


@query("m12_ranker_ablation")
def ranker_ablation(spark, sf_dir):
    """The same report of all results and of those at odd ranks alone, side by side."""
    found, expected = _results(spark, sf_dir)
    return metrics.ablation({"all": metrics.retrieval_report(found, expected), "odd": metrics.retrieval_report(found.filter("rank % 2 = 1"), expected)}, "all")


@query("a14_nearest_rank", """SELECT source, percent, n_chars FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents), (SELECT unnest([5, 50, 95, 99]) AS percent) WHERE p = round_even(percent / 100.0::DOUBLE * (n - 1), 0)""")
def nearest_rank(spark, sf_dir):
    """Percentiles by nearest rank."""
    return metrics.nearest_rank(table(spark, sf_dir, "documents"), "source", "n_chars", [5, 50, 95, 99])


@query("a15_auc", """SELECT round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg FROM (SELECT quality AS y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM (SELECT quality, floor(n_chars / 100) AS s FROM labels JOIN documents USING (doc_id)))""")
def auc(spark, sf_dir):
    """The ROC area of document length for quality, ties at their mean rank."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("quality", F.floor(F.col("n_chars") / 100).alias("s"))
    return metrics.auc(rows, "quality", "s").withColumn("auc", F.round("auc", 6))


@query("a16_class_medians", "SELECT median(n_chars) FILTER (quality = 1) AS pos, median(n_chars) FILTER (quality = 0) AS neg, median(n_chars) FILTER (quality = 1) - median(n_chars) FILTER (quality = 0) AS delta FROM labels JOIN documents USING (doc_id)")
def class_medians(spark, sf_dir):
    """Each class's median and their difference."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    middles = metrics.percentiles(rows, "quality", "n_chars", {"m": 0.5})
    of = lambda q: F.max(F.when(F.col("quality") == q, F.col("m")))  # noqa: E731  # a row a class
    return middles.agg(of(1).alias("pos"), of(0).alias("neg"), (of(1) - of(0)).alias("delta"))


@query("a18_shot_length", "SELECT video_id, count(*) AS cuts, round(avg(gap), 2) AS mean_shot FROM (SELECT user_id AS video_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events WHERE event_type = 'click') WHERE gap IS NOT NULL GROUP BY 1")
def shot_length(spark, sf_dir):
    """The mean gap between cuts."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click'").withColumn("t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"))
    gap = (F.col("t") - F.lag("t").over(W.partitionBy("user_id").orderBy("ts", "event_id"))) / 1e6
    return e.select(F.col("user_id").alias("video_id"), gap.alias("gap")).filter("gap IS NOT NULL").groupBy("video_id").agg(F.count("*").alias("cuts"), F.round(F.avg("gap"), 2).alias("mean_shot"))


@query("a19_word_counts", "SELECT role, CAST(sum(n_words) AS BIGINT) AS words, max(n_words) AS longest FROM sent GROUP BY 1", SENTENCES_SQL)
def word_counts(spark, sf_dir):
    """Words by role."""
    return sentences(spark, sf_dir).groupBy("role").agg(F.sum("n_words").alias("words"), F.max("n_words").alias("longest"))


@query("a21_merged_notes", "SELECT lang, list_sort(list(DISTINCT source)) AS sources, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def merged_notes(spark, sf_dir):
    """Distinct notes of all windows, sorted."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n"))


@query("a13_clip_metrics", """SELECT (SELECT count(*) FROM ex) AS examples, (SELECT count(*) FROM cand) AS candidates, round(count(*) / (SELECT count(*) FROM ex)::DOUBLE, 6) AS coverage, round(avg(iou), 6) AS mean_iou, round(avg((abs(start_sec - a) + abs(end_sec - b)) / 2.0), 6) AS boundary_error, round(avg(CASE WHEN setup IS NULL THEN NULL WHEN first <= setup THEN 1.0 ELSE 0 END), 6) AS setup_containment,
  (SELECT round(avg(CASE WHEN s.video_id IS NULL THEN 1.0 ELSE 0 END), 6) FROM cand c LEFT JOIN (SELECT DISTINCT video_id, start_sec FROM sent) s ON c.video_id = s.video_id AND c.start_sec = s.start_sec) AS mid_sentence_starts
FROM (SELECT *, shared / (greatest(end_sec, b) - least(start_sec, a))::DOUBLE AS iou FROM (SELECT *, greatest(0, least(end_sec, b) - greatest(start_sec, a)) AS shared FROM ex JOIN cand USING (video_id)) WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY example ORDER BY shared / (greatest(end_sec, b) - least(start_sec, a))::DOUBLE DESC, start_sec, end_sec, first) = 1)""", SENTENCES_SQL,
  "cand AS (SELECT video_id, sentence_idx AS first, start_sec + CASE WHEN sentence_idx % 3 = 1 THEN 1 ELSE 0 END AS start_sec, end_sec + 7 AS end_sec FROM sent WHERE role = 'user')", "ex AS (SELECT video_id * 1000 + sentence_idx AS example, video_id, start_sec AS a, end_sec + 12 AS b, CASE WHEN sentence_idx > 1 THEN sentence_idx - 1 END AS setup FROM sent WHERE role = 'assistant')")
def clip_metrics(spark, sf_dir):
    """Users' turns, some of them late, as clips for what the assistants say: coverage, overlap, bounds, setups, clean starts."""
    s = sentences(spark, sf_dir)
    i = F.col("sentence_idx")
    clips = s.filter("role = 'user'").select("video_id", i.alias("first"), (F.col("start_sec") + F.when(i % 3 == 1, 1).otherwise(0)).alias("start_sec"), (F.col("end_sec") + 7).alias("end_sec"))
    examples = s.filter("role = 'assistant'").select((F.col("video_id") * 1000 + i).alias("example"), "video_id", F.col("start_sec").alias("a"), (F.col("end_sec") + 12).alias("b"), F.when(i > 1, i - 1).alias("setup"))
    report = metrics.clip_report(clips, examples, s.select("video_id", "start_sec"))
    return report.select([F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in report.dtypes])


@query("a22_throttle_snapshot", "SELECT event_type AS bucket, count(*) AS calls FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def throttle_snapshot(spark, sf_dir):
    """Calls of the last hour by bucket; the filter reaches the scan."""
    e = table(spark, sf_dir, "events").filter(F.expr("ts > TIMESTAMP_NTZ'2024-01-15 11:00:00' AND ts <= TIMESTAMP_NTZ'2024-01-15 12:00:00'"))
    return e.groupBy(F.col("event_type").alias("bucket")).agg(F.count("*").alias("calls"))
