"""The smaller operators, one query each."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, texts, times
from ..operators import mutation, selection
from ..operators.intervals import as_of
from ..sources.library import SENTENCES_SQL, WORDS_SQL, sentences, table, words
from .registry import query


@query("s02_vector_integrity", "SELECT doc_id AS id, 'no vector' AS why FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'no chunk' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def vector_integrity(spark, sf_dir):
    """Chunks without a vector and vectors without a chunk, by key."""
    d, e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return d.join(e, "id", "left_anti").withColumn("why", F.lit("no vector")).unionByName(e.join(d, "id", "left_anti").withColumn("why", F.lit("no chunk")))


@query("s11_words_to_compute", "SELECT DISTINCT c_custkey AS video_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def words_to_compute(spark, sf_dir):
    """Videos without word times."""
    have = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id")).distinct().join(have, "video_id", "left_anti")


@query("s14_media_files", "SELECT host, arg_min(url, struct_pack(p := CASE WHEN starts_with(url, 'https') THEN 0 ELSE 1 END, u := url)) AS url FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, url FROM pages) GROUP BY 1")
def media_files(spark, sf_dir):
    """The preferred address of each host."""
    p = table(spark, sf_dir, "pages").select(texts.host(F.col("url")).alias("host"), "url")
    return p.groupBy("host").agg(F.min_by("url", F.struct(F.when(F.col("url").startswith("https"), 0).otherwise(1), "url")).alias("url"))


@query("k08_duplicate_guard", "SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) OR EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id) AS indexed FROM documents d")
def duplicate_guard(spark, sf_dir):
    """Whether each id is indexed in either table."""
    ids = table(spark, sf_dir, "labels").select("doc_id").unionByName(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))).distinct().withColumn("_in", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(ids, "doc_id", "left").select("doc_id", F.coalesce("_in", F.lit(False)).alias("indexed"))


@query("k10_point_update", "SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def point_update(spark, sf_dir):
    """One row's value set."""
    return mutation.update(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey") == 7, o_totalprice=F.lit(0.0))


@query("k11_feedback", "SELECT event_type AS verdict, count(*) AS n FROM events GROUP BY 1")
def feedback(spark, sf_dir):
    """Labels by verdict after an append."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("verdict"))
    return mutation.append_new(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["event_id"]).groupBy("verdict").agg(F.count("*").alias("n"))


@query("k13_run_history", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 200")
def run_history(spark, sf_dir):
    """Each tool's newest 200 runs."""
    from ..operators.ranking import cap

    return cap(table(spark, sf_dir, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], 200).select("event_type", "event_id")


@query("k17_reconcile", "SELECT DISTINCT o_custkey AS video_id, 'failed' AS status FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def reconcile(spark, sf_dir):
    """Videos of interrupted jobs that aren't indexed."""
    cut = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("video_id")).distinct()
    own = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("video_id"))
    return cut.join(own, "video_id", "left_anti").withColumn("status", F.lit("failed"))


@query("p02_defaults", "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_name END, 'Untitled') AS title, coalesce(CASE WHEN p_size > 40 THEN p_brand END, 'Creator Library') AS channel FROM part")
def defaults(spark, sf_dir):
    """Defaults where a field is absent."""
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_name")), F.lit("Untitled")).alias("title"), F.coalesce(F.when(F.col("p_size") > 40, F.col("p_brand")), F.lit("Creator Library")).alias("channel"))


@query("p03_spoken_only", "SELECT doc_id FROM documents WHERE NOT (lang = 'de' OR starts_with(text, 'The'))")
def spoken_only(spark, sf_dir):
    """Rows that are spoken: neither marked nor named otherwise."""
    return table(spark, sf_dir, "documents").filter(~((F.col("lang") == "de") | F.col("text").startswith("The"))).select("doc_id")


@query("p04_score_floor", "SELECT event_id FROM events WHERE value >= 10 AND value > -500")
def score_floor(spark, sf_dir):
    """Scores above an optional threshold and the suppression floor."""
    return table(spark, sf_dir, "events").filter("value >= 10 AND value > -500").select("event_id")


@query("p07_video_level", "SELECT vec_id, CASE WHEN label % 3 = 0 THEN -1.0 ELSE vec_id / 1000.0 END AS score FROM embeddings")
def video_level(spark, sf_dir):
    """Chunks that only have their video's picture score -1."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 3 == 0, -1.0).otherwise(F.col("vec_id") / 1000.0).alias("score"))


@query("p08_exists", "SELECT (SELECT count(*) FROM embeddings WHERE label = 4) > 0 AS any_ok, (SELECT count(*) FROM embeddings WHERE label = 99) > 0 AS none_ok")
def exists(spark, sf_dir):
    """Whether any row qualifies."""
    e = table(spark, sf_dir, "embeddings")
    return e.agg(F.coalesce(F.bool_or(F.col("label") == 4), F.lit(False)).alias("any_ok"), F.coalesce(F.bool_or(F.col("label") == 99), F.lit(False)).alias("none_ok"))


@query("p18_json_shape", "SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.missing') AS has_missing FROM events")
def json_shape(spark, sf_dir):
    """Whether documents hold their required keys."""
    has = lambda k: F.array_contains(F.json_object_keys("props"), k)
    return table(spark, sf_dir, "events").select("event_id", has("k").alias("has_k"), has("missing").alias("has_missing"))


@query("p19_first_seen", "SELECT source, min(doc_id) AS first FROM documents GROUP BY 1")
def first_seen(spark, sf_dir):
    """Sources by their first row."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))


@query("p20_media_type", r"SELECT page_id, regexp_matches(lower(url), '\.(mp4|mkv|webm|mov|mp3|wav|m4a)$') OR url LIKE 'https%' AS media FROM pages")
def media_type(spark, sf_dir):
    """Media by kind or ending."""
    return table(spark, sf_dir, "pages").select("page_id", (F.lower("url").rlike(r"\.(mp4|mkv|webm|mov|mp3|wav|m4a)$") | F.col("url").startswith("https")).alias("media"))


@query("p21_finite_signals", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN 1 ELSE 0 END + CASE WHEN l_discount > 0 THEN 1 ELSE 0 END AS n FROM lineitem")
def finite_signals(spark, sf_dir):
    """How many signals are numbers."""
    m = F.map_filter(F.create_map(F.lit("tax"), F.when(F.col("l_tax") > 0, F.col("l_tax")), F.lit("discount"), F.when(F.col("l_discount") > 0, F.col("l_discount"))), lambda k, v: v.isNotNull() & ~F.isnan(v))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.size(m).alias("n"))


@query("j11_winner_texts", "SELECT d.doc_id, d.text FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1 AND d.text <> ''")
def winner_texts(spark, sf_dir):
    """The texts of winners."""
    won = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return won.join(table(spark, sf_dir, "documents").filter("text <> ''"), "doc_id").select("doc_id", "text")


@query("a06_distinct_videos", "SELECT count(DISTINCT conv_id) AS videos, count(DISTINCT role) AS roles FROM conversations")
def distinct_videos(spark, sf_dir):
    """How many videos there are."""
    return table(spark, sf_dir, "conversations").agg(F.countDistinct("conv_id").alias("videos"), F.countDistinct("role").alias("roles"))


@query("a11_usage_merge", "SELECT user_id, CAST(sum(coalesce(CAST(props->>'$.k' AS BIGINT), 0)) AS BIGINT) AS tokens, arg_min(event_type, event_id) AS model FROM events GROUP BY 1")
def usage_merge(spark, sf_dir):
    """Tokens of all attempts, unknown ones as none, and the first model."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(k).alias("tokens"), F.min_by("event_type", "event_id").alias("model"))


@query("a20_cohesion", "SELECT label, round(sqrt(sum(v * v)), 5) AS cohesion FROM (SELECT label, d, sum(x) AS v FROM (SELECT label, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def cohesion(spark, sf_dir):
    """The length of each span's vector sum."""
    s = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.sum(F.col("x").cast("double")).alias("v"))
    return s.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 5).alias("cohesion"))


@query("w08_silence", """SELECT o_orderkey, round(coalesce(greatest(0.0, t - (SELECT max(e."end") FROM wrd e WHERE e.video_id = o.v AND e."end" <= o.t)), 0.0), 6) AS before, round(coalesce(greatest(0.0, (SELECT min(e.start) FROM wrd e WHERE e.video_id = o.v AND e.start >= o.t) - t), 0.0), 6) AS after
FROM (SELECT o_orderkey, o_custkey AS v, CAST(o_orderkey * 173 % 2592000 AS DOUBLE) AS t FROM orders) o""", WORDS_SQL)
def silence(spark, sf_dir):
    """Dead air around a time; none where nothing is known."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("video_id"), (F.col("o_orderkey") * 173 % 2592000).cast("double").alias("t"))
    w = words(spark, sf_dir)
    both = as_of(as_of(o, "t", w, "video_id", "end", "b"), "t", w, "video_id", "start", "a", forward=True)
    gap = lambda x: F.round(F.coalesce(F.greatest(F.lit(0.0), x), F.lit(0.0)), 6)
    return both.select("o_orderkey", F.when(F.col("b").isNull(), 0.0).otherwise(gap(F.col("t") - F.col("b"))).alias("before"), F.when(F.col("a").isNull(), 0.0).otherwise(gap(F.col("a") - F.col("t"))).alias("after"))


@query("w12_halves", """SELECT user_id, round(median(value) FILTER (p >= n // 2) - median(value) FILTER (p < n // 2), 6) AS delta FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1""")
def halves(spark, sf_dir):
    """The second half's median less the first's."""
    w = W.partitionBy("user_id")
    p = table(spark, sf_dir, "events").select("user_id", "value", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("p"), F.floor(F.count("*").over(w) / 2).alias("h"))
    half = lambda c: F.percentile(F.when(c, F.col("value")), 0.5)
    return p.groupBy("user_id").agg(F.round(half(F.col("p") >= F.col("h")) - half(F.col("p") < F.col("h")), 6).alias("delta"))


@query("t03_clip_order", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY round(n_chars / 7000.0, 4) DESC, n_chars % 100, doc_id) AS place FROM documents")
def clip_order(spark, sf_dir):
    """Clips by composite rounded to four places, start and id."""
    w = W.partitionBy("source").orderBy(F.desc(F.round(F.col("n_chars") / 7000.0, 4)), F.col("n_chars") % 100, "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.row_number().over(w).cast("bigint").alias("place"))


@query("t14_near_misses", "SELECT doc_id FROM documents WHERE n_chars < 3000 ORDER BY n_chars DESC, doc_id LIMIT 3")
def near_misses(spark, sf_dir):
    """The three best below the floor."""
    return table(spark, sf_dir, "documents").filter("n_chars < 3000").orderBy(F.desc("n_chars"), "doc_id").limit(3).select("doc_id")


@query("u04_stale_videos", "SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'")
def stale_videos(spark, sf_dir):
    """Videos with rows of an old shape."""
    return table(spark, sf_dir, "conversations").filter("role = 'system'").select("conv_id").distinct()


@query("u09_found_words", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS found FROM events GROUP BY 1")
def found_words(spark, sf_dir):
    """What was found, once each, sorted."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("found"))


@query("u10_subset", "SELECT p_partkey, len([x for x in string_split(p_name, ' ') if NOT list_contains(string_split(lower(p_type), ' '), x)]) = 0 AS held FROM part")
def subset(spark, sf_dir):
    """Whether a name's words are all of its type's."""
    return table(spark, sf_dir, "part").select("p_partkey", (F.size(F.array_except(F.split("p_name", " "), F.split(F.lower("p_type"), " "))) == 0).alias("held"))


@query("f09_cue_clocks", "SELECT o_orderkey, (o_orderkey * 997 % 360000000) / 1000.0 AS seconds FROM orders")
def cue_clocks(spark, sf_dir):
    """Subtitle times written and parsed."""
    s = F.col("o_orderkey") * 997 % 360_000_000 / 1000.0
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(times.parse_cue_clock(times.cue_clock(s)), 3).alias("seconds"))


@query("f10_whole_seconds", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS low, CAST(ceil(o_totalprice) AS BIGINT) AS high FROM orders")
def whole_seconds(spark, sf_dir):
    """Times rounded outwards."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("low"), F.ceil("o_totalprice").alias("high"))


@query("f22_video_ids", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN lpad(CAST(page_id AS VARCHAR), 11, 'x') WHEN page_id % 3 = 1 THEN lpad(CAST(page_id AS VARCHAR), 11, '_') END AS id FROM pages")
def video_ids(spark, sf_dir):
    """Video ids from addresses and as they are."""
    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), F.lpad(k.cast("string"), 11, "x"), F.lit("&t=3"))).when(k % 3 == 1, F.lpad(k.cast("string"), 11, "_")).otherwise("nothing here at all")
    return table(spark, sf_dir, "pages").select("page_id", texts.video_id(url).alias("id"))


@query("f23_containment", r"SELECT d.doc_id, contains(lower(trim(regexp_replace(d.text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(left(d.text, 40), '\s+', ' ', 'g')))) AS held FROM documents d")
def containment(spark, sf_dir):
    """Whether a text holds its own beginning, white space and case aside."""
    return table(spark, sf_dir, "documents").select("doc_id", texts.squash(F.col("text")).contains(texts.squash(F.substring("text", 1, 40))).alias("held"))


@query("f24_letters", "SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g') AS plain FROM conversations")
def letters(spark, sf_dir):
    """Texts as quotes are compared."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.letters_only(F.col("text")).alias("plain"))


@query("f27_titles", "SELECT p_partkey, 'Part ' || p_partkey || ' File' AS title FROM part")
def titles(spark, sf_dir):
    """Titles from file names."""
    return table(spark, sf_dir, "part").select("p_partkey", texts.title_of(F.concat(F.lit("part_"), F.col("p_partkey").cast("string"), F.lit("-file.mp4"))).alias("title"))


@query("f32_match_reason", "SELECT p_partkey, CASE WHEN p_size > 30 THEN 'Matches ' || split_part(p_name, ' ', 1) || ' and ' || split_part(p_name, ' ', 2) WHEN p_size > 10 THEN 'Discusses ' || p_type ELSE 'Related passage' END AS reason FROM part")
def match_reason(spark, sf_dir):
    """Why a result matches."""
    n, s = F.split("p_name", " "), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(s > 30, F.concat(F.lit("Matches "), F.get(n, F.lit(0)), F.lit(" and "), F.coalesce(F.get(n, F.lit(1)), F.lit("")))).when(s > 10, F.concat(F.lit("Discusses "), F.col("p_type"))).otherwise("Related passage").alias("reason"))


@query("f37_caption_case", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS word FROM events")
def caption_case(spark, sf_dir):
    """Captions in capitals or as they are."""
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("word"))


@query("r08_rerank", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 4) AS score FROM events")
def rerank(spark, sf_dir):
    """A reranker's logits as scores."""
    return table(spark, sf_dir, "events").select("event_id", numbers.sigmoid((F.col("value") - 50) / 10).alias("score"))


@query("r12_envelope", "SELECT count(*) AS total_chunks_scanned, count(DISTINCT conv_id) AS library_video_count, 'spoken' AS search_mode, false AS degraded FROM conversations")
def envelope(spark, sf_dir):
    """What stands around results."""
    return table(spark, sf_dir, "conversations").agg(F.count("*").alias("total_chunks_scanned"), F.countDistinct("conv_id").alias("library_video_count"), F.lit("spoken").alias("search_mode"), F.lit(False).alias("degraded"))


@query("n03_summaries", r"SELECT video_id, left(trim(regexp_replace(string_agg(text, ' ' ORDER BY sentence_idx), '\s+', ' ', 'g')), 140) AS summary FROM (SELECT * FROM sent QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY sentence_idx) <= 2) GROUP BY 1", SENTENCES_SQL)
def summaries(spark, sf_dir):
    """The first two sentences, 140 characters at most."""
    w = W.partitionBy("video_id").orderBy("sentence_idx")
    two = sentences(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r <= 2").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("sentence_idx", "text"))).alias("t"))
    return two.select("video_id", F.substring(F.trim(F.regexp_replace(F.array_join("t.text", " "), r"\s+", " ")), 1, 140).alias("summary"))


@query("n04_window_plan", "SELECT source, CASE WHEN sum(n_chars) <= 60000 OR count(*) <= 60 THEN 'whole' ELSE 'windows' END AS plan FROM documents GROUP BY 1")
def window_plan(spark, sf_dir):
    """Whether a transcript goes whole or in windows."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.when((F.sum("n_chars") <= 60_000) | (F.count("*") <= 60), "whole").otherwise("windows").alias("plan"))


@query("n12_manual_snap", """SELECT o_orderkey, CASE WHEN near IS NOT NULL THEN greatest(0.0, near - 0.12) ELSE t END AS new_start FROM (SELECT o_orderkey, t, (SELECT arg_min(w.start, struct_pack(d := abs(w.start - o.t), s := w.start)) FROM wrd w WHERE w.video_id = o.v AND abs(w.start - o.t) <= 1.2) AS near FROM (SELECT o_orderkey, o_custkey AS v, CAST(o_orderkey * 173 % 2592000 AS DOUBLE) AS t FROM orders) o)""", WORDS_SQL)
def manual_snap(spark, sf_dir):
    """A dragged edge on the nearest word either way."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("video_id"), (F.col("o_orderkey") * 173 % 2592000).cast("double").alias("t"))
    w = words(spark, sf_dir)
    both = as_of(as_of(o, "t", w, "video_id", "start", "b"), "t", w, "video_id", "start", "a", forward=True)
    t, b, a = F.col("t"), F.col("b"), F.col("a")
    near = F.when(a.isNull() | (t - b <= a - t), b).otherwise(a)
    return both.select("o_orderkey", F.when(F.abs(near - t) <= selection.SNAP, F.greatest(F.lit(0.0), near - selection.LEAD_IN)).otherwise(t).alias("new_start"))


@query("g01_hook_strength", "SELECT l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, ((0.2 * l_tax + 0.8 * l_discount * 5) - 0.0164) / (0.4314 - 0.0164)) + CASE WHEN l_linenumber = 1 THEN 0.15 ELSE 0 END), 6) AS hook FROM lineitem WHERE (0.2 * l_tax + 0.8 * l_discount * 5 - 0.0164) / (0.4314 - 0.0164) <= 1")
def hook_strength(spark, sf_dir):
    """The blend of meaning and cues on its range, with a beat's bonus."""
    raw = 0.2 * F.col("l_tax") + 0.8 * F.col("l_discount") * 5
    rows = table(spark, sf_dir, "lineitem").filter((raw - 0.0164) / (0.4314 - 0.0164) <= 1)
    bonus = F.when(F.col("l_linenumber") == 1, 0.15).otherwise(0.0)
    return rows.select("l_orderkey", "l_linenumber", F.round(numbers.clamp01(numbers.normalise(raw, 0.0164, 0.4314) + bonus), 6).alias("hook"))


@query("g06_taste", """SELECT e.vec_id, round(greatest(0.0, least(1.0, (list_dot_product(e.embedding::DOUBLE[], c.v) + 1) / 2)), 5) AS taste FROM embeddings e, (SELECT list(v ORDER BY d) AS v FROM (SELECT d, v / sqrt(sum(v * v) OVER ()) AS v FROM (SELECT d, avg(x) AS v FROM (SELECT unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label = 1) GROUP BY 1))) c""")
def taste(spark, sf_dir):
    """How near each vector is to the winners' mean, which alone is broadcast."""
    e = table(spark, sf_dir, "embeddings")
    mean = e.filter("label = 1").select(F.posexplode("embedding").alias("d", "x")).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("v")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("v"))
    centre = mean.select("v", numbers.norm(F.col("v")).alias("len"))
    return e.join(F.broadcast(centre)).select("vec_id", F.round(numbers.clamp01((numbers.dot(F.col("embedding"), F.col("v")) / F.col("len") + 1) / 2), 5).alias("taste"))


@query("m01_visual_retries", "SELECT doc_id FROM documents WHERE lang = 'en' OR (lang = 'fr' AND source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 1))")
def visual_retries(spark, sf_dir):
    """Rows to try again: never tried, or upgradeable where media exists."""
    media = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    status = F.when(F.col("lang") == "fr", "video-level").when(F.col("lang") == "de", "failed").when(F.col("lang") != "en", "ok")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", status.alias("status"), F.lit(False).alias("gave_up"))
    return mutation.to_retry(d, media, "source", "status", "gave_up").select("doc_id")


@query("m06_transcript_input", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'library' WHEN source = 'src1' THEN 'timed' ELSE 'plain' END AS kind, n_chars <= 15000 AS short_enough FROM documents")
def transcript_input(spark, sf_dir):
    """Where a tool's transcript comes from."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "library").when(F.col("source") == "src1", "timed").otherwise("plain").alias("kind"), (F.col("n_chars") <= 15_000).alias("short_enough"))


@query("m10_hook_report", "SELECT count(*) AS n, avg(CASE WHEN s >= 0.999 THEN 1.0 ELSE 0 END) AS saturated, quantile_disc(s, 0.5) AS middle FROM (SELECT least(1.0, n_chars / 5000.0) AS s FROM documents)")
def hook_report(spark, sf_dir):
    """How scores spread, and how many are at the top."""
    d = table(spark, sf_dir, "documents").select(F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("s"))
    return d.agg(F.count("*").alias("n"), F.avg((F.col("s") >= 0.999).cast("double")).alias("saturated"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY s)").alias("middle"))
