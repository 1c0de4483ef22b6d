"""Search: BM25 and dense rankings, fusion, gates, windows and quotes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import inverted, retrieval
from ..operators import search as found
from ..sources import scratch
from ..sources.library import SENTENCES_SQL, sentences, table
from .registry import query

BM25_SQL = """post AS (SELECT video_id, sentence_idx, len(t) AS dl, unnest(t) AS term FROM (SELECT video_id, sentence_idx, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t FROM sent)),
tf AS (SELECT video_id, sentence_idx, dl, term, count(*) AS tf FROM post GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS avgdl FROM sent),
raw AS (SELECT term, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), size),
weight AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS term FROM benchmark) GROUP BY 1, 2),
scored AS (SELECT item_id, video_id, sentence_idx, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN tf USING (term) JOIN weight USING (term) GROUP BY 1, 2, 3)"""


def _bm25(spark, sf_dir):
    s = sentences(spark, sf_dir)
    return retrieval.bm25(s.select("video_id", "sentence_idx", "text"), ["video_id", "sentence_idx"], "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("r04_bm25", "SELECT item_id, video_id, sentence_idx, round(score, 5) AS score FROM scored", SENTENCES_SQL, BM25_SQL)
def bm25(spark, sf_dir):
    """The BM25 score of every sentence that shares a term with a query."""
    return _bm25(spark, sf_dir).withColumn("score", F.round("score", 5))


@query("f01_search", """SELECT item_id, rank, video_id, sentence_idx, round(score, 4) AS score FROM (SELECT item_id, video_id, sentence_idx, round(score, 8) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, video_id, sentence_idx) AS rank FROM scored) WHERE rank <= 30""", SENTENCES_SQL, BM25_SQL)
def search(spark, sf_dir):
    """Each query's pool of 30 sentences."""
    scored = _bm25(spark, sf_dir).withColumn("score", F.round("score", 8))
    return retrieval.top(scored, "item_id", ["video_id", "sentence_idx"]).select("item_id", "rank", "video_id", "sentence_idx", F.round("score", 4).alias("score"))


@query("r02_dense", """SELECT q, vec_id, rank FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0) WHERE rank <= 10""")
def dense(spark, sf_dir):
    """The ten nearest vectors of every fiftieth vector."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return retrieval.nearest(asked, "q", "v", e, "vec_id", "embedding", 10).select("q", "vec_id", "rank")


@query("r05_fusion", """SELECT item_id, video_id, sentence_idx, round(score, 8) AS score FROM (SELECT item_id, video_id, sentence_idx, sum(1.0 / (60 + rank)) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, video_id, sentence_idx) AS rank FROM scored UNION ALL
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sentence_idx, video_id) AS rank FROM scored) WHERE rank <= 30 GROUP BY 1, 2, 3)""", SENTENCES_SQL, BM25_SQL)
def fusion(spark, sf_dir):
    """Two rankings fused by reciprocal rank: BM25, and earliest first."""
    scored = _bm25(spark, sf_dir).withColumn("score", F.round("score", 8))
    first = retrieval.top(scored, "item_id", ["video_id", "sentence_idx"])
    second = retrieval.top(scored.withColumn("score", -F.col("sentence_idx").cast("double")), "item_id", ["video_id"])
    return retrieval.fuse([first, second], "item_id", ["video_id", "sentence_idx"]).withColumn("score", F.round("score", 8))


@query("r03_tfidf", r"""SELECT item_id, doc_id, round(s, 6) AS score FROM (SELECT item_id, doc_id, sum(q.w * d.w) AS s FROM
  (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM (SELECT item_id, term, tf * (ln((n + 1.0) / (df + 1)) + 1) AS w FROM (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS term FROM benchmark) GROUP BY 1, 2) JOIN df USING (term), (SELECT count(*) AS n FROM small))) q
  JOIN (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM (SELECT doc_id, term, tf * (ln((n + 1.0) / (df + 1)) + 1) AS w FROM dt JOIN df USING (term), (SELECT count(*) AS n FROM small))) d USING (term) GROUP BY 1, 2)""",
  "small AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)", "dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS term FROM small) GROUP BY 1, 2)", "df AS (SELECT term, count(*) AS df FROM dt GROUP BY 1)")
def tfidf(spark, sf_dir):
    """The TF-IDF cosine of each query with each document that shares a term."""
    return retrieval.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("score", F.round("score", 6))


@query("r06_hybrid", """SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT item_id, doc_id, round(sum(1.0 / (60 + r)), 8) AS score FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, doc_id) AS r FROM lexical UNION ALL
    SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 8) DESC, d.doc_id) FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e JOIN documents d ON d.doc_id = e.vec_id)
  GROUP BY 1, 2)) WHERE rank <= 30""",
  "post AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS t FROM documents))", "tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM post GROUP BY ALL)",
  "size AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+'))) AS avgdl FROM documents)", "raw AS (SELECT term, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), size)",
  "weight AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw)", "asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS term FROM benchmark) GROUP BY 1, 2)",
  "lexical AS (SELECT item_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN tf USING (term) JOIN weight USING (term) GROUP BY 1, 2)")
def hybrid(spark, sf_dir):
    """Each benchmark item's 30 documents by dense and lexical rank together; documents without a vector have a lexical rank alone. Scores are written, as they are looked at three times and cost a pass over all texts or vectors."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    lexical = scratch.written(retrieval.bm25_by_counts(d, ["doc_id"], "text", b, "item_id", "text"), scratch.folder(spark, "lexical"))
    asked = b.join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), "item_id").select("item_id", "v")
    vectors = e.withColumnRenamed("vec_id", "doc_id").join(d.select("doc_id"), "doc_id", "left_semi")
    dense = scratch.written(retrieval.dense(asked, "item_id", "v", vectors, "doc_id", "embedding"), scratch.folder(spark, "dense"))
    return found.fused(lexical, dense, "item_id", ["doc_id"]).select("item_id", "rank", "doc_id", "score")


_LEFT_SQL = """left_ AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0)""", """toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t FROM left_)""", """post AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks)""", "tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM post GROUP BY ALL)", """size AS (SELECT (SELECT count(*) FROM left_) AS n, (SELECT avg(len(t)) FROM toks) AS avgdl)""", """raw AS (SELECT term, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), size)""", """weight AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw)""", """asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS term FROM benchmark) GROUP BY 1, 2)"""


@query("st5_persisted_index", """SELECT item_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN tf USING (term) JOIN weight USING (term) GROUP BY 1, 2)) WHERE rank <= 10""", *_LEFT_SQL)
def persisted(spark, sf_dir):
    """Each item's ten best documents by an index on disk, to which documents came in two deltas and from which a third took some."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = inverted.Index(spark, scratch.folder(spark, "index"), "doc_id bigint", buckets=16, concepts=False)
    index.append("first", d.filter("doc_id % 2 = 0"), "text")
    index.append("second", d.filter("doc_id % 2 <> 0"), "text")
    index.append("gone", d.filter("doc_id % 7 = 0"), "text", -1)
    scored = index.bm25(["first", "second", "gone"], table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("score", F.round("score", 6))
    return retrieval.top(scored, "item_id", ["doc_id"], 10).select("item_id", "doc_id", "rank")


@query("r09_results")
def results(spark, sf_dir):
    """Search end to end: pool, sentences around, merged ranges, suppression, gates, near misses. A score is the share of the query's best."""
    s = sentences(spark, sf_dir)
    pool = found.fused(_bm25(spark, sf_dir), None, "item_id", ["video_id", "sentence_idx"])
    wide = found.merged(pool.withColumn("score", F.col("score") / F.max("score").over(W.partitionBy("item_id"))), s, "item_id")
    return found.decide(wide, "item_id", 5).withColumn("score", F.round("score", 6))


@query("r11_focus_quote")
def focus(spark, sf_dir):
    """Quotes of long conversations shrunk to 55 words and 25 seconds around their middle sentence."""
    from ..operators.selection import focus_quotes

    return focus_quotes(sentences(spark, sf_dir))


@query("r13_suggested", """SELECT 'Where did I talk about ' || concept || '?' AS query FROM (SELECT concept, sum(w) AS f, min(length(concept)) FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS concept, 1 AS w FROM part UNION ALL SELECT lower(unnest(string_split(p_type, ' '))), 2 FROM part) WHERE length(concept) >= 3 GROUP BY 1) ORDER BY ln(1 + f) DESC, concept LIMIT 4""")
def suggested(spark, sf_dir):
    """Four queries about the most frequent concepts."""
    from .aggregates import concepts

    c = concepts(spark, sf_dir).orderBy(F.desc(F.log1p("weight")), "concept").limit(4)
    return c.select(F.concat(F.lit("Where did I talk about "), F.col("concept"), F.lit("?")).alias("query"))


@query("f15_hook_cues", r"""SELECT video_id, sentence_idx, round(least(1.0, 0.30 * question + 0.30 * curiosity_gap + 0.20 * second_person + 0.15 * superlative + 0.10 * negation + 0.10 * numeral), 4) AS lexical, question, curiosity_gap, second_person, superlative, negation, numeral FROM (
  SELECT video_id, sentence_idx, CAST(lower(trim(text)) LIKE '%?' OR coalesce(t[1] IN ('what', 'why', 'how', 'when', 'where', 'who', 'which', 'did', 'have', 'is', 'are', 'can', 'should', 'will'), false) AS DOUBLE) AS question,
    CAST(regexp_matches(w, '\b(secret|mistake|truth|turns out|the thing is|little did|crazy part|actually|realized|surprising|here''?s (the|what|why))\b') AS DOUBLE) AS curiosity_gap,
    CAST(regexp_matches(w, '\b(you|your|yourself|you''re|you''ve|you''ll)\b') AS DOUBLE) AS second_person,
    CAST(regexp_matches(w, '\b(best|worst|biggest|only|never|nobody|no one|everyone|always|most|first|hardest|easiest|fastest)\b') AS DOUBLE) AS superlative,
    CAST(regexp_matches(w, '\b(not|never|don''?t|doesn''?t|didn''?t|can''?t|won''?t|stop|avoid|wrong)\b') AS DOUBLE) AS negation, CAST(regexp_matches(w, '[0-9]') AS DOUBLE) AS numeral
  FROM (SELECT video_id, sentence_idx, text, t, array_to_string(t, ' ') AS w FROM (SELECT *, list_slice(regexp_extract_all(lower(text), '[a-z0-9'']+'), 1, 15) AS t FROM sent)))""", SENTENCES_SQL)
def hooks(spark, sf_dir):
    """The lexical hook score and cues of each sentence."""
    s = sentences(spark, sf_dir)
    return s.select("video_id", "sentence_idx", F.round(texts.hook_lexical(F.col("text")), 4).alias("lexical"), *[c.alias(k) for k, c in texts.hook_cues(F.col("text")).items()])


_LEADS_SQL = "leads AS (SELECT ['so', 'and', 'but', 'then', 'now', 'well', 'okay', 'ok', 'yeah', 'right', 'actually', 'basically', 'obviously', 'anyway', 'however', 'because', 'since', 'plus', 'also', 'though', 'although'] AS c)"


@query("f17_points_back", r"""SELECT video_id, sentence_idx, CASE WHEN low = '' THEN false WHEN regexp_matches(low, '^(as i said|as i mentioned|like i said|like i mentioned|as we discussed|going back to|back to that|that''s why|thats why|which is why|that''s when|thats when|so anyway|anyway|as a result|because of that|after that|the same thing|same thing|that said)') THEN true
  WHEN f = 'it' THEN NOT regexp_matches(array_to_string(rest, ' '), '^it\s*''?s?\s+(been|going|about|time|cold|hot|hard|easy|important|possible|impossible|worth|clear|obvious|likely|unlikely|true|false|funny|weird|crazy|nice|good|bad|great|late|early|okay|fine)\b|^it\s+(is|was|has|had|will|would|takes|took|seems|seemed|turns|turned|looks|looked|appears|appeared|feels|felt|happens|happened|occurred|matters|mattered)\b|^it\s*''?s?\s*(rain|snow|pour|drizzle|hail|thunder)(s|ed|ing)?\b|^it\s*''?s\b\s+(a|an|the|not|no|just|only|all|so|too|very|really)\b')
  WHEN f IN ('he', 'she', 'they', 'him', 'her', 'them', 'his', 'hers', 'its', 'their', 'theirs', 'himself', 'herself', 'itself', 'themselves') THEN true
  WHEN f IN ('this', 'that', 'these', 'those') THEN coalesce(split_part(rest[2], '''', 1), '') NOT IN ('week', 'weekend', 'month', 'year', 'morning', 'afternoon', 'evening', 'night', 'day', 'time', 'summer', 'winter', 'spring', 'fall', 'season', 'video', 'channel', 'episode', 'lesson', 'podcast', 'series', 'clip', 'course', 'session', 'one') ELSE false END AS points_back
FROM (SELECT *, split_part(rest[1], '''', 1) AS f FROM (SELECT *, list_slice(w, 1 + CASE WHEN NOT coalesce(list_contains(c, w[1]), false) THEN 0 WHEN NOT coalesce(list_contains(c, w[2]), false) THEN 1 WHEN NOT coalesce(list_contains(c, w[3]), false) THEN 2 ELSE 3 END, len(w)) AS rest
  FROM (SELECT video_id, sentence_idx, lower(trim(text)) AS low, regexp_extract_all(lower(trim(text)), '[a-zA-Z'']+') AS w FROM sent), leads))""", SENTENCES_SQL, _LEADS_SQL)
def anaphors(spark, sf_dir):
    """Whether each sentence points back."""
    return sentences(spark, sf_dir).select("video_id", "sentence_idx", texts.points_back(F.col("text")).alias("points_back"))
