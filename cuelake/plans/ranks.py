"""Top-k, caps, retention and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ranking
from ..sources.library import SENTENCES_SQL, sentences, table
from .registry import query


@query("t01_top_30", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30")
def top_30(spark, sf_dir):
    """The 30 best, ties by id."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(30)


@query("t02_confidence", "SELECT doc_id, s, CASE WHEN s >= 0.35 THEN 'strong' WHEN s >= 0.10 THEN 'possible' WHEN s >= 0.08 THEN 'weak' ELSE 'unranked' END AS confidence FROM (SELECT doc_id, n_chars / 10000.0 AS s FROM documents)")
def confidence(spark, sf_dir):
    """Scores as words."""
    s = F.col("s")
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 10000.0).alias("s")).withColumn("confidence", F.when(s >= 0.35, "strong").when(s >= 0.10, "possible").when(s >= 0.08, "weak").otherwise("unranked"))


@query("t04_diversify")
def diversify(spark, sf_dir):
    """Ten diverse candidates of each label."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("vec_id") % 97 / 97.0).alias("composite"), F.col("embedding").alias("vector"))
    return ranking.diversify(e, "label", "vec_id", 10)


@query("t05_suppression", """, steps AS (SELECT video_id, k, [item] AS kept FROM ordered WHERE k = 1
  UNION ALL SELECT p.video_id, p.k + 1, CASE WHEN len([x for x in p.kept if least(x.e - x.s, o.item.e - o.item.s) > 0 and (least(x.e, o.item.e) - greatest(x.s, o.item.s)) / least(x.e - x.s, o.item.e - o.item.s) >= 0.5]) > 0 THEN p.kept ELSE list_append(p.kept, o.item) END FROM steps p JOIN ordered o ON o.video_id = p.video_id AND o.k = p.k + 1)
SELECT video_id, item.i AS sentence_idx, item.score AS score, item.s AS start_sec, item.e AS end_sec FROM (SELECT video_id, unnest(kept) AS item FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY k DESC) = 1))""", SENTENCES_SQL, "ordered AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY n_words DESC, sentence_idx) AS k, struct_pack(i := sentence_idx, s := (start_sec - 5)::DOUBLE, e := (end_sec + 5)::DOUBLE, score := n_words / 100) AS item FROM sent)")
def suppression(spark, sf_dir):
    """Sentences suppressed where they overlap better ones."""
    s = sentences(spark, sf_dir).select("video_id", "sentence_idx", (F.col("start_sec") - 5).alias("start_sec"), (F.col("end_sec") + 5).alias("end_sec"), (F.col("n_words") / 100).alias("score"))
    return ranking.suppress_overlapping(s, ["video_id"], "sentence_idx")


@query("t06_cap", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 2")
def cap(spark, sf_dir):
    """Two of each source."""
    return ranking.cap(table(spark, sf_dir, "documents"), "source", [F.desc("n_chars"), F.col("doc_id")], 2).select("source", "doc_id")


@query("t09_voice_samples", "SELECT lang, doc_id FROM documents WHERE n_chars >= 120 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 3")
def voice_samples(spark, sf_dir):
    """The three longest texts of 120 characters or more."""
    return ranking.cap(table(spark, sf_dir, "documents").filter("n_chars >= 120"), "lang", [F.desc("n_chars"), F.col("doc_id")], 3).select("lang", "doc_id")


@query("t10_newest", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def newest(spark, sf_dir):
    """The newest 200."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200).select("o_orderkey")


@query("t11_runs", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50")
def runs(spark, sf_dir):
    """One tool's newest 50 runs."""
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


@query("t13_dominance", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM (
  SELECT e.*, row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY value DESC, event_id) AS p, t.n, t.c, t.k FROM events e JOIN (SELECT user_id, sum(c) AS n, max(c) AS c, arg_max(event_type, struct_pack(c := c, t := event_type)) AS k FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1) t ON e.user_id = t.user_id)
  WHERE NOT (event_type = k AND c > n * 0.6 AND p > greatest(1, floor(n * 0.6)))) WHERE r <= 15""")
def dominance(spark, sf_dir):
    """Fifteen moments, of which one kind is 60 % at most."""
    return ranking.limit_dominance(table(spark, sf_dir, "events"), ["user_id"], "event_type", [F.desc("value"), F.col("event_id")]).select("user_id", "event_id")


@query("t16_reasons", "SELECT l_orderkey, l_linenumber, CASE WHEN q >= p AND q >= t THEN 'quantity' WHEN p >= t THEN 'price' ELSE 'tax' END AS top FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS q, l_extendedprice / 100000 AS p, l_tax * 10 AS t FROM lineitem)")
def reasons(spark, sf_dir):
    """The strongest signal's name."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("q"), (F.col("l_extendedprice") / 100000).alias("p"), (F.col("l_tax") * 10).alias("t"))
    signals = F.array(*[F.struct((-F.col(c)).alias("s"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (c, name) in enumerate((("q", "quantity"), ("p", "price"), ("t", "tax")))])
    return rows.select("l_orderkey", "l_linenumber", F.array_min(signals)["name"].alias("top"))


@query("t17_even_sample", "SELECT page_id FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS p, count(*) OVER () AS n FROM pages) WHERE p IN (SELECT CAST(floor(i * n / 40.0) AS BIGINT) FROM range(40) t(i), (SELECT count(*) AS n FROM pages))")
def even_sample(spark, sf_dir):
    """Forty pages at even distances: places by counts of id ranges, so that no window holds all rows."""
    p = table(spark, sf_dir, "pages").select("page_id").withColumn("cell", F.floor(F.col("page_id") / 1000))
    sizes = p.groupBy("cell").agg(F.count("*").alias("c"))
    before = sizes.select("cell", F.coalesce(F.sum("c").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(W.partitionBy()).alias("n"))
    placed = p.join(before, "cell").withColumn("p", F.row_number().over(W.partitionBy("cell").orderBy("page_id")) - 1 + F.col("before"))
    k = F.ceil(F.col("p") * 40.0 / F.col("n"))
    return placed.filter((k < 40) & (F.floor(k * F.col("n") / 40.0) == F.col("p"))).select("page_id")


@query("t18_query_history", "SELECT lower(event_type) AS q, max(ts) AS last FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 8")
def query_history(spark, sf_dir):
    """The eight latest distinct queries, case aside."""
    return table(spark, sf_dir, "events").groupBy(F.lower("event_type").alias("q")).agg(F.max("ts").alias("last")).orderBy(F.desc("last")).limit(8)


@query("u01_union", "SELECT doc_id AS id, 'document' AS kind, lang FROM documents UNION ALL SELECT page_id, 'page', NULL FROM pages")
def union(spark, sf_dir):
    """Rows of two shapes, missing columns null."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "lang")
    return d.unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind")), allowMissingColumns=True)


@query("u03_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_(spark, sf_dir):
    """Ids of one side alone."""
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("u05_keep_first", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def keep_first(spark, sf_dir):
    """The first row of each key."""
    first = F.min(F.struct("ts", "event_id")).alias("f")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(first).select("user_id", "event_type", "f.event_id")


@query("u06_beat_dedupe", "SELECT video_id, role, min(sentence_idx) AS first FROM sent GROUP BY 1, 2", SENTENCES_SQL)
def beat_dedupe(spark, sf_dir):
    """The first beat of a kind in each video."""
    return sentences(spark, sf_dir).groupBy("video_id", "role").agg(F.min("sentence_idx").alias("first"))
