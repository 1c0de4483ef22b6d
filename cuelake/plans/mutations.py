"""Writes as whole-table rewrites: what a table holds after a mutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutation
from ..sources.library import table
from .registry import query


@query("k04_incremental_append", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 = 0")
def append(spark, sf_dir):
    """Only what the table doesn't hold is added."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return mutation.append_new(d.filter("doc_id % 3 <> 0"), d, ["doc_id"])


@query("k06_upsert", "SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type FROM events GROUP BY 1")
def upsert(spark, sf_dir):
    """The latest version of each key wins."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return mutation.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")


@query("k07_delete_cascade", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey % 10 <> 3")
def cascade(spark, sf_dir):
    """Children of deleted parents go with them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    gone = o.filter("o_custkey % 10 = 3").select(F.col("o_orderkey").alias("l_orderkey"))
    left = mutation.delete(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])
    return left.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")


@query("k09_replace_key", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN 0.0 ELSE l_tax END AS l_tax FROM lineitem")
def replace(spark, sf_dir):
    """All rows of a key replaced."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return mutation.replace(x, x.filter("l_orderkey % 5 = 0").withColumn("l_tax", F.lit(0.0)), ["l_orderkey"])


@query("k12_newest_5000", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def retain(spark, sf_dir):
    """The log after an append: the newest 5000 entries."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return mutation.retain_newest(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["ts", "event_id"], 5000).select("event_id")


@query("k14_job_recovery", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'interrupted by a restart' END AS error FROM orders")
def recovery(spark, sf_dir):
    """Jobs that ran when the process ended have failed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("done").alias("status"))
    return mutation.fail_interrupted(o, "interrupted by a restart").select("o_orderkey", "status", "error")


@query("k15_config_merge", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'default') AS segment, coalesce(CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS BIGINT) END, 7) AS nation FROM customer")
def config(spark, sf_dir):
    """Stored settings over defaults, field by field."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("bigint")).alias("nation"))
    return mutation.over_defaults(c, {"segment": "default", "nation": 7})


@query("k16_evict_legacy", "SELECT source, count(*) AS stale FROM documents WHERE n_chars < 500 GROUP BY 1")
def evict(spark, sf_dir):
    """Legacy rows by video, to be derived again."""
    return table(spark, sf_dir, "documents").filter("n_chars < 500").groupBy("source").agg(F.count("*").alias("stale"))


@query("k18_diagnosis", "SELECT o_custkey AS video_id, arg_min(o_orderpriority, o_orderkey) AS title, max(o_totalprice) AS total, NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AS orphan FROM orders GROUP BY 1")
def diagnosis(spark, sf_dir):
    """Video rows derived from chunks, and which have none of their own."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("video_id")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("title"), F.max("o_totalprice").alias("total"))
    own = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("video_id"), F.lit(True).alias("own"))
    return o.join(own, "video_id", "left").select("video_id", "title", "total", F.col("own").isNull().alias("orphan"))
