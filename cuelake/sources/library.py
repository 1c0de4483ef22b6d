"""The library's tables over what lies in a folder: sentences, words and videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.texts import word_count

#: Seconds that a spoken word takes where a table has no times.
WORD_SECONDS = 0.4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, sentence_idx, role, text, n_words, start_sec, end_sec): conversations as videos, turns as sentences, whole seconds by the words before."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("sentence_idx"), "role", "text", word_count("text").cast("bigint").alias("n_words"))
    before = F.coalesce(F.sum("n_words").over(W.partitionBy("video_id").orderBy("sentence_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).select("*", F.floor(F.col("_before") * WORD_SECONDS).alias("start_sec"), F.ceil((F.col("_before") + F.col("n_words")) * WORD_SECONDS).alias("end_sec")).drop("_before")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, pos, word, start, end): events as timed words of their users, a quarter of a second each."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("word"), at.alias("start"), (at + 0.25).alias("end"))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, start, end): the sentences' words at their even times, with a short silence behind each and a longer one behind the end of a sentence."""
    said = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    before = F.coalesce(F.sum("n_words").over(W.partitionBy("video_id").orderBy("sentence_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = sentences(spark, sf_dir).withColumn("b", before).select("video_id", "b", F.posexplode(said).alias("p", "w"))
    at = (F.col("b") + F.col("p")).cast("double")
    return each.select("video_id", (at * WORD_SECONDS).alias("start"), ((at + 1) * WORD_SECONDS - F.when(F.col("w").rlike("[.!?]$"), 0.3).otherwise(0.02)).alias("end"))


# DuckDB's form of the tables above, for the queries' SQL.
SENTENCES_SQL = r"""sent AS (
  SELECT video_id, sentence_idx, role, text, n_words, CAST(floor(before * 0.4) AS BIGINT) AS start_sec, CAST(ceil((before + n_words) * 0.4) AS BIGINT) AS end_sec
  FROM (SELECT *, coalesce(CAST(sum(n_words) OVER (PARTITION BY video_id ORDER BY sentence_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
    FROM (SELECT conv_id AS video_id, turn AS sentence_idx, role, text, CAST(len([x for x in regexp_split_to_array(text, '\s+') if x <> '']) AS BIGINT) AS n_words FROM conversations)))"""
WORDS_SQL = """wrd AS (
  SELECT user_id AS video_id, event_id AS pos, event_type AS word, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS start, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 + 0.25 AS "end" FROM events)"""
SPOKEN_SQL = r"""spoken AS (
  SELECT video_id, (b + p)::DOUBLE * 0.4::DOUBLE AS start, (b + p + 1)::DOUBLE * 0.4::DOUBLE - CASE WHEN regexp_matches(w, '[.!?]$') THEN 0.3::DOUBLE ELSE 0.02::DOUBLE END AS "end"
  FROM (SELECT video_id, b, unnest(range(len(t))) AS p, unnest(t) AS w FROM (SELECT video_id, t, coalesce(CAST(sum(len(t)) OVER (PARTITION BY video_id ORDER BY sentence_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS b
    FROM (SELECT video_id, sentence_idx, [x for x in regexp_split_to_array(text, '\s+') if x <> ''] AS t FROM sent))))"""
