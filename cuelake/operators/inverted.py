"""A persisted inverted index: postings by term in buckets on disk, written in deltas that add up.

A delta holds what some chunks add or, with the sign turned, take away. Counts, lengths and document frequencies are sums
over the deltas, so that writing one never reads what others hold, and a search reads the buckets of its terms alone.
``compact`` makes one delta of many. Deltas are named by the caller; one that is written again replaces itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.texts import terms, tokens
from .retrieval import EPSILON, MOST_ASKED, K1, B

BUCKETS = 64
#: Query terms that are pushed into the scan as a list; more are joined.
MOST_LISTED = 1000
_VOCABULARY = "term string, df bigint, kind string, bucket int"
_SIZES = "n bigint, lengths bigint, measured bigint"


class Sizes(NamedTuple):
    """Chunks, the sum of their tokens and how many have a text."""

    n: int
    lengths: int
    measured: int


class Index:
    """Chunks by their keys (a DDL such as "doc_id bigint"), which are unique among those that were added and not taken away.

    A null text has no postings but counts as a chunk. Without ``concepts`` the vocabulary has search tokens alone, and there is no ``idf``.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: str, buckets: int = BUCKETS, concepts: bool = True):
        self.concepts = concepts
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), [k.split()[0] for k in keys.split(",")], buckets
        self._postings = f"{keys}, dl bigint, tf bigint, sign int, term string, bucket int"

    def _bucket(self) -> Column:
        return (F.crc32(F.col("term").cast("binary")) % self.buckets).cast("int")

    def _read(self, what: str, deltas: list[str], ddl: str) -> DataFrame:
        if not deltas:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).option("basePath", f"{self.folder}/{what}").parquet(*(f"{self.folder}/{what}/d={d}" for d in deltas))

    def _write(self, what: str, delta: str, rows: DataFrame, *by: str) -> None:
        rows.hint("rebalance", *by).sortWithinPartitions(*by, "term").write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{what}/d={delta}")

    def append(self, delta: str, chunks: DataFrame, text: str, sign: int = 1) -> None:
        """What the chunks add (sign 1) or, if they were there, take away (-1)."""
        each = chunks.select(*self.keys, tokens(F.col(text)).alias("t"))
        found = each.select(*self.keys, F.size("t").cast("bigint").alias("dl"), F.explode("t").alias("term")).groupBy(*self.keys, "dl", "term").agg(F.count("*").alias("tf"))
        self._write("postings", delta, found.withColumn("sign", F.lit(sign)).withColumn("bucket", self._bucket()), "bucket")
        mine = self._read("postings", [delta], self._postings)
        words = mine.groupBy("term").agg(F.sum("sign").alias("df")).withColumn("kind", F.lit("word"))
        if self.concepts:
            said = chunks.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).groupBy("term").agg((F.count("*") * sign).alias("df")).withColumn("kind", F.lit("term"))
            words = words.unionByName(said)
        self._write("vocabulary", delta, words.withColumn("bucket", self._bucket()), "kind", "bucket")
        size = chunks.agg((F.count("*") * sign).alias("n"), (F.count(text) * sign).alias("measured"))
        length = mine.agg(F.coalesce(F.sum(F.col("tf") * F.col("sign")), F.lit(0)).alias("lengths"))
        size.join(F.broadcast(length)).select(*Sizes._fields).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/sizes/d={delta}")

    def compact(self, deltas: list[str], delta: str) -> None:
        """One delta with what these hold together; they are left as they are."""
        same = [*self.keys, "dl", "tf", "term", "bucket"]
        kept = self._read("postings", deltas, self._postings).groupBy(*same).agg(F.sum("sign").alias("sign")).filter("sign <> 0")
        self._write("postings", delta, kept.withColumn("sign", F.col("sign").cast("int")), "bucket")
        self._write("vocabulary", delta, self.vocabulary(deltas), "kind", "bucket")
        self._read("sizes", deltas, _SIZES).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in Sizes._fields]).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/sizes/d={delta}")

    def sizes(self, deltas: list[str]) -> Sizes:
        row = self._read("sizes", deltas, _SIZES).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in Sizes._fields]).first()
        return Sizes(*row)

    def vocabulary(self, deltas: list[str], kind: str | None = None) -> DataFrame:
        """(term, df, kind, bucket) of the chunks that are there: of search tokens (word) or of words with contractions expanded (term)."""
        rows = self._read("vocabulary", deltas, _VOCABULARY)
        return (rows if kind is None else rows.filter(F.col("kind") == kind)).groupBy("term", "kind", "bucket").agg(F.sum("df").alias("df")).filter("df > 0")

    def idf(self, deltas: list[str], of: DataFrame | None = None, more: DataFrame | None = None, n_more: int = 0) -> DataFrame:
        """(term, df, idf) as ``retrieval.idf`` counts them over all texts, of some terms (term) alone if given, and with documents that aren't in the index yet, their (term, df) and number."""
        found = self.vocabulary(deltas, "term").select("term", "df")
        if more is not None:
            found = found.unionByName(more.select("term", "df")).groupBy("term").agg(F.sum("df").alias("df"))
        if of is not None:
            found = found.join(of.select("term").distinct(), "term", "left_semi")
        n = self.sizes(deltas).n + n_more
        return found.select("term", "df", (F.log(F.lit(n + 1) / (F.col("df") + 1)) + 1).alias("idf"))

    def of_terms(self, rows: DataFrame, named: DataFrame, listed: list[str] | None) -> DataFrame:
        """Rows of the index with one of these terms (term): their buckets are read alone. A few that are ``listed`` go into the scan; more are joined."""
        if listed is None:
            buckets = [r[0] for r in named.select(self._bucket()).distinct().collect()]  # a term's bucket each, as many at most as there are
        else:
            buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in listed})
        rows = rows.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        return rows.filter(F.col("term").isin(listed)) if listed is not None else rows.join(named, "term", "left_semi")

    def _asked(self, asked: DataFrame) -> tuple[list[str] | None, Callable[[DataFrame], DataFrame]]:
        """The terms of queries, if they are few, and what may be broadcast of them: rows by term and query, if their number is within the bound."""
        found = [r[0] for r in asked.select("term").distinct().limit(MOST_LISTED + 1).collect()]
        listed = found if len(found) <= MOST_LISTED else None
        return listed, F.broadcast if asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED else (lambda x: x)

    def bm25(self, deltas: list[str], queries: DataFrame, query: str, query_text: str) -> DataFrame:
        """(query, keys, score) of each chunk that holds a term of a query: the scores of ``retrieval.bm25`` over the chunks that are there.

        Postings of the queries' terms are dealt by chunk once. The mean weight of all terms, the floor of frequent ones, is
        taken from the vocabulary, and only if a query has such a term.
        """
        asked = queries.select(query, F.explode(tokens(F.col(query_text))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("times"))
        listed, small = self._asked(asked)
        named = small(asked.select("term").distinct())
        n, lengths, measured = self.sizes(deltas)
        raw = (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")
        mine = self.of_terms(self._read("vocabulary", deltas, _VOCABULARY).filter("kind = 'word'"), named, listed).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0").select("term", raw)
        floor = 0.0
        if not mine.filter("raw < 0").isEmpty():
            floor = self.vocabulary(deltas, "word").select(raw).agg(F.avg("raw") * EPSILON).first()[0]
        weighed = small(asked.join(mine.select("term", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf")), "term"))
        held = self.of_terms(self._read("postings", deltas, self._postings), named, listed)
        same = [*self.keys, "dl", "tf", "term"]
        live = held.repartition(*self.keys).groupBy(*same).agg(F.sum("sign").alias("sign")).filter("sign > 0")
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(lengths / max(measured, 1))))
        return live.join(weighed, "term").groupBy(query, *self.keys).agg(F.sum(part * F.col("times")).alias("score"))

    def tfidf(self, deltas: list[str], chunks: DataFrame, text: str, queries: DataFrame, query: str, query_text: str) -> DataFrame:
        """(query, keys, score): the cosines of ``retrieval.tfidf`` over these chunks, which are those of the index. Frequencies come from the vocabulary, and only chunks that hold a term of a query are taken apart."""
        count = lambda rows, keys, c: rows.select(*keys, F.explode(tokens(F.col(c))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
        asked = count(queries, [query], query_text)
        listed, small = self._asked(asked)
        held = self.of_terms(self._read("postings", deltas, self._postings), small(asked.select("term").distinct()), listed)
        touched = chunks.join(held.select(self.keys).distinct(), self.keys, "left_semi")
        weight = self.vocabulary(deltas, "word").select("term", (F.log(F.lit(self.sizes(deltas).n + 1) / (F.col("df") + 1)) + 1).alias("idf"))

        def unit(tf: DataFrame, keys: list[str]) -> DataFrame:
            w = tf.join(weight, "term").select(*keys, "term", (F.col("tf") * F.col("idf")).alias("w"))
            return w.select(*keys, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*keys)))).alias("w"))

        q, d = unit(asked, [query]), unit(count(touched, self.keys, text), self.keys)
        return d.withColumnRenamed("w", "v").join(small(q), "term").groupBy(query, *self.keys).agg(F.sum(F.col("w") * F.col("v")).alias("score"))
