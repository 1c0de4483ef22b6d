"""What a sentence is about: scored n-grams of meaningful words, a topic, and questions that it answers."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.texts import terms

# Words that say nothing in spoken media.
FILLER = ("yeah", "okay", "sure", "look", "said", "says", "tell", "told", "actually", "basically", "literally", "something", "anything", "everything", "nothing", "gonna", "wanna", "gotta", "today", "video", "episode", "channel", "subscribe", "comment", "watch", "click", "description", "below", "people", "time", "times", "years", "year", "think", "thought", "believe", "happen", "happened", "happening", "shows", "shown", "given", "taken", "known", "found", "order", "course", "seconds", "minutes", "hours", "quickly", "slowly", "heavily", "largely", "mostly", "overall", "recently", "eventually", "finally", "specifically", "speaker", "spoken", "mention")
LEAST_LETTERS = 5
MOST, LEAST, BACKFILL = 6, 3, 4
GENERAL = "General Discussion"


def stop_words() -> list[str]:
    """Spark's English stop words and the media's fillers."""
    return sorted({*StopWordsRemover.loadDefaultStopWords("english"), *FILLER})


def scored_grams(sentences: DataFrame, keys: list[str], text: str, idf: DataFrame, stops: list[str] | None = None) -> DataFrame:
    """(keys, gram, n, score, freq, first): n-grams of up to three adjacent meaningful words that recur in the sentence or are long, scored tf * mean idf + 0.3 n; a term without an idf weighs 1."""
    stops = stop_words() if stops is None else stops
    good = lambda w: (F.length(w) >= LEAST_LETTERS) & ~w.isin(*stops)
    words = sentences.select(*keys, terms(F.col(text)).alias("w"))

    def grams(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        each = F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("w", i, n).alias("parts")))
        return F.filter(each, lambda g: F.forall(g["parts"], good))

    all_ = words.select(*keys, F.size(F.filter("w", good)).alias("total"), F.explode(F.concat(*map(grams, (1, 2, 3)))).alias("g"))
    counted = all_.groupBy(*keys, "total", F.array_join("g.parts", " ").alias("gram")).agg(F.count("*").alias("freq"), F.min("g.at").alias("first"), F.first("g.parts").alias("parts"))
    n = F.size("parts")
    long = F.when(n == 1, F.length("gram") >= 7).when(n == 2, F.forall("parts", lambda p: F.length(p) >= 6)).otherwise(F.lit(False))
    kept = counted.filter((F.col("freq") >= 2) | long)
    weight = kept.select(*keys, "gram", F.explode("parts").alias("term")).join(idf.select("term", "idf"), "term", "left").groupBy(*keys, "gram").agg(F.avg(F.coalesce("idf", F.lit(1.0))).alias("idf"))
    scored = kept.join(weight, [*keys, "gram"])
    return scored.select(*keys, "gram", n.alias("n"), (F.col("freq") / F.greatest("total", F.lit(1)) * F.col("idf") + 0.3 * n).alias("score"), "freq", "first")


def concepts(sentences: DataFrame, keys: list[str], text: str, idf: DataFrame, stops: list[str] | None = None) -> DataFrame:
    """(keys, concepts, section_topic, questions): up to six concepts by falling score, ties by length and place; a single word goes if those before hold it. Sentences without any are of General Discussion."""
    grams = scored_grams(sentences, keys, text, idf, stops)
    order = F.struct((-F.round("score", 9)).alias("s"), "n", "first", "gram")
    kind = "array<struct<s:double,n:int,first:int,gram:string>>"

    def step(kept: Column, x: Column) -> Column:
        held = F.exists(kept, lambda k: F.array_contains(F.split(k["gram"], " "), x["gram"]))
        return F.when((F.size(kept) >= MOST) | ((x["n"] == 1) & held), kept).otherwise(F.concat(kept, F.array(x)))

    folded = grams.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(order)).cast(kind), F.array().cast(kind), step).alias("k"))
    named = folded.select(*keys, F.transform("k", lambda k: k["gram"]).alias("concepts"))
    both = sentences.select(*keys).join(named, keys, "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    c = lambda k: F.get("concepts", F.lit(k))
    size = F.size("concepts")
    topic = F.when(size == 0, GENERAL).when((size == 1) | c(0).contains(" "), F.initcap(c(0))).otherwise(F.concat_ws(" & ", F.initcap(c(0)), F.initcap(c(1))))
    between = F.concat(F.lit("What is the relationship between "), c(0), F.lit(" and "), c(1), F.lit("?"))
    questions = F.when(size == 0, F.array(F.lit("What concept is addressed in this segment?"))).when(size == 1, F.array(F.concat(F.lit("What are the key points about "), c(0), F.lit("?")))).when(size == 2, F.array(between)).otherwise(F.array(between, F.concat(F.lit("What role does "), c(2), F.lit(" play in this discussion?"))))
    return both.select(*keys, "concepts", topic.alias("section_topic"), questions.alias("questions"))


def enriched(text: Column, topic: Column) -> Column:
    """The text behind its topic, unless that is general."""
    return F.when((topic != "") & (topic != GENERAL), F.concat_ws(". ", topic, text)).otherwise(text)


def frequencies(chunks: DataFrame) -> DataFrame:
    """(concept, weight): 2 for each part of a section's topic, 1 for each concept, case and outer space aside; shorter than three letters none."""
    topics = chunks.select(F.explode(F.split("section_topic", "&")).alias("c"), F.lit(2).alias("w"))
    own = chunks.select(F.explode("concepts").alias("c"), F.lit(1).alias("w"))
    return topics.unionByName(own).select(F.lower(F.trim("c")).alias("concept"), "w").filter(F.length("concept") >= 3).groupBy("concept").agg(F.sum("w").alias("weight"))


def suggested_queries(chunks: DataFrame, idf: DataFrame, generic: list[str], most: int = 4) -> DataFrame:
    """(query): the most distinctive recurring concepts: mean idf times ln(1 + weight), ties by name; generic single words are left out."""
    f = frequencies(chunks).filter(F.col("concept").contains(" ") | ~F.col("concept").isin(*generic))
    weight = f.select("concept", F.explode(F.split("concept", " ")).alias("term")).join(idf.select("term", "idf"), "term", "left").groupBy("concept").agg(F.avg(F.coalesce("idf", F.lit(1.0))).alias("idf"))
    top = f.join(weight, "concept").orderBy(F.desc(F.col("idf") * F.log1p("weight")), "concept").limit(most)
    return top.select(F.concat(F.lit("Where did I talk about "), F.col("concept"), F.lit("?")).alias("query"))


def neighbours_of(chunks: DataFrame, key: str = "video_id") -> DataFrame:
    """Chunks with the topics of the one before and the one after."""
    w = W.partitionBy(key).orderBy("sentence_idx")
    return chunks.withColumn("topic_before", F.lag("section_topic").over(w)).withColumn("topic_after", F.lead("section_topic").over(w))
