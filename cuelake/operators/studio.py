"""Checks on what a language model returned, before anything trusts it, and the run history around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.texts import first_words, letters_only, word_count
from .ranking import limit_dominance

# Kinds of beats.
BEAT_TYPES = ("hook", "setup", "punchline", "confession", "turning_point", "lesson", "payoff", "cta", "tangent")
MOST_INPUT_WORDS, RUNS_AN_HOUR, LEAD_IN = 15_000, 60, 15
ANSWER_WORDS, QUOTES, QUOTE_WORDS = 45, 5, 120


def valid_beats(beats: DataFrame, sentences: DataFrame, types: tuple[str, ...] = BEAT_TYPES) -> DataFrame:
    """Beats (video_id, beat_type, first, last, needs, title, why, quote) of known types on sentences that there are, in order; a need that is no earlier sentence is null, a quote that its range doesn't say is empty, long texts are cut."""
    places = sentences.select("video_id", F.col("sentence_idx").alias("i"))
    at = lambda c: places.select("video_id", F.col("i").alias(c))
    known = beats.filter(F.col("beat_type").isin(*types) & (F.col("first") <= F.col("last"))).join(at("first"), ["video_id", "first"], "left_semi").join(at("last"), ["video_id", "last"], "left_semi")
    needed = known.withColumn("_id", F.monotonically_increasing_id()).join(at("needs").withColumn("_has", F.lit(True)), ["video_id", "needs"], "left").withColumn("needs", F.when(F.col("_has") & (F.col("needs") <= F.col("first")), F.col("needs")))
    said = needed.select("_id", "video_id", F.explode(F.sequence("first", "last")).alias("sentence_idx")).join(sentences.select("video_id", "sentence_idx", "text"), ["video_id", "sentence_idx"])
    whole = said.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_idx", "text"))), lambda x: x["text"]), " ").alias("_said"))
    quote = F.trim(letters_only(F.coalesce("quote", F.lit(""))))
    true = (quote == "") | letters_only(F.col("_said")).contains(quote)
    out = needed.join(whole, "_id").withColumn("quote", F.when(true, F.coalesce("quote", F.lit(""))).otherwise(""))
    return out.select("video_id", "beat_type", "first", "last", "needs", F.substring(F.coalesce("title", F.lit("")), 1, 120).alias("title"), F.substring(F.coalesce("why", F.lit("")), 1, 400).alias("why"), "quote")


def moments(found: DataFrame, sentences: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Moments (video_id, first, last, type, score) of known types on known sentences, once a range (the best score), no type over its share, with a start up to LEAD_IN seconds before."""
    at = lambda c: sentences.select("video_id", F.col("sentence_idx").alias(c))
    good = found.filter(F.col("type").isin(*types) & (F.col("first") <= F.col("last"))).join(at("first"), ["video_id", "first"], "left_semi").join(at("last"), ["video_id", "last"], "left_semi")
    once = good.withColumn("_r", F.row_number().over(W.partitionBy("video_id", "first", "last").orderBy(F.desc("score"), "type"))).filter("_r = 1").drop("_r")
    kept = limit_dominance(once, ["video_id"], "type", [F.desc("score"), F.col("first")])
    w = W.partitionBy("video_id").orderBy("start_sec").rangeBetween(-LEAD_IN, 0)
    leads = sentences.select("video_id", F.col("sentence_idx").alias("first"), F.min("sentence_idx").over(w).alias("lead_in"))
    return kept.join(leads, ["video_id", "first"])


def citations(found: Column, n: Column) -> Column:
    """Cited numbers that are whole and within 1..n, each once, sorted."""
    numbers = F.transform(found, lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x >= 1) & (x <= n))))


def answer(text: Column) -> Column:
    return first_words(text, ANSWER_WORDS)


def admitted(runs: DataFrame, words: Column, at: str, group: str) -> DataFrame:
    """Runs with whether their input is short enough and the hour before held fewer than RUNS_AN_HOUR."""
    w = W.partitionBy(group).orderBy(F.unix_micros(at)).rangeBetween(-3_600_000_000, -1)
    return runs.withColumn("short_enough", words <= MOST_INPUT_WORDS).withColumn("in_hour", F.count("*").over(w)).withColumn("admitted", F.col("short_enough") & (F.col("in_hour") < RUNS_AN_HOUR))


def banned_words(text: Column, words: list[str]) -> Column:
    """Which of the words the text holds as whole phrases, sorted."""
    if not words:
        return F.array().cast("array<string>")
    held = [F.when(F.lower(text).rlike(rf"(?<!\w)\Q{w.lower()}\E(?!\w)"), w) for w in sorted(set(words))]
    return F.filter(F.array(*held), lambda x: x.isNotNull())


def merged_blocks(windows: DataFrame, key: str) -> DataFrame:
    """(key, notes, titles, n_chapters) of windows (key, window, notes, titles, chapters): distinct notes and titles in the order they first come, all chapters by time."""
    ordered = F.array_sort(F.collect_list(F.struct("window", "notes", "titles", "chapters")))
    g = windows.groupBy(key).agg(ordered.alias("w"))
    flat = lambda c: F.flatten(F.transform("w", lambda x: F.coalesce(x[c], F.expr("array()"))))
    return g.select(key, F.array_distinct(flat("notes")).alias("notes"), F.array_distinct(flat("titles")).alias("titles"), F.array_sort(flat("chapters")).alias("chapters"))


def numbered(lines: DataFrame, key: str, most_words: int = QUOTE_WORDS) -> DataFrame:
    """(key, prompt): a video's lines as ``[n] text``, cut to so many words each."""
    line = F.concat(F.lit("["), F.col("sentence_idx").cast("string"), F.lit("] "), first_words(F.col("text"), most_words))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_idx", line.alias("l")))), lambda x: x["l"]), "\n").alias("prompt"))


def total_words(lines: DataFrame, key: str) -> DataFrame:
    return lines.groupBy(key).agg(F.sum(word_count("text")).cast("bigint").alias("words"))


def error_kind(message: Column) -> Column:
    """What a provider's error means."""
    low = F.lower(F.coalesce(message, F.lit("")))
    any_of = lambda *xs: low.rlike("|".join(xs))
    return F.when(any_of("rate.?limit", "429", "quota"), "rate_limit").when(any_of("context.?length", "too many tokens", "maximum context"), "context_length").when(any_of("model.{0,40}not.?found", "does not exist", "404"), "model_not_found").otherwise("other")
