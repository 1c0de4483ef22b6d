"""The contract with a language model: requests as rows, answers as checked JSON, one retry, tokens counted.

The provider is a function (system, user) -> (text, prompt_tokens, completion_tokens) that tasks call; it raises where there
is no answer. Nothing here depends on which one it is.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scratch
from . import selection
from .studio import error_kind, valid_beats

Provider = Callable[[str, str], tuple[str, int, int]]
# Names under which models wrap a list that was asked for.
LIST_NAMES = ("items", "comments", "replies", "flags", "results", "data", "list", "array", "output", "response", "suggestions", "result", "reply", "beats", "queries")
ATTEMPTS = 2
#: Segments that a digest names one by one, and lines that older ones are pressed into beyond that.
DIGEST_LINES, DIGEST_BUCKETS = 40, 6


def unwrapped(found: object) -> object:
    """The list in an object that wraps one: under a known name, else its longest list, else its values if all are objects or lists; anything else as it is."""
    if not isinstance(found, dict):
        return found
    named = next((found[n] for n in LIST_NAMES if isinstance(found.get(n), list)), None)
    if named is not None:
        return named
    lists = [v for v in found.values() if isinstance(v, list)]
    if lists:
        return max(lists, key=len)
    return list(found.values()) if found and all(isinstance(v, dict) for v in found.values()) else found


def strings(found: object, change: Callable[[str], str]) -> object:
    """The same nested value with each text in it changed; names stay."""
    if isinstance(found, dict):
        return {k: strings(v, change) for k, v in found.items()}
    if isinstance(found, list):
        return [strings(v, change) for v in found]
    return change(found) if isinstance(found, str) else found


def problem(found: object, kind: str, required: tuple[str, ...]) -> str | None:
    """What is wrong with a value that should be an object, or a list of objects, with some names."""
    if not isinstance(found, list if kind == "array" else dict):
        return f"expected {kind}"
    for x in found if kind == "array" else [found]:
        missing = sorted(set(required) - set(x)) if isinstance(x, dict) else list(required)
        if missing:
            return f"missing {', '.join(missing)}"
    return None


def _asked(system: str, user: str, provider: Provider, kind: str, required: tuple[str, ...]) -> tuple:
    said, tokens, why = user, [0, 0], ""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            text, spent, made = provider(system, said)
        except Exception as e:  # noqa: BLE001  whatever a provider raises is its answer
            return None, str(e), *tokens, attempt
        tokens = [tokens[0] + (spent or 0), tokens[1] + (made or 0)]
        try:
            found = json.loads(text)
            found = unwrapped(found) if kind == "array" else found
            why = problem(found, kind, required)
        except ValueError as e:
            found, why = None, f"no JSON: {e}"
        if why is None:
            return json.dumps(found, ensure_ascii=False), None, *tokens, attempt
        said = f"{user}\n\nYour previous response was invalid: {why}. Respond again with only valid JSON of the required shape."
    return None, f"invalid after a retry: {why}", *tokens, ATTEMPTS


def completed(requests: DataFrame, provider: Provider, kind: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Requests (system, user, ..) with the answer's JSON or an error, the tokens of all attempts and their number. Lists that a model wraps are unwrapped; an invalid answer is asked for once more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_asked(s or "", u or "", provider, kind, required) for s, u in zip(pdf["system"], pdf["user"], strict=True)]
            yield pdf.assign(**{n: [r[k] for r in rows] for k, n in enumerate(("answer", "error", "prompt_tokens", "completion_tokens", "attempts"))})

    more = T.StructType.fromDDL("answer string, error string, prompt_tokens bigint, completion_tokens bigint, attempts bigint")
    return requests.mapInPandas(run, T.StructType(requests.schema.fields + more.fields))


_BEATS = "array<struct<type:string,start:bigint,end:bigint,requires:bigint,title:string,why:string,quote:string>>"


def window_beats(sentences: DataFrame, windows: DataFrame, provider: Provider, system: str) -> tuple[DataFrame, DataFrame]:
    """Beats (video_id, beat_type, first, last, needs, title, why, quote) of windows (video_id, window, sentence_idx), and a report by video (video_id, mode, windows, failed, prompt_tokens, completion_tokens).

    A window whose request is too long for the model is cut in half, once, and its halves are asked for alone. Other
    failures leave their window out: mode is llm if none failed, llm_partial if some did, heuristic if all did. Answers are
    written before they are looked at: nothing is asked, or paid for, again where they are read twice or an executor is lost after.
    """
    path = scratch.folder(sentences.sparkSession, "answers")
    lines = windows.join(sentences.select("video_id", "sentence_idx", "text"), ["video_id", "sentence_idx"]).withColumn("half", F.lit(0))

    def ask(rows: DataFrame) -> DataFrame:
        line = F.concat(F.lit("["), F.col("sentence_idx").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
        user = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_idx", line.alias("l")))), lambda x: x["l"]), "\n")
        asked = rows.groupBy("video_id", "window", "half").agg(user.alias("user"), F.count("*").alias("n")).withColumn("system", F.lit(system))
        return completed(asked, provider, "array").withColumn("kind", F.when(F.col("error").isNotNull(), error_kind(F.col("error"))))

    whole = scratch.written(ask(lines), f"{path}/whole")
    cut = whole.filter("kind = 'context_length' AND n > 1").select("video_id", "window", "n")
    place = F.row_number().over(W.partitionBy("video_id", "window").orderBy("sentence_idx"))
    halves = ask(lines.join(cut, ["video_id", "window"]).withColumn("half", F.when(place <= F.floor(F.col("n") / 2), 1).otherwise(2)).drop("n"))
    all_ = whole.join(cut.select("video_id", "window"), ["video_id", "window"], "left_anti").unionByName(scratch.written(halves, f"{path}/halves"))
    x = F.explode(F.from_json("answer", _BEATS)).alias("x")
    beats = all_.filter("answer IS NOT NULL").select("video_id", x).select("video_id", F.col("x.type").alias("beat_type"), F.col("x.start").alias("first"), F.col("x.end").alias("last"), F.col("x.requires").alias("needs"), "x.title", "x.why", "x.quote")
    bad = F.count_if(F.col("answer").isNull())
    spent = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens")]
    mode = F.when(bad == 0, "llm").when(bad < F.count("*"), "llm_partial").otherwise("heuristic")
    return beats, all_.groupBy("video_id").agg(mode.alias("mode"), F.count("*").alias("windows"), bad.alias("failed"), *spent)


def generated_beats(sentences: DataFrame, windows: DataFrame, provider: Provider | None, system: str) -> tuple[DataFrame, DataFrame]:
    """Beats (video_id, beat_type, first, last, needs) and (video_id, mode): a model's where it gave any that hold, by the words of the sentences themselves where there is no model or all of a video's windows failed."""
    columns = ["video_id", "beat_type", "first", "last", "needs"]
    plain = selection.heuristic_beats(sentences)
    if provider is None:
        return plain.select(columns), sentences.select("video_id").distinct().withColumn("mode", F.lit("heuristic"))
    found, report = window_beats(sentences, windows, provider, system)
    valid = valid_beats(found, sentences).select(columns)
    # videos without any window were never asked about
    modes = sentences.select("video_id").distinct().join(report.select("video_id", "mode"), "video_id", "left").withColumn("mode", F.coalesce("mode", F.lit("heuristic")))
    return valid.unionByName(plain.join(modes.filter("mode = 'heuristic'"), "video_id", "left_semi").select(columns)), modes


def digest(segments: DataFrame, lines: int = DIGEST_LINES, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """(video_id, segment, digest): for each segment (video_id, segment, first, last, summary) a line for each before it, ``[first-last] summary``.

    Beyond so many lines the older ones are pressed into a few, each with its whole range and its first summary, so that
    every sentence stays within some line. Segments without a summary are left out.
    """
    kind = F.struct("segment", "first", "last", "summary")
    whole = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(kind)).alias("all"))
    each = whole.select("video_id", "all", F.explode("all").alias("x")).select("video_id", F.col("x.segment").alias("segment"), F.filter("all", lambda s: (s["segment"] < F.col("x.segment")) & (F.coalesce(s["summary"], F.lit("")) != "")).alias("p"))
    span = lambda a, b: F.concat(F.lit("["), a["first"].cast("string"), F.lit("-"), b["last"].cast("string"), F.lit("] "))
    n, keep = F.size("p"), max(lines - buckets, 1)
    old = F.greatest(n - keep, F.lit(0))
    per = F.greatest(F.ceil(old / buckets).cast("int"), F.lit(1))
    starts = F.when(old > 0, F.sequence(F.lit(0), old - 1, per)).otherwise(F.array().cast("array<int>"))
    group = lambda i: F.slice("p", i + 1, F.least(per, old - i))
    pressed = F.transform(starts, lambda i: F.concat(span(F.get(F.col("p"), i), F.element_at(group(i), -1)), F.size(group(i)).cast("string"), F.lit(" earlier sections, opening: "), F.get(F.col("p"), i)["summary"]))
    plain = lambda xs: F.transform(xs, lambda s: F.concat(span(s, s), s["summary"]))
    found = F.when(n <= lines, plain(F.col("p"))).otherwise(F.concat(pressed, plain(F.slice("p", old + 1, F.greatest(n - old, F.lit(1))))))
    return each.select("video_id", "segment", F.array_join(found, "\n").alias("digest"))


def chapters(found: DataFrame, sentences: DataFrame) -> DataFrame:
    """(video_id, sentence_idx, title, start_sec) of chapters (video_id, sentence_idx, title) at sentences that there are; the time is the sentence's, null where it has none, and a null title is empty."""
    return found.join(sentences.select("video_id", "sentence_idx", "start_sec"), ["video_id", "sentence_idx"]).select("video_id", "sentence_idx", F.coalesce("title", F.lit("")).alias("title"), "start_sec")


# What the signals of a clip are called.
SIGNAL_LABELS = {"hook_strength": "hook", "self_containedness": "self-containedness", "emotional_delta": "emotional delta", "quotability": "quotability", "boundary_cleanliness": "clean boundaries", "taste_match": "taste match"}


def signal_label(name: Column) -> Column:
    """A signal's label; one that isn't known is its own."""
    known = F.create_map(*[F.lit(x) for pair in SIGNAL_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)
