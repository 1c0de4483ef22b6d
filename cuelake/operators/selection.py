"""Clips: topic segments, beats, constraint-solved candidates, snapped bounds and named signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, texts
from ..sources import scratch
from . import prosody
from .intervals import as_of

MIN_SEGMENT, MIN_GAIN, MAX_DEPTH = 8, 0.012, 12
MIN_CLIP, MAX_CLIP = 12, 75
MERGE_IOU = 0.6
FOCUS_WORDS, FOCUS_SECONDS = 55, 25
LEAD_IN, TAIL, SNAP = 0.12, 0.25, 1.2
#: Sentences by which a clip may grow for a clean pause, the gain that this needs, and how clean cuts count that nothing is known about.
BEFORE, AFTER, LEAST_GAIN, UNMEASURED = 3, 2, 0.15, 0.5
# The share of meaning in a hook, the blend's range, the range of cues alone, and the bonus of a beat.
HOOK_MEANING, HOOK_RANGE, HOOK_CUES_ALONE, HOOK_BONUS = 0.20, (0.0164, 0.4314), 0.5, 0.15
WEIGHTS = {"hook_strength": 0.25, "self_containedness": 0.20, "emotional_delta": 0.20, "quotability": 0.20, "boundary_cleanliness": 0.15}


def split_points(vectors: np.ndarray, min_gain: float = MIN_GAIN, min_segment: int = MIN_SEGMENT) -> list[int]:
    """Where topics change: a span is cut where the lengths of both sides' vector sums exceed the whole's most, if the gain a sentence reaches min_gain."""
    sums = np.vstack([np.zeros(vectors.shape[1]), np.cumsum(vectors, axis=0)])
    length = lambda a, b: np.linalg.norm(sums[b] - sums[a], axis=-1)
    cuts, spans = [], [(0, len(vectors), 0)]
    while spans:
        a, b, depth = spans.pop()
        places = np.arange(a + min_segment, b - min_segment + 1)
        if depth >= MAX_DEPTH or not len(places):
            continue
        gain = length(a, places) + length(places, b) - length(a, b)
        k = int(np.argmax(gain))
        if gain[k] / (b - a) >= min_gain:
            cuts.append(int(places[k]))
            spans += [(a, cuts[-1], depth + 1), (cuts[-1], b, depth + 1)]
    return sorted(cuts)


def topic_segments(sentences: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """(group, order, segment): each video's sentences with their topic's number. Cuts depend on those before, so a video is a task; its vectors alone are held."""
    kinds = dict(sentences.dtypes)

    def segment(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        cuts = split_points(np.stack(pdf[vector].to_numpy()).astype(np.float64))
        return pdf[[group, order]].assign(segment=np.searchsorted(cuts, np.arange(len(pdf)), "right").astype(np.int64))

    return sentences.select(group, order, vector).groupBy(group).applyInPandas(segment, f"{group} {kinds[group]}, {order} {kinds[order]}, segment bigint")


def packed_windows(segments: DataFrame, group: str, order: str, size: int = 60, overlap: int = 10) -> DataFrame:
    """(group, window, order): whole segments in turn in windows of ``size`` rows at most; a larger segment has windows of its own that overlap.

    Segments are few: their sizes are folded in order, and rows then join their segment's windows.
    """
    sizes = segments.groupBy(group, "segment").agg(F.count("*").alias("n"))
    kind = "array<struct<segment:bigint,n:bigint,window:bigint,filled:bigint>>"
    step_ = size - overlap

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        own = F.when(x["n"] > size, F.ceil((x["n"] - size) / step_) + 1).otherwise(1)  # windows that this segment takes
        joins = (F.size(done) > 0) & (x["n"] <= size) & (last["filled"] + x["n"] <= size)
        at = F.when(F.size(done) == 0, 0).when(joins, last["window"]).otherwise(last["window"] + 1)
        filled = F.when(joins, last["filled"] + x["n"]).when(x["n"] > size, size).otherwise(x["n"])
        return F.concat(done, F.array(F.struct(x["segment"].alias("segment"), x["n"].alias("n"), (at + own - 1).cast("bigint").alias("window"), filled.cast("bigint").alias("filled"))))

    folded = sizes.groupBy(group).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("segment", "n"))), F.array().cast(kind), step).alias("w"))
    last = folded.select(group, F.explode("w").alias("w")).select(group, "w.segment", "w.n", F.col("w.window").alias("_last"))
    place = F.row_number().over(W.partitionBy(group, "segment").orderBy(order)) - 1
    rows = segments.withColumn("_p", place).join(last, [group, "segment"])
    windows = F.when(F.col("n") > size, F.ceil((F.col("n") - size) / step_) + 1).otherwise(1)
    low = F.greatest(F.lit(0), F.ceil((F.col("_p") - size + 1) / step_))
    high = F.least(F.floor(F.col("_p") / step_), windows - 1)
    numbers_ = F.when(F.col("n") > size, F.sequence(low.cast("bigint"), high.cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    moved = F.transform(numbers_, lambda k: (k + F.col("_last") - windows + 1).cast("bigint"))
    return rows.select(group, F.explode(moved).alias("window"), order)


def heuristic_beats(sentences: DataFrame) -> DataFrame:
    """(video_id, beat_type, first, last, needs): the opening line as a hook, questions with the sentence after as payoffs, sentences with a discourse marker as turning points that need the one before. Of beats of one kind that overlap, the first stays."""
    w = W.partitionBy("video_id").orderBy("sentence_idx")
    low = F.lower(F.trim("text"))
    marked = F.lit(False)
    for m in texts.DISCOURSE_MARKERS:
        marked = marked | low.contains(m)
    asks = low.endswith("?") | low.rlike("^(" + "|".join(texts.QUESTION_WORDS) + ")")
    at = F.col("sentence_idx")
    s = sentences.select("video_id", "sentence_idx", F.row_number().over(w).alias("n"), F.lag("sentence_idx").over(w).alias("before"), F.lead("sentence_idx").over(w).alias("after"), asks.alias("asks"), marked.alias("marked"))
    beat = lambda kind, last, needs: F.struct(F.lit(kind).alias("beat_type"), at.alias("first"), last.alias("last"), needs.cast("bigint").alias("needs"))
    beats = F.array(F.when(F.col("n") == 1, beat("hook", at, F.lit(None))), F.when(F.col("asks") & F.col("after").isNotNull(), beat("payoff", F.col("after"), at)), F.when(F.col("marked"), beat("turning_point", at, F.coalesce("before", "sentence_idx"))))
    found = s.select("video_id", F.explode(F.filter(beats, lambda b: b.isNotNull())).alias("b")).select("video_id", "b.*")
    kind = "array<struct<first:bigint,last:bigint,needs:bigint>>"

    def step(kept: Column, x: Column) -> Column:
        return F.when((F.size(kept) > 0) & (x["first"] <= F.element_at(kept, -1)["last"]), kept).otherwise(F.concat(kept, F.array(x)))

    folded = found.groupBy("video_id", "beat_type").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("first", "last", "needs"))).cast(kind), F.array().cast(kind), step).alias("k"))
    return folded.select("video_id", "beat_type", F.explode("k").alias("k")).select("video_id", "beat_type", "k.*")


def merge_candidates(found: DataFrame, share: float = MERGE_IOU) -> DataFrame:
    """Candidates in order of their start; one that overlaps the last kept by more than the share of sentences gives way to the longer."""
    kind = "array<struct<first:bigint,last:bigint,s:bigint,e:bigint>>"
    row = F.struct(F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), F.col("start_sec").cast("bigint").alias("s"), F.col("end_sec").cast("bigint").alias("e"))

    def step(kept: Column, x: Column) -> Column:
        k = F.element_at(kept, -1)
        near = numbers.iou(k["first"], k["last"] + 1, x["first"], x["last"] + 1) > share
        longer = (x["last"] - x["first"]) > (k["last"] - k["first"])
        return F.when(F.size(kept) == 0, F.array(x)).when(~near, F.concat(kept, F.array(x))).when(longer, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(kept)

    folded = found.groupBy("video_id").agg(F.aggregate(F.array_sort(F.collect_list(row)).cast(kind), F.array().cast(kind), step).alias("k"))
    return folded.select("video_id", F.explode("k").alias("k")).select("video_id", "k.first", "k.last", F.col("k.s").alias("start_sec"), F.col("k.e").alias("end_sec"))


def snapped(clips: DataFrame, start_word: str, end_word: str) -> DataFrame:
    """Bounds on word edges with a lead-in and a tail; an edge without a word within SNAP seconds (null) stays as it is."""
    s = F.when(F.abs(F.col(start_word) - F.col("start_sec")) <= SNAP, F.greatest(F.lit(0.0), F.col(start_word) - LEAD_IN)).otherwise(F.col("start_sec").cast("double"))
    e = F.when(F.abs(F.col(end_word) - F.col("end_sec")) <= SNAP, F.col(end_word) + TAIL).otherwise(F.col("end_sec").cast("double"))
    return clips.withColumn("new_start", s).withColumn("new_end", e).withColumn("precise", F.col("new_end") > F.col("new_start"))


def snap_info(start: Column, end: Column, new_start: Column, new_end: Column, reason: Column) -> Column:
    """A struct of how far a clip's bounds moved, with their signs, and whether they did."""
    a, b = F.round(new_start - start, 4), F.round(new_end - end, 4)
    return F.struct(((a != 0) | (b != 0)).alias("snapped"), a.alias("start_moved_by"), b.alias("end_moved_by"), reason.alias("reason"))


def self_containedness(text: Column, dangling: Column) -> Column:
    """1 less 0.35 for each dangling reference (null: not measured) and 0.08 for each pointing word among the first ten."""
    words = F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0)), 1, 10)
    pointing = F.size(F.filter(words, lambda w: F.split_part(w, F.lit("'"), F.lit(1)).isin(*texts.PRONOUNS, *texts.DEMONSTRATIVES)))
    return numbers.clamp01(1 - 0.08 * pointing - 0.35 * F.coalesce(dangling, F.lit(0)))


def composite(signals: dict[str, Column], taste: Column | None = None) -> Column:
    """The weighted sum of the signals, rounded to four places; a taste signal takes 15 % and the others share the rest."""
    total = sum((signals[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    if taste is not None:
        total = F.when(taste.isNull(), total).otherwise(0.85 * total + 0.15 * taste)
    return F.round(total, 4)


def focus_quotes(sentences: DataFrame) -> DataFrame:
    """(video_id, first, last, n_words): for videos of more than FOCUS_WORDS words, the sentences around the one of the largest ``weight`` (if there is such a column and value; the first of equals), or the middle one, that fit FOCUS_WORDS and FOCUS_SECONDS, grown by turns, the one before first."""
    kinds = dict(sentences.dtypes)

    def focus(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sentence_idx")
        n, s, e, at = (pdf[c].to_numpy() for c in ("n_words", "start_sec", "end_sec", "sentence_idx"))
        empty = pd.DataFrame({"video_id": pd.Series([], dtype=object), "first": [], "last": [], "n_words": []})
        if n.sum() <= FOCUS_WORDS or len(n) < 2:
            return empty
        weight = pdf["weight"].to_numpy(dtype=float)
        lo = hi = len(n) // 2 if np.isnan(weight).all() else int(np.nanargmax(weight))
        grew = True
        while grew:
            grew = False
            for a, b in ((lo - 1, hi), (lo, hi + 1)):
                a, b = min(a, lo), max(b, hi)
                if a >= 0 and b < len(n) and (a, b) != (lo, hi) and n[a : b + 1].sum() <= FOCUS_WORDS and e[b] - s[a] <= FOCUS_SECONDS:
                    lo, hi, grew = a, b, True
        return pd.DataFrame({"video_id": pd.Series([pdf["video_id"].iloc[0]], dtype=object), "first": [at[lo]], "last": [at[hi]], "n_words": [n[lo : hi + 1].sum()]})

    weight = F.col("weight").cast("double") if "weight" in sentences.columns else F.lit(None).cast("double")
    return sentences.select("video_id", "sentence_idx", "n_words", "start_sec", "end_sec", weight.alias("weight")).groupBy("video_id").applyInPandas(focus, f"video_id {kinds['video_id']}, first bigint, last bigint, n_words bigint")


def pauses(points: DataFrame, words: DataFrame) -> DataFrame:
    """Points (video_id, at, side, ..), where side is start or end, with ``word``, the onset or offset of the word there, and ``pause``: the seconds of silence in the speech there; null if nothing is said on the other side.

    Pauses are whole microseconds. Of a start it is the gap before the first word from then on, of an end the gap behind the last word until then: a
    property of the speech, which doesn't change as a cut moves inside a pause. Words are (video_id, start, end); four as-of joins for all points.
    """
    never = 1e18
    starts, ends = points.filter("side = 'start'"), points.filter("side = 'end'")
    onset = as_of(starts, "at", words, "video_id", "start", "_word", forward=True).withColumn("_edge", F.coalesce("_word", F.lit(-never)))
    before = as_of(onset, "_edge", words, "video_id", "end", "_other").withColumn("pause", F.greatest(F.lit(0.0), F.col("_word") - F.col("_other")))
    offset = as_of(ends, "at", words, "video_id", "end", "_word").withColumn("_edge", F.coalesce("_word", F.lit(never)))
    after = as_of(offset, "_edge", words, "video_id", "start", "_other", forward=True).withColumn("pause", F.greatest(F.lit(0.0), F.col("_other") - F.col("_word")))
    both = before.unionByName(after)
    known = F.col("_word").isNotNull() & F.col("_other").isNotNull()  # greatest passes over nulls
    return both.withColumn("pause", F.when(known, F.round("pause", 6))).select(*points.columns, F.col("_word").alias("word"), "pause")


def cleanliness(start_pause: Column, end_pause: Column, timed: Column) -> Column:
    """How clean both cuts are: the mean of their pauses' scores, or UNMEASURED for a video without timed words."""
    return F.when(timed, (numbers.pause_score(start_pause) + numbers.pause_score(end_pause)) / 2).otherwise(UNMEASURED)


def pause_aligned(clips: DataFrame, sentences: DataFrame, words: DataFrame) -> DataFrame:
    """Clips (video_id, first, last) on the cleanest pauses near by: (video_id, first, last, new_first, new_last, gain, score).

    A clip may begin up to BEFORE sentences earlier and end up to AFTER later, within the limits of its length. Of these
    bounds the cleanest wins if it gains LEAST_GAIN; of equally clean ones the tightest, then that which begins later. A clip whose own
    length is outside the limits has no row. Twelve bounds a clip come from seven points, each of which is looked up once.
    """
    return _aligned(clips, sentences, words).drop("onset", "offset")


def _aligned(clips: DataFrame, sentences: DataFrame, words: DataFrame) -> DataFrame:
    """``pause_aligned`` with the words at both bounds: ``onset`` of the first from the start on, ``offset`` of the last until the end."""
    own = clips.select("video_id", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last")).distinct()
    timed = words.select("video_id").distinct().withColumn("_timed", F.lit(True))
    at = sentences.select("video_id", F.col("sentence_idx").cast("bigint").alias("idx"), F.col("start_sec").cast("double").alias("_s"), F.col("end_sec").cast("double").alias("_e"))
    begin = own.select("*", F.explode(F.sequence(F.col("first") - BEFORE, F.col("first"))).alias("idx"), F.lit("start").alias("side"))
    finish = own.select("*", F.explode(F.sequence(F.col("last"), F.col("last") + AFTER)).alias("idx"), F.lit("end").alias("side"))
    named = begin.unionByName(finish).join(at, ["video_id", "idx"]).withColumn("at", F.when(F.col("side") == "start", F.col("_s")).otherwise(F.col("_e"))).drop("_s", "_e")
    # clips share points: each sentence's start and end are looked up once
    points = pauses(named.select("video_id", "idx", "at", "side").distinct(), words)
    found = named.join(points, ["video_id", "idx", "at", "side"])
    mine = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("idx", "at", "pause", "word")))
    each = found.groupBy("video_id", "first", "last").agg(mine("start").alias("a"), mine("end").alias("b")).join(timed, "video_id", "left")
    known = F.coalesce("_timed", F.lit(False))

    def bound(x: Column, y: Column) -> Column:
        score, wider = cleanliness(x["pause"], y["pause"], known), (F.col("first") - x["idx"]) + (y["idx"] - F.col("last"))
        return F.struct(score.alias("score"), (-wider).alias("tight"), x["idx"].alias("x"), y["idx"].alias("y"), (y["at"] - x["at"]).alias("length"), x["word"].alias("onset"), y["word"].alias("offset"))

    bounds = F.filter(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: bound(x, y)))), lambda c: c["length"].between(MIN_CLIP, MAX_CLIP))
    listed = each.withColumn("_all", bounds).withColumn("_own", F.get(F.filter("_all", lambda c: c["tight"] == 0), F.lit(0))).filter("_own IS NOT NULL")
    best = F.array_max(F.filter("_all", lambda c: (c["tight"] == 0) | (c["score"] >= F.col("_own.score") + LEAST_GAIN)))
    return listed.withColumn("_best", best).select("video_id", "first", "last", F.col("_best.x").alias("new_first"), F.col("_best.y").alias("new_last"), F.round(F.col("_best.score") - F.col("_own.score"), 4).alias("gain"), F.col("_best.score").alias("score"), "_best.onset", "_best.offset")


def on_pauses(clips: DataFrame, sentences: DataFrame, words: DataFrame) -> DataFrame:
    """The solver's clips (video_id, first, last, beats, gain, dangling, start_sec, end_sec) with the bounds, gain, times and dangling reference of ``pause_aligned``."""
    found = scratch.written(clips, scratch.folder(clips.sparkSession, "clips"))
    moved = pause_aligned(found, sentences, words).drop("score")
    before = F.lag("sentence_idx").over(W.partitionBy("video_id").orderBy("sentence_idx"))
    begin = sentences.select("video_id", F.col("sentence_idx").cast("bigint").alias("new_first"), F.col("start_sec").cast("double").alias("start_sec"), (texts.points_back(F.col("text")) & before.isNotNull()).alias("_open"))
    until = sentences.select("video_id", F.col("sentence_idx").cast("bigint").alias("new_last"), F.col("end_sec").cast("double").alias("end_sec"))
    each = moved.join(found.select("video_id", "first", "last", "beats"), ["video_id", "first", "last"]).join(begin, ["video_id", "new_first"]).join(until, ["video_id", "new_last"])
    dangling = F.when(F.col("_open"), F.array("new_first")).otherwise(F.array().cast("array<bigint>"))
    return each.select("video_id", F.col("new_first").alias("first"), F.col("new_last").alias("last"), "beats", "gain", dangling.alias("dangling"), "start_sec", "end_sec")


def snap_to_words(clips: DataFrame, words: DataFrame) -> DataFrame:
    """Clips (video_id, start_sec, end_sec, ..) with new_start, new_end and precise: the start on the next word's onset, the end on the last word's offset, see ``snapped``."""
    at = clips.withColumn("_s", F.col("start_sec").cast("double")).withColumn("_e", F.col("end_sec").cast("double"))
    both = as_of(as_of(at, "_s", words, "video_id", "start", "_onset", forward=True), "_e", words, "video_id", "end", "_offset")
    return snapped(both, "_onset", "_offset").drop("_s", "_e", "_onset", "_offset")


def hook_strength(opening: Column, meaning: Column | None, beat: Column) -> Column:
    """How strongly a clip opens: its line's cues, blended with a meaning where a model gives one (null: by the cues alone, on their own range), and a bonus if the line is in a hook's beat."""
    cues = texts.hook_lexical(opening)
    alone = numbers.normalise(cues, 0.0, HOOK_CUES_ALONE)
    blend = alone if meaning is None else F.when(meaning.isNull(), alone).otherwise(numbers.normalise(HOOK_MEANING * meaning + (1 - HOOK_MEANING) * cues, *HOOK_RANGE))
    return numbers.clamp01(blend + F.when(beat, HOOK_BONUS).otherwise(0.0))


def ranked_clips(clips: DataFrame, sentences: DataFrame, words: DataFrame, idf: DataFrame, beats: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """(video_id, first, last, start_sec, end_sec, the five signals, gain, composite): clips (video_id, first, last) aligned to pauses, snapped to words and measured.

    Sentences are (video_id, sentence_idx, text, start_sec, end_sec), beats (video_id, beat_type, first, last). The pace of the words is
    measured here; energy and pitch come from ``measured`` (clip_id, energy_delta, pitch_range_st, pitch_delta_st) by
    the clip's id, video_id:first:last, where there are any. What was not measured has no weight.
    """
    # what found the clips and times the words runs once, not at each look at them; videos without clips have no use for their words
    own = scratch.written(clips.select("video_id", "first", "last"), scratch.folder(clips.sparkSession, "clips"))
    words = scratch.written(words.select("video_id", "start", "end").join(own.select("video_id").distinct(), "video_id", "left_semi"), scratch.folder(clips.sparkSession, "words"))
    found = _aligned(own, sentences, words)
    moved = found.groupBy("video_id", F.col("new_first").alias("first"), F.col("new_last").alias("last")).agg(*[F.max(c).alias(c) for c in ("gain", "score", "onset", "offset")])
    before = F.lag("sentence_idx").over(W.partitionBy("video_id").orderBy("sentence_idx"))
    # a sentence that points back needs the one before it: only a clip's first can be without
    lines = sentences.select("video_id", F.col("sentence_idx").cast("bigint").alias("first"), "text", "start_sec", (texts.points_back(F.col("text")) & before.isNotNull()).cast("int").alias("_open"))
    until = sentences.select("video_id", F.col("sentence_idx").cast("bigint").alias("last"), "end_sec")
    # a bound on words needs the same onsets and offsets as its pause
    placed = snapped(moved.join(lines, ["video_id", "first"]).join(until, ["video_id", "last"]), "onset", "offset")
    # clips are few and looked at five times: they are written once
    named = placed.select("video_id", "first", "last", "gain", "score", "text", "_open", F.col("new_start").alias("start_sec"), F.col("new_end").alias("end_sec"), F.concat_ws(":", "video_id", "first", "last").alias("clip_id"))
    named = scratch.written(named, scratch.folder(clips.sparkSession, "clips"))
    quote = named.select("clip_id", F.explode(texts.terms(F.col("text"))).alias("term")).join(idf, "term").groupBy("clip_id").agg(F.avg("idf").alias("_idf"))
    hooks = beats.filter(F.col("beat_type") == "hook").select("video_id", F.explode(F.sequence(F.col("first").cast("bigint"), F.col("last").cast("bigint"))).alias("first")).distinct()
    opens = named.join(hooks, ["video_id", "first"]).select("clip_id", F.lit(True).alias("_beat"))
    pace = prosody.rate_delta(words, named)
    every = named.join(quote, "clip_id", "left").join(opens, "clip_id", "left").join(pace, "clip_id", "left")
    if measured is not None:
        every = every.join(measured.select("clip_id", "energy_delta", "pitch_range_st", "pitch_delta_st"), "clip_id", "left")
    heard = lambda c: F.col(c) if measured is not None else F.lit(None).cast("double")
    signals = {
        "hook_strength": hook_strength(F.col("text"), None, F.coalesce("_beat", F.lit(False))),
        "self_containedness": self_containedness(F.col("text"), F.col("_open")),
        "emotional_delta": prosody.emotional_delta(F.lit(False), prosody.acoustic(F.col("rate_delta"), heard("energy_delta"), heard("pitch_range_st"), heard("pitch_delta_st"))),
        "quotability": F.coalesce(numbers.normalise(F.col("_idf"), 4.0, 6.3), F.lit(0.2)),
        "boundary_cleanliness": F.col("score"),
    }
    return every.select("video_id", "first", "last", "start_sec", "end_sec", "gain", *[v.alias(k) for k, v in signals.items()], composite(signals).alias("composite"))
