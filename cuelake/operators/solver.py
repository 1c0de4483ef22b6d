"""Clip candidates under constraints: needed setups are hard, references are kept while the clip stays short enough, pauses are preferred."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import points_back

PAYOFFS = ("punchline", "confession", "turning_point", "lesson", "payoff")
MIN_CLIP, MAX_CLIP = 12, 75
BEFORE, AFTER, LEAST_GAIN, MOST_STEPS = 3, 2, 0.15, 8
MERGE = 0.6
#: Videos that are solved at a time.
BATCH = 256

Score = Callable[[float, float], float]


class Video:
    """One video's sentences by number, its beats in order, and which earlier sentence each needs."""

    def __init__(self, sentences: list[tuple[int, float, float, bool]], beats: list[tuple[str, int, int, int | None]], score: Score | None = None):
        ordered = sorted(sentences)
        self.start = {i: s for i, s, _, _ in ordered}
        self.end = {i: e for i, _, e, _ in ordered}
        places = [i for i, *_ in ordered]
        self.needs = {i: places[k - 1] for k, (i, _, _, back) in enumerate(ordered) if k and back}
        self.beats = [b for b in beats if b[1] in self.start and b[2] in self.start and b[1] <= b[2]]
        self.score = score
        self._covering: dict[int, tuple | None] | None = None
        self._ways: dict[tuple, tuple[int | None, int]] = {}

    def length(self, a: int, b: int) -> float:
        return self.end[b] - self.start[a]

    def fits(self, a: int, b: int) -> bool:
        return MIN_CLIP <= self.length(a, b) <= MAX_CLIP

    def covering(self, i: int) -> tuple | None:
        """The first of the beats that hold a sentence that a beat needs. All are found once: a heap of open beats along the places."""
        if self._covering is None:
            order = sorted(range(len(self.beats)), key=lambda k: self.beats[k][1])
            self._covering, opened, at = {}, [], 0
            for place in sorted({b[3] for b in self.beats if b[3] is not None}):
                while at < len(order) and self.beats[order[at]][1] <= place:
                    heapq.heappush(opened, order[at])
                    at += 1
                while opened and self.beats[opened[0]][2] < place:
                    heapq.heappop(opened)
                self._covering[place] = self.beats[opened[0]] if opened else None
        return self._covering.get(i)

    def _way(self, seed: tuple) -> tuple[int | None, int]:
        """How far back the needs reach on the way from a beat to that which holds what it needs, and so on, and the beats on it; each beat is passed once for all seeds."""
        path, places, beat = [], {}, seed
        while beat is not None and beat not in self._ways and beat not in places:
            places[beat] = len(path)
            path.append(beat)
            beat = self.covering(beat[3]) if beat[3] is not None else None
        if beat in places:  # a circle: all of its beats reach as far
            circle = path[places[beat] :]
            least = min(b[3] for b in circle)
            self._ways.update(dict.fromkeys(circle, (least, len(circle))))
            del path[places[beat] :]
        least, count = self._ways[beat] if beat is not None else (None, 0)
        for b in reversed(path):
            least, count = min((x for x in (b[3], least) if x is not None), default=None), count + 1
            self._ways[b] = least, count
        return self._ways[seed]

    def setup(self, seed: tuple) -> tuple[int, int, int]:
        """(direct, whole, beats): how far back the seed's own need reaches, how far its needs' needs do, and the beats on that way."""
        direct = min(seed[1], seed[3]) if seed[3] is not None else seed[1]
        least, count = self._way(seed)
        return direct, direct if least is None else min(direct, least), count

    def resolved(self, a: int, b: int) -> int:
        """The start from which nothing up to b points back before it, as far as the longest clip and MOST_STEPS allow: a sentence needs the one before it, so that only the first can."""
        for _ in range(MOST_STEPS):
            low = self.needs.get(a, a)
            if low >= a or self.length(low, b) > MAX_CLIP:
                break
            a = low
        return a

    def dangling(self, a: int, b: int) -> list[int]:
        return [a] if a <= b and self.needs.get(a, a) < a else []

    def aligned(self, a: int, b: int) -> tuple[int, int, float]:
        """Bounds on the cleanest pauses near by, if they gain LEAST_GAIN; of equal ones the tightest."""
        if self.score is None:
            return a, b, 0.0
        base = self.score(self.start[a], self.end[b])
        best = (base, 0, a, b)
        for x in range(a, a - BEFORE - 1, -1):
            for y in range(b, b + AFTER + 1):
                if (x, y) != (a, b) and x in self.start and y in self.start and self.fits(x, y):
                    value, wider = self.score(self.start[x], self.end[y]), (a - x) + (y - b)
                    if value >= base + LEAST_GAIN and (value, -wider) > best[:1] + (-best[1],):
                        best = (value, wider, x, y)
        return best[2], best[3], round(best[0] - base, 4)

    def candidates(self) -> list[tuple[int, int, int, float, list[int]]]:
        """(first, last, beats, gain, dangling) by start: one for each payoff whose setup fits; of those that share more than MERGE of their sentences the one of more beats."""
        found = []
        for seed in self.beats:
            if seed[0] not in PAYOFFS:
                continue
            direct, whole, count = self.setup(seed)
            for a, beats in ((whole, count), (direct, min(count, 2))):
                if a not in self.start:
                    continue
                a = self.resolved(a, seed[2])
                if self.fits(a, seed[2]):
                    x, y, gain = self.aligned(a, seed[2])
                    found.append((x, y, beats, gain, self.dangling(x, y)))
                    break
        kept: list[tuple] = []
        open_: list[int] = []  # places in kept of those that reach the next one's start
        for c in sorted(found, key=lambda c: c[0]):
            open_ = [k for k in open_ if kept[k][1] >= c[0]]
            near = next((k for k in open_ if _share(kept[k], c) > MERGE), None)
            if near is None:
                open_.append(len(kept))
                kept.append(c)
            elif c[2] > kept[near][2]:
                kept[near] = c
        return kept


def _share(a: tuple, b: tuple) -> float:
    both = max(0, min(a[1], b[1]) - max(a[0], b[0]) + 1)
    return both / (a[1] - a[0] + b[1] - b[0] + 2 - both)


def solve(sentences: DataFrame, beats: DataFrame, score: Score | None = None) -> DataFrame:
    """(video_id, first, last, beats, gain, dangling, start_sec, end_sec) from sentences (video_id, sentence_idx, text, start_sec, end_sec) and beats (video_id, beat_type, first, last, needs).

    Which sentence points back is computed on whole tables; the search needs a video's sentences and beats together: a
    row for each video that has both, with its numbers and none of its texts, and many rows a batch.
    """
    kind = dict(sentences.dtypes)["video_id"]
    second = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    line = F.struct(F.col("sentence_idx").cast("bigint").alias("i"), second("start_sec"), second("end_sec"), points_back(F.col("text")).alias("back"))
    beat = F.struct("beat_type", *[F.col(c).cast("bigint").alias(c) for c in ("first", "last", "needs")])
    lines = sentences.groupBy("video_id").agg(F.collect_list(line).alias("lines"))
    both = lines.join(beats.groupBy("video_id").agg(F.collect_list(beat).alias("beats")), "video_id")

    names = ("video_id", "first", "last", "beats", "gain", "dangling", "start_sec", "end_sec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = (batch.schema.field("video_id").type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.float64(), pa.float64())
            for at in range(0, batch.num_rows, BATCH):
                found = []
                for row in batch.slice(at, BATCH).to_pylist():
                    named = [(b["beat_type"], b["first"], b["last"], None if b["needs"] is None or b["needs"] > b["first"] else b["needs"]) for b in row["beats"]]
                    named.sort(key=lambda b: (b[1], b[2], b[0], b[3] is not None, b[3] or 0))
                    video = Video([tuple(x.values()) for x in row["lines"]], named, score)
                    found += [(row["video_id"], a, b, *rest, video.start[a], video.end[b]) for a, b, *rest in video.candidates()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(types)], names=names)

    return both.mapInArrow(run, f"video_id {kind}, first bigint, last bigint, beats bigint, gain double, dangling array<bigint>, start_sec double, end_sec double")
