"""Sentences from transcript segments."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

MOST_SECONDS, MOST_WORDS, LEAST_WORDS = 40.0, 80, 3
_PART = re.compile(r"([^.!?]*)([.!?]*)")


@dataclass
class _Pending:
    """Words that no sentence holds yet, with the time that they span."""

    parts: list[str] = field(default_factory=list)
    start: float = 0.0
    end: float = 0.0

    def add(self, text: str, start: float, end: float) -> None:
        if not self.parts:
            self.start = start
        self.parts.append(text)
        self.end = end

    @property
    def text(self) -> str:
        return " ".join(self.parts)

    @property
    def words(self) -> int:
        return len(self.text.split())


def sentences_of(segments: Iterable[tuple[str | None, float, float]]) -> list[tuple[str, int, int]]:
    """(text, start_sec, end_sec) from (text, start, duration): a sentence ends at . ! or ?, at MOST_WORDS or at MOST_SECONDS.

    Less than LEAST_WORDS waits for the next sentence; at the end and at the time limit it joins the one before instead,
    or stands alone if there is none. No word is lost.
    """
    out: list[tuple[str, int, int]] = []
    pending = _Pending()

    def close(last: bool) -> None:
        nonlocal pending
        if not pending.parts or (pending.words < LEAST_WORDS and not last):
            return
        start, end = math.floor(pending.start), math.ceil(pending.end)
        if pending.words >= LEAST_WORDS or not out:
            out.append((pending.text, start, end))
        else:
            text, first, until = out[-1]
            out[-1] = (f"{text} {pending.text}", first, max(until, end))
        pending = _Pending()

    for text, start, length in segments:
        for body, mark in _PART.findall((text or "").strip()):
            if body.strip():
                pending.add(body.strip() + mark, start, start + length)
            late = bool(pending.parts) and pending.end - pending.start >= MOST_SECONDS
            if mark or late or pending.words >= MOST_WORDS:
                close(last=late)
    close(last=True)
    return out


def segment(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, sentence_idx, text, start_sec, end_sec) from (key, text, start, duration); a sentence depends on those before, so a video is a task."""
    kind = dict(segments.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", kind="stable")
        rows = sentences_of(zip(pdf["text"], pdf["start"].fillna(0.0), pdf["duration"].fillna(0.0), strict=True))
        return pd.DataFrame([(pdf[key].iloc[0], k, *r) for k, r in enumerate(rows)], columns=[key, "sentence_idx", "text", "start_sec", "end_sec"])

    return segments.select(key, "text", "start", "duration").groupBy(key).applyInPandas(run, f"{key} {kind}, sentence_idx bigint, text string, start_sec bigint, end_sec bigint")
