"""Compression classifier: zstandard dictionaries of good and bad text; the normalised size difference becomes a score.

Half of the labelled sample gives the two dictionaries, equally long ones, the other half calibrates. Each text is
compressed block by block under the good dictionary, the bad one and none. Only differences between these sizes are
features: bad less good and none less good over the text's length, each of the whole text and of its worst block, and
what either dictionary saves over the size without one, which tells text that repeats itself. A logistic regression
fitted on the calibration half makes a score of them. Compression time and memory are linear in the text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .text import fresh, per_batch, table, texts

#: Bytes of each dictionary, bytes of a block, and zstandard's level.
DICT_BYTES = 50_000
BLOCK = 512
LEVEL = 3
#: Fewer samples than this train no dictionary.
LEAST_SAMPLES = 16
#: Steps of Newton's method and the ridge of the calibration.
STEPS, RIDGE = 30, 1.0
FEATURES = ("bad less good", "bad less good of the worst block", "none less good", "none less good of the worst block", "saved by good", "saved by bad")
N_FEATURES = len(FEATURES)


class Model(NamedTuple):
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained zstandard dictionary; of samples too few or short to train one, pieces of each as plain content; empty of none."""
    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= LEAST_SAMPLES else _content(samples)[:size]
    except zstandard.ZstdError:
        return _content(samples)[:size]


def dictionaries(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    """One of each kind, the longer made again as short as the other one, so that no difference comes from the room that they have."""
    both = dictionary(good), dictionary(bad)
    least = min(map(len, both))
    return tuple(d if len(d) == least else (again if len(again := dictionary(x, least)) == least else d[:least]) for d, x in zip(both, (good, bad), strict=True))


def _content(samples: list[bytes]) -> bytes:
    """As many bytes from the middle of each sample, so that no long text fills it."""
    share = max(64, DICT_BYTES // max(1, len(samples)))
    return b"\n".join(x[max(0, (len(x) - share) // 2) :][:share] for x in samples[: DICT_BYTES // 64])[:DICT_BYTES]


class Sizes:
    """Features of texts from compressed sizes under a model's dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.good, self.bad, self.none = make(good).compress, make(bad).compress, make(b"").compress

    def __call__(self, text: str) -> tuple:
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return (0.0,) * N_FEATURES
        n, g, b, z = len(data), 0, 0, 0
        worst, least = [], []
        for at in range(0, n, BLOCK):
            block = data[at : at + BLOCK]
            x, y, none = len(self.good(block)), len(self.bad(block)), len(self.none(block))
            g, b, z = g + x, b + y, z + none
            room = max(len(block), BLOCK // 4)
            worst.append((y - x) / room)
            least.append((none - x) / room)
        return (b - g) / n, min(worst), (z - g) / n, min(least), (z - g) / z, (z - b) / z


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the last is the constant) of a ridge logistic regression by Newton's method."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = RIDGE * np.diag([*[1.0] * x.shape[1], 1e-3])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge, z.T @ (p - y) + ridge @ w)
    return mean, scale, w


def fit(rows: list[tuple[str, int]]) -> Model:
    """From (text, label) rows: even ones make the dictionaries, odd ones calibrate. Without both labels every text scores the labels' smoothed mean."""
    y = np.array([label for _, label in rows], np.float64)
    source = [(t.encode("utf-8", "surrogatepass"), label) for t, label in rows[::2]]
    good, bad = dictionaries(*([t for t, label in source if label == k] for k in (1, 0)))
    if not good or not bad or len(set(y[1::2])) < 2:
        mean = (y.sum() + 1) / (len(y) + 2)
        return Model(good, bad, np.zeros(N_FEATURES), np.ones(N_FEATURES), np.array([0.0] * N_FEATURES + [np.log(mean / (1 - mean))]))
    of = Sizes(good, bad)
    return Model(good, bad, *calibrate(np.array([of(t) for t, _ in rows[1::2]]), y[1::2]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted on the labelled sample (see ``labelled.sample`` for its bounds), never on held-out rows."""
    return fit([(t, y) for _, t, y in sample(docs, labels, "quality")])


def score_of(model: Model):
    """The struct function (score, predicted) of a text; null counts as empty."""

    def prepare():
        of = Sizes(model.good, model.bad)

        def scores(batch: pa.Array) -> list:
            x = np.array([of(t) for t in texts(batch)], np.float64).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip((x - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1], -30, 30)))
            return [p, (p >= 0.5).astype(np.int32)]

        return scores

    return per_batch(prepare, "score double, predicted int")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, held_out, score, predicted. A null key is not held out; each row gives a row; other columns are left out."""
    slim = docs.select(F.col(key), F.col(text).alias("_text"))
    held: Column = F.coalesce(held_out(key), F.lit(False)).alias("held_out")
    return slim.select(F.col(key), held, score_of(model)(F.col("_text")).alias("_fields")).select(key, "held_out", "_fields.*")


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that the model predicts as good, with all their columns."""
    verdict = fresh(docs, "_verdict")
    return docs.withColumn(verdict, score_of(model)(F.col(text))).filter(F.col(f"{verdict}.predicted") == 1).drop(verdict)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
