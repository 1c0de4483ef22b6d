"""Quality rules: gradient-boosted trees over document statistics, flattened into numpy node arrays.

The trees are fitted here (histogram splits, logistic loss) on a bounded labelled sample. For the features in MONOTONE a
document never scores higher as the feature grows: splits that break the order are not taken and both sides' values are
held to their side of the split's middle. Scoring walks all rows through all trees at once, level by level.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .labelled import sample
from .text import per_batch, table, texts, with_fields

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "digit_share", "unique_share", "words_per_line")
#: -1: more of it never makes a document better.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "bang_share": -1}

TREES, DEPTH, BINS, RATE, LEAST_ROWS, L2 = 80, 3, 64, 0.2, 8, 1.0

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_BLANKS = b" \t\n\x0b\x0c\r"


def _count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window whose words occur as a window twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    total, done = 0, 0
    for at, w in enumerate(windows):
        if w in twice:
            total += at + 3 - max(at, done)
            done = at + 3
    return total


def statistics(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then what the features need besides: upper-case letters, '!', digits, distinct words, lines with a word."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text) - _count(data, _BLANKS),
        _count(data, SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
        _count(data, _UPPER),
        data.count(b"!"),
        _count(data, _DIGITS),
        len(set(words)),
        len(lines),
    )


def features(stats: np.ndarray) -> np.ndarray:
    """The rows' FEATURES from their statistics; shares of nothing are 0."""
    words, chars, symbols, dup, repeat, upper, bangs, digits, distinct, lines = stats.astype(np.float64).T.reshape(10, -1)
    share = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    return np.stack([words, share(chars, words), share(symbols, chars), share(dup, lines), share(repeat, words), share(upper, chars), share(bangs, chars), share(digits, chars), share(distinct, words), share(words, lines)], axis=1)


class Trees(NamedTuple):
    """All trees' nodes in flat arrays: a leaf has feature -1 and its value; other nodes go to ``left`` if the feature is at most the threshold, else to the node after it. ``roots`` are the trees' first nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            feature = self.feature[at]
            inner = feature >= 0
            right = x[rows, np.maximum(feature, 0)] > self.threshold[at]
            at = np.where(inner, self.left[at] + right, at)
        return 1 / (1 + np.exp(-np.clip(self.bias + self.value[at].sum(axis=1), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees on features and 0/1 labels; without both labels a constant model of the labels' mean (0.5 of none)."""
    mean = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(mean / (1 - mean)))
    nodes: list[list] = []
    roots: list[int] = []
    if len(np.unique(y)) == 2:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        signs = [MONOTONE.get(f, 0) for f in FEATURES]
        logit = np.full(len(y), bias)

        def leaf(g: float, h: float, low: float, high: float) -> float:
            return float(np.clip(-g / (h + L2), low, high))

        def grow(rows: np.ndarray, depth: int, low: float, high: float, at: int) -> None:
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-9, -1, 0, 0.0, 0.0)
            for f in range(x.shape[1]) if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS else ():
                size = len(edges[f]) + 1
                b = binned[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[rows], hess[rows], None))
                for cut in np.flatnonzero((ns >= LEAST_ROWS) & (ns <= len(rows) - LEAST_ROWS)):
                    gl, hl = gs[cut], hs[cut]
                    vl, vr = leaf(gl, hl, low, high), leaf(g - gl, h - hl, low, high)
                    gain = gl * gl / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g * g / (h + L2)
                    if gain > best[0] and signs[f] * (vr - vl) >= 0:
                        best = (gain, f, int(cut), vl, vr)
            if best[1] < 0:
                value = RATE * leaf(g, h, low, high)
                nodes[at][3] = value
                logit[rows] += value
                return
            _, f, cut, vl, vr = best
            left = len(nodes)
            nodes.extend([[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]])
            nodes[at][:3] = [f, float(edges[f][cut]), left]
            goes = binned[rows, f] <= cut
            middle = (vl + vr) / 2
            grow(rows[goes], depth + 1, *((middle, high) if signs[f] < 0 else (low, middle) if signs[f] > 0 else (low, high)), left)
            grow(rows[~goes], depth + 1, *((low, middle) if signs[f] < 0 else (middle, high) if signs[f] > 0 else (low, high)), left + 1)

        for _ in range(TREES):
            p = 1 / (1 + np.exp(-logit))
            grad, hess = p - y, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([-1, 0.0, 0, 0.0])
            grow(np.arange(len(y)), 0, -np.inf, np.inf, roots[-1])
    flat = np.array(nodes, np.float64).reshape(-1, 4)
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3], np.array(roots, np.int64), bias)


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    """Fitted on the labelled sample (see ``labelled.sample`` for its bounds)."""
    rows = sample(docs, labels, "quality")
    stats = np.array([statistics(t) for _, t, _ in rows], np.float64).reshape(-1, 10)
    return fit(features(stats), np.array([y for *_, y in rows], np.float64))


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def apply(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, the base statistics, base_failed, kept and the trees' score.

    A null or empty text has no words and fails the base rules. Each row gives a row; other columns are left out.
    """

    def prepare():
        def of(batch: pa.Array) -> list:
            stats = np.array([statistics(x) for x in texts(batch)], np.int64).reshape(-1, 10)
            failed = base_failed(stats[:, 0], stats[:, 4])
            score = trees.score(features(stats))
            return [*stats[:, :5].T, failed, ~failed & (score >= 0.5), score]

        return of

    ddl = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"
    return with_fields(docs, key, text, per_batch(prepare, ddl))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return apply(docs, train(docs, table(spark, sf_dir, "labels")))
