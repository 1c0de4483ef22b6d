"""Chat formatting in budgeted windows of whole turns.

Prefix sums of the turns' tokens choose, from each start, the longest span of turns that fits the window's budget beside
what is repeated: the system turn, and a limited history of turns before the span. Repeated turns are marked as such and
never under the loss mask, so that each assistant text is a target once. Texts are escaped reversibly where they hold a
control string; a window can be read back to its turns and targets.

Conversations stream through a task in order of their turns: memory holds one window, its history and the system turn, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .text import table, tidy

BUDGET = 1024
#: Turns before a span that its window repeats, and their tokens, at most.
HISTORY_TURNS, HISTORY_TOKENS = 2, 256
#: Tokens that a turn's markers count for.
MARKERS = 4
TOKENIZER = "word_bpe_49k.json"

NEW, REPEATED, END = "<|im_start|>", "<|im_repeat|>", "<|im_end|>"
#: Control strings of common chat templates: none is left whole in an escaped text.
CONTROL = re.compile(r"<\|[A-Za-z0-9_]*\|>|</?s>|\[/?INST\]|<</?SYS>>")
#: The escape character (symbol for escape), followed by e for itself, c inside a control string, n for a line feed in a role.
ESCAPE = "␛"
_TURN = re.compile(r"(<\|im_start\|>|<\|im_repeat\|>)([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[0][0]}{ESCAPE}c{m[0][1:]}", text.replace(ESCAPE, ESCAPE + "e"))


def unescape(text: str) -> str:
    return re.sub(ESCAPE + "([ecn])", lambda m: {"e": ESCAPE, "c": "", "n": "\n"}[m[1]], text)


class Turn(NamedTuple):
    role: str
    text: str
    tokens: int


class Window(NamedTuple):
    """text, and the loss mask as flattened [start, end) code points of it."""

    text: str
    loss: list[int]


def render(repeated: list[Turn], new: list[Turn]) -> Window:
    parts, loss, at = [], [], 0
    for mark, turns in ((REPEATED, repeated), (NEW, new)):
        for turn in turns:
            head, body = f"{mark}{escape(turn.role).replace(chr(10), ESCAPE + 'n')}\n", escape(turn.text)
            if mark == NEW and turn.role == "assistant":
                loss += [at + len(head), at + len(head) + len(body)]
            parts += [head, body, END, "\n"]
            at += len(head) + len(body) + len(END) + 1
    return Window("".join(parts), loss)


class Formatter:
    """Windows of one conversation whose turns come in order."""

    def __init__(self, budget: int = BUDGET):
        self.budget = budget
        self.system: Turn | None = None  # the first turn, if it is the system's; repeated once a window has held it
        self.before: list[Turn] = []  # the end of what earlier windows held
        self.waiting: list[Turn] = []
        self.windows = 0

    def _repeated(self) -> list[Turn]:
        out, room = [], HISTORY_TOKENS
        for turn in reversed(self.before):
            if (room := room - turn.tokens) < 0:
                break
            out.insert(0, turn)
        return [self.system, *out] if self.system and self.windows else out

    def _close(self, span: int) -> Window:
        new, self.waiting = self.waiting[:span], self.waiting[span:]
        window = render(self._repeated(), new)
        self.before = [t for t in [*self.before, *new] if t is not self.system][-HISTORY_TURNS:]
        self.windows += 1
        return window

    def add(self, turn: Turn) -> list[Window]:
        """Windows that this turn completes: while more waits than fits, the longest span that does (one turn at least)."""
        if turn.role == "system" and not self.windows and not self.waiting:
            self.system = turn
        self.waiting.append(turn)
        out = []
        while len(self.waiting) > 1:
            prefix = np.cumsum([t.tokens for t in self.waiting])
            span = int(np.searchsorted(prefix, self.budget - sum(t.tokens for t in self._repeated()), "right"))
            if span >= len(self.waiting):
                break
            out.append(self._close(max(span, 1)))
        return out

    def end(self) -> list[Window]:
        return [self._close(len(self.waiting))] if self.waiting else []


def parse(text: str) -> list[tuple[bool, str, str]]:
    """(repeated, role, text) of each turn of a window."""
    return [(m[1] == REPEATED, unescape(m[2]), unescape(m[3])) for m in _TURN.finditer(text)]


_WINDOWS = "window bigint, text string, loss array<bigint>"


def windows(conversations: DataFrame, budget: int = BUDGET, tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, window, text, loss): each conversation's windows, in order within a partition.

    Turns go by turn, then role and text; null texts and roles are empty, null turns first; rows without a conv_id form one
    conversation; repeated rows are turns of their own. Other columns of the input are left out. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokens.tokenizer(tokenizer)
        conv, state, count = None, None, 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))], names=["conv_id", "window", "text", "loss"])

        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 512):
                part = [batch.column(c).slice(at, 512).to_pylist() for c in range(3)]
                sizes = [len(x) // of.dtype.itemsize for x in of.many(batch.column(2).slice(at, 512))]
                for k, role, text, size in zip(*part, sizes, strict=True):
                    if state is None or k != conv:
                        for w in state.end() if state else ():
                            rows.append((conv, count, w.text, w.loss))
                            count += 1
                        conv, state, count = k, Formatter(budget), 0
                    for w in state.add(Turn(role, text, size + MARKERS)):
                        rows.append((conv, count, w.text, w.loss))
                        count += 1
            yield batch_of(rows)
        yield batch_of([(conv, count + k, w.text, w.loss) for k, w in enumerate(state.end())] if state else [])
        del of, state
        tidy()

    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, f"conv_id bigint, {_WINDOWS}")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows in order as ``windows`` returns them: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        conv, sums, turns, loss = None, None, None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        def row() -> tuple:
            return (conv, sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), sums[2], sums[3])

        for batch in batches:
            rows = []
            for k, text, mask in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if sums is None or k != conv:
                    if sums is not None:
                        rows.append(row())
                    conv, sums, turns, loss = k, [0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                for repeated, role, said in parse(text):
                    if not repeated:
                        sums[0] += 1
                        turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(mask[::2], mask[1::2], strict=True):
                    target = unescape(text[a:b])
                    sums[1] += len(target)
                    loss.update(target.encode("utf-8", "surrogatepass"))
                sums[2] += len(text)
                sums[3] += 1
            yield batch_of(rows)
        yield batch_of([row()] if sums is not None else [])

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts are control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))
