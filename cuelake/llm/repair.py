"""Conversation structure repair over a bidirectional tight-arc DAG.

A conversation should be blank or go (s?(ua)+): system at most once and first, then user and assistant in turn. Its rows in
order and the states of that pattern are the layers of a graph, whose arcs are edits: keep, rerole, delete and insert.
Least costs from the start and to the end tell which arcs lie on a cheapest path (they are tight: both and the arc's own
make the total); from the start, the set of nodes that the edits so far can have reached then takes the least letter that a
tight arc of any of them has, until the end. No path is ever listed, however many are cheapest.

Rows are dealt by ranges of their order, not by conversation, so that several tasks share a long one. Costs from a state to
a state make a 4 x 4 matrix a task's part, which compose; each task has two such parts at most, that of the conversation
that it begins with and that of the one it ends with. Two sweeps settle them: the first gives the matrices, the second
where each possible entry leaves a part. Texts are no part of any of this: hashes stand for them until rows are written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .text import arrow_schema, table, tidy

DELETE, INSERT, RETYPE, UNENDED = 2, 5, 1, 5  # costs; keeping costs nothing, a row that isn't deleted and doesn't end UNENDED more
WHITE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}

#: States: nothing yet, after system, after user, after assistant. What a new row must be in each, and the state it leads to.
STATES, ENDS = 4, (0, 3)
WANTED, AFTER = "uuau", (2, 2, 3, 2)
NEVER = 1 << 60
#: Least costs from each state to the end where no row is left.
END = (0, 2 * INSERT, INSERT, 0)
START = (0, NEVER, NEVER, NEVER)


def _arcs(symbol: str) -> tuple:
    """Of each state, the edits (letter, cost, state) of such a row, by letter. x: must go. s, u, a, o (another role): stays as it likes; in capitals if it doesn't end."""
    out = []
    for q in range(STATES):
        arcs = [("D", DELETE, q)]
        if symbol != "x":
            extra = UNENDED if symbol.isupper() else 0
            kept = 1 if symbol.lower() == "s" and q == 0 else AFTER[q] if symbol.lower() == WANTED[q] else None
            if kept is not None:
                arcs.append(("K", extra, kept))
            arcs.append(("R", RETYPE + extra, AFTER[q]))
        out.append(tuple(arcs))
    return tuple(out)


ARCS = {s: _arcs(s) for s in "xsuaoSUAO"}


def forward(symbols: str, start: tuple, closed: bool) -> list[tuple]:
    """Least costs from the start to each state before each row, inserts there included, and after the last; there with inserts if ``closed``."""

    def inserted(f: tuple) -> tuple:
        after_user = min(f[2], INSERT + min(f[0], f[1], f[3]))
        return f[0], f[1], after_user, min(f[3], INSERT + after_user)

    out, f = [], start
    for symbol in symbols:
        f = inserted(f)
        out.append(f)
        to = [NEVER] * STATES
        for q, arcs in enumerate(ARCS[symbol]):
            for _, cost, t in arcs:
                if f[q] + cost < to[t]:
                    to[t] = f[q] + cost
        f = tuple(to)
    out.append(inserted(f) if closed else f)
    return out


def backward(symbols: str, end: tuple) -> list[tuple]:
    """Least costs from each state before each row to the end, and ``end`` itself."""
    out, b = [end], end
    for symbol in reversed(symbols):
        b0, b1, b2, b3 = (min(cost + b[t] for _, cost, t in arcs) for arcs in ARCS[symbol])
        after_user = min(b2, INSERT + b3)
        b = min(b0, INSERT + after_user), min(b1, INSERT + after_user), after_user, min(b3, INSERT + b2)
        out.append(b)
    out.reverse()
    return out


def matrix(symbols: str) -> list[int]:
    """Least costs of these rows from each state to each, row by row."""
    return [c for q in range(STATES) for c in forward(symbols, tuple(0 if k == q else NEVER for k in range(STATES)), False)[-1]]


class Path(NamedTuple):
    """Of each row the inserts before it (initials) and its edit, the inserts after the last row, and the state at the end."""

    edits: tuple
    after: str
    state: int


def walk(symbols: str, entry: int = 0, end: tuple = END, last: bool = True) -> Path:
    """The least letters of all cheapest ways from a state to the end. Unless these are a conversation's last rows, what is inserted after them is the next part's."""
    f, b = forward(symbols, tuple(0 if k == entry else NEVER for k in range(STATES)), last), backward(symbols, end)
    total, n = b[0][entry], len(symbols)
    front, at, before, edits = {entry}, 0, "", []
    while at < n or last:
        tight: dict[str, set] = {}
        for q in front:
            for letter, cost, t in ARCS[symbols[at]][q] if at < n else ():
                if f[at][q] + cost + b[at + 1][t] == total:
                    tight.setdefault(letter, set()).add(t)
            if f[at][q] + INSERT + b[at][AFTER[q]] == total:
                tight.setdefault("I", set()).add(AFTER[q])
        if not tight:
            break  # only after the last row
        letter = min(tight)
        if letter == "I":
            before += "".join(sorted({WANTED[q] for q in front if f[at][q] + INSERT + b[at][AFTER[q]] == total}))
        else:
            # the pattern leaves one role to a row in each state, and one state to each string of letters
            edits.append((before, letter, "".join(sorted({WANTED[q] for q in front}))))
            before, at = "", at + 1
        front = tight[letter]
    return Path(tuple(edits), before, min(front))


@lru_cache(1 << 14)
def _short(symbols: str) -> Path:
    return walk(symbols)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults, by a checksum of conversation and turn: gone, emptied, without ends of sentences, twice, or the user's. Null roles and texts are a space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("_kind")
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("col")


_KEYS = ["conv_id", "turn", "role", "said"]


def _rows(conversations: DataFrame) -> DataFrame:
    """With ``said``, a hash of role and text; ids and turns as numbers."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    return rows.withColumn("said", F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)))


def _same(*columns: str) -> list:
    """Columns that are equal where nulls are as well, for joins that need no comparison of nulls."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in columns]


def faults(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, said, copies, blank, duplicate, truncated, symbol, initial): equal rows of a turn as one, with its first fault and how many of its copies are duplicates.

    A duplicate's role and text were said in an earlier row of the conversation. Counting copies and first turns combines before each shuffle, so that one row repeated at will is as cheap as any.
    """
    ended = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    each = _rows(conversations).select(*_KEYS, ended.alias("ended")).groupBy(*_KEYS, "ended").agg(F.count("*").alias("copies"))
    turns = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = each.groupBy(*_same("conv_id"), F.col("said").alias("_said")).agg(F.min(turns).alias("_first"), F.count("*").alias("_turns")).filter("_turns > 1").drop("_turns")
    named = each.select("*", *_same("conv_id"))
    found = named.join(again, (named["_conv_id"] == again["_conv_id"]) & (named["said"] == again["_said"]), "left").select(*(named[c] for c in each.columns), "_first")
    blank, later = F.col("ended") == "", F.coalesce(turns > F.col("_first"), F.lit(False))
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    unended = ~blank & ~later & ~F.col("ended").isin(".", "!", "?")
    return found.select(
        *_KEYS,
        "copies",
        F.when(blank, F.col("copies")).otherwise(0).alias("blank"),
        F.when(blank, 0).when(later, F.col("copies")).otherwise(F.col("copies") - 1).alias("duplicate"),
        unended.cast("bigint").alias("truncated"),
        F.when(blank | later, "x").when(unended, F.upper(initial)).otherwise(initial).alias("symbol"),
        initial.alias("initial"),
    )


def ordered(found: DataFrame) -> DataFrame:
    """The faults in order of conversation, turn (nulls first), role and hash, with their ``place``; written, since what follows reads parts as they lie."""
    dealt = found.repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS)
    return shared.cut(dealt.withColumn("place", F.monotonically_increasing_id()))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bool, dict]]:
    """A task's conversations in order as lists by column, each with whether it is the task's first and its last."""
    rows: dict[str, list] = {}
    first = True
    for batch in batches:
        columns = batch.to_pydict()
        ids = columns["conv_id"]
        begin = 0
        for k in range(len(ids) + 1):
            if k == len(ids) or k > begin and ids[k] != ids[k - 1]:
                if begin < k:
                    if rows and rows["conv_id"][-1] != ids[begin]:
                        yield first, False, rows
                        rows, first = {}, False
                    for name, values in columns.items():
                        rows.setdefault(name, []).extend(values[begin:k])
                begin = k
    if rows:
        yield first, True, rows


_SUMMARY = "part bigint, conv_id bigint, side int, costs array<bigint>, initial string"
_EXITS = "part bigint, side int, states array<bigint>"
_EDITS = "conv_id bigint, place bigint, step bigint, edit string, copies bigint, role string, turn bigint, was string, said binary, cost bigint, illegal bigint"
#: Sides of a task that a conversation lies at: it begins there, ends there, or is all that there is.
HEAD, TAIL, ALL = range(3)


def _side(first: bool, last: bool) -> int | None:
    return ALL if first and last else HEAD if first else TAIL if last else None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _shared_parts(rows: DataFrame) -> dict[tuple[int, int], tuple]:
    """Of the parts of conversations that several tasks share: where they are entered, the costs from their end on, the role before them, and whether they are the last.

    What comes to the driver is two short rows a task, whatever the tables hold.
    """

    summary_schema, exits_schema = arrow_schema(_SUMMARY), arrow_schema(_EXITS)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for first, last, part in _parts(batches):
            side = _side(first, last)
            if side is not None:
                out.append((part["place"][0] >> 33, part["conv_id"][0], side, matrix("".join(part["symbol"])), part["initial"][-1]))
        yield _batch(out, summary_schema)

    # ALL and TAIL of a task follow its HEAD
    found = sorted(rows.select("conv_id", "place", "symbol", "initial").mapInArrow(summary, _SUMMARY).collect(), key=lambda r: (r["part"], r["side"]))
    chains: list[list] = []
    for r in found:
        before = chains[-1][-1] if chains else None
        if before is not None and before["side"] != HEAD and r["side"] != TAIL and before["conv_id"] == r["conv_id"] and before["part"] != r["part"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    ends = {}
    for chain in chains:
        cost = END
        for r in reversed(chain):
            ends[r["part"], r["side"]] = cost
            cost = tuple(min(r["costs"][STATES * q + t] + cost[t] for t in range(STATES)) for q in range(STATES))
    if not ends:
        return {}
    final = {(c[-1]["part"], c[-1]["side"]) for c in chains}

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for first, last, part in _parts(batches):
            at = (part["place"][0] >> 33, _side(first, last))
            if at in ends:
                symbols = "".join(part["symbol"])
                out.append((*at, [walk(symbols, q, ends[at], at in final).state for q in range(STATES)]))
        yield _batch(out, exits_schema)

    states = {(r["part"], r["side"]): r["states"] for r in rows.select("conv_id", "place", "symbol").mapInArrow(exits, _EXITS).collect()}
    known = {}
    for chain in chains:
        entry, initial = 0, ""
        for r in chain:
            at = (r["part"], r["side"])
            known[at] = (entry, ends[at], initial, at in final)
            entry, initial = states[at][entry], r["initial"]
    return known


def edits(rows: DataFrame) -> DataFrame:
    """(conv_id, place, step, edit, copies, role, turn, was, said, cost, illegal) of ``ordered`` rows: each letter of the audit, by place and step.

    ``role`` is the row's after the edit (None: deleted), ``was`` that before it; an inserted row has neither turn nor hash. ``copies`` are as many deletions.
    """
    known, schema = _shared_parts(rows), arrow_schema(_EDITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for first, last, part in _parts(batches):
            symbols = "".join(part["symbol"])
            entry, end, before, final = known.get((part["place"][0] >> 33, _side(first, last)), (0, END, "", True))
            path = _short(symbols) if (entry, end, final) == (0, END, True) and len(symbols) <= 64 else walk(symbols, entry, end, final)
            for k, (inserted, letter, wanted) in enumerate(path.edits):
                conv, place, was, initial = (part[c][k] for c in ("conv_id", "place", "role", "initial"))
                copies = part["copies"][k]
                step = 0
                for step, role in enumerate(inserted, 1):
                    out.append((conv, place, step, "I", 1, ROLES[role], None, None, None, INSERT, 0))
                illegal = int(bool(before) and before + initial not in ("su", "ua", "au")) + copies - 1  # copies have the same role
                before = initial
                cost = DELETE if letter == "D" else RETYPE * (letter == "R") + UNENDED * symbols[k].isupper()
                role = None if letter == "D" else was if letter == "K" else ROLES[wanted]
                out.append((conv, place, step + 1, letter, 1, role, part["turn"][k], was, part["said"][k], cost, illegal))
                if copies > 1:
                    out.append((conv, place, step + 2, "D", copies - 1, None, part["turn"][k], was, part["said"][k], DELETE * (copies - 1), 0))
                if k == len(symbols) - 1:
                    for more, role in enumerate(path.after if final else "", step + 3):
                        out.append((conv, place, more, "I", 1, ROLES[role], None, None, None, INSERT, 0))
                if len(out) >= 8192:
                    yield _batch(out, schema)
                    out = []
        yield _batch(out, schema)
        tidy()

    return rows.select("conv_id", "place", "turn", "role", "said", "copies", "symbol", "initial").mapInArrow(run, _EDITS)


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(conv_id, place, step, edit, copies, role, text, cost, illegal): conversations (conv_id, turn, role, text) repaired, one row an edit, in order of place and step.

    Rows whose ``role`` is not null are the repaired conversation; inserted ones have an empty text. Null roles and texts are a
    space, null turns come first, rows without a conv_id are a conversation; rows of one turn go by role and a hash of the text;
    a role of no letter or of another one is neither system's, user's nor assistant's. Other columns are left out, and an empty
    table gives none. ``rows`` are those that ``ordered`` made of these conversations, if there are any yet.
    """
    made = edits(ordered(faults(conversations)) if rows is None else rows)
    key = _same("conv_id", "turn")
    texts = _rows(conversations).select(*key, F.col("said").alias("_said"), "text").dropDuplicates(["_conv_id", "_turn", "_said"])
    named = made.select("*", *key, F.when(F.col("edit").isin("K", "R"), F.col("said")).alias("_said"))
    found = named.join(texts, ["_conv_id", "_turn", "_said"], "left")
    return found.select("conv_id", "place", "step", "edit", "copies", "role", F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "cost", "illegal")


_FOLDED = "conv_id bigint, cost bigint, illegal bigint, audit string, repaired_sha256 string"


def read_back(repaired: DataFrame) -> DataFrame:
    """(conv_id, cost, illegal, audit, repaired_sha256) of ``repair``'s rows. A conversation's hash needs its texts one after the other: they stream through a task, which holds a batch of them."""
    schema = arrow_schema(_FOLDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def row() -> tuple:
            return current, state[0], state[1], "".join(state[2]), state[3].hexdigest()

        for batch in batches:
            done = []
            for at in range(0, batch.num_rows, 512):
                for conv, edit, copies, role, text, cost, illegal in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    if state is None or conv != current:
                        if state is not None:
                            done.append(row())
                        current, state = conv, [0, 0, [], hashlib.sha256(), False]
                    state[0] += cost
                    state[1] += illegal
                    state[2].append(edit * copies)
                    if role is not None:
                        state[3].update(("\n" * state[4] + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                        state[4] = True
            yield _batch(done, schema)
        yield _batch([row()] if state is not None else [], schema)

    streamed = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")
    return streamed.select("conv_id", "edit", "copies", "role", "text", "cost", "illegal").mapInArrow(run, _FOLDED)


def report(original: DataFrame, damaged: DataFrame) -> DataFrame:
    """A row for each conversation of ``original``, with the faults that ``damaged`` has and their repair; zeros and empty strings where nothing is left."""
    rows = ordered(faults(damaged))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    turns = rows.groupBy("conv_id", "turn").agg(*sums)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    counts = turns.groupBy("conv_id").agg(*sums, gaps).select("*", *_same("conv_id")).drop("conv_id")
    folded = read_back(repair(damaged, rows)).select("*", *_same("conv_id")).drop("conv_id")
    ids = original.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().select("*", *_same("conv_id"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    all_ = ids.join(counts, "_conv_id", "left").join(folded, "_conv_id", "left")
    return all_.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return report(rows, damage(rows))
