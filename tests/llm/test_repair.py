"""Conversation structure repair against every edit that there is, and against a plain version of its tables."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.llm import repair

PATTERN = re.compile("(s?(ua)+)?")
COLUMNS = "conv_id bigint, turn bigint, role string, text string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def every_repair(symbols: str, most: int) -> list[tuple]:
    """(cost, audit, roles) of all edits that cost so much at most, without looking at any state."""
    found = []

    def go(k: int, cost: int, audit: str, roles: str) -> None:
        if cost > most or not re.match("s?(ua)*u?$", roles):
            return
        if k == len(symbols) and PATTERN.fullmatch(roles):
            found.append((cost, audit, roles))
        for role in "ua":
            go(k, cost + 5, audit + "I", roles + role)
        if k < len(symbols):
            x, extra = symbols[k], 5 * symbols[k].isupper()
            go(k + 1, cost + 2, audit + "D", roles)
            if x != "x":
                go(k + 1, cost + extra, audit + "K", roles + x.lower())
                for role in "ua":
                    go(k + 1, cost + 1 + extra, audit + "R", roles + role)

    go(0, 0, "", "")
    return found


def audit_of(path: repair.Path) -> str:
    return "".join("I" * len(before) + letter for before, letter, _ in path.edits) + "I" * len(path.after)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="xsuaoSUAO", max_size=5))
def test_the_least_of_all_cheapest_edits(symbols):
    all_ = every_repair(symbols, 2 * len(symbols))  # deleting all of it always does
    cost = min(c for c, _, _ in all_)
    best = min((audit, roles) for c, audit, roles in all_ if c == cost)
    path = repair.walk(symbols)
    assert audit_of(path) == best[0]
    roles = "".join(before + {"D": "", "K": x.lower(), "R": wanted}[letter] for x, (before, letter, wanted) in zip(symbols, path.edits, strict=True)) + path.after
    assert roles == best[1] and repair.backward(symbols, repair.END)[0][0] == cost


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="xsuaoSUAO", max_size=30), st.lists(st.integers(0, 30), max_size=4))
def test_parts_compose(symbols, cuts):
    at = [0, *sorted(min(c, len(symbols)) for c in cuts), len(symbols)]
    parts = [symbols[a:b] for a, b in zip(at, at[1:], strict=False)]
    ends, cost = [], repair.END
    for part in reversed(parts):
        ends.insert(0, cost)
        m = repair.matrix(part)
        cost = tuple(min(m[4 * q + t] + cost[t] for t in range(4)) for q in range(4))
    state, audit = 0, ""
    for k, (part, end) in enumerate(zip(parts, ends, strict=True)):
        path = repair.walk(part, state, end, k == len(parts) - 1)
        state, audit = path.state, audit + audit_of(path)
    assert audit == audit_of(repair.walk(symbols))


def test_known_repairs():
    found = {s: audit_of(repair.walk(s)) for s in ("", "ua", "sua", "u", "a", "s", "aua", "uua", "uuaa", "uax", "UA", "uo", "sxua", "uaU")}
    assert found == {"": "", "ua": "KK", "sua": "KKK", "u": "D", "a": "D", "s": "D", "aua": "DKK", "uua": "DKK", "uuaa": "KRRK", "uax": "KKD", "UA": "DD", "uo": "KR", "sxua": "KDKK", "uaU": "KKD"}


def plain_damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_report(rows: list[tuple]) -> list[tuple]:
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]] += plain_damage([r])
    out = []
    for conv, mine in groups.items():
        said = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
        mine = sorted(mine, key=lambda r: (r[1] is not None, r[1] or 0, r[2], said(r)))
        turns = {t for _, t, _, _ in mine if t is not None}
        counts, symbols, seen = [0, 0, 0], "", set()
        for _, _, role, text in mine:
            trimmed = text.strip(" \t\n\x0b\x0c\r")
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not trimmed:
                counts[0] += 1
                symbols += "x"
            elif (role, text) in seen:
                counts[1] += 1
                symbols += "x"
            else:
                counts[2] += trimmed[-1] not in ".!?"
                symbols += initial if trimmed[-1] in ".!?" else initial.upper()
            seen.add((role, text))
        # the cheapest audits, by Dijkstra over whole strings of letters: of each state the least string of its cost
        best = {(0, 0): (0, "", ())}
        for k in range(len(symbols) + 1):
            for _ in range(3):
                for q, (to, role) in {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}.items():
                    if (k, q) in best:
                        c, a, r = best[k, q]
                        new = (c + 5, a + "I", (*r, (role, None)))
                        best[k, to] = min(best.get((k, to), new), new, key=lambda x: x[:2])
            if k < len(symbols):
                for q in range(4):
                    if (k, q) not in best:
                        continue
                    c, a, r = best[k, q]
                    to, role = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}[q]
                    options = [(q, (c + 2, a + "D", r))]
                    x = symbols[k]
                    if x != "x":
                        extra = 5 * x.isupper()
                        options.append((to, (c + 1 + extra, a + "R", (*r, (role, k)))))
                        if x.lower() == role or x.lower() == "s" and q == 0:
                            options.append((1 if x.lower() == "s" else to, (c + extra, a + "K", (*r, (None, k)))))
                    for t, new in options:
                        best[k + 1, t] = min(best.get((k + 1, t), new), new, key=lambda x: x[:2])
        cost, audit, kept = min((best[len(symbols), q] for q in (0, 3) if (len(symbols), q) in best), key=lambda x: x[:2])
        lines = []
        for role, k in kept:
            lines.append(f"{ {'u': 'user', 'a': 'assistant', None: None}[role] or mine[k][2]}:{'' if k is None else mine[k][3]}")
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *counts, illegal, cost, audit, sha("\n".join(lines))))
    return out


def rows_of(rng: random.Random, conv: int | None, n: int) -> list[tuple]:
    out = []
    for k in range(n):
        turn = rng.choice([k, k, k, k + 3, None])
        out.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No!", "well", "", " \t\n", "So?  ", "é. x", f"Line {k}.", f"Line {k}", None])))
    return out


def reported(spark, rows: list[tuple], extra: bool = False) -> list[tuple]:
    names = COLUMNS + (", place string, said string, `_conv_id` string, edit string" if extra else "")
    table = spark.createDataFrame([(*r, *(["x"] * 4 if extra else [])) for r in rows], names)
    found = repair.report(table, repair.damage(table))
    assert found.columns == NAMES
    return sorted(map(tuple, found.collect()), key=str)


def test_odd_conversations(spark):
    rng = random.Random(11)
    rows = [r for conv in [None, *range(60)] for r in rows_of(rng, conv, rng.randint(1, 9))]
    rows += [(900, 1, "user", "Same.")] * 3 + [(901, None, None, None), (902, 5, "user", "x" * 300_000 + ".")] + [(903, k, "user", "Again.") for k in range(30)]
    assert reported(spark, rows, extra=True) == sorted(plain_report(rows), key=str)


def test_nothing(spark):
    assert reported(spark, []) == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert reported(spark, [(gone, 0, "user", "Hello.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_conversation_that_tasks_share(spark):
    rng = random.Random(4)
    rows = rows_of(rng, 1, 40) + rows_of(rng, 2, 900) + rows_of(rng, 3, 30) + rows_of(rng, 4, 500)
    rows = [(c, None if t is None else t * 7, r, x) for c, t, r, x in rows]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        table = spark.createDataFrame(rows, COLUMNS)
        known = repair._shared_parts(repair.ordered(repair.faults(repair.damage(table))))
        assert len(known) > 4
        assert reported(spark, rows) == sorted(plain_report(rows), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repaired_rows(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, 2, "tool", "And?"), (1, 3, "assistant", "So.")], COLUMNS)
    found = repair.repair(table).orderBy("place", "step").collect()
    assert [(r.edit, r.copies, r.role, r.text) for r in found] == [("K", 1, "user", "Hi."), ("K", 1, "assistant", "Hello."), ("D", 1, None, None), ("R", 1, "user", "And?"), ("K", 1, "assistant", "So.")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_the_tables_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = sorted(map(tuple, repair.op11_repair(spark, "/root/testdata/sf0.01").select(NAMES).collect()), key=str)
    assert found == sorted(plain_report(rows), key=str) and any("I" in r[7] or "R" in r[7] for r in found)
