"""Small tables with every odd case."""

from __future__ import annotations

import random

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use themselves.
CLASHES = ("_text", "_fields", "_verdict", "score", "fp", "d", "h", "n_words", "key", "sign", "line", "_d", "_kept", "component_id", "kept")
SYLLABLES = "an er th on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(words))


def docs(spark, rows: list[tuple], extra: bool = False):
    """documents from (doc_id, text); with extra columns whose names clash."""
    full = [(d, t, "en", "src0", len(t) if t is not None else None, *(["x"] * len(CLASHES) if extra else [])) for d, t in rows]
    names = COLUMNS + "".join(f", `{c}` string" for c in CLASHES) if extra else COLUMNS
    return spark.createDataFrame(full, names)


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    return [(1, None), (2, ""), (3, "  \n\t\n "), (4, "one"), (5, "one"), (5, "one"), (6, prose(rng, 30_000)), (7, "x" * 200_000), (8, prose(rng, 80)), (None, "no id here"), (None, None)]


def labels(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
