"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed rules and are always kept. Three more kinds are proposed on top:
``iban`` (confirmed by mod-97), ``ssn`` (three groups of digits) and ``secret`` (a long hex string); the last two need a
context word near by. Every regular expression runs in time linear in the text: an email is sought from its '@'
backwards, digit chains use possessive repeats.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .text import per_text, table, with_fields

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])")

#: Words that raise a kind's score when one stands within CONTEXT characters before or after a span.
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "key", "password", "passwd"),
}
CONTEXT = 40
#: Score without context; what the context adds; what a span needs to count.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
CONTEXT_GAIN = 0.3
LEAST = 0.5
_NEAR = {kind: re.compile(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])") for kind, words in CONTEXT_WORDS.items()}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check: from the right, each second digit doubled, its digits summed."""
    total = 0
    for at, d in enumerate(reversed(digits)):
        value = ord(d) - 48
        if at % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces leaves 1 modulo 97, its first four characters moved to the end, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, done := m.end()))
        at = text.find("@", max(at + 1, done))
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _context(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - CONTEXT) : start]} | {text[end : end + CONTEXT]}".lower()
    return min(1.0, PRIOR[kind] + CONTEXT_GAIN * bool(_NEAR[kind].search(near)))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind that pass its check, as (start, end, kind); a failing match is dropped, its inside is not tried again."""
    out = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if 12 <= m.end() - m.start() <= 37 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return out


def find(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind as in KINDS; null or empty: none. Base spans always stay."""
    text = text or ""
    spans = [Span(kind, s, e, _context(text, kind, s, e)) for s, e, kind in base_spans(text)]
    for m in _IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            spans.append(Span("iban", *m.span(), _context(text, "iban", *m.span())))
    for kind, pattern in (("ssn", _SSN), ("secret", _SECRET)):
        for m in pattern.finditer(text):
            if (score := _context(text, kind, *m.span())) >= LEAST:
                spans.append(Span(kind, *m.span(), score))
    return sorted(spans, key=lambda x: (x.start, KINDS.index(x.kind), x.end))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, overlapping ones joined, replaced by <KIND> of its first."""
    if text is None:
        return None
    out, done = [], 0
    for x in spans:
        if x.start >= done:
            out += [text[done : x.start], f"<{x.kind.upper()}>"]
        done = max(done, x.end)
    return "".join(out) + text[done:]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", redacted: bool = True) -> DataFrame:
    """Per row: the key, counts of the base kinds, base_sha256, spans, the highest score and, unless it isn't wanted, the redacted text.

    Null texts count as empty (no spans, redacted text empty); rows with equal keys each give a row; other columns of the input are left out.
    """

    def prepare():
        def one(x: str) -> tuple:
            spans = find(x)
            base = [s for s in spans if s.kind in BASE]
            counts = [sum(s.kind == k for s in base) for k in BASE]
            return (*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans), max((s.score for s in spans), default=0.0), *([redact(x, spans)] if redacted else []))

        return one

    ddl = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, max_score double" + ", redacted string" * redacted
    return with_fields(docs, key, text, per_text(prepare, ddl))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return scan(table(spark, sf_dir, "documents"), redacted=False)
