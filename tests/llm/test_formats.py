"""Operators of one record that change its form: fill-in-middle, main text of pages."""

from __future__ import annotations

import hashlib
import html
import os
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.llm import fim, html_text

from .helpers import docs, odd_rows, prose


def plain_fim(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def fim_rows() -> list[tuple]:
    rng = random.Random(3)
    odd = [(20, "a<P>b"), (21, "<M>"), (22, "<P" * 50), (23, ">S<" * 50), (24, "P><S"), (25, "é\r\n\x00🤦🏼 x\U0010ffff" * 30), (-3, "negative id"), (26, "<"), (27, "x" * 3_000_000)]
    return odd_rows() + odd + [(k, prose(rng, rng.randint(0, 60)) + rng.choice(["", "<", "<S", "\n", "ß"])) for k in range(100, 400)]


def test_fill_in_middle_is_that_of_plain_slices_and_reads_back(spark):
    rows = fim_rows()
    made = fim.transform(docs(spark, rows, extra=True)).cache()
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(((d, *plain_fim(d, t)) for d, t in rows), key=key)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    assert sorted(map(tuple, fim.restore(made).collect()), key=key) == sorted(((d, t or "") for d, t in rows), key=key)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(((d, *(p := plain_fim(d, t))[:4], sha(p[4]), sha(t or "")) for d, t in rows), key=key)
    assert sorted(map(tuple, fim.digest(docs(spark, rows)).collect()), key=key) == want


def test_fill_in_middle_of_nothing_and_other_shares(spark):
    assert fim.digest(docs(spark, [])).count() == 0 and fim.transform(docs(spark, [])).count() == 0
    rows = [(k, "some text") for k in range(50)]
    assert {r.form for r in fim.transform(docs(spark, rows), plain=100).collect()} == {"plain"}
    assert {r.form for r in fim.transform(docs(spark, rows), plain=0, suffix_first=100).collect()} == {"spm"}


def test_pieces_keep_order_and_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 30, "", "d" * 5, "e" * 6])], names=["t"])
    parts = [p.column(0).to_pylist() for p in fim.pieces(batch, 0, 10)]
    assert sum(parts, []) == batch.column(0).to_pylist() and len(parts) > 1
    assert list(fim.pieces(batch.slice(0, 0), 0, 10)) == []


WORDS = "The river rose over the old bridge and the town watched it go by all night, until the last lamp went out."
BODY = "".join(f"<p>{WORDS} Part {k}.</p>" for k in range(4))
SAID = "\n".join(f"{WORDS} Part {k}." for k in range(4))
MENU = "<nav><ul>" + "".join(f'<li><a href="/{k}">Section {k}</a></li>' for k in range(6)) + "</ul></nav>"

#: Pages around BODY, whose main text is SAID with what the second value has.
PAGES = {
    "article": (f"<body>{MENU}<article>{BODY}</article><footer>&copy; all</footer></body>", "{}"),
    "title and short paragraphs": (f"<head><title>T</title></head><body>{MENU}<article><h1>A flood</h1><p>Yes.</p>{BODY}<p>No.</p></article>", "A flood\nYes.\n{}\nNo."),
    "no article": (f"<body>{MENU}<div id=content><h1>A flood</h1>{BODY}</div><div class=sidebar><p>{WORDS}</p></div></body>", "A flood\n{}"),
    "wrapped": (f"<body><div class='page'><div class='top'><a href=/>Home</a></div><div class='post'><div class='text'>{BODY}</div></div></div>", "{}"),
    "straight in the body": (f"{MENU}{BODY}<footer>{WORDS}</footer>", "{}"),
    "advert inside": (f"<article><p>One.</p><div class='ad-slot'><p>{WORDS} Buy!</p></div>{BODY}</article>", "One.\n{}"),
    "aside, form, script, style": (f"<article>{BODY}<aside>{WORDS}</aside><form><label>Mail</label><input><p>{WORDS}</p></form><script>if (a < b) {{ '</p>' }}</script><style>p {{ }}</style></article>", "{}"),
    "comments": (f"<main><article>{BODY}</article><section id='comments'><h2>3 comments</h2><article><p>{WORDS}</p></article></section></main>", "{}"),
    "comments by heading": (f"<article>{BODY}<section><h3>Reader comments (3)</h3><p>{WORDS} I agree.</p></section></article>", "{}"),
    "comments behind the text": (f"<div id=main><h1>A flood</h1>{BODY}<h2>Comments</h2><p>{WORDS} I agree.</p><div><p>{WORDS} So do I.</p></div></div>", "A flood\n{}"),
    "notice": (f"<div class='cookie-notice'><p>{WORDS} Accept?</p></div><div role=alert>{WORDS}</div><article>{BODY}</article>", "{}"),
    "headers": (f"<header><h1>The Paper</h1><p>{WORDS}</p></header><article><header><h1>A flood</h1></header>{BODY}</article>", "A flood\n{}"),
    "menu not closed": (f"<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul><article>{BODY}</article>", "{}"),
    "page in a form": (f"<form id=all>{MENU}<article>{BODY}</article></form>", "{}"),
    "wrapper named after a menu": (f"<div class='with-nav'>{MENU}<main>{BODY}</main></div>", "{}"),
    "lists and tables": (f"<article>{BODY}<ul><li>one<li>two</ul><table><tr><td>a<td>b</table><blockquote>said</blockquote></article>", "{}\none\ntwo\na\nb\nsaid"),
    "links inside": (f"<article>{BODY}<p>See <a href=/x>this long and helpful page about it</a></p></article>", "{}\nSee this long and helpful page about it"),
    "links of no name": (f"<article>{BODY}</article><div><a href=/1>More</a> <a href=/2>of this</a></div>", "{}"),
    "white space, inline, references": (f"<article><p>  a <b>b</b>c\n&amp;&nbsp;&lt;d&gt;<br>e &eacute;&#x1F600; </p>{BODY}</article>", "a bc & <d> e é😀\n{}"),
    "unclosed": (f"<article><p><b>bold<br>{BODY.replace('</p>', '')}", "bold\n{}"),
    "cut in a tag": (f"<article>{BODY}<p>last<a hre", "{}\nlast"),
    "span of an advert": (f"<article><p>one <span class=advert>buy</span>two</p>{BODY}</article>", "one two\n{}"),
    "hidden": (f"<article>{BODY}<p hidden>x</p><p style='display: none'>y</p><template><p>z</p></template></article>", "{}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert html_text.extract(f"<!DOCTYPE html><html>{page}") == want.format(SAID)


@pytest.mark.parametrize("page", ["", "   ", "<p>", "<!-- x -->", MENU, "<div class=ad>Buy this now</div>", f"<footer>{WORDS}</footer>", "<script>x", f"<article></article><div class='ad'>{WORDS}</div>", "<form><p>Your name</p></form>"])
def test_pages_without_main_text(page):
    assert html_text.extract(page) == ""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<nav>", "</nav>", "<li>", "<td>", "<a href=x>", "</a>", "<br>", "<b>", "&amp;", "<script>", "</script>", "<!--", "-->", "<h1>", "word ", "long words here", "\n", "<"]), max_size=40))
def test_any_tags_give_trimmed_lines(parts):
    text = html_text.extract("".join(parts))
    assert all(line == " ".join(line.split()) != "" for line in text.split("\n")) or text == ""


@pytest.mark.parametrize("page", ["<article>" * 50_000 + "x", "<div class='ad'>" * 50_000 + "<article>" * 3_000, "<p>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<" * 100_000, "<a " * 50_000, "<!--" * 50_000, "<li><b>" * 30_000], ids=range(8))
def test_hostile_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    html_text.extract(page)
    assert time.perf_counter() - began < 20


def test_smoothing_keeps_what_is_even():
    assert html_text.smoothed(__import__("numpy").full(7, 3.0)) == pytest.approx([3.0] * 7)
    one = html_text.smoothed(__import__("numpy").array([0.0, 0, 0, 10, 0, 0, 0]))
    assert one.argmax() == 3 and one[2] > one[1] > one[0] == 0


def test_main_text_of_a_table(spark):
    rows = [(1, "u", PAGES["article"][0], "a"), (1, "u", PAGES["article"][0], "a"), (2, None, None, "b"), (None, "v", "", "c"), (3, "w", "<p>" + "long " * 400_000, None), (4, "x", "no markup at all", "d")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = html_text.main_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    by = {}
    for r in found.collect():
        by.setdefault(r.page_id, []).append((r.url, r.text, r.n_chars))
    assert by[1] == [("u", SAID, len(SAID))] * 2 and by[2] == [(None, "", 0)] and by[None] == [("v", "", 0)]
    assert by[3] == [("w", " ".join(["long"] * 400_000), 5 * 400_000 - 1)] and by[4] == [("x", "no markup at all", 16)]
    assert html_text.main_text(pages.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_the_tables_pages_are_their_articles(spark):
    def plain(page: str) -> str:
        article = re.search("<article>(.*?)</article>", page, re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split("</?(?:h1|p)>", article))
        return "\n".join(x for x in blocks if x)

    found = html_text.op12_html_text(spark, "/root/testdata/sf0.01").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(found) == len(pages) and all(r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text) for r in found)
