"""Operators across documents: line dedup, near-duplicates, packing, chat windows, the fixity audit."""

from __future__ import annotations

import functools
import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.llm import chat, components, line_dedup, packing, simhash, tokens, warc

from .helpers import docs, odd_rows, prose


def plain_dedup(rows: list[tuple[int, str]], least: int) -> dict[int, str]:
    """Every run of lines with ``least`` words or more that occurs earlier, line by line, by comparing all places."""
    seqs = {d: line_dedup.lines(t) for d, t in rows}
    seen, gone = {}, {d: set() for d in seqs}
    order = sorted(seqs)
    for d in order:
        ids = seqs[d]
        for i in range(len(ids)):
            total = 0
            for j in range(i, len(ids)):
                total += ids[j][2]
                run = tuple(x[1] for x in ids[i : j + 1])
                if run in seen:
                    if total >= least:
                        gone[d].update(x[0] for x in ids[i : j + 1])
                else:
                    seen[run] = (d, i)
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in rows}


def test_line_dedup_is_the_plain_search(spark):
    rng = random.Random(4)
    pool = [prose(rng, rng.randint(1, 9)) for _ in range(12)]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.8 else prose(rng, 5) for _ in range(rng.randint(1, 14)))) for k in range(25)]
    rows += [(30, rows[3][1]), (31, "\n".join([pool[0]] * 9)), (32, rows[3][1] + "\n\n" + rows[5][1])]
    want = plain_dedup(rows, 12)
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows, extra=True), min_words=12).collect()}
    assert got == want


def test_line_dedup_of_odd_documents(spark):
    rng = random.Random(6)
    passage = "\n".join(prose(rng, 20) for _ in range(4))
    rows = odd_rows() + [(40, f"start\n{passage}\nend"), (41, f"other\n\n{passage}"), (41, f"other\n\n{passage}"), (42, passage)]
    table = docs(spark, rows, extra=True)
    found = line_dedup.dedup(table).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id}
    assert by_id[40].text == rows[-4][1] and by_id[41].text == "other\n" and by_id[42].text == "" and by_id[42].n_deleted_lines == 4
    assert by_id[1].text is None and by_id[2].text == "" and sum(r.doc_id == 41 for r in found) == 2
    kept = line_dedup.dedup_rows(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {42}
    assert {(r.text, r.n_chars) for r in kept.filter("doc_id = 41").collect()} == {("other\n", 6)}
    assert line_dedup.dedup(docs(spark, [])).count() == 0


def plain_fingerprint(text: str) -> int:
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB \n\té", max_size=40))
def test_fingerprints_are_the_plain_ones(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def plain_roots(values: list[int]) -> list[int]:
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**10 - 1), unique=True, max_size=40))
def test_tree_links_connect_what_all_pairs_do(values):
    links = simhash.forest(values)
    assert all((a ^ b).bit_count() <= 2 for a, b in links) and len(links) < max(1, len(values))
    at = {v: k for k, v in enumerate(values)}
    root = list(range(len(values)))
    for _ in values:
        for a, b in links:
            low = min(root[at[a]], root[at[b]])
            root[at[a]] = root[at[b]] = low
    assert root == plain_roots(values)


@pytest.mark.parametrize("most", [1, 256])
def test_links_between_fingerprints_are_whole(spark, most, monkeypatch):
    """Shards of one member at most send all to the exact way for crowded shards."""
    monkeypatch.setattr(simhash, "MOST_IN_TREE", most)
    rng = random.Random(8)
    values = set()
    for _ in range(30):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(v)
            for _ in range(rng.randint(1, 3)):
                v ^= 1 << rng.randrange(64)
    values = sorted(values)
    table = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint")
    roots = {r.u: r.root for r in components.components(simhash.links(table)).collect()}
    got = [roots.get(simhash._signed(v), simhash._signed(v)) for v in values]
    plain = plain_roots(values)
    least = {p: min(simhash._signed(values[i]) for i in range(len(values)) if plain[i] == p) for p in plain}
    assert got == [least[p] for p in plain]


@pytest.mark.parametrize("leaf", [1, 64])
def test_tree_groups_connect_what_all_pairs_do(leaf, monkeypatch):
    """Fingerprints of several words around some of their own, equal ones among them; with other radii than the pipeline's too."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = np.random.default_rng(11)
    for n in (1, 2, 40, 250):
        bits = rng.integers(0, 2, (n // 6 + 1, 192), np.uint8)[rng.integers(0, n // 6 + 1, n)]
        for row in bits:
            row[rng.choice(192, rng.integers(0, 60), replace=False)] ^= 1
        prints = np.packbits(bits, axis=1).view(np.uint64)
        for radius in (0, 40, simhash.WIDE_RADIUS):
            root = np.arange(n)
            for i, j in np.argwhere((bits[:, None] != bits).sum(axis=2) <= radius):
                root[root == max(root[i], root[j])] = min(root[i], root[j])
            found = simhash.tree_groups(prints, radius)
            assert len(set(zip(found.tolist(), root.tolist(), strict=True))) == len(set(found.tolist())) == len(set(root.tolist()))


def test_wide_fingerprints_differ_by_the_angle_of_the_sets():
    """Sets just alike in 0.15 of the bits, unrelated ones in half; short and long ones."""
    rng = np.random.default_rng(12)
    planes = simhash._planes(60 * 8)
    for same, own, most in ((4, 1, 0.21), (16, 2, 0.2), (800, 100, 0.2)):
        apart, unrelated = [], []
        for _ in range(40):
            h = rng.integers(0, 1 << 63, same + 2 * own, np.uint64) * np.uint64(2)
            a, b, c = (simhash.wide_fingerprint(x, planes) for x in (h[: same + own], h[: same + own - 1] if own == 1 else np.delete(h, np.s_[same : same + own]), ~h))
            apart.append((a != b).mean())
            unrelated.append((a != c).mean())
        assert 0.12 < np.mean(apart) < 0.18 and max(apart) < most + 0.05 and abs(np.mean(unrelated) - 0.5) < 0.03


def test_near_duplicates_of_odd_documents(spark):
    rng = random.Random(9)
    body = prose(rng, 300)
    rows = odd_rows() + [(50, body), (51, body), (52, body + " more"), (53, prose(rng, 200))]
    table = docs(spark, rows, extra=True)
    found = simhash.near_duplicates(table).collect()
    assert len(found) == len(rows)
    prints = {d: plain_fingerprint(t or "") for d, t in rows if t is None or len(t) < 5000}
    by_id = {r.doc_id: r.component_id for r in found}
    assert by_id[51] == 50 and by_id[2] == 1 and by_id[3] == 1 and by_id[5] == 4
    assert by_id[52] == (50 if (prints[50] ^ prints[52]).bit_count() <= 2 else 52)
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i) == sorted({c for d, c in by_id.items() if d}) and ids.count(None) == 2
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("few", [0, components.FEW])
def test_components_of_a_long_chain_and_a_star(spark, few, monkeypatch):
    monkeypatch.setattr(components, "FEW", few)
    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)] + [(5, 5), (1, 0)]
    table = spark.createDataFrame(pairs, "u bigint, v bigint")
    roots = {r.u: r.root for r in components.components(table).collect()}
    assert {roots[k] for k in range(61)} == {0} and {roots[k] for k in range(100, 180)} == {100}
    assert components.components(table.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


ODD_TEXTS = ["a <|endoftext|>b c<|startoftext|>", "J̌ Ẅ. Éa, xé. (ABC) ABC*** a.b.c, <|ENDOFTEXT|>", "İstanbul ΣΑΣ Σ", "a\x1cb \x85c\xa0d e", "it's don't 's IT'S,", "한국 é", "", "  \n\t ", "123 45a6 10,000.00 a0.", "x​y", "—. a—. ’s"]


@functools.cache
def fast():
    return tokens.tokenizer("word_bpe_49k.json")


def test_an_idle_tokenizer_goes(monkeypatch):
    monkeypatch.setattr(tokens, "IDLE", 0.2)
    tokens._kept.clear()
    tokens._state["watched"] = False
    of = tokens.tokenizer("word_bpe_49k.json")
    assert tokens.tokenizer("word_bpe_49k.json") is of and of.ids("some words").size
    time.sleep(0.6)
    assert not tokens._kept and of.ids("some words").size
    assert tokens.tokenizer("word_bpe_49k.json") is not of


def test_vocabularies_of_other_habits_encode_whole_texts(monkeypatch, tmp_path):
    """One that keeps capitals apart: its own words, cut at white space."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({"Word": 1, "word": 2, "0</w>": 3, "?": 0}, unk_token="?"))
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    plain.save(path := str(tmp_path / "plain.json"))
    of = tokens.tokenizer(path)
    assert not of.by_words and of.ids("Word word other").tolist() == [1, 2, 0] and of.ids(None).tolist() == []


def test_ids_are_the_tokenizers(tokenizer):
    of = fast()
    assert of.by_words
    for text in [*ODD_TEXTS, *[t for _, t in odd_rows() if t]]:
        assert of.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text_are_the_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")) if not hasattr(tokens, "_plain") else tokens._plain
    tokens._plain = plain
    assert fast().ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing_is_a_whole_partition_of_the_ids(spark, tokenizer):
    rng = random.Random(10)
    rows = odd_rows() + [(100 + k, prose(rng, rng.randint(1, 400))) for k in range(120)] + [(300 + k, t) for k, t in enumerate(ODD_TEXTS)]
    found = packing.pack(docs(spark, rows, extra=True), window=256, ids=True).toPandas()
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows if d and d != 5}
    for d, pieces in found[found.doc_id.isin(list(ids))].sort_values("start").groupby("doc_id"):
        assert [x for p in pieces.ids for x in p] == ids[d] and (pieces.doc_tokens == len(ids[d])).all()
        assert (pieces.start == np.concatenate([[0], pieces.length.cumsum()[:-1]])).all()
    assert (found.ids_crc32 == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in found.ids]).all()
    assert found[found.doc_id == 5].length.sum() == 2 * len([*tokenizer.encode("one").ids, 2]) - 0 if len(tokenizer.encode("one", add_special_tokens=False).ids) == len(tokenizer.encode("one").ids) else True
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == np.concatenate([[0], s.length.cumsum()[:-1]])).all()
        total = s.length.sum()
        assert total == 256 or total & (total - 1) == 0
    assert packing.pack(docs(spark, [])).count() == 0


def test_index_scores_are_plain_bm25():
    rng = np.random.default_rng(1)
    pieces = [rng.integers(0, 400, rng.integers(5, 60)).astype("<u2") for _ in range(40)]
    index = packing.Index(pieces)
    n, mean = len(pieces), np.mean([len(p) for p in pieces])
    df = {t: sum(t in p for p in pieces) for t in range(400)}
    for doc in (0, 7):
        want = [sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (c := (p == t).sum()) * (packing.K1 + 1) / (c + packing.K1 * (1 - packing.B + packing.B * len(p) / mean)) for t in set(pieces[doc].tolist()) if df[t] > 1 and t in p) for p in pieces]
        assert np.allclose(index.scores(doc), want)


def test_scores_keep_the_terms_of_most_documents():
    """BM25 over all terms, by other documents; half of the terms are in most documents."""
    rng = np.random.default_rng(2)
    pieces = [np.concatenate([rng.integers(0, 30, 40), rng.integers(100, 400, 10)]).astype("<u2") for _ in range(40)]
    index = packing.Index(pieces)
    n, mean = len(pieces), np.mean([len(p) for p in pieces])
    df = {t: sum(t in p for p in pieces) for t in range(400)}
    assert max(df.values()) > n / 2
    for doc in range(n):
        want = [sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (c := (p == t).sum()) * (packing.K1 + 1) / (c + packing.K1 * (1 - packing.B + packing.B * len(p) / mean)) for t in set(pieces[doc].tolist())) for p in pieces]
        others = np.arange(n) != doc
        assert np.allclose(index.scores(doc)[others], np.array(want)[others])


def test_windows_are_filled_with_copies():
    """A shard of 1024 unrelated tails of which 200 are copies but for four tokens: a copy's window holds copies."""
    rng = np.random.default_rng(3)
    body = rng.integers(2000, 40_000, 200)
    docs_ = [("other", k, rng.integers(2000, 40_000, 200)) for k in range(824)]
    for k in range(200):
        copy = body.copy()
        copy[rng.choice(200, 4, replace=False)] = rng.integers(2000, 40_000, 4)
        docs_.append(("copy", k, copy))
    order = rng.permutation(1024)
    packer, out = packing.Packer(window=2000), []
    for k in order:
        out += packer.add(docs_[k][:2], docs_[k][2].astype("<u2"))
    out += packer.flush(last=True)
    assert sum(p[2] for p in out) == 1024 * 200
    windows: dict = {}
    for doc, _, length, sequence, _ in out:
        windows.setdefault(sequence, []).append((doc[0][0], length))
    with_copies = [w for w in windows.values() if any(kind == "copy" for kind, _ in w)]
    full = [w for w in with_copies if all(kind == "copy" for kind, _ in w)]
    assert len(full) >= len(with_copies) - 2 and len(with_copies) <= 22


def test_neighbours_share_a_window():
    packer = packing.Packer(window=20, shard_docs=100)
    kinds = [np.arange(1000 * k, 1000 * k + 10, dtype="<u2") for k in range(1, 6)]
    out = []
    for k in range(2):
        for kind, ids in enumerate(kinds):
            out += packer.add((kind, k), ids)
    out += packer.flush(last=True)
    by_window: dict = {}
    for doc, *_, sequence, _ in out:
        by_window.setdefault(sequence, set()).add(doc[0][0])
    assert all(len(x) == 1 for x in by_window.values())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|>/sINST[]␛cen_imd\n SYS", max_size=40))
def test_escapes_are_reversible_and_leave_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not chat.CONTROL.search(escaped)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text(alphabet="a<|>\n␛", max_size=12), st.integers(1, 50)), max_size=20))
def test_windows_hold_each_turn_once(turns):
    state = chat.Formatter(60)
    out = [w for r, t, n in turns for w in state.add(chat.Turn(r, t, n))] + state.end()
    parsed = [chat.parse(w.text) for w in out]
    assert [(r, t) for p in parsed for repeated, r, t in p if not repeated] == [(r, t) for r, t, _ in turns]
    assert [chat.unescape(w.text[a:b]) for w in out for a, b in zip(w.loss[::2], w.loss[1::2])] == [t for r, t, _ in turns if r == "assistant"]
    if turns and turns[0][0] == "system":
        assert all(p[0][1:] == turns[0][:2] for p in parsed)


def test_chat_of_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, None, None, "first"), (None, 0, "user", "no id"), (2, 0, "assistant", "</s>[INST] " * 2000), (3, 5, "user\nrole", "")]
    table = spark.createDataFrame([(*r, "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, window string")
    found = {r.conv_id: r for r in chat.read_back(chat.windows(table)).collect()}
    assert len(found) == 4
    want = hashlib.sha256(b"\nfirst\nuser\n\nassistant\nx\nassistant\nx\n").hexdigest()
    assert found[1].turns_sha256 == want and found[1].loss_chars == 2 and found[2].loss_chars == 11 * 2000 and found[3].n_turns == 1
    assert chat.read_back(chat.windows(table.limit(0))).count() == 0


def pages(spark, rows: list[tuple]):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, hash string")


def test_audit_finds_what_differs(spark, tmp_path):
    rows = [(k * 7 - 300, f"http://h/{k}", f"<p>{k}\r\n\r\nWARC/1.0 é</p>" * (k % 5)) for k in range(300)] + [(None, None, None), (14, None, "twin"), (14, None, "twin")]
    records = warc.records(pages(spark, rows))
    whole = warc.planned(records)
    assert warc.audit(whole, whole).count() == 0
    other = [r if k != 5 else (r[0], r[1], "changed") for k, r in enumerate(rows) if k not in (9, 200)] + [(99_999, "u", "extra"), (14, None, "twin")]
    found = {r.page_id: r for r in warc.audit(whole, warc.planned(warc.records(pages(spark, other)))).collect()}
    assert {k: r.status for k, r in found.items()} == {rows[5][0]: "changed", rows[9][0]: "missing", rows[200][0]: "missing", 99_999: "extra", 14: "changed"}
    assert found[rows[9][0]].replica_start is None and found[99_999].start is None
    none = warc.planned(warc.records(pages(spark, [])))
    assert warc.audit(none, none).count() == 0 and {r.status for r in warc.audit(whole, none).collect()} == {"missing"}
    warc.write(warc.records(pages(spark, [])), f"{tmp_path}/none")
    assert warc.audit(none, warc.scan(spark, f"{tmp_path}/none")).count() == 0


@pytest.mark.parametrize("copies", [warc.MOST_COPIES, 1])
@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_are_as_planned(spark, tmp_path, monkeypatch, copies, compression):
    """Records come back, and offsets are true in the stored bytes; with one copy at most, repeated ids have files of their own."""
    monkeypatch.setattr(warc, "MOST_COPIES", copies)
    rows = [(k * 7 - 300, f"http://h/{k}\r\nx", f"<p>{k}\r\n\r\nWARC/1.0 é</p>" * (k % 5)) for k in range(80)] + [(None, None, None), (9000, "u", "far"), (14, None, "twin"), (14, None, "twin"), (14, None, "other")]
    records = warc.records(pages(spark, rows))
    path = str(tmp_path / "warc")
    warc.write(records, path, compression)
    assert sorted(map(tuple, warc.read(spark, path).collect())) == sorted(map(tuple, records.collect()))
    found = warc.scan(spark, path)
    assert warc.audit(warc.planned(records), found).count() == 0
    stored = {r.page_id: (r.name, r.start, r.n) for r in found.collect()}
    for r in warc.leaves(warc.planned(records)).collect():
        name, start, n = stored[r.node]
        if r.start is not None and r.node != 14:
            data = warc._plain(open(name.removeprefix("file:"), "rb").read())
            assert r.start == start and data[start : start + n].startswith(b"WARC/1.0") and f"<urn:page:{r.node}>".encode() in data[start : start + n]
    assert (14 in {r.node for r in warc.leaves(warc.planned(records)).filter("start IS NULL").collect()}) == (copies == 1)


def test_damaged_files_become_rows(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>é{k}</p>" * 9) for k in range(40)] + [(5000, "u", "in another file")]
    records = warc.records(pages(spark, rows))
    warc.write(records, str(tmp_path / "warc"))
    path = next((tmp_path / "warc" / "file=0").rglob("part-*"))
    data = path.read_bytes()
    at = {page: (a, b) for a, b, page in warc.parse(data)}

    def audit(changed: bytes, name: str) -> dict:
        for p in (tmp_path / "warc").rglob(".*.crc"):
            p.unlink()
        path.write_bytes(changed)
        return {(r.page_id, r.status): r for r in warc.audit(warc.planned(records), warc.scan(spark, str(tmp_path / "warc"))).collect()}

    a, b = at[7]
    flipped = audit(data[: b - 9] + bytes([data[b - 9] ^ 0x80]) + data[b - 8 :], "a byte of a page")
    assert set(flipped) == {(7, "changed")} and flipped[7, "changed"].replica_start == a == flipped[7, "changed"].start
    head = audit(data[: a + 3] + b"?" + data[a + 4 :], "a byte of a head")
    assert set(head) == {(7, "missing"), (None, "unreadable")} and (head[None, "unreadable"].replica_start, head[None, "unreadable"].replica_length) == (a, b - a)
    cut_off = audit(data[: at[38][0] + 20], "a cut file")
    assert set(cut_off) == {(38, "missing"), (39, "missing"), (None, "unreadable")} and cut_off[None, "unreadable"].replica_start == at[38][0]
    moved = audit(data[:a] + data[b:] + data[a:b], "a moved record")
    assert set(moved) == {(7, "moved")} and moved[7, "moved"].replica_start == len(data) - (b - a)
    garbage = audit(b"\xff\xfe" * 50, "no record at all")
    assert sum(s == "missing" for _, s in garbage) == 40 and garbage[None, "unreadable"].replica_length == 100


def test_sql_of_the_operators(spark, tmp_path):
    """The queries that SQL can express give the SQL's rows."""
    from cuelake.llm.queries import ORACLE_SQL, QUERIES

    rng = random.Random(12)
    passage = prose(rng, 70)
    rows = [(k, "\n".join([prose(rng, 30), passage if k % 4 == 0 else prose(rng, 60), prose(rng, 12)])) for k in range(40)]
    tables = {
        "documents": docs(spark, rows),
        "benchmark": spark.createDataFrame([(0, passage), (1, prose(rng, 30)), (2, "so few words")], "item_id bigint, text string"),
        "pages": spark.createDataFrame([(k, f"http://x/{k}", prose(rng, 20)) for k in range(120)], "page_id bigint, url string, html string"),
    }
    con = duckdb.connect()
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, str(tmp_path))
        columns = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want)), name
