"""Operators that look at one document at a time: personal data, quality, quality rules, decontamination."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.llm import decontam, licences, pii, quality, quality_rules

from .helpers import docs, labels, odd_rows, prose

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text: str) -> list[tuple]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123459.@a-+ ()Z", max_size=40))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert sorted(pii.base_spans(text)) == plain_spans(text)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    found = pii.find("My bank account GB82 WEST 1234 5698 7654 32, ssn 078-05-1120, id 078-05-1121" + " " * 60 + "and 078-05-1122 there")
    assert [x.kind for x in found if x.kind in ("iban", "ssn")] == ["iban", "ssn", "ssn"]
    assert not [x for x in pii.find("ssn 000-12-3456, ssn 666-12-3456, ssn 900-12-3456, ssn 123-00-4567, ssn 123-45-0000") if x.kind == "ssn"]
    hexes = "0123456789abcdef" * 2
    assert [x.kind for x in pii.find(f"token = {hexes}")] == ["secret"]
    assert pii.find(f"commit {hexes} of it") == []
    assert pii.redact("to a@b.cd now", pii.find("to a@b.cd now")) == "to <EMAIL> now"


def test_personal_data_of_odd_documents(spark):
    rows = odd_rows() + [(9, "a@b.cd é 10.0.0.1 " + "9" * 50_000 + " " + "a" * 50_000)]
    found = pii.scan(docs(spark, rows, extra=True)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[9].spans == "email:0:6,ip:9:17" and by_id[9].base_sha256 == hashlib.sha256(b"email:0:6,ip:9:17").hexdigest()
    assert by_id[1].n_email == 0 and by_id[1].redacted == ""
    assert pii.scan(docs(spark, [])).count() == 0


def junk(rng: random.Random, n: int) -> str:
    return " ".join(w + rng.choice(["***", "&&&", "%%%"]) for w in prose(rng, n).split())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for k in range(600):
        good = rng.random() < 0.7
        rows.append((k, prose(rng, rng.randint(60, 300)) if good else junk(rng, rng.randint(60, 300))))
        marks.append((k, int(good), 0))
    return docs(spark, rows).cache(), labels(spark, marks).cache(), dict((d, q) for d, q, _ in marks)


def held(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_quality_learns_from_the_other_folds_only(spark, corpus):
    table, marks, truth = corpus
    found = quality.score(table, quality.train(table, marks)).collect()
    assert all(r.held_out == held(r.doc_id) for r in found) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    mine = [r for r in found if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in mine]) > 0.95
    # other labels of held-out rows change nothing
    flipped = labels(spark, [(d, 1 - q if held(d) else q, 0) for d, q in truth.items()])
    assert [tuple(r) for r in quality.score(table, quality.train(table, flipped)).orderBy("doc_id").collect()] == [tuple(r) for r in sorted(found)]


def test_quality_scores_are_the_plain_ones(spark, corpus):
    """Block by block with new compressors, differences and logistic curve written out."""
    import zstandard

    model = quality.train(*corpus[:2])
    assert len(model.good) == len(model.bad) > 0

    def size(block: bytes, dictionary: bytes) -> int:
        options = {"level": quality.LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return len(zstandard.ZstdCompressor(**options, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {})).compress(block))

    def plain(text: str) -> float:
        data = text.encode()
        cut = [data[k : k + quality.BLOCK] for k in range(0, len(data), quality.BLOCK)]
        good, bad, none = ([size(x, d) for x in cut] for d in (model.good, model.bad, b""))
        rooms = [max(len(x), quality.BLOCK / 4) for x in cut]
        x = [(sum(bad) - sum(good)) / len(data), min((b - g) / r for b, g, r in zip(bad, good, rooms)), (sum(none) - sum(good)) / len(data), min((z - g) / r for z, g, r in zip(none, good, rooms)), 1 - sum(good) / sum(none), 1 - sum(bad) / sum(none)] if data else [0.0] * 6
        return 1 / (1 + np.exp(-sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale)) - model.weights[-1]))

    rng = random.Random(16)
    rows = [(k, t) for k, t in enumerate([prose(rng, 40), prose(rng, 900), junk(rng, 300), "word " * 900, "", "é"])]
    assert np.allclose([r.score for r in quality.score(docs(spark, rows), model).orderBy("doc_id").collect()], [plain(t) for _, t in rows])


def test_dictionaries_are_equally_long():
    rng = random.Random(17)
    good, bad = [prose(rng, 400).encode() for _ in range(200)], [junk(rng, 60).encode() for _ in range(40)]
    for a, b in ((good, bad), (bad, good[:3]), (good[:2], bad[:1])):
        assert len({len(x) for x in quality.dictionaries(a, b)}) == 1
    assert quality.dictionaries(good, []) == (b"", b"")


def test_quality_of_odd_documents(spark, corpus):
    model = quality.train(*corpus[:2])
    rows = odd_rows()
    table = docs(spark, rows, extra=True)
    assert quality.score(table, model).count() == len(rows)
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns and 0 < kept.count() <= len(rows)
    nothing = quality.train(docs(spark, []), labels(spark, []))
    assert {r.predicted for r in quality.score(table, nothing).collect()} == {1}
    assert quality.score(docs(spark, []), model).count() == 0
    nulls = quality.train(corpus[0], labels(spark, [(None, 1, 0), (1, None, 0)]))
    assert quality.score(table, nulls).count() == len(rows)


def plain_statistics(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in many for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té#|\x1c\x0b", max_size=60))
def test_statistics_are_the_plain_ones(text):
    assert quality_rules.statistics(text)[:5] == plain_statistics(text)


def test_trees_keep_their_order_and_score_as_one_by_one(spark, corpus):
    table, marks, truth = corpus
    trees = quality_rules.train(table, marks)
    rng = np.random.default_rng(3)
    x = quality_rules.features(rng.integers(1, 400, (200, 10)))
    score = trees.score(x)
    for name in quality_rules.MONOTONE:
        more = x.copy()
        more[:, quality_rules.FEATURES.index(name)] += rng.random(200)
        assert (trees.score(more) <= score + 1e-12).all()

    def walk(row, at):
        while trees.feature[at] >= 0:
            at = trees.left[at] + (row[trees.feature[at]] > trees.threshold[at])
        return trees.value[at]

    plain = [1 / (1 + np.exp(-(trees.bias + sum(walk(row, r) for r in trees.roots)))) for row in x[:20]]
    assert np.allclose(plain, score[:20])
    found = {r.doc_id: r for r in quality_rules.apply(table, trees).collect()}
    assert np.mean([r.kept == bool(truth[d]) for d, r in found.items() if held(d) and not r.base_failed]) > 0.95


def test_quality_rules_of_odd_documents(spark, corpus):
    trees = quality_rules.train(*corpus[:2])
    rows = odd_rows()
    found = quality_rules.apply(docs(spark, rows, extra=True), trees).collect()
    assert len(found) == len(rows)
    assert all(r.base_failed and not r.kept for r in found if r.doc_id in (1, 2, 3, 4, 5))
    assert quality_rules.apply(docs(spark, []), quality_rules.train(docs(spark, []), labels(spark, []))).count() == 0


def plain_verdict(text: str, items: list[tuple]) -> tuple:
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or ""))
    words, hit, names = cut(text), set(), set()
    for item, body in items:
        seq = cut(body)
        for i in range(max(1, len(seq) - 12)) if seq else ():
            window = seq[i : i + 13]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    names.add(str(item))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.fixture(scope="module")
def contaminated():
    rng = random.Random(2)
    items = [(k, prose(rng, n)) for k, n in enumerate([40, 13, 12, 3, 1, 60])] + [(6, None), (7, ""), (0, prose(rng, 20))]
    rows = odd_rows()
    for k in range(60):
        body = prose(rng, rng.randint(5, 120)).split()
        item = rng.choice(items)[1] or ""
        a = rng.randint(0, max(0, len(item.split()) - 1))
        at = rng.randint(0, len(body))
        body[at:at] = item.split()[a : a + rng.randint(1, 30)]
        rows.append((100 + k, " ".join(body).upper() if k % 2 else ", ".join(body)))
    return items, rows


def plain_longest(text: str, items: list[tuple]) -> tuple:
    """(words, place, item) of the longest match that holds a whole window, by comparing all places."""
    text, best = [w.decode() for w in decontam.words(text or "")], (0, None, None)
    for item, body in items:
        seq = [w.decode() for w in decontam.words(body or "")]
        for i in range(len(seq)):
            for at in range(len(text)):
                n = next((k for k in range(min(len(seq) - i, len(text) - at)) if seq[i + k] != text[at + k]), min(len(seq) - i, len(text) - at))
                if n >= 13 or (i == 0 and n == len(seq)):
                    best = min(best, (-n, at, str(item)), key=lambda x: (x[0], x[1] or 0, x[2] or ""))
    return (-best[0], *best[1:])


@pytest.mark.parametrize("chars", [decontam.BLOCK_CHARS, 1600, 300])
def test_decontamination_is_the_plain_search(spark, contaminated, chars):
    """In one block and in many, with null and repeated ids and repeated rows. Blocks of 300 characters cut items, and so may cut the longest match."""
    items, rows = contaminated
    rng = random.Random(15)
    items = items + [(50 + k, prose(rng, 40)) for k in range(30)]
    whole = chars > 300
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, n_words string")
    table = docs(spark, rows + [(7, items[0][1]), (None, items[1][1]), (100, "clean words")], extra=True)
    small = [(d, t) for d, t in [(r.doc_id, r.text) for r in table.collect()] if t is None or len(t) < 5000]
    want = [(d or -1, *plain_verdict(t, items), *(plain_longest(t, items) if whole else ())) for d, t in small]
    found = decontam.judge(spark, table, bench, block_chars=chars).collect()
    assert len(found) == table.count()
    got = [(r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, *((r.longest, r.longest_start, r.longest_item) if whole else ())) for r in found]
    assert sum(n > 20_000 for _, n, *_ in got) == 1
    assert sorted(map(str, [g for g in got if g[1] < 20_000 and (g[0] != 7 or g[2])])) == sorted(map(str, [w for w in want if w[0] != 7 or w[2]]))
    kept = decontam.remove(spark, table, bench, block_chars=chars)
    assert kept.columns == table.columns
    clean = {(d, t) for d, t in small if not plain_verdict(t, items)[-1]}
    assert {(r.doc_id, r.text) for r in kept.collect() if r.text is None or len(r.text) < 5000} == clean
    assert kept.count() == sum(not r.contaminated for r in found)
    assert decontam.judge(spark, table, bench.limit(0), block_chars=chars).filter("n_hit > 0").isEmpty() and decontam.judge(spark, docs(spark, []), bench, block_chars=chars).isEmpty()


def test_blocks_hold_the_bound_and_the_windows(spark):
    rng = random.Random(14)
    items = [(0, prose(rng, 3000)), (0, prose(rng, 40)), (1, prose(rng, 40)), (1, None)] * 2
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    parts = [p.collect() for p in decontam.blocks(bench, "item_id", "text", 4000)]
    assert len(parts) > 1 and max(sum(len(r.text) for r in p) for p in parts) <= 4000
    windows = lambda rows: {(str(i), tuple(w[k : k + 13])) for i, t in rows for w in [decontam.words(t or "")] for k in range(len(w) - 12)}
    assert windows([(r.item, r.text) for p in parts for r in p]) == windows(items)


def test_longest_matches_are_the_plain_ones(spark, contaminated):
    items, rows = contaminated
    items, rows = items[:3], [r for r in rows if r[0] and r[0] >= 100]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.item_id, r.suffix): r.length for r in decontam.longest_matches(spark, docs(spark, rows), bench).collect()}
    texts = [[w.decode() for w in decontam.words(t)] for _, t in rows]
    for item, body in items:
        seq = [w.decode() for w in decontam.words(body)]
        for at in range(len(seq)):
            best = max(next((n for n in range(len(seq) - at, 0, -1) if any(t[i : i + n] == seq[at : at + n] for i in range(len(t) - n + 1))), 0) for t in texts)
            assert got.get((str(item), at), best if best < 2 else 0) == best


def test_licences(spark):
    rows = odd_rows() + [(20, "some text\nLicensed under the Apache License, Version 2.0.\nmore"), (21, "he lost his license in public"), (22, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (23, "Released under the MIT License."), (23, "Released under the MIT License."), (24, "SPDX-License-Identifier: Zlib")]
    found = licences.scan(docs(spark, rows, extra=True)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[20].families == "Apache-2.0" and by_id[20].n_confirmed == 1 and by_id[21].n_licences == 0
    assert by_id[22].families == "CC-BY-NC,MIT" and by_id[23].n_licences == 1 and by_id[24].families == ""
    assert licences.scan(docs(spark, [])).count() == 0


def test_wrapped_notices_are_one_paragraph(spark):
    wrapped = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction."
    rows = [(1, f"A first line.\n{wrapped}\nA last line."), (2, wrapped.replace("\n", "\n\n")), (3, "x\nAll rights reserved.\ny"), (4, "mit mit mit\nReleased under the MIT License.")]
    by_id = {r.doc_id: r for r in licences.scan(docs(spark, rows)).collect()}
    assert (by_id[1].n_licences, by_id[1].n_confirmed, by_id[1].families) == (1, 1, "MIT")
    assert by_id[3].families == "proprietary" and by_id[3].n_confirmed == 1 and by_id[4].families == "MIT"


def test_classification_is_the_plain_one(spark):
    """Spark's scores against sums over n-grams one by one, on notices, parts of them and ordinary sentences."""
    model = licences.train()
    rng = random.Random(18)
    texts = [t for ts in licences.NOTICES.values() for t in ts] + licences.ORDINARY
    texts += [" ".join(rng.sample(t.split(), max(1, len(t.split()) * 2 // 3))) for t in texts] + ["free software", "mit license " * 9]
    table = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = {r.k: r for r in licences.classify(table, model, ["k"], "t").collect()}
    held = 0
    for k, text in enumerate(texts):
        licence, share = licences._shares((model.features, model.weights, model.bias), licences.words_of(text), frozenset(model.anchors))
        assert (k in found) == (licence >= model.least_licence), text
        if k in found:
            held += 1
            assert abs(found[k].score - licence) < 1e-9 and (found[k].family == licences.UNKNOWN) == (share < model.least_family)
    assert held > 40


def test_notices_that_it_never_saw():
    """Every third notice is left out of training in turn; a family that is left out as a whole is mostly unknown."""
    right, licensed, n = 0, 0, 0
    for fold in range(3):
        seen = {f: [t for k, t in enumerate(ts) if k % 3 != fold or len(ts) < 3] for f, ts in licences.NOTICES.items()}
        model = licences.fitted(seen, calibrate=False)
        weights = (model.features, model.weights, model.bias)
        for family, notices in licences.NOTICES.items():
            for text in notices:
                if text not in seen[family]:
                    z = _families(weights, licences.words_of(text), frozenset(model.anchors))
                    n, licensed, right = n + 1, licensed + (z[0] >= 0.5), right + (z[1] == family)
    print("held-out notices", n, "licences", licensed, "family", right)
    assert licensed >= 0.6 * n and right >= 0.4 * n  # wordings that share little with what was seen
    model = licences.train()
    unknown = [t for t in ["SPDX-License-Identifier: Zlib", "Licensed under the Eclipse Public License, version 2.0.", "Released under the Boost Software License, version 1.0.", "This work is licensed under the European Union Public License."]]
    judged = [licences._shares((model.features, model.weights, model.bias), licences.words_of(t), frozenset(model.anchors)) for t in unknown]
    assert all(p >= model.least_licence for p, _ in judged) and sum(share < model.least_family for _, share in judged) >= 3


def _families(model: tuple, words: list[str], anchors: frozenset) -> tuple[float, str]:
    names, w, b = model
    at = {g: k for k, g in enumerate(names)}
    z = b + sum((w[at[g]] for g in licences.grams(words, anchors) if g in at), np.zeros(len(b)))
    return licences._shares(model, words, anchors)[0], licences.CLASSES[int(np.argmax(z[: len(licences.NOTICES)]))]


def test_changed_training_notices_and_ordinary_sentences():
    model = licences.train()
    rng = np.random.default_rng(11)
    changed = [(v, family) for family, notices in licences.NOTICES.items() for text in notices for v in licences._variants(text, rng)[:4]]
    shares = [licences._shares((model.features, model.weights, model.bias), words, frozenset(model.anchors)) for words, _ in changed]
    assert np.mean([p >= model.least_licence for p, _ in shares]) > 0.9
    ordinary = [licences._shares((model.features, model.weights, model.bias), licences.words_of(t), frozenset(model.anchors))[0] for t in licences.ORDINARY]
    assert max(ordinary) < model.least_licence


def test_licences_of_repeated_rows_and_null_ids(spark):
    public, mit = "The program of the general license.\nA public version of the GNU General Public License is free software.", "Released under the MIT License."
    rows = [(1, public), (2, public), (2, public), (2, public), (3, mit), (None, mit), (None, mit), (None, public), (None, None), (4, "nothing")]
    found = licences.scan(docs(spark, rows)).collect()
    alone = {t: tuple(licences.scan(docs(spark, [(9, t)])).first())[1:] for t in (public, mit)}
    assert len(found) == len(rows)
    assert {tuple(r)[1:] for r in found if r.doc_id in (1, 2)} == {alone[public]}
    assert {tuple(r)[1:] for r in found if r.doc_id == 3} == {alone[mit]}
    assert sorted(tuple(r)[1:] for r in found if r.doc_id is None) == sorted([alone[mit], alone[mit], alone[public], (0, 0, 0, "", 0.0)])


def test_sample_passes_over_texts_that_are_too_long(spark):
    from cuelake.llm import labelled

    rows = [(k, "x" * 10) for k in range(40)]
    marks = labels(spark, [(k, k % 2, 0) for k in range(40)])
    first = labelled.sample(docs(spark, rows), marks, "quality", chars=100)[0][0]
    assert len(labelled.sample(docs(spark, rows), marks, "quality", chars=100)) == 10
    long = [(k, "x" * (500 if k == first else 10)) for k, _ in rows]
    again = labelled.sample(docs(spark, long), marks, "quality", chars=100)
    assert len(again) == 10 and first not in [d for d, _, _ in again]
    often = labelled.sample(docs(spark, rows + [(first, "x" * 10)] * 50), marks, "quality", chars=100)
    assert first not in [d for d, _, _ in often]
    with pytest.raises(ValueError, match="longer than"):
        labelled.sample(docs(spark, [(k, "x" * 500) for k in range(40)]), marks, "quality", chars=100)
    assert labelled.sample(docs(spark, []), marks, "quality") == []
