"""The pipeline, stage by stage, against plain versions of its stages, and on odd tables."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from cuelake.llm import quality, simhash

from .helpers import docs, labels, odd_rows, prose
from .test_across_documents import plain_dedup, plain_fingerprint, plain_roots
from .test_per_document import junk, plain_verdict


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(20)
    passage = "\n".join(prose(rng, 30) for _ in range(3))
    items = [(k, prose(rng, 40)) for k in range(3)]
    rows, marks = [], []
    for k in range(160):
        good = rng.random() < 0.75
        text = "\n".join((prose if good else junk)(rng, rng.randint(20, 60)) for _ in range(3))
        if good and k % 9 == 0:
            text += "\n" + passage
        if good and k % 11 == 0:
            text += "\n" + items[k % 3][1]
        rows.append((k, text))
        marks.append((k, int(good), 0))
    rows += [(200 + k, rows[k][1]) for k in range(0, 40, 4)] + [(300 + k, rows[k][1] + " end") for k in range(1, 40, 4)]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels(spark, marks).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, marks, items


def test_each_stage_does_what_its_plain_version_does(spark, corpus):
    folder, rows, marks, items = corpus
    table, kept = spark.read.parquet(f"{folder}/documents.parquet"), dict(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, folder)
        if name == "quality classifier":
            model = quality.train(table, spark.read.parquet(f"{folder}/labels.parquet"))
            good = {r.doc_id for r in quality.score(table, model).collect() if r.predicted}
            truth = {d: q for d, q, _ in marks}
            assert sum((d in good) == bool(truth[d]) for d in truth) > 0.95 * len(truth)
            kept = {d: t for d, t in kept.items() if d in good}
        elif name == "line dedup":
            lost = {d for d, t in kept.items() if t.strip()}
            kept = plain_dedup(sorted(kept.items()), 51)
            kept = {d: t for d, t in kept.items() if t.strip() or d not in lost}
        elif name == "SimHash near-dedup":
            ids = sorted(kept)
            roots = plain_roots([plain_fingerprint(kept[d]) for d in ids])
            kept = {d: kept[d] for k, d in enumerate(ids) if roots[k] == k}
        elif name == "benchmark decontamination":
            kept = {d: t for d, t in kept.items() if not plain_verdict(t, items)[-1]}
        else:
            assert {r.doc_id for r in out.collect()} == set(kept)
            continue
        assert out.columns == table.columns
        found = {r.doc_id: r.text for r in out.collect()}
        assert found == kept, name
        table = spark.createDataFrame(out.collect(), out.schema)
    assert len(kept) < 0.8 * len(rows)


def test_run_gives_the_last_stages_rows(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.columns[0] == "doc_id" and out.count() >= out.select("doc_id").distinct().count() > 0


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_stages_take_odd_and_empty_tables(spark, corpus, rows):
    table = docs(spark, rows, extra=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, corpus[0])
        assert out.columns == table.columns, name
        assert out.count() <= len(rows)
        if name == "SimHash near-dedup" and rows:
            assert sorted(r.doc_id for r in out.collect() if r.doc_id) == [1, 4, 6, 7, 8]
    assert (corpus_pipeline.STAGES[-1][1](spark, table, corpus[0]).count() > 0) == bool(rows)


def test_near_deduplication_takes_all_that_are_alike(spark):
    """Against all pairs of shingle sets; most of these copies are more than two bits apart."""
    rng = random.Random(21)
    rows = []
    for group in range(40):
        words = prose(rng, rng.randint(4, 250)).split()
        rows.append((len(rows), " ".join(words)))
        for _ in range(4):
            copy = words[:]
            for at in rng.sample(range(len(copy)), rng.randint(0, max(1, len(copy) // 40))):
                copy[at] = "changed"
            rows.append((len(rows), " ".join(copy)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for _, t in rows if (w := t.split())]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if 9 * same >= 4 * (len(sets[i]) + len(sets[j])) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    prints = plain_roots([plain_fingerprint(t) for _, t in rows])
    out = corpus_pipeline.simhash_near_deduplication(spark, docs(spark, rows), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(root))
    assert len(set(root)) < len(set(prints))


def test_near_duplicates_come_from_the_fingerprints_trees(spark, monkeypatch):
    """Pairs barely alike are found; with a radius that no pair is within, equal sets of shingles alone are."""
    rng = random.Random(22)
    rows = []
    for _ in range(60):
        words = prose(rng, 204).split()
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words)), (len(rows) + 2, " ".join([*words[:-22], *prose(rng, 22).split()]))]
    table = docs(spark, rows)
    found = corpus_pipeline.simhash_near_deduplication(spark, table, "")
    assert sorted(r.doc_id for r in found.collect()) == list(range(0, 180, 3))
    monkeypatch.setattr(simhash, "WIDE_RADIUS", -1)
    found = corpus_pipeline.simhash_near_deduplication(spark, table, "")
    assert sorted(r.doc_id for r in found.collect()) == [k for k in range(180) if k % 3 != 1]


def test_large_groups_of_near_copies_are_compared_without_rows_of_pairs(spark, monkeypatch):
    """Most copies are not alike, but some are in chains; the same by all pairs, in one cell and in many. No set is written for each of its bands."""
    rng = random.Random(23)
    start, rows = prose(rng, 150).split(), []
    for _ in range(160):
        copy = start[:] if rng.random() < 0.8 or not rows else rng.choice(rows)[1].split()
        for at in rng.sample(range(len(copy)), rng.choice([1, 2, 4, 6])):
            copy[at] = f"changed{len(rows)}x{at}"
        rows.append((len(rows), " ".join(copy)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows if (w := t.split())]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    table = docs(spark, rows)
    written = []
    monkeypatch.setattr(simhash, "cut", lambda df, cut=simhash.cut: written.append(cut(df)) or written[-1])
    for cell, side in ((64, 256), (16, 24), (1, 8)):
        monkeypatch.setattr(simhash, "CELL", cell, raising=False)
        monkeypatch.setattr(simhash, "SIDE", side, raising=False)
        written.clear()
        assert {r.doc_id: r.component_id for r in simhash.alike(table).collect()} == dict(enumerate(root))
        pairs = [x for x in written if x.columns == ["u", "v"]]
        assert max(x.count() for x in pairs) <= 2 * len(rows)
    assert 1 < len(set(root)) < len(rows)
