"""The library end to end, and the operators of whole videos."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.library import SCHEMAS, Library, _part, _part_of
from cuelake.operators import captions, concepts, config, prosody, selection, solver, studio
from cuelake.sources.segmenting import sentences_of


def segments(spark, said):
    return spark.createDataFrame([(t, 6.0 * k, 6.0) for k, t in enumerate(said)], "text string, start double, duration double")


def test_library(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    assert lib.search("anything").count() == 0 and lib.statistics().first()["chunks"] == 0
    lib.ingest("a", "Cooking", segments(spark, ["Welcome to the kitchen garden.", "What makes sourdough bread rise?", "Natural fermentation makes sourdough bread rise slowly.", "But then the oven failed completely.", "Nothing else happened that morning."]))
    lib.ingest("b", "Cars", segments(spark, ["Engines need clean oil.", "Change the oil twice every year.", "Tyres wear down with age."]))
    lib.ingest("a", "Again", segments(spark, ["Should not be added here."]))
    assert {(r.id, r.chunk_count) for r in lib.videos().collect()} == {("a", 5), ("b", 3)}
    found = lib.search("sourdough bread").collect()
    assert found[0].video_id == "a" and "fermentation" in found[0].text and found[0].confidence == "unranked"
    assert lib.search("").count() == 0 and lib.search("zebra").count() == 0
    assert 0 < lib.suggested_queries().count() <= 4
    lib.analyse("a")
    clips = lib.table("clips").collect()
    assert clips and all(12 <= c.end_sec - c.start_sec <= 75 for c in clips)
    lib.analyse("a")
    assert lib.table("clips").count() == len(clips)
    lib.fail("c", "no audio")
    lib.delete("b")
    stats = lib.statistics().first()
    assert (stats.indexed, stats.failed, stats.chunks) == (1, 1, 5)
    rows = spark.createDataFrame([("notes", 10, 5, f"m{k}", float(k)) for k in range(10)], "tool_id string, prompt_tokens bigint, completion_tokens bigint, model string, ts double")
    lib.record_usage(rows)
    lib.record("usage", rows.withColumn("ts", F.col("ts") + 100), "ts", 12)
    use = lib.usage(110.0).first()
    assert lib.table("usage").count() == 12 and use.last_model == "m9" and use.prompt_tokens == 120
    jobs = spark.createDataFrame([("1", "ingest", "d", "running", None, 1.0), ("2", "ingest", "a", "done", None, 1.0)], "id string, kind string, video_id string, status string, error string, updated_at double")
    lib.write("jobs", jobs)
    lib.recover()
    assert {r.id: r.status for r in lib.table("jobs").collect()} == {"1": "failed", "2": "done"}
    assert lib.table("videos").filter("id = 'd'").first()["status"] == "failed"


def test_changes_of_one_video_write_its_part_alone(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    vector = lambda v, k, x: (v, k, "dense", "ok", [x])
    schema = SCHEMAS["vectors"]
    assert lib.table("vectors").count() == 0 and lib.of("vectors", "a").count() == 0 and lib.vacuum() == 0
    lib.put_vectors(spark.createDataFrame([vector("a", 0, 1.0), vector("a", 1, 2.0), vector("b", 0, 3.0)], schema))
    state = lambda: {(r.video_id, r.sentence_idx): r.vector[0] for r in lib.table("vectors").collect()}
    assert state() == {("a", 0): 1.0, ("a", 1): 2.0, ("b", 0): 3.0}
    before = lib._versions("vectors")
    lib.put_vectors(spark.createDataFrame([vector("a", 1, 5.0)], schema))
    after = lib._versions("vectors")
    assert [k for k in after if after[k] != before[k]] == [_part("a")] and state()[("a", 1)] == 5.0
    many = spark.createDataFrame([vector(f"v{k}", 0, float(k)) for k in range(400)] + [vector(None, 0, 7.0)], schema)
    lib.put_vectors(many)  # all parts: a new generation
    assert len(lib._generations("vectors")) == 1 and len(state()) == 404
    assert lib.table("vectors").select(_part_of("video_id")).distinct().count() > 8
    lib.put("vectors", "b")
    assert len(state()) == 403 and lib.of("vectors", "b").count() == 0
    (tmp_path / "lib" / "vectors" / "g=1" / f"part={_part('a')}" / "v=9").mkdir()  # a write that never ended
    assert len(state()) == 403
    for x in range(3):
        lib.put("vectors", "a", spark.createDataFrame([vector("a", 0, float(x))], schema))
    assert lib.vacuum(keep=1) > 0 and state()[("a", 0)] == 2.0 and len(state()) == 402
    lib.write("vectors", lib.table("vectors").filter("video_id = 'none'"))
    assert state() == {}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab .!?", max_size=30), st.floats(0, 20), st.floats(0, 50)), max_size=12))
def test_no_word_is_lost(parts):
    at, segs = 0.0, []
    for text, gap, length in parts:
        segs.append((text, at, length))
        at += gap
    out = sentences_of(segs)
    letters = lambda x: x.replace(" ", "").replace(".", "").replace("!", "").replace("?", "")
    assert letters("".join(t for t, *_ in out)) == letters("".join(t for t, *_ in segs))
    assert all(a <= b for _, a, b in out)


def test_sentences():
    assert sentences_of([("One two three. Four five six! Go", 0.0, 4.0), ("now please.", 4.0, 2.0)]) == [("One two three.", 0, 4), ("Four five six!", 0, 4), ("Go now please.", 0, 6)]
    assert sentences_of([("Stop.", 0.0, 1.0)]) == [("Stop.", 0, 1)] and sentences_of([("", 0, 1), (None, 1, 1)]) == []
    assert sentences_of([("I did it again.", 0.0, 1.0), ("Yes.", 1.0, 1.0)]) == [("I did it again. Yes.", 0, 2)]
    assert len(sentences_of([(" ".join(["word"] * 10), 10.0 * k, 10.0) for k in range(12)])) == 3


def test_solver_keeps_setups_and_references():
    s = [(k, 6.0 * k, 6.0 * k + 6, k in (3,)) for k in range(30)]
    beats = [("setup", 1, 1, None), ("payoff", 4, 5, 3), ("lesson", 20, 20, 1)]
    found = solver.Video(s, beats).candidates()
    assert found == [(2, 5, 1, 0.0, [])]
    assert solver.Video(s, [("payoff", 4, 4, None)]).candidates() == []
    chain = solver.Video([(k, 6.0 * k, 6.0 * k + 6, False) for k in range(12)], [("setup", 0, 1, None), ("setup", 2, 3, 0), ("payoff", 5, 6, 3)])
    assert chain.candidates() == [(0, 6, 3, 0.0, [])]
    prefer = solver.Video([(k, 6.0 * k, 6.0 * k + 6, False) for k in range(12)], [("payoff", 5, 7, None)], lambda a, b: 1.0 if a == 18.0 else 0.0)
    assert prefer.candidates() == [(3, 7, 1, 1.0, [])]
    loop = solver.Video([(k, 6.0 * k, 6.0 * k + 6, False) for k in range(12)], [("payoff", 4, 6, 2), ("setup", 2, 3, 2)])
    assert [c[:2] for c in loop.candidates()] == [(2, 6)]


def test_pitch_of_tones(spark):
    t = np.arange(16_000 * 2) / 16_000
    for f in (90, 150, 220, 300):
        rms, f0 = prosody.contour(np.sin(2 * np.pi * f * t) + 0.3 * np.sin(4 * np.pi * f * t))
        assert (f0 > 0).mean() > 0.9 and abs(np.median(f0[f0 > 0]) - f) < 0.03 * f
    rng = np.random.default_rng(1)
    assert (prosody.contour(rng.normal(0, 0.1, 32_000))[1] > 0).mean() < 0.1
    assert (prosody.contour(np.zeros(32_000))[1] == 0).all() and len(prosody.contour(np.zeros(10))[0]) == 0
    rising = np.sin(2 * np.pi * np.cumsum(np.where(t < 1, 120, 180)) / 16_000) * np.where(t < 1, 0.2, 0.8)
    signal = spark.createDataFrame([("v", [float(x) for x in rising])], "video_id string, pcm array<float>")
    clips = spark.createDataFrame([("v", "c", 0.0, 2.0), ("v", "short", 0.0, 0.05), ("w", "none", 0.0, 2.0)], "video_id string, clip_id string, start_sec double, end_sec double")
    found = {r.clip_id: r for r in prosody.clip_features(prosody.frames(signal), clips).collect()}
    assert set(found) == {"c"} and found["c"].pitch_reliable
    assert found["c"].pitch_delta_st == pytest.approx(12 * np.log2(1.5), abs=0.5) and found["c"].energy_delta == pytest.approx(0.75, abs=0.05)


def test_what_was_not_measured_has_no_weight(spark):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(prosody.acoustic(none, none, none, none).alias("a"), prosody.acoustic(F.lit(0.5), none, none, none).alias("b"), prosody.acoustic(F.lit(0.5), F.lit(0.39), none, none).alias("c"), prosody.emotional_delta(F.lit(True), none).alias("d"), prosody.emotional_delta(F.lit(False), none).alias("e")).first()
    assert row.a is None and row.b == 0.5 and row.c == pytest.approx((0.5 * 0.15 + 0.3) / 0.45) and (row.d, row.e) == (0.35, 0.3)


def test_concepts(spark):
    s = spark.createDataFrame([(1, 0, "Kubernetes cluster scaling makes kubernetes cluster planning harder"), (1, 1, "so it is"), (1, 2, None)], "video_id int, sentence_idx int, text string")
    idf = spark.createDataFrame([("kubernetes", 3.0), ("cluster", 2.0)], "term string, idf double")
    found = {r.sentence_idx: r for r in concepts.concepts(s, ["video_id", "sentence_idx"], "text", idf).collect()}
    assert found[0].concepts[0] == "kubernetes cluster" and "kubernetes" not in found[0].concepts and found[0].section_topic == "Kubernetes Cluster"
    assert found[1].section_topic == found[2].section_topic == "General Discussion" and found[1].concepts == []


def test_beats_from_a_model_are_checked(spark):
    s = spark.createDataFrame([(1, k, f"Sentence number {k}, it's here.") for k in range(5)], "video_id int, sentence_idx bigint, text string")
    rows = [(1, "hook", 0, 0, None, "t" * 200, "w", "Number 0 its here"), (1, "payoff", 2, 3, 1, "t", "w", "made up"), (1, "payoff", 3, 4, 9, "t", None, None), (1, "nonsense", 0, 0, None, "", "", ""), (1, "hook", 4, 9, None, "", "", ""), (1, "hook", 3, 2, None, "", "", "")]
    beats = spark.createDataFrame(rows, "video_id int, beat_type string, first bigint, last bigint, needs bigint, title string, why string, quote string")
    found = {r.first: r for r in studio.valid_beats(beats, s).collect()}
    assert set(found) == {0, 2, 3} and found[0].quote == "Number 0 its here" and len(found[0].title) == 120
    assert found[2].quote == "" and found[2].needs == 1 and found[3].needs is None


def test_merged_blocks_and_banned_words(spark):
    w = spark.createDataFrame([("a", 1, ["x", "y"], ["t"], [3]), ("a", 2, ["y", "z"], None, [1])], "k string, window int, notes array<string>, titles array<string>, chapters array<int>")
    row = studio.merged_blocks(w, "k").first()
    assert row.notes == ["x", "y", "z"] and row.titles == ["t"] and row.chapters == [1, 3]
    held = spark.range(1).select(studio.banned_words(F.lit("A Game changer; synergy-ish"), ["synergy", "game changer", "sync"]).alias("b")).first()
    assert held.b == ["game changer", "synergy"]


def test_captions(spark):
    w = spark.createDataFrame([("v", k, f"w{k}", float(k), k + 0.5) for k in range(5)], "video_id string, pos bigint, word string, start double, end double")
    cues = captions.cues(w, 2, upper=True)
    assert [tuple(r) for r in cues.orderBy("cue").collect()][2] == ("v", 2, 4.0, 4.5, "W4")
    ticks = spark.createDataFrame([("v", x) for x in (0.0, 0.2, 1.8, 2.1, 9.0)], "video_id string, at double")
    found = [(r.at, r.cue, r.changed) for r in captions.frame_states(cues, ticks).orderBy("at").collect()]
    assert found == [(0.0, 0, True), (0.2, 0, False), (1.8, None, True), (2.1, 1, True), (9.0, None, True)]


def test_packed_windows(spark):
    sizes = [20, 30, 15, 130, 5]
    rows = [("v", i, k) for k, n in enumerate(sizes) for i in range(sum(sizes[:k]), sum(sizes[: k + 1]))]
    found = {}
    for r in selection.packed_windows(spark.createDataFrame(rows, "g string, i bigint, segment bigint"), "g", "i").collect():
        found.setdefault(r.window, []).append(r.i)
    assert {k: (min(v), max(v), len(v)) for k, v in found.items()} == {0: (0, 49, 50), 1: (50, 64, 15), 2: (65, 124, 60), 3: (115, 174, 60), 4: (165, 194, 30), 5: (195, 199, 5)}


def test_palette(spark):
    rows = [(250.0, 10.0, 10.0)] * 30 + [(128.0, 128.0, 128.0)] * 60 + [(10.0, 10.0, 200.0)] * 10
    found = {r.colour: r for r in config.palette(spark.createDataFrame(rows, "r double, g double, b double"), k=3).collect()}
    assert found["#808080"].role == "primary" and found["#fa0a0a"].role == "accent" and found["#fa0a0a"].text_colour == "#ffffff"
