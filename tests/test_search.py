"""Search end to end against a plain version, the library's modes, and the contract with a model."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cuelake.functions import numbers
from cuelake.library import Library
from cuelake.operators import captions, contract, dependencies, metrics, ranking, retrieval, search, selection, studio, tools

from .test_library import segments


def plain_ranks(scores: dict, most: int) -> dict:
    return {k: r + 1 for r, k in enumerate(sorted(scores, key=lambda k: (-round(scores[k], 8), k))[:most])}


def test_fusion_and_its_fallbacks(spark):
    rng = random.Random(1)
    a = {(q, k): round(rng.random(), 3) for q in range(3) for k in range(60) if rng.random() < 0.7}
    b = {(q, k): round(rng.random(), 2) for q in range(3) for k in range(60) if rng.random() < 0.7}
    frame = lambda x: spark.createDataFrame([(q, k, v) for (q, k), v in x.items()], "q int, k int, score double")
    got = {(r.q, r.k): r["rank"] for r in search.fused(frame(a), frame(b), "q", ["k"], 10).collect()}
    for q in range(3):
        ranks = [plain_ranks({k: v for (p, k), v in x.items() if p == q}, len(x)) for x in (a, b)]
        total = {k: sum(1 / (60 + r[k]) for r in ranks if k in r) for k in set(ranks[0]) | set(ranks[1])}
        assert {k: r for (p, k), r in got.items() if p == q} == plain_ranks(total, 10)
    alone = {(r.q, r.k): r["rank"] for r in search.fused(frame(a), None, "q", ["k"], 10).collect()}
    assert {k: r for (p, k), r in alone.items() if p == 1} == plain_ranks({k: v for (p, k), v in a.items() if p == 1}, 10)
    assert search.fused(None, None, "q", ["k"]) is None


def test_late_ranks_decide(spark):
    """Row 0 is first in one ranking and far behind in the other, row 1 a little earlier there: what the late ranks add decides."""
    n = 3000
    lexical = {0: 10.0, 1: 9.99} | {k: 5.0 - k / n for k in range(2, n)}
    dense = {k: float(k) for k in range(2, n)} | {0: 1.5, 1: 1.75}
    frame = lambda x: spark.createDataFrame([(7, k, v) for k, v in x.items()], "q int, k int, score double")
    ranks = [plain_ranks(x, n) for x in (lexical, dense)]
    total = {k: sum(1 / (60 + r[k]) for r in ranks) for k in range(n)}
    got = {r.k: (r["rank"], r.score) for r in search.fused(frame(lexical), frame(dense), "q", ["k"], 30).collect()}
    assert {k: r for k, (r, _) in got.items()} == plain_ranks(total, 30)
    assert all(s == round(total[k], 8) for k, (_, s) in got.items()) and ranks[1][0] == n and 0 in got
    known = spark.createDataFrame([(7, k) for k in (0, 1, 5, 2999, 4444)], "q int, k int")
    for x, r in ((lexical, ranks[0]), (dense, ranks[1])):
        assert {y.k: y["rank"] for y in retrieval.ranks_of(known, frame(x), "q", ["k"], 5).collect()} == {k: r[k] for k in (0, 1, 5, 2999)}
    tied = {k: 1.0 for k in range(200)}
    assert {y.k: y["rank"] for y in retrieval.ranks_of(known, frame(tied), "q", ["k"], 5).collect()} == {0: 1, 1: 2, 5: 6}


def plain_decision(rows: list[tuple], most: int, relevant: float, strong: float, floor: float | None) -> list[tuple]:
    """Of one query's (video, first, start, end, score): gates and suppression one by one."""

    def apart(found):
        kept = []
        for x in sorted(found, key=lambda r: (-r[4], r[1])):
            short = lambda y: min(x[3] - x[2], y[3] - y[2])  # noqa: E731, B023
            if not any(y[0] == x[0] and short(y) > 0 and (min(x[3], y[3]) - max(x[2], y[2])) / short(y) >= ranking.OVERLAP for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda r: (-r[4], r[0], r[1]))

    good = apart([r for r in rows if r[4] >= relevant])
    shown = [r for r in good if floor is None or r[4] >= floor]
    top = max((r[4] for r in shown), default=0)
    shown = [r for r in shown if top <= 0 or r[4] >= top * ranking.RELATIVE_FLOOR]
    capped = [r for r in shown if sum(o[0] == r[0] and (-o[4], o[1]) < (-r[4], r[1]) for o in shown) < ranking.PER_VIDEO][:most]
    if capped:
        return [("result", r[0], r[1], "strong" if r[4] >= strong else "possible") for r in capped]
    return [("near_miss", r[0], r[1], "weak") for r in (good or apart(rows))[: search.NEAR_MISSES]]


@pytest.mark.parametrize("floor", [ranking.DISPLAY_FLOOR, None])
def test_decisions_are_the_plain_ones(spark, floor):
    rng = random.Random(2)
    rows = []
    for q in range(40):
        best = rng.choice([0.02, 0.09, 0.2, 1.0])
        for k in range(rng.randint(1, 15)):
            start = rng.randint(0, 60)
            rows.append((q, f"v{rng.randint(0, 3)}", 100 * k + q, float(start), float(start + rng.randint(1, 30)), round(rng.random() * best, 4)))
    found = search.decide(spark.createDataFrame(rows, "q int, video_id string, first bigint, start_sec double, end_sec double, score double"), "q", 5, floor=floor).collect()
    for q in range(40):
        got = [(r.kind, r.video_id, r["first"], r.confidence) for r in sorted(found, key=lambda r: r.place) if r.q == q]
        assert got == plain_decision([r[1:] for r in rows if r[0] == q], 5, search.RELEVANT, search.STRONG, floor), q
    unranked = search.decide(spark.createDataFrame(rows, "q int, video_id string, first bigint, start_sec double, end_sec double, score double"), "q", 2, scored=False)
    assert {r.confidence for r in unranked.collect()} == {"unranked"} and unranked.count() <= 80


def test_only_the_best_of_each_partition_are_shuffled(spark):
    """Pairs of query and chunk stay where their chunk is: the ranks' limit stands below the last exchange."""
    chunks = spark.createDataFrame([(k, f"word{k % 7} word{k % 3} common") for k in range(100)], "k int, t string")
    asked = spark.createDataFrame([(q, f"word{q} common") for q in range(7)], "q int, t string")
    top = retrieval.top(retrieval.bm25(chunks, ["k"], "t", asked, "q", "t"), "q", ["k"], 5)
    plan = top._sc._jvm.PythonSQLUtils.explainString(top._jdf.queryExecution(), "simple")
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    lib = Library(spark, str(tmp_path_factory.mktemp("lib")))
    lib.ingest("a", "Bread", segments(spark, ["Welcome to the kitchen garden.", "What makes sourdough bread rise?", "Natural fermentation makes sourdough bread rise slowly.", "But then the oven failed completely.", "Nothing else happened that morning.", "[Visual Scene 00:40 - 00:45] sourdough bread"]))
    lib.ingest("b", "Cars", segments(spark, ["Engines need clean oil.", "Change the oil twice every year.", "Tyres wear down with age."]))
    return lib


def logit(query, text):
    """Stands in for a model: how many of the query's words the text has."""
    n = F.size(F.array_intersect(F.split(F.lower(query), " "), F.split(F.regexp_replace(F.lower(text), "[^a-z ]", ""), " ")))
    return n * 4.0 - 6.0


def test_search_modes(spark, library):
    found = library.search("sourdough bread").collect()
    assert found[0].video_id == "a" and "fermentation" in found[0].text and {r.confidence for r in found} == {"unranked"}
    ranked = library.search("sourdough bread", rerank=logit).collect()
    assert ranked[0].kind == "result" and ranked[0].confidence == "strong" and ranked[0].score == pytest.approx(1 / (1 + math.exp(-2)), abs=1e-4)
    far = library.search("oil refinery prices", rerank=lambda q, t: F.lit(-5.0)).collect()
    assert far and {r.kind for r in far} == {"near_miss"} and {r.confidence for r in far} == {"weak"} and len(far) <= search.NEAR_MISSES
    assert library.search("").count() == 0 and library.search("x", mode="visual").count() == 0
    answer = library.answer("sourdough bread")
    assert answer["degraded"] and answer["message"] and answer["results"] and answer["library_video_count"] == 2
    assert not library.answer("sourdough bread", rerank=logit)["degraded"] and "pictures" in library.answer("x", mode="visual")["message"]


def test_vectors_and_their_cascade(spark, library):
    place = lambda t: [float("oil" in t.lower()), float("bread" in t.lower()), 0.1]
    make = F.udf(place, "array<double>")
    library.reindex(lambda c: c.select("video_id", "sentence_idx", make("text").alias("vector")))
    assert library.table("vectors").count() == library.table("chunks").count() and library.table("chunks").columns == [f.split(" ")[0] for f in "id,video_id,sentence_idx,start_sec,end_sec,start_timestamp,end_timestamp,text,enriched_text,section_topic,questions,concepts".split(",")]
    found = library.search("lubricant", embed=lambda q: [1.0, 0.0, 0.1]).collect()
    assert found[0].video_id == "b" and "oil" in found[0].text
    shown = spark.createDataFrame([("a", 0, "visual", "ok", [0.0, 1.0]), ("a", 3, "visual", "video-level", [1.0, 0.0]), ("b", 0, "visual", "ok", [0.25, 0.0])], "video_id string, sentence_idx bigint, kind string, status string, vector array<double>")
    library.put_vectors(shown)
    library.put_vectors(shown)
    assert library.table("vectors").filter("kind = 'visual'").count() == 3
    seen = library.search("an engine", mode="visual", embed=lambda q: [1.0, 0.0]).collect()
    assert [(r.video_id, r.confidence) for r in seen] == [("b", "possible")] and "visual scene" in seen[0].reason
    library.delete("b")
    assert {r.video_id for r in library.table("vectors").collect()} == {"a"}


def test_lists_are_unwrapped_and_checked():
    assert contract.unwrapped({"x": [1], "beats": [2]}) == [2] and contract.unwrapped({"a": [1], "b": [1, 2]}) == [1, 2]
    assert contract.unwrapped({"a": {"t": 1}, "b": {"t": 2}}) == [{"t": 1}, {"t": 2}] and contract.unwrapped({"a": 1}) == {"a": 1} and contract.unwrapped({}) == {}
    assert contract.problem([{"a": 1}], "array", ("a",)) is None and "missing b" in contract.problem([{"a": 1}], "array", ("a", "b")) and contract.problem({}, "array", ()) == "expected array"
    assert contract.strings({"a": ["x", {"b": "y"}], "n": 1}, str.upper) == {"a": ["X", {"b": "Y"}], "n": 1}


def provider(system, user):
    if "limit" in user:
        raise RuntimeError("429 rate limit")
    if "twice" in user:
        return "never json", 5, 1
    if "once" in user and "previous response" not in user:
        return json.dumps({"items": [{"wrong": 1}]}), 5, 1
    return json.dumps({"items": [{"name": user[:5]}]}), 7, None


def test_answers_are_asked_for_twice_at_most(spark):
    asked = spark.createDataFrame([(1, "s", "plain"), (2, "s", "once more"), (3, "s", "twice bad"), (4, "s", "limit"), (5, None, None)], "id int, system string, user string")
    found = {r.id: r for r in contract.completed(asked, provider, "array", ("name",)).collect()}
    assert json.loads(found[1].answer) == [{"name": "plain"}] and (found[1].prompt_tokens, found[1].completion_tokens, found[1].attempts) == (7, 0, 1)
    assert (found[2].prompt_tokens, found[2].completion_tokens, found[2].attempts) == (12, 1, 2) and found[2].error is None
    assert found[3].answer is None and "retry" in found[3].error and found[3].prompt_tokens == 10
    assert "429" in found[4].error and found[5].answer is not None
    assert contract.completed(asked.limit(0), provider, "array").count() == 0


def beats_provider(system, user):
    lines = user.split("\n")
    if len(lines) > 4:
        raise RuntimeError("context_length exceeded")
    at = int(lines[0][1 : lines[0].index("]")])
    if at == 20:
        raise RuntimeError("broken")
    return json.dumps({"beats": [{"type": "hook", "start": at, "end": at}]}), len(lines), 1


def test_long_windows_are_halved(spark):
    rows = [(v, i, f"t{i}") for v in (1, 2, 3) for i in range(24)]
    s = spark.createDataFrame(rows, "video_id int, sentence_idx bigint, text string")
    windows = spark.createDataFrame([(1, 0, i) for i in range(8)] + [(2, 0, i) for i in range(4)] + [(2, 1, i) for i in range(20, 24)] + [(3, 0, i) for i in range(20, 24)], "video_id int, window bigint, sentence_idx bigint")
    beats, report = contract.window_beats(s, windows, beats_provider, "")
    assert sorted((r.video_id, r["first"]) for r in beats.collect()) == [(1, 0), (1, 4), (2, 0)]
    assert {r.video_id: (r.mode, r.windows, r.failed, r.prompt_tokens) for r in report.collect()} == {1: ("llm", 2, 0, 8), 2: ("llm_partial", 2, 1, 4), 3: ("heuristic", 1, 1, 0)}


def test_beats_without_a_model_come_from_the_words(spark):
    said = ["We begin here.", "Why did it fail?", "Nobody knew.", "But then it worked."]
    s = spark.createDataFrame([(v, i + (20 if v == 3 else 0), said[i % 4]) for v in (1, 3) for i in range(4)], "video_id int, sentence_idx bigint, text string")
    windows = s.select("video_id", F.lit(0).cast("bigint").alias("window"), "sentence_idx")
    plain = {(r.video_id, r.beat_type, r["first"]) for r in selection.heuristic_beats(s).collect()}
    beats, modes = contract.generated_beats(s, windows, beats_provider, "")
    got = {(r.video_id, r.beat_type, r["first"]) for r in beats.collect()}
    assert got == {(1, "hook", 0)} | {x for x in plain if x[0] == 3} and len(got) > 3
    assert {r.video_id: r.mode for r in modes.collect()} == {1: "llm", 3: "heuristic"}
    beats, modes = contract.generated_beats(s, windows, None, "")
    assert {(r.video_id, r.beat_type, r["first"]) for r in beats.collect()} == plain and {r.mode for r in modes.collect()} == {"heuristic"}


def test_a_digest_names_every_sentence(spark):
    rows = [("v", k, 3 * k, 3 * k + 2, f"s{k}" if k != 5 else "") for k in range(60)]
    found = {r.segment: r.digest for r in contract.digest(spark.createDataFrame(rows, "video_id string, segment bigint, first bigint, last bigint, summary string")).collect()}
    assert found[0] == "" and found[1] == "[0-2] s0" and found[40].count("\n") == 38
    last = found[59].split("\n")
    assert len(last) == 40 and last[0] == "[0-14] 4 earlier sections, opening: s0".replace("[0-14] 4", "[0-11] 4") and last[-1] == "[174-176] s58"
    spans = [tuple(map(int, x[1 : x.index("]")].split("-"))) for x in last]
    assert all(a2 - b1 in (1, 4) for (_, b1), (a2, _) in zip(spans, spans[1:]))


def test_needs_with_cycles_and_chains(spark):
    rows = [(1, k, k - 1 if k else None) for k in range(50)] + [(2, 0, 2), (2, 2, 1), (2, 1, 0), (3, 5, 9), (3, 9, 3)]
    found = {(r.video_id, r.sentence_idx): r.earliest for r in dependencies.earliest_needed(spark.createDataFrame(rows, "video_id int, sentence_idx bigint, needs bigint")).collect()}
    assert all(found[1, k] == 0 for k in range(1, 50)) and (1, 0) not in found
    assert found[2, 0] == found[2, 1] == found[2, 2] == 0 and found[3, 5] == 3
    none = spark.createDataFrame([], "video_id int, sentence_idx bigint, needs bigint")
    assert dependencies.earliest_needed(none).count() == 0
    clips = spark.createDataFrame([(1, 3, 6), (1, 0, 2), (9, 0, 1)], "video_id int, first bigint, last bigint")
    got = {(r.video_id, r["first"]): r.dangling for r in dependencies.dangling(clips, spark.createDataFrame(rows, "video_id int, sentence_idx bigint, needs bigint")).collect()}
    assert got == {(1, 3): [3], (1, 0): [], (9, 0): []}


def test_reports_of_nothing(spark):
    results = spark.createDataFrame([], "query int, rank bigint, video_id string, start_sec double, end_sec double, words bigint")
    expected = spark.createDataFrame([(1, "v", 0.0, 5.0), (2, None, None, None)], "query int, video_id string, a double, b double")
    row = metrics.retrieval_report(results, expected).first()
    assert (row.n_positive, row.n_negative, row.recall_1, row.mrr, row.seek_error, row.false_positive_rate, row.mean_quote_words) == (1, 1, 0.0, 0.0, None, 0.0, None)
    clips = spark.createDataFrame([], "video_id int, first bigint, start_sec double, end_sec double")
    examples = spark.createDataFrame([(1, 1, 0.0, 10.0, None)], "example int, video_id int, a double, b double, setup bigint")
    starts = spark.createDataFrame([], "video_id int, start_sec double")
    assert metrics.clip_report(clips, examples, starts).first()["coverage"] == 0.0


def test_captions_shrink_to_the_picture(spark):
    rows = spark.createDataFrame([("short",), ("x" * 60,), ("x" * 500,)], "t string").select("t", captions.layout(F.col("t"), 1000, 1000, "large").alias("l"))
    found = {len(r.t): r.l for r in rows.collect()}
    assert found[5].font == 62 and found[5].y == 820 and found[60].font * 30 <= 920 and found[500].font == 24 and found[500].x == 0


def test_whole_phrases_alone_are_banned(spark):
    held = spark.range(1).select(studio.banned_words(F.lit("Synergy! and synergyx"), ["synergy"]).alias("b")).first()
    assert held.b == ["synergy"]


def test_tools_run_and_make_blocks_anew(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    made = iter(range(9))
    run = lambda inputs, profile: ({"title": f"Synergy {inputs['t']} {next(made)}", "tags": ["synergy", "x"]}, {"prompt_tokens": 3, "model": "m"})
    known = {"notes": tools.Tool(run, lambda i: len(i["t"].split()))}
    first = lib.run_tool(known, "notes", {"t": "bread"}, 100.0, banned=("synergy",))
    assert first["title"] == "bread 0" and first["tags"] == ["", "x"] and first["guardrail_notes"] == {"banned_words_removed": ["synergy"]}
    again = lib.regenerate(known, first["run_id"], "title", 200.0)
    assert again["title"] == "Synergy bread 1" and again["tags"] == ["", "x"]
    assert json.loads(lib.table("runs").first()["output"])["title"] == "Synergy bread 1"
    assert lib.usage(200.0).first()["hour"] == 2
    for bad in (lambda: lib.run_tool(known, "none", {}, 1.0), lambda: lib.run_tool(known, "notes", {"t": "w " * 15_001}, 1.0), lambda: lib.regenerate(known, "run-x", "title", 1.0)):
        with pytest.raises(tools.ToolError):
            bad()


def test_nearest_by_blocks_is_the_best_of_all_pairs(spark, monkeypatch):
    """Pairs were rows of a join, each with a fold over its vectors; now a task gives each of its queries' best alone."""
    rng = random.Random(8)
    whole = [[rng.choice([0.0, 0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(3)] for _ in range(120)]
    odd = [None, [], [1.0], [0.5, None, 0.25], [float("nan"), 1.0, 0.0], [1e30, 0.0, 0.0], [float("inf"), 0.0, 1.0]]
    rows = [(k, v) for k, v in enumerate(whole + [whole[0]] * 40 + [[0.5, 0.25, 0.0000005]] * 3 + odd)]
    rng.shuffle(rows)
    e = spark.createDataFrame(rows, "k bigint, v array<float>")
    asked = e.filter("k % 5 = 0 OR k > 160").select(F.col("k").alias("q"), "v")
    pairs = asked.crossJoin(e.select("k", F.col("v").alias("w"))).select("q", "k", F.round(numbers.dot(F.col("w"), F.col("v")), 6).alias("score"))
    for most in (4, 200):
        want = {(r.q, r.k): r["rank"] for r in retrieval.top(pairs, "q", ["k"], most).collect()}
        for queries, block, tile in ((10_000, 8192, 256), (9, 50, 4)):
            monkeypatch.setattr(retrieval, "MOST_QUERIES", queries)
            monkeypatch.setattr(retrieval, "BLOCK", block)
            monkeypatch.setattr(retrieval, "TILE", tile)
            monkeypatch.setattr(retrieval, "PAIRS", 64)
            found = retrieval.nearest(asked, "q", "v", e, "k", "v", most)
            assert {(r.q, r.k): r["rank"] for r in found.collect()} == want
    plan = retrieval.nearest(asked, "q", "v", e, "k", "v", 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert retrieval.nearest(asked.limit(0), "q", "v", e, "k", "v", 4).count() == 0 == retrieval.nearest(asked, "q", "v", e.limit(0), "k", "v", 4).count()


def test_bm25_by_matrices_is_that_by_joins(spark, monkeypatch):
    """Each occurrence of an asked term was a row that met all its queries, and texts were split three times to count them."""
    rng = random.Random(4)
    said = ["river", "Town", "the", "it's", "lamp", "bridge", "äther", "42"]
    rows = [(k, f"n{k % 5}" if k % 9 else None, " ".join(rng.choices(said, k=rng.randint(0, 12)))) for k in range(300)] + [(1000, "none", None), (1001, "empty", "")]
    chunks = spark.createDataFrame(rows, "k bigint, name string, text string").cache()
    asked = spark.createDataFrame([(0, "The river, the town"), (1, "lamp lamp unknown"), (2, "nothing"), (3, None), (4, "42 it's")], "q int, t string")
    split = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            split.add(len(pdf))
            yield pdf

    def scores(c, by=retrieval.bm25_by_counts):
        return {(r.q, r.k, r.name): round(r.score, 9) for r in by(c, ["k", "name"], "text", asked, "q", "t").collect()}

    got = scores(chunks.mapInPandas(counted, chunks.schema))
    assert split.value == 3 * len(rows)  # the keys, the statistics and the scores
    twice = chunks.unionByName(chunks.filter("k < 40"))
    assert got == scores(chunks, retrieval.bm25) and len(got) > 500 and scores(twice) == scores(twice, retrieval.bm25) != got
    monkeypatch.setattr(retrieval, "MOST_CELLS", 10)
    assert got == scores(chunks)
    monkeypatch.undo()
    assert scores(chunks.limit(0)) == {} == scores(chunks.filter("text IS NULL"))


def test_ranks_and_dense_scores_of_odd_rows(spark, monkeypatch):
    """Rows without a score came before all others, and a NaN after them."""
    rows = [(0, "a", 0.5), (0, "b", None), (0, "c", float("nan")), (0, "d", 0.5), (0, None, 0.5), (0, "e", -1.0), (1, "a", 2.0), (1, "b", None)] + [(0, f"x{k}", 0.25 * (k % 9)) for k in range(200)]
    scored = spark.createDataFrame(rows, "q int, k string, score double")
    want = {(r.q, r.k): r["rank"] for r in retrieval.top(scored, "q", ["k"], 1000).collect()}
    known = scored.filter("k IS NULL OR k IN ('a', 'b', 'c', 'e', 'x7', 'x8', 'x16')").select("q", "k").union(spark.createDataFrame([(0, "gone"), (7, "a")], "q int, k string"))
    got = {(r.q, r.k): r["rank"] for r in retrieval.ranks_of(known, scored, "q", ["k"], 12).collect()}
    assert got == {x: r for x, r in want.items() if x[1] in ("a", "b", "c", "e", "x7", "x8", "x16")}
    assert retrieval.ranks_of(known.limit(0), scored, "q", ["k"], 12).count() == 0
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [3.0]), (4, []), (5, [0.1, 0.2])], "k bigint, v array<float>")
    asked = vectors.select(F.col("k").cast("string").alias("q"), F.col("v").alias("w"))
    plain = {(r.q, r.k): r.s for r in asked.crossJoin(vectors).select("q", "k", numbers.dot(F.col("v"), F.col("w")).alias("s")).collect()}
    monkeypatch.setattr(retrieval, "PAIRS", 12)
    assert {(r.q, r.k): r.score for r in retrieval.dense(asked, "q", "w", vectors, "k", "v").collect()} == plain
