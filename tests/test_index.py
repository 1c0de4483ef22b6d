"""The persisted index against scores over all texts, and commits of several writers."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from cuelake.library import SCHEMAS, Library, Overtaken
from cuelake.operators import inverted, retrieval

from .test_library import segments

WORDS = "river bridge lamp town night old rose over watched the and it".split()


def scores(frame, keys=("q", "id")):
    return {tuple(r[k] for k in keys): round(r.score, 8) for r in frame.collect()}


def test_deltas_add_up_to_the_scores_of_what_is_there(spark, tmp_path):
    rng = random.Random(2)
    texts = [(k, " ".join(rng.choices(WORDS, weights=range(1, 13), k=rng.randint(1, 30)))) for k in range(120)] + [(900, None), (901, ""), (902, "don't you're lamp")]
    frame = lambda rows: spark.createDataFrame(rows, "id int, text string")
    queries = spark.createDataFrame([(1, "the old lamp"), (2, "river river bridge"), (3, "zebra"), (4, ""), (5, None)], "q int, ask string")
    index = inverted.Index(spark, str(tmp_path), "id int", 8)
    assert scores(index.bm25([], queries, "q", "ask")) == {} and index.sizes([]) == (0, 0, 0)
    index.append("a", frame(texts[:60]), "text")
    index.append("b", frame(texts[60:]), "text")
    index.append("b", frame(texts[60:]), "text")  # written again: itself
    index.append("c", frame(texts[10:30]), "text", -1)
    index.append("d", frame(texts[10:15]), "text")
    states = [(["a", "b"], texts), (["a", "b", "c", "d"], texts[:15] + texts[30:])]
    index.compact(["a", "b", "c", "d"], "e")
    for deltas, there in [*states, (["e"], states[-1][1])]:
        assert scores(index.bm25(deltas, queries, "q", "ask")) == scores(retrieval.bm25(frame(there), ["id"], "text", queries, "q", "ask"))
    # the last state, before and after its deltas became one
    assert scores(index.tfidf(["a", "b", "c", "d"], frame(there), "text", queries, "q", "ask")) == scores(retrieval.tfidf(frame(there), "id", "text", queries, "q", "ask"))
    idf = lambda x: {r.term: (r.df, round(r.idf, 9)) for r in x.collect()}
    assert idf(index.idf(["a", "b", "c", "d"])) == idf(index.idf(["e"])) == idf(retrieval.idf(frame(there), "text"))


def test_a_search_reads_the_buckets_of_its_words(spark, tmp_path):
    index = inverted.Index(spark, str(tmp_path), "id int", 64)
    index.append("a", spark.createDataFrame([(k, f"word{k} common") for k in range(200)], "id int, text string"), "text")
    named = spark.createDataFrame([("word7",)], "term string")
    plan = index.of_terms(index._read("postings", ["a"], index._postings), named, ["word7"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in text and "PushedFilters: [IsNotNull(term), EqualTo(term,word7)]" in text or "In(term" in text
    read = {f.split("bucket=")[1].split("/")[0] for f in plan.inputFiles()}
    assert len(read) == 64 or len(read) == 1  # files listed before or after pruning
    assert plan.count() == 1
    files = plan.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(files) == 1 and "/d=a/bucket=" in files[0].f
    assert index.of_terms(index._read("postings", ["a"], index._postings), named, None).count() == 1


def row(spark, k):
    return spark.createDataFrame([("notes", k, k, f"m{k}", float(k))], SCHEMAS["usage"])


def test_writers_at_once_lose_nothing(spark, tmp_path):
    libs = [Library(spark, str(tmp_path / "lib")) for _ in range(5)]
    failed = []

    def record(k):
        try:
            libs[k].record_usage(row(spark, k))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=record, args=(k,)) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and {r.ts for r in libs[0].table("usage").collect()} == {0.0, 1.0, 2.0, 3.0, 4.0}


def test_a_file_is_made_once(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    made = []
    threads = [threading.Thread(target=lambda k=k: made.append((lib._make("_commits/1.json", f"{k}" * 1000), k))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winner = [k for yes, k in made if yes]
    assert len(winner) == 1 and (tmp_path / "lib" / "_commits" / "1.json").read_text() == f"{winner[0]}" * 1000
    assert list((tmp_path / "lib" / "_aside").glob("[!.]*")) == []


def test_changes_of_other_parts_are_kept_and_those_of_the_same_done_again(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    vector = lambda v, x: spark.createDataFrame([(v, 0, "dense", "ok", [x])], SCHEMAS["vectors"])
    lib.put("vectors", "a", vector("a", 1.0))
    runs = []

    def work(change, other, mine):
        runs.append(mine)
        change.put("vectors", mine, vector(mine, 5.0))
        if len(runs) == 1:
            lib.put("vectors", other, vector(other, 9.0))  # someone is faster

    lib.commit(lambda c: work(c, "b", "a"))
    assert runs == ["a"]  # another part: nothing is done twice
    runs.clear()
    lib.commit(lambda c: work(c, "a", "a"))
    assert runs == ["a", "a"]
    assert {r.video_id: r.vector[0] for r in lib.table("vectors").collect()} == {"a": 5.0, "b": 9.0}

    def always(change):
        change.put("vectors", "a", vector("a", 0.0))
        lib.put("vectors", "a", vector("a", 1.0))

    import cuelake.library as module

    most, module.MOST_TRIES = module.MOST_TRIES, 2
    try:
        with pytest.raises(Overtaken):
            lib.commit(always)
    finally:
        module.MOST_TRIES = most


def test_a_crash_between_two_tables_shows_neither(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    lib.ingest("a", "A", segments(spark, ["The river rose over the bridge.", "The town watched it all night."]))
    before, reader = lib.table("chunks").count(), lib.snapshot()

    def killed(change):
        change.put("chunks", "a")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        lib.commit(killed)
    assert lib.table("chunks").count() == before == 2 and lib.is_indexed("a") and len(lib.snapshot().manifest["index"]) == 1
    lib.delete("a")
    assert reader.table("chunks").count() == before and reader.table("videos").count() == 1  # as it was
    assert lib.table("chunks").count() == lib.table("videos").count() == 0 and lib.search("river").count() == 0


def test_the_library_searches_its_index(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    said = {"a": ["The river rose over the bridge.", "A lamp burned in the town."], "b": ["Nobody crossed the old bridge.", "The river fell again."]}
    for k, v in said.items():
        lib.ingest(k, k, segments(spark, v))
    lib.delete("b")
    lib.ingest("b", "b", segments(spark, said["b"][:1]))
    now = lib.snapshot()
    asked = spark.createDataFrame([(0, "the river bridge")], "q int, text string")
    keys = ["video_id", "sentence_idx"]
    got = lib.index.bm25(now.manifest["index"], asked, "q", "text").drop("scene")
    assert len(now.manifest["index"]) == 4
    assert scores(got, keys) == scores(retrieval.bm25(now.table("chunks"), keys, "text", asked, "q", "text"), keys)
    lib.reindex(lambda c: c.select("video_id", "sentence_idx", F.array(F.lit(1.0)).alias("vector")))
    again = lib.snapshot()
    assert len(again.manifest["index"]) == 1 and scores(lib.index.bm25(again.manifest["index"], asked, "q", "text").drop("scene"), keys) == scores(got, keys)
    assert lib.vacuum(keep=1) > 0 and lib.search("river bridge").count() > 0
    idf = lambda x: {r.term: (r.df, round(r.idf, 9)) for r in x.collect()}
    assert idf(again.idf()) == idf(retrieval.idf(again.table("chunks"), "text"))


def test_a_failing_model_leaves_an_unranked_search(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    lib.ingest("a", "A", segments(spark, ["The river rose over the bridge.", "The town watched it all night."]))

    @F.udf("double")
    def broken(query, text):
        raise ValueError("no model")

    found = lib.answer("river", rerank=lambda q, t: broken(q, t))
    assert found["degraded"] and found["results"][0]["confidence"] == "unranked"
    assert not lib.answer("river", rerank=lambda q, t: F.lit(3.0))["degraded"]


def test_no_write_lowers_a_pictures_state(spark, tmp_path):
    from cuelake.operators import mutation

    rng = random.Random(4)
    ddl = "video_id string, k int, status string, vector array<double>"
    rows = [("a", rng.randint(0, 5), rng.choice([None, "failed", "video-level", "ok", "odd"]), [rng.random()]) for _ in range(40)]
    frame = lambda x: spark.createDataFrame(x, ddl)
    tables = []
    for _ in range(3):
        rng.shuffle(rows)
        once = mutation.raised(frame(rows[:15]), frame(rows[10:]), ["video_id", "k"], "status")
        tables.append(sorted(map(str, mutation.raised(once, frame(rows[:20]), ["video_id", "k"], "status").collect())))
    assert tables[0] == tables[1] == tables[2] and len(tables[0]) == len({r[1] for r in rows})
    lib = Library(spark, str(tmp_path / "lib"))
    put = lambda status, x: lib.put_vectors(spark.createDataFrame([("a", 0, "visual", status, [x])], SCHEMAS["vectors"]))
    for status, x in (("video-level", 1.0), ("ok", 2.0), ("failed", 3.0), ("video-level", 4.0)):
        put(status, x)
    assert [(r.status, r.vector) for r in lib.table("vectors").collect()] == [("ok", [2.0])]
    media = spark.createDataFrame([("a",), ("b",)], "video_id string")
    known = spark.createDataFrame([("a", 1, None, None), ("a", 2, "video-level", False), ("b", 3, "video-level", True), ("c", 4, "video-level", None), ("a", 5, "ok", None), ("a", 6, "failed", None), ("c", 7, None, True)], "video_id string, k int, status string, gave_up boolean")
    assert {r.k for r in mutation.to_retry(known, media, "video_id", "status", "gave_up").collect()} == {1, 2, 7}


def test_quotes_are_around_what_answers(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    filler = "we walked along the quiet road and talked about many other small things until the evening came over all of it"
    said = [f"First {filler}.", f"Second {filler} with a zebra.", f"Third {filler} at last."]
    lib.ingest("a", "A", segments(spark, said))
    matched = lib.search("zebra").first()
    assert "zebra" in matched.text and "Third" not in matched.text and (matched.first, matched["last"]) == (0, 2)
    around = lambda word: lib.search("zebra", rerank=lambda q, t: F.when(t.contains(word), 5.0).otherwise(1.0)).first().text
    third = around("Third")
    assert "Third" in third and "First" not in third
