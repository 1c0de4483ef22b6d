"""A library of videos as tables in a folder: what an application calls.

Each table is a folder of numbered generations, each written whole. A table of videos is dealt to parts by a hash of the
video's id, and each part of a generation has versions of its own: what one video changes is written as its part's next
version alone. Which generation and versions count is said by manifests, one a commit, which name those of all tables: a
reader takes one manifest for all that it reads, and a change of several tables shows whole or not at all. A manifest is
made only if its number is free. A writer that comes second keeps what it wrote if nobody changed what it read or wrote,
else it starts over; no two writers ever get the same folder. ``vacuum`` removes what no late manifest names.

The lexical index (``operators.inverted``) is a list of deltas in the manifest and changes with the chunks: an ingest or a
delete writes its own postings, and a search reads the buckets of its words.
"""

from __future__ import annotations

import copy
import hashlib
import json
import logging
import os
import time
import uuid
import zlib
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import times
from .functions.texts import terms, word_count
from .operators import concepts, inverted, mutation, ranking, retrieval, search, selection, solver, tools
from .sources.segmenting import segment

SCHEMAS = {
    "videos": "id string, title string, status string, total_seconds bigint, error string, version bigint",
    "chunks": "id string, video_id string, sentence_idx bigint, start_sec bigint, end_sec bigint, start_timestamp string, end_timestamp string, text string, enriched_text string, section_topic string, questions array<string>, concepts array<string>",
    "vectors": "video_id string, sentence_idx bigint, kind string, status string, vector array<double>",
    "words": "video_id string, pos bigint, word string, start double, end double",
    "clips": "video_id string, first bigint, last bigint, beats bigint, gain double, dangling array<bigint>, start_sec double, end_sec double",
    "feedback": "clip_id string, verdict string, ts double",
    "usage": "tool_id string, prompt_tokens bigint, completion_tokens bigint, model string, ts double",
    "runs": "id string, tool_id string, inputs string, output string, created_at double",
    "jobs": "id string, kind string, video_id string, status string, error string, updated_at double",
}
#: The column with the video's id, in the tables that are dealt by it.
KEYED = {"videos": "id", "chunks": "video_id", "vectors": "video_id", "words": "video_id", "clips": "video_id"}
#: Parts of such a table, and how many of them are written one by one before the whole table is.
PARTS, FEW_PARTS = 256, 8
MOST_USAGE, MOST_RUNS, MOST_JOBS = 5000, 200, 200
#: Buckets of the index's terms.
BUCKETS = 16
#: Deltas of the index before they become one, and how often a change that others overtake starts over.
MOST_DELTAS, MOST_TRIES = 16, 50


def _part(video_id: str) -> int:
    return zlib.crc32(video_id.encode()) % PARTS


def _part_of(column: str) -> Column:
    """The same as ``_part``, of a column; null is the empty id."""
    return (F.crc32(F.coalesce(F.col(column), F.lit("")).cast("binary")) % PARTS).cast("int")


def _scene() -> Column:
    """Whether a chunk is a scene without speech."""
    return F.coalesce(F.col("text").startswith(search.SCENE), F.lit(False))


class Overtaken(Exception):
    """Others changed what this change read or wrote, again and again."""


class Snapshot:
    """All tables as one commit left them."""

    def __init__(self, library: Library, number: int, manifest: dict):
        self.library, self.spark, self.number, self.manifest = library, library.spark, number, manifest
        self.read: set[tuple] = set()

    def _paths(self, name: str, part: int | None) -> list[str]:
        entry = self.manifest["tables"].get(name)
        if entry is None:
            return []
        if name not in KEYED:
            return [f"{name}/g={entry['g']}"]
        return [f"{name}/g={entry['g']}/part={k}/v={v}" for k, v in sorted(entry["parts"].items(), key=lambda x: int(x[0])) if part is None or int(k) == part]

    def _rows(self, name: str, part: int | None) -> DataFrame:
        self.read.add((name, part))
        return self.library._read(name, self._paths(name, part))

    def table(self, name: str) -> DataFrame:
        """The table, empty if it never was written."""
        return self._rows(name, None)

    def of(self, name: str, video_id: str) -> DataFrame:
        """One video's rows; its part alone is read."""
        return self._rows(name, _part(video_id)).filter(F.col(KEYED[name]) == video_id)

    def of_videos(self, name: str, video_ids: list[str]) -> DataFrame:
        """Some videos' rows; their parts alone are read."""
        parts = {_part(v) for v in video_ids}
        self.read |= {(name, p) for p in parts}
        paths = [path for p in sorted(parts) for path in self._paths(name, p)]
        return self.library._read(name, paths).filter(F.col(KEYED[name]).isin(video_ids))

    def is_indexed(self, video_id: str) -> bool:
        return not (self.of("videos", video_id).isEmpty() and self.of("chunks", video_id).isEmpty())

    def idf(self, of: DataFrame | None = None, more: DataFrame | None = None, n_more: int = 0) -> DataFrame:
        """(term, df, idf) over all chunks' texts, from the index's vocabulary."""
        return self.library.index.idf(self.manifest["index"], of, more, n_more)


class Change(Snapshot):
    """A snapshot and what a change has written on top of it, which it sees itself."""

    def __init__(self, library: Library, number: int, manifest: dict):
        super().__init__(library, number, copy.deepcopy(manifest))
        self.before = manifest
        self.written: set[tuple] = set()
        self.deltas: list[str] = []  # the index's, added
        self.reindexed = False  # its deltas stand for all

    def write(self, name: str, rows: DataFrame) -> None:
        """The whole table anew."""
        lib = self.library
        path = lib._claimed(name, "g", (lib._generations(name) or [0])[-1])
        rows = rows.select(lib.columns(name))
        entry: dict = {"g": int(path.rpartition("=")[2])}
        if name in KEYED:  # large parts are several files
            rows.withColumn("part", _part_of(KEYED[name])).hint("rebalance", "part").withColumn("v", F.lit(0)).write.mode("overwrite").partitionBy("part", "v").parquet(f"{lib.folder}/{path}")
            entry["parts"] = {p.rpartition("=")[2]: 0 for p in lib._found(f"{path}/part=*")}
        else:
            rows.write.mode("overwrite").parquet(f"{lib.folder}/{path}")
        self.manifest["tables"][name] = entry
        self.written.add((name, None))
        if name == "chunks":
            self._index(self.table("chunks"), whole=True)

    def _write_part(self, name: str, part: int, rows: DataFrame) -> None:
        lib, tables = self.library, self.manifest["tables"]
        entry = tables.setdefault(name, {"g": 0, "parts": {}})
        path = lib._claimed(f"{name}/g={entry['g']}/part={part}", "v", max([entry["parts"].get(str(part), 0), *lib._versions(name, part, entry["g"]).get(part, [0])]))
        rows.select(lib.columns(name)).write.mode("overwrite").parquet(f"{lib.folder}/{path}")
        entry["parts"][str(part)] = int(path.rpartition("=")[2])
        self.written.add((name, part))

    def put(self, name: str, video_id: str, rows: DataFrame | None = None) -> None:
        """Replaces one video's rows (None: by nothing); its part alone is written."""
        part = _part(video_id)
        mine = F.col(KEYED[name]).eqNullSafe(video_id)
        before = self._rows(name, part)
        others = before.filter(~mine)
        self._write_part(name, part, others if rows is None else others.unionByName(rows.select(others.columns)))
        if name == "chunks":
            self._index(before.filter(mine), sign=-1)
            if rows is not None:
                self._index(self._rows(name, part).filter(mine))

    def _index(self, chunks: DataFrame, sign: int = 1, whole: bool = False) -> None:
        if not whole and chunks.isEmpty():
            return
        index, delta = self.library.index, uuid.uuid4().hex
        index.append(delta, chunks.select("video_id", "sentence_idx", _scene().alias("scene"), "text"), "text", sign)
        self.reindexed |= whole
        self.deltas = [delta] if whole else [*self.deltas, delta]
        self.manifest["index"] = [delta] if whole else [*self.manifest["index"], delta]
        if len(self.manifest["index"]) > MOST_DELTAS:
            index.compact(self.manifest["index"], joined := uuid.uuid4().hex)
            self.manifest["index"] = self.deltas = [joined]
            self.reindexed = True

    def put_video(self, row: DataFrame) -> None:
        video_id = row.first()["id"]
        version = (self.of("videos", video_id).agg(F.max("version")).first()[0] or 0) + 1
        self.put("videos", video_id, row.withColumn("version", F.lit(version).cast("bigint")))

    def over(self, latest: dict) -> dict | None:
        """The latest manifest with this change, if nobody has changed what it read or wrote."""

        def entry(manifest: dict, name: str, part: int | None):
            found = manifest["tables"].get(name)
            return found if part is None or found is None else (found["g"], found["parts"].get(str(part)))

        if any(entry(latest, *at) != entry(self.before, *at) for at in self.read | self.written):
            return None
        if self.reindexed and latest["index"] != self.before["index"]:
            return None
        out = copy.deepcopy(latest)
        for name, part in self.written:
            mine = self.manifest["tables"][name]
            if part is None:
                out["tables"][name] = mine
            else:
                theirs = out["tables"].setdefault(name, {"g": mine["g"], "parts": {}})
                if theirs["g"] != mine["g"]:
                    return None
                theirs["parts"][str(part)] = mine["parts"][str(part)]
        out["index"] = self.deltas if self.reindexed else [*latest["index"], *self.deltas]
        return out


class Library:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.index = inverted.Index(spark, f"{self.folder}/_index", "video_id string, sentence_idx bigint, scene boolean", BUCKETS)

    def columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], SCHEMAS[name]).columns

    def _at(self, path: str):
        """The path in the folder and its file system."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _found(self, pattern: str) -> list[str]:
        """What lies in the folder and looks so, by its path in it."""
        path, fs = self._at(pattern)
        depth = pattern.count("/") + 1
        return ["/".join(s.getPath().toString().split("/")[-depth:]) for s in fs.globStatus(path) or []]

    def _remove(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)

    def _make(self, path: str, text: str = "") -> bool:
        """Makes a file with its whole content, unless there is one; False then. Of several at once one alone succeeds.

        By a hard link on a local disk; elsewhere by a rename that never replaces a file, which HDFS has.
        """
        aside, fs = self._at(f"_aside/{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(text.encode())
        out.close()
        to, _ = self._at(path)
        fs.mkdirs(to.getParent())
        try:
            if fs.getScheme() == "file":
                os.link(urlparse(aside.toString()).path, urlparse(to.toString()).path)
                return True
            return fs.rename(aside, to)
        except FileExistsError:
            return False
        finally:
            fs.delete(aside, False)

    def _claimed(self, below: str, kind: str, last: int) -> str:
        """A folder name of the next number that nobody else writes."""
        taken = [int(p.rpartition("=")[2].split(".")[0]) for p in self._found(f"_claims/{below}/{kind}=*.taken")]
        number = max([last, *taken]) + 1
        while not self._make(f"_claims/{below}/{kind}={number}.taken"):
            number += 1
        return f"{below}/{kind}={number}"

    def _generations(self, name: str) -> list[int]:
        return sorted(int(p.split("/")[1][2:]) for p in self._found(f"{name}/g=*/_SUCCESS"))

    def _versions(self, name: str, part: int | str = "*", g: int | None = None) -> dict[int, list[int]]:
        """The versions that were written to their end, by part, in a generation (the last; 0 if none was written whole)."""
        g = (self._generations(name) or [0])[-1] if g is None else g
        done = {p.rpartition("/")[0] for p in self._found(f"{name}/g={g}/part={part}/v=*/_SUCCESS")}
        out: dict[int, list[int]] = {}
        for p in self._found(f"{name}/g={g}/part={part}/v=*"):
            if p in done or p.endswith("/v=0"):  # the generation's own mark stands for its versions 0
                k, v = (int(x.partition("=")[2]) for x in p.split("/")[2:])
                out.setdefault(k, []).append(v)
        return {k: sorted(v) for k, v in out.items()}

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.folder}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def _numbers(self) -> list[int]:
        return sorted(int(p.rpartition("/")[2].split(".")[0]) for p in self._found("_commits/*.json"))

    def _manifest(self, number: int) -> dict:
        where, fs = self._at(f"_commits/{number}.json")
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _latest(self) -> tuple[int, dict]:
        """The last commit; number 0 is a library before its first."""
        numbers = self._numbers()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (0, {"tables": {}, "index": []})

    def snapshot(self) -> Snapshot:
        """All tables as they are now; they stay so for this snapshot's readers."""
        return Snapshot(self, *self._latest())

    def commit(self, work: Callable[[Change], object]):
        """What ``work`` writes through a change, as one commit. It is run again, over what others have made of the tables, if they changed what it read or wrote."""
        for _ in range(MOST_TRIES):
            number, manifest = self._latest()
            change = Change(self, number, manifest)
            out = work(change)
            if not change.written or self._publish(change):
                return out
        raise Overtaken(f"{MOST_TRIES} times")

    def _publish(self, change: Change) -> bool:
        number, manifest = change.number, change.manifest
        while not self._make(f"_commits/{number + 1}.json", json.dumps(manifest)):
            number, latest = self._latest()
            manifest = change.over(latest)
            if manifest is None:
                return False
        return True

    def table(self, name: str) -> DataFrame:
        """The table as last committed, empty if it never was."""
        return self.snapshot().table(name)

    def of(self, name: str, video_id: str) -> DataFrame:
        """One video's rows; its part alone is read."""
        return self.snapshot().of(name, video_id)

    def write(self, name: str, rows: DataFrame) -> None:
        """The whole table anew."""
        self.commit(lambda c: c.write(name, rows))

    def put(self, name: str, video_id: str, rows: DataFrame | None = None) -> None:
        """Replaces one video's rows (None: by nothing); its part alone is written."""
        self.commit(lambda c: c.put(name, video_id, rows))

    def vacuum(self, keep: int = 2) -> int:
        """Removes what none of the last ``keep`` commits names and a later one has replaced, and tells how many folders went; a reader that began before those commits loses its files."""
        numbers = self._numbers()
        last = [self._manifest(n) for n in numbers[-keep:]]
        if not last:
            return 0
        gone = []
        for name in SCHEMAS:
            entries = [m["tables"][name] for m in last if name in m["tables"]]
            if not entries:
                continue
            oldest = min(e["g"] for e in entries)
            gone += [p for p in self._found(f"{name}/g=*") if int(p.rpartition("=")[2]) < oldest]
            for g in {e["g"] for e in entries} if name in KEYED else ():
                first: dict[int, int] = {}
                for e in entries:
                    for k, v in e["parts"].items() if e["g"] == g else ():
                        first[int(k)] = min(v, first.get(int(k), v))
                gone += [f"{name}/g={g}/part={k}/v={v}" for k, vs in self._versions(name, g=g).items() for v in vs if v < first.get(k, 0)]
        named = {d for m in last for d in m["index"]}
        # of deltas that no manifest of these names, only those of earlier ones are known to be nobody's work in progress
        old = {d for n in numbers[:-keep] for d in self._manifest(n)["index"]} - named
        gone += [f"_index/{what}/d={d}" for d in sorted(old) for what in ("postings", "vocabulary", "sizes")]
        for path in gone:
            self._remove(path)
        for n in numbers[:-keep]:
            self._remove(f"_commits/{n}.json")
        return len(gone)

    def is_indexed(self, video_id: str) -> bool:
        return self.snapshot().is_indexed(video_id)

    def ingest(self, video_id: str, title: str, segments: DataFrame) -> None:
        """Segments (text, start, duration) as sentences with concepts; an indexed video is left as it is. What other videos say is known from the index's vocabulary."""
        s = segment(segments.withColumn("video_id", F.lit(video_id)))

        def work(change: Change) -> None:
            if change.is_indexed(video_id):
                return
            said = s.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
            idf = change.idf(said, said, s.count())
            c = concepts.concepts(s, ["video_id", "sentence_idx"], "text", idf)
            new = s.join(c, ["video_id", "sentence_idx"]).select(F.format_string("chunk-%s-%d", "video_id", F.col("sentence_idx") + 1).alias("id"), "*", times.clock(F.col("start_sec")).alias("start_timestamp"), times.clock(F.col("end_sec")).alias("end_timestamp"), concepts.enriched(F.col("text"), F.col("section_topic")).alias("enriched_text"))
            change.put("chunks", video_id, new)
            ends = change.of("chunks", video_id).agg(F.coalesce(F.max("end_sec"), F.lit(0)).alias("total_seconds"))
            change.put_video(ends.select(F.lit(video_id).alias("id"), F.lit(title).alias("title"), F.lit("fully_indexed").alias("status"), "total_seconds", F.lit(None).cast("string").alias("error")))

        self.commit(work)

    def _failed(self, video_id: str, why: str) -> DataFrame:
        return self.spark.createDataFrame([(video_id, None, "failed", 0, why)], "id string, title string, status string, total_seconds bigint, error string")

    def fail(self, video_id: str, why: str) -> None:
        self.commit(lambda c: c.put_video(self._failed(video_id, why)))

    def delete(self, video_id: str) -> None:
        """The video, its chunks, their postings and their vectors of all kinds; its words and clips stay."""

        def work(change: Change) -> None:
            for name in ("chunks", "vectors", "videos"):
                change.put(name, video_id)

        self.commit(work)

    def videos(self) -> DataFrame:
        """Videos with their chunk counts."""
        s = self.snapshot()
        n = s.table("chunks").groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("chunk_count"))
        return s.table("videos").join(n, "id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))

    def statistics(self) -> DataFrame:
        now, s = self.snapshot(), F.col("status")
        v = now.table("videos").agg(F.count_if(s == "fully_indexed").alias("indexed"), F.count_if(s == "indexing").alias("indexing"), F.count_if(s == "failed").alias("failed"), times.hours_minutes(F.coalesce(F.sum(F.when(s == "fully_indexed", F.col("total_seconds"))), F.lit(0))).alias("duration"))
        return v.join(F.broadcast(now.table("chunks").agg(F.count("*").alias("chunks"))))

    def suggested_queries(self) -> DataFrame:
        s = self.snapshot()
        return concepts.suggested_queries(s.table("chunks"), s.idf(), ["people", "thing", "really", "something"])

    def put_vectors(self, rows: DataFrame) -> None:
        """Vectors of sentences (video_id, sentence_idx, kind, status, vector) in place of those of the same sentence and kind; kind is dense or visual, status of a visual one ok, video-level or failed. A visual one never takes the place of a better one."""
        keys = ["video_id", "sentence_idx", "kind"]
        touched = [r[0] for r in rows.select(_part_of("video_id")).distinct().collect()]  # PARTS at most

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            seen = F.col("kind").eqNullSafe("visual")
            return mutation.replace(old.filter(~seen), new.filter(~seen), keys).unionByName(mutation.raised(old.filter(seen), new.filter(seen), keys, "status"))

        def work(change: Change) -> None:
            if len(touched) > FEW_PARTS:
                change.write("vectors", merged(change.table("vectors"), rows))
                return
            for part in touched:
                change._write_part("vectors", part, merged(change._rows("vectors", part), rows.filter(_part_of("video_id") == part)))

        self.commit(work)

    def reindex(self, embed: Callable[[DataFrame], DataFrame]) -> None:
        """All dense vectors and postings anew, with the chunks in one commit: ``embed`` makes (video_id, sentence_idx, vector) of all chunks; concepts follow the whole library's frequencies."""

        def work(change: Change) -> None:
            c = change.table("chunks")
            s = c.select("video_id", "sentence_idx", "text")
            found = concepts.concepts(s, ["video_id", "sentence_idx"], "text", change.idf())
            old = [x for x in c.columns if x in ("video_id", "sentence_idx") or x not in found.columns and x != "enriched_text"]
            change.write("chunks", c.select(old).join(found, ["video_id", "sentence_idx"]).withColumn("enriched_text", concepts.enriched(F.col("text"), F.col("section_topic"))))
            new = embed(change.table("chunks")).select("video_id", "sentence_idx", F.lit("dense").alias("kind"), F.lit("ok").alias("status"), "vector")
            change.write("vectors", change.table("vectors").filter("kind <> 'dense'").unionByName(new))

        self.commit(work)

    def search(self, query: str, k: int = 5, mode: str = "spoken", embed: Callable[[str], list[float] | None] | None = None, rerank: Callable[[Column, Column], Column] | None = None, least: float | None = None) -> DataFrame:
        """(kind, place, video_id, first, last, score, start_sec, end_sec, text, confidence, reason), results by place, or near misses where nothing is good enough.

        The pool is the best by dense and lexical rank; ``embed`` makes a query's vector (None: TF-IDF stands in for it), and ``least`` is a floor
        of the pool. ``rerank`` gives a column of logits for the query and a text; without it, or if it fails, results are unranked. In visual mode
        sentences are ranked by their pictures alone, those with a picture of the whole video last. A blank query, an empty
        library, or one without pictures in visual mode gives no row. Long texts are shrunk to the part around the sentence that answers best.
        """
        now, visual = self.snapshot(), mode == "visual"
        c, vectors = now.table("chunks"), now.table("vectors")
        keys = ["video_id", "sentence_idx"]
        empty = self.spark.createDataFrame([], "kind string, place int, video_id string, first bigint, last bigint, score double, start_sec double, end_sec double, text string, confidence string, reason string")
        mine = vectors.filter(F.col("kind") == ("visual" if visual else "dense"))
        if not (query or "").strip() or c.isEmpty() or visual and mine.filter("status = 'ok'").isEmpty():
            return empty
        asked = self.spark.createDataFrame([(0, query)], "q int, text string")
        vector = embed(query) if embed else None
        if vector is not None and not mine.isEmpty():
            q = self.spark.createDataFrame([(0, [float(x) for x in vector])], "q int, v array<double>")
            spoken = c if visual else c.filter(~F.coalesce(F.col("text"), F.lit("")).startswith(search.SCENE))
            score = retrieval.dense(q, "q", "v", mine.join(spoken.select(*keys), keys, "left_semi"), [*keys, "status"], "vector")
            dense = score.withColumn("score", F.when(F.col("status") == "video-level", -1.0).otherwise(F.col("score"))).drop("status") if visual else score.drop("status")
        else:
            found = self.index.tfidf(now.manifest["index"], c.withColumn("scene", _scene()), "text", asked, "q", "text")
            dense = (found if visual else found.filter("NOT scene")).drop("scene")
        lexical = None if visual else self.index.bm25(now.manifest["index"], asked, "q", "text").filter("score > 0 AND NOT scene").drop("scene")
        pool = search.fused(lexical, dense, "q", keys)
        if least is not None:
            pool = pool.filter(F.col("score") >= least)
        best = pool.collect()  # POOL rows at most: what follows reads their videos alone
        if not best:
            return empty
        near = now.of_videos("chunks", sorted({r["video_id"] for r in best}))
        found = search.merged(self.spark.createDataFrame(best, pool.schema), near, "q")
        ranked = rerank is not None and not visual
        if ranked:
            try:
                rows = found.withColumn("score", F.round(1 / (1 + F.exp(-rerank(F.lit(query), F.col("text")))), 4)).collect()
            except Exception as e:  # whatever the model raises, the search goes on without it
                logging.getLogger(__name__).warning("no relevance model: %s", e)
                ranked = False
        if not ranked:
            rows = found.collect()
        found = self.spark.createDataFrame(rows, found.schema)
        limits = (search.VISUAL_RELEVANT, search.VISUAL_STRONG, None) if visual else (search.RELEVANT, search.STRONG, ranking.DISPLAY_FLOOR)
        chosen = search.decide(found, "q", k, visual or ranked, *limits)
        texts = chosen.join(found.select("video_id", "first", "last", "text"), ["video_id", "first"])
        about = near.select("video_id", F.col("sentence_idx").alias("first"), search.reason(F.col("section_topic"), F.col("concepts"), visual).alias("reason"))
        full = texts.join(about, ["video_id", "first"], "left")
        if visual:
            return full.select(empty.columns).orderBy("kind", "place")
        # a long text is shrunk around its sentence that answers best, by the model, or else around the best that was matched
        weights = self.spark.createDataFrame([(r["video_id"], r["sentence_idx"], r["score"]) for r in best], "video_id string, sentence_idx bigint, weight double")
        if ranked:
            inside = near.join(full.select("video_id", F.explode(F.sequence("first", "last")).alias("sentence_idx")).distinct(), ["video_id", "sentence_idx"], "left_semi")
            answers = inside.select("video_id", "sentence_idx", rerank(F.lit(query), F.col("text")).cast("double").alias("weight"))
            try:
                weights = self.spark.createDataFrame(answers.collect(), weights.schema)
            except Exception as e:
                logging.getLogger(__name__).warning("quotes around matched sentences: %s", e)
        shown = self._focused(full, near, weights)
        return shown.select(empty.columns).orderBy("kind", "place")

    def _focused(self, found: DataFrame, chunks: DataFrame, weights: DataFrame) -> DataFrame:
        """Long texts as the sentences around that of the largest weight (video_id, sentence_idx, weight); times stay those of the whole."""
        name = F.concat_ws("|", "kind", "place")
        each = found.select(name.alias("n"), "video_id", F.explode(F.sequence("first", "last")).alias("sentence_idx")).join(chunks.select("video_id", "sentence_idx", "text", "start_sec", "end_sec"), ["video_id", "sentence_idx"])
        lines = each.join(weights, ["video_id", "sentence_idx"], "left").select(F.col("n").alias("video_id"), "sentence_idx", word_count("text").cast("bigint").alias("n_words"), "start_sec", "end_sec", "weight")
        part = selection.focus_quotes(lines).select(F.col("video_id").alias("n"), F.col("first").alias("a"), F.col("last").alias("b"))
        kept = each.join(part, "n").filter("sentence_idx BETWEEN a AND b")
        short = kept.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_idx", "text"))), lambda x: x["text"]), " ").alias("short"))
        return found.withColumn("n", name).join(short, "n", "left").withColumn("text", F.coalesce("short", "text")).drop("n", "short")

    def answer(self, query: str, k: int = 5, mode: str = "spoken", **plugged) -> dict:
        """A search's rows with what an application shows around them; at most k + 3 rows are fetched."""
        began = time.perf_counter()
        rows = [r.asDict() for r in self.search(query, k, mode, **plugged).collect()]
        found = {x: [r for r in rows if r["kind"] == x] for x in ("result", "near_miss")}
        degraded = mode != "visual" and any(r["confidence"] == "unranked" for r in rows)
        no_pictures = mode == "visual" and not rows and self.table("vectors").filter("kind = 'visual' AND status = 'ok'").isEmpty()
        message = "No relevance model is there: results are unranked." if degraded else "This library has no pictures of moments yet." if no_pictures else None
        return {"query": query, "results": found["result"], "near_misses": found["near_miss"], "execution_time_ms": round((time.perf_counter() - began) * 1000, 2), "total_chunks_scanned": self.table("chunks").count(), "library_video_count": self.table("videos").count(), "search_mode": mode, "degraded": degraded, "message": message}

    def _spent(self, tool_id: str, spent: dict, now: float) -> None:
        row = (tool_id, int(spent.get("prompt_tokens") or 0), int(spent.get("completion_tokens") or 0), spent.get("model"), now)
        self.record_usage(self.spark.createDataFrame([row], SCHEMAS["usage"]))

    def run_tool(self, known: dict[str, tools.Tool], tool_id: str, inputs: dict, now: float, profile: str = "", banned: tuple[str, ...] = ()) -> dict:
        """A tool's output without banned phrases, recorded with its tokens; refused for too long an input or too many runs in the last hour."""
        if tool_id not in known:
            raise tools.ToolError(f"no tool {tool_id}")
        tools.allowed(known[tool_id].words(inputs), self.usage(now).first()["hour"])
        output, spent = known[tool_id].run(inputs, profile)
        output, found = tools.without(output, list(banned))
        output = output | {"guardrail_notes": {"banned_words_removed": found}} if found else output
        self._spent(tool_id, spent, now)
        run_id = f"run-{hashlib.sha1(f'{tool_id}|{now}|{json.dumps(inputs, sort_keys=True)}'.encode()).hexdigest()[:12]}"
        self.record("runs", self.spark.createDataFrame([(run_id, tool_id, json.dumps(inputs), json.dumps(output), now)], SCHEMAS["runs"]), "created_at", MOST_RUNS)
        return output | {"run_id": run_id, "tool_id": tool_id}

    def regenerate(self, known: dict[str, tools.Tool], run_id: str, block: str, now: float, profile: str = "", banned: tuple[str, ...] = ()) -> dict:
        """A recorded run's output with one block made anew."""
        run = self.table("runs").filter(F.col("id") == run_id).first()
        if run is None or run["tool_id"] not in known:
            raise tools.ToolError(f"no run {run_id} of a known tool")
        tools.allowed(0, self.usage(now).first()["hour"])
        new, spent = known[run["tool_id"]].block(json.loads(run["inputs"]), block, profile)
        output = json.loads(run["output"]) | {block: tools.without(new, list(banned))[0]}
        self._spent(run["tool_id"], spent, now)
        self.commit(lambda c: c.write("runs", mutation.update(c.table("runs"), F.col("id") == run_id, output=F.lit(json.dumps(output)))))
        return output | {"run_id": run_id, "tool_id": run["tool_id"]}

    def job(self, job_id: str) -> DataFrame:
        return self.table("jobs").filter(F.col("id") == job_id)

    def jobs(self, video_id: str | None = None) -> DataFrame:
        """Jobs, of one video or all, the latest first."""
        rows = self.table("jobs")
        return (rows if video_id is None else rows.filter(F.col("video_id") == video_id)).orderBy(F.desc("updated_at"), "id")

    def analyse(self, video_id: str) -> None:
        """Replaces the video's clips by what the solver finds, on the cleanest pauses near by if the video has timed words."""

        def work(change: Change) -> None:
            s = change.of("chunks", video_id).select("video_id", "sentence_idx", "text", "start_sec", "end_sec")
            change.put("clips", video_id, selection.on_pauses(solver.solve(s, selection.heuristic_beats(s)), s, change.of("words", video_id)))

        self.commit(work)

    def record(self, name: str, rows: DataFrame, order: str, most: int) -> None:
        """Appends to a log and keeps its newest rows, whoever else appends."""
        self.commit(lambda c: c.write(name, mutation.retain_newest(c.table(name), rows.select(self.columns(name)), [order], most)))

    def record_usage(self, rows: DataFrame) -> None:
        self.record("usage", rows, "ts", MOST_USAGE)

    def usage(self, now: float) -> DataFrame:
        since = lambda s: F.col("ts") >= now - s
        month = lambda c: F.coalesce(F.sum(F.when(since(30 * 86_400), F.col(c))), F.lit(0))
        return self.table("usage").agg(F.count_if(since(3600)).alias("hour"), F.count_if(since(86_400)).alias("day"), F.count_if(since(30 * 86_400)).alias("month"), month("prompt_tokens").alias("prompt_tokens"), month("completion_tokens").alias("completion_tokens"), F.max_by("model", "ts").alias("last_model"))

    def recover(self) -> None:
        """Jobs that were running have failed, and so have their videos, if these aren't indexed: all in one commit."""

        def work(change: Change) -> None:
            jobs = change.table("jobs")
            cut = jobs.filter(F.col("status").isin("running", "queued") & F.col("video_id").isNotNull()).select(F.col("video_id").alias("id")).distinct()
            lost = [r["id"] for r in cut.join(change.table("videos"), "id", "left_anti").limit(MOST_JOBS).collect()]
            change.write("jobs", mutation.fail_interrupted(jobs.drop("error"), "interrupted by a restart").select(jobs.columns))
            for video_id in lost:
                change.put_video(self._failed(video_id, "interrupted by a restart"))

        self.commit(work)
