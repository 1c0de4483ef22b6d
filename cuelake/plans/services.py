"""What stands around the engine: model answers, digests, captions, settings of a clip's cut."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import captions, contract, selection, sequences
from ..sources.library import SENTENCES_SQL, sentences, table
from .registry import query


@query("m14_caption_layout", """, shrunk AS (SELECT p_partkey, letters, 66 AS font, 0 AS k FROM line UNION ALL SELECT p_partkey, letters, greatest(14, CAST(floor(font * 0.9) AS INTEGER)), k + 1 FROM shrunk WHERE letters * font > 1080 * 0.92 AND font > 14 AND k < 8)
SELECT p_partkey, font, CAST(floor(letters * font) AS INTEGER) AS text_width, greatest(0, CAST(floor((1080 - CAST(floor(letters * font) AS INTEGER)) / 2.0) AS INTEGER)) AS x, 886 AS y FROM shrunk QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k DESC) = 1""", "line AS (SELECT p_partkey, length(p_name || ' ' || p_type) * 0.5 AS letters FROM part)")
def caption_layout(spark, sf_dir):
    """Where a part's name and kind stand as a large caption of a picture of 1080 by 1080."""
    x = captions.layout(F.concat_ws(" ", "p_name", "p_type"), 1080, 1080, "large", margins=(0.12, 0.18))
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("l")).select("p_partkey", "l.*").withColumn("y", F.lit(int(1080 * 0.82) + 1))


@query("m16_snap_info", """SELECT o_orderkey, round(b - a, 4) AS end_moved_by, round(d - c, 4) AS start_moved_by, round(d - c, 4) <> 0 OR round(b - a, 4) <> 0 AS snapped, CASE WHEN o_orderkey % 3 = 0 THEN 'no words' ELSE 'word' END AS reason
FROM (SELECT o_orderkey, o_totalprice AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE floor(o_totalprice) END AS b, o_totalprice / 2 AS c, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2 ELSE floor(o_totalprice / 2) END AS d FROM orders)""")
def snap_info(spark, sf_dir):
    """How far bounds moved to whole seconds; every third one has no words to snap to."""
    none = F.col("o_orderkey") % 3 == 0
    e, s = F.col("o_totalprice"), F.col("o_totalprice") / 2
    to = lambda c: F.when(none, c).otherwise(F.floor(c).cast("double"))
    info = selection.snap_info(s, e, to(s), to(e), F.when(none, "no words").otherwise("word"))
    return table(spark, sf_dir, "orders").select("o_orderkey", info.alias("i")).select("o_orderkey", "i.*")


@query("f36_signal_labels", """SELECT n_name, CASE n_regionkey WHEN 0 THEN 'hook' WHEN 1 THEN 'clean boundaries' WHEN 2 THEN 'taste match' ELSE n_name END AS label FROM nation""")
def signal_labels(spark, sf_dir):
    """Labels of signals, and of names that are none."""
    r = F.col("n_regionkey")
    name = F.when(r == 0, "hook_strength").when(r == 1, "boundary_cleanliness").when(r == 2, "taste_match").otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_name", contract.signal_label(name).alias("label"))


@query("p11_chapters", """SELECT c.video_id, c.sentence_idx, coalesce(c.title, '') AS title, s.start_sec FROM (SELECT video_id, sentence_idx * 2 AS sentence_idx, CASE WHEN sentence_idx % 2 = 0 THEN role END AS title FROM sent) c JOIN sent s ON c.video_id = s.video_id AND c.sentence_idx = s.sentence_idx""", SENTENCES_SQL)
def chapters(spark, sf_dir):
    """Chapters at twice each turn's place: those beyond the end go, and null titles become empty."""
    s = sentences(spark, sf_dir)
    i = F.col("sentence_idx")
    return contract.chapters(s.select("video_id", (i * 2).alias("sentence_idx"), F.when(i % 2 == 0, F.col("role")).alias("title")), s)


@query("f31_digest", """SELECT video_id, segment, CASE WHEN segment = 0 THEN '' WHEN segment <= 4 THEN list_aggregate(list_transform(range(0, segment), lambda k: line[k + 1]), 'string_agg', chr(10)) ELSE list_aggregate(list_concat(list_transform(range(0, segment - 2, per), lambda k: '[' || k || '-' || least(k + per, segment - 2) - 1 || '] ' || least(per, segment - 2 - k) || ' earlier sections, opening: ' || roles[k + 1]), list_transform(range(segment - 2, segment), lambda k: line[k + 1])), 'string_agg', chr(10)) END AS digest
FROM (SELECT video_id, unnest(range(0, len(roles))) AS segment, greatest(1, CAST(ceil((unnest(range(0, len(roles))) - 2) / 2.0) AS BIGINT)) AS per, roles, list_transform(range(0, len(roles)), lambda k: '[' || k || '-' || k || '] ' || roles[k + 1]) AS line FROM (SELECT video_id, list(role ORDER BY sentence_idx) AS roles FROM sent GROUP BY 1))""", SENTENCES_SQL)
def digest(spark, sf_dir):
    """For each turn what came before it: the last two turns by their role, older ones pressed into two lines."""
    i = F.col("sentence_idx")
    segments = sentences(spark, sf_dir).select("video_id", i.alias("segment"), i.alias("first"), i.alias("last"), F.col("role").alias("summary"))
    return contract.digest(segments, lines=4, buckets=2)


def _provider(system: str, user: str) -> tuple[str, int, int]:
    """Stands in for a model: a beat on the first line; too long from 30 lines on, no JSON at every fifth number."""
    lines = user.split("\n")
    if len(lines) > 30:
        raise ValueError("context_length_exceeded")
    at = int(lines[0][1 : lines[0].index("]")])
    if at % 5 == 4 and "previous response" not in user:
        return "not json", len(lines), 1
    return json.dumps({"beats": [{"type": "hook", "start": at, "end": at, "title": "t"}]}), len(lines), 1


@query("u08_window_beats")
def window_beats(spark, sf_dir):
    """Beats that a stand-in model finds in windows of 40 turns; longer requests are halved."""
    s = sentences(spark, sf_dir)
    windows = sequences.count_windows(s, "video_id", "sentence_idx", 40, 10)
    return contract.window_beats(s, windows, _provider, "")[0]


@query("m11_hook_ablation", """SELECT round(quantile_cont(n_chars, 0.05) FILTER (quality = 0), 6) AS floor, round(quantile_cont(n_chars, 0.95) FILTER (quality = 1), 6) AS ceiling, round(median(least(1.0, n_chars / 2000.0)) FILTER (quality = 1) - median(least(1.0, n_chars / 2000.0)) FILTER (quality = 0), 6) AS delta FROM labels JOIN documents USING (doc_id)""")
def hook_ablation(spark, sf_dir):
    """The floor and the ceiling that a score's classes suggest, and what the score tells apart by itself."""
    from ..operators.metrics import suggested_bounds

    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return suggested_bounds(rows, F.col("quality") == 1, F.col("n_chars").cast("double"), F.least(F.lit(1.0), F.col("n_chars") / 2000))

