"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling; later copies of repeated runs go.

Each document is its sequence of lines with words; a line's ID is a hash of its words. Prefix doubling ranks the suffixes:
after round k two suffixes have the same rank if and only if their first 2^k lines agree, and ranks sort as those lines
do (range partitions, sorted, numbered in order). The suffixes that share their first n lines are one interval of the
suffix array, the longest-common-prefix interval of depth n; for 2^k <= n < 2^(k+1) it is the set of suffixes with one
pair of ranks, of the suffix and of the one n - 2^k lines on.

A run of lines of MIN_WORDS words or more that occurs earlier (by document id, then place) is deleted. Such a run is the
union of its shortest stretches that hold MIN_WORDS words, counted forwards from a line or backwards from one, and each
of these repeats as well; so the intervals of these stretches' depths, at most MIN_WORDS lines, reveal every maximal
repeated run, however long, and doubling ends after log2(MIN_WORDS) rounds. In each interval the first suffix stays and the others' stretches are deleted.

Only lines that occur twice or more, in stretches of neighbours that hold MIN_WORDS words, enter the suffix array: no
other suffix can be part of a repeated run. No step gathers the members of an interval: counts and minima are combined
before the shuffle and joins may be split.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut
from .text import fresh, per_text, table

#: Repeated runs of at least so many words are deleted: passages of over 50 words.
MIN_WORDS = 51

_DOC = ("d", "h")


def lines(text: str) -> list[tuple[int, int, int]]:
    """(place among all lines, ID, words) of each line with a word; lines end at "\\n" and words at ASCII white space, the ID hashes the words joined by single spaces."""
    out = []
    for at, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        if words := line.split():
            value = xxhash.xxh64_intdigest(b" ".join(words))
            out.append((at, value - (1 << 64) if value >> 63 else value, len(words)))
    return out


def _sequences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(d, h, i, id, words): every line with a word; a document is its id (null as the smallest number) and a hash of its text."""

    def prepare():
        def one(x: str) -> tuple:
            found = lines(x)
            return [v for _, v, _ in found], [n for *_, n in found]

        return one

    slim = docs.select(*_document(key, text), F.col(text).alias("_text"))
    found = slim.select(*_DOC, per_text(prepare, "ids array<bigint>, words array<bigint>")(F.col("_text")).alias("s"))
    return found.select(*_DOC, F.posexplode(F.arrays_zip("s.ids", "s.words")).alias("i", "x")).select(*_DOC, "i", F.col("x.ids").alias("id"), F.col("x.words").alias("words"))


def _document(key: str, text: str) -> tuple:
    return F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("h")


def _stretches(active: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """The suffixes (d, h, seg, i, id) of runs of repeated lines with enough words, and the stretches (d, h, i, n) of these runs that hold min_words words and are shortest from their first or last line."""
    place = W.partitionBy(*_DOC).orderBy("i")
    run = W.partitionBy(*_DOC, "seg")
    ordered = run.orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    segs = active.dropDuplicates([*_DOC, "i"]).withColumn("seg", F.col("i") - F.row_number().over(place))
    sized = segs.withColumn("total", F.sum("words").over(run)).filter(F.col("total") >= min_words).withColumn("end", F.sum("words").over(ordered)).withColumn("start", F.col("end") - F.col("words"))
    counted = sized.withColumn("ahead", F.count("*").over(run.orderBy("start").rangeBetween(0, min_words - 1))).withColumn("back", F.count("*").over(run.orderBy("end").rangeBetween(1 - min_words, 0)))
    kept = cut(counted.select(*_DOC, "seg", "i", "id", F.when(F.col("total") - F.col("start") >= min_words, F.col("ahead")).alias("ahead"), F.when(F.col("end") >= min_words, F.col("back")).alias("back")))
    forward = kept.filter("ahead IS NOT NULL").select(*_DOC, "i", F.col("ahead").alias("n"))
    backward = kept.filter("back IS NOT NULL").select(*_DOC, (F.col("i") - F.col("back") + 1).cast("int").alias("i"), F.col("back").alias("n"))
    return kept.select(*_DOC, "seg", "i", "id"), forward.unionByName(backward).distinct()


def _doubled(ranks: DataFrame, step: int) -> DataFrame:
    """Ranks by twice as many lines: of the pairs (rank, rank ``step`` lines on) that occur twice or more, by their order. A suffix without such a pair repeats nothing of this depth and leaves."""
    pairs = ranks.withColumn("second", F.lead("rank", step).over(W.partitionBy(*_DOC, "seg").orderBy("i"))).withColumn("there", F.lead("i", step).over(W.partitionBy(*_DOC, "seg").orderBy("i")))
    pairs = pairs.filter(F.col("there") == F.col("i") + step).select(*_DOC, "seg", "i", "rank", "second")
    names = pairs.groupBy("rank", "second").agg(F.count("*").alias("n")).filter("n > 1").select("rank", "second")
    numbered = cut(names.repartitionByRange("rank", "second").sortWithinPartitions("rank", "second").withColumn("next", F.monotonically_increasing_id()))
    return cut(pairs.join(numbered, ["rank", "second"]).select(*_DOC, "seg", "i", F.col("next").alias("rank")))


def later_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(d, h, i, n): stretches of n lines with a word, from the i-th, that occur earlier."""
    all_lines = cut(_sequences(docs, key, text))
    # written first, so that the join reads two plain shuffles and a very common line's rows can be split over tasks
    repeated = cut(all_lines.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    suffixes, stretches = _stretches(all_lines.join(repeated, "id").select(*_DOC, "i", "id", "words"), min_words)
    stretches = cut(stretches.withColumn("k", F.floor(F.log2("n")).cast("int")))
    deepest = stretches.agg(F.max("k")).first()[0]
    ranks, out = suffixes.withColumnRenamed("id", "rank"), None
    for k in range(0 if deepest is None else deepest + 1):
        if k:
            ranks = _doubled(ranks, 1 << (k - 1))
        here = stretches.filter(F.col("k") == k).withColumn("there", (F.col("i") + F.col("n") - (1 << k)).cast("int"))
        first = ranks.select(*_DOC, "i", F.col("rank").alias("a"))
        second = ranks.select(*_DOC, F.col("i").alias("there"), F.col("rank").alias("b"))
        both = here.join(first, [*_DOC, "i"]).join(second, [*_DOC, "there"]) if k else here.join(first, [*_DOC, "i"]).withColumn("b", F.col("a"))
        both = both.select("n", "a", "b", *_DOC, "i")
        out = both if out is None else out.unionByName(both)
    if out is None:
        return stretches.select(*_DOC, "i", "n")
    intervals = cut(out)
    first = cut(intervals.groupBy("n", "a", "b").agg(F.min(F.struct(*_DOC, "i")).alias("first"), F.count("*").alias("c")).filter("c > 1"))
    return intervals.join(first, ["n", "a", "b"]).filter(F.struct(*_DOC, "i") != F.col("first")).select(*_DOC, "i", "n")


#: A line's first word and what follows; a word. Words are what ASCII white space separates.
_LINE_WITH_WORD, _WORD = "[^ \\t\\n\\r\\x0B\\x0C][^\\n]*", "[^ \\t\\n\\r\\x0B\\x0C]+"


def _without(text: str, gone: str) -> Column:
    """The text without those of its lines with a word whose numbers are in the array ``gone``, distinct ones.

    Lines with a word and numbers with a mark are brought to one order and met place by place, which looks nothing up;
    lines without a word stay where they were.
    """
    numbered = F.transform(F.split(text, "\n"), lambda x, at: F.struct(at.alias("at"), x.alias("line")))
    worded, blank = F.filter(numbered, lambda x: x["line"].rlike(_WORD)), F.filter(numbered, lambda x: ~x["line"].rlike(_WORD))
    every = F.sequence(F.lit(0), F.regexp_count(text, F.lit(_LINE_WITH_WORD)) - 1)
    mark = lambda numbers, stays: F.transform(numbers, lambda i: F.struct(i.alias("i"), F.lit(stays).alias("stays")))
    marks = F.array_sort(F.concat(mark(F.col(gone), False), mark(F.array_except(every, F.col(gone)), True)))
    kept = F.filter(F.zip_with(worded, marks, lambda line, m: F.when(m["stays"], line)), lambda x: x.isNotNull())
    return F.array_join(F.transform(F.array_sort(F.concat(blank, kept)), lambda x: x["line"]), "\n")


def _joined(docs: DataFrame, key: str, text: str, min_words: int) -> tuple[DataFrame, str]:
    """All rows and columns, and besides the numbers of the row's lines to delete (null if none), and that column's name.

    The lines are cut out by column functions, in the tasks of the join: no text goes through a Python worker for it.
    """
    spans = later_copies(docs, key, text, min_words)
    numbers = F.flatten(F.collect_set(F.sequence(F.col("i"), (F.col("i") + F.col("n") - 1).cast("int"))))
    d, h, gone = (fresh(docs, x) for x in ("_d", "_h", "_gone"))
    per_doc = cut(spans.groupBy(*_DOC).agg(F.array_distinct(numbers).alias(gone))).select(F.col("d").alias(d), F.col("h").alias(h), gone)
    keys = [c.alias(n) for c, n in zip(_document(key, text), (d, h), strict=True)]
    return docs.select("*", *keys).join(per_doc, [d, h], "left").drop(d, h), gone


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: key, text without later copies, n_lines, n_deleted_lines, n_deleted_words.

    A null text stays null, an empty one empty; a document may lose all its lines. Rows with equal id and text count
    once and get the same result; with equal ids and other texts the order between them is by a hash of the text; null ids come
    first. Other columns of the input are left out.
    """
    wide, gone = _joined(docs.select(F.col(key), F.col(text)), key, text, min_words)
    has, words = F.col(gone).isNotNull(), lambda c: F.regexp_count(c, F.lit(_WORD)).cast("bigint")
    lines_ = F.coalesce(F.regexp_count(text, F.lit(_LINE_WITH_WORD)), F.lit(0)).cast("bigint")
    sized = wide.select(F.col(key), F.col(text).alias("_was"), F.when(has, _without(text, gone)).otherwise(F.col(text)).alias("text"), lines_.alias("n_lines"), F.when(has, F.size(gone)).otherwise(0).cast("bigint").alias("n_deleted_lines"))
    return sized.select(F.col(key), "text", "n_lines", "n_deleted_lines", F.when(F.col("n_deleted_lines") > 0, words("_was") - words("text")).otherwise(0).alias("n_deleted_words"))


def dedup_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with all their columns and the text without later copies; n_chars, if there is such a number, follows the text. Rows that lose their last line go."""
    wide, gone = _joined(docs, key, text, min_words)
    has = F.col(gone).isNotNull()
    left = wide.filter(~has | (F.size(gone) < F.regexp_count(text, F.lit(_LINE_WITH_WORD))))
    new = left.withColumn(text, F.when(has, _without(text, gone)).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(has, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return new.select(docs.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of repeated runs of lines."""
    return dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, pos, line, trim(regexp_replace(line, '[ \t\r\x0b\x0c]+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), seq AS (
  SELECT doc_id, pos, norm, len(string_split(norm, ' ')) AS words, row_number() OVER w AS i, sum(len(string_split(norm, ' '))) OVER w AS e
  FROM lines WHERE norm <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ext AS (
  SELECT *, e - words AS s, max(e) OVER (PARTITION BY doc_id) AS total,
    count(*) OVER (PARTITION BY doc_id ORDER BY e - words RANGE BETWEEN CURRENT ROW AND 50 FOLLOWING) AS ahead,
    count(*) OVER (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 50 PRECEDING AND CURRENT ROW) AS back
  FROM seq
), stretch AS (
  SELECT doc_id, i, ahead AS n FROM ext WHERE total - s >= 51
  UNION SELECT doc_id, i - back + 1, back FROM ext WHERE e >= 51
), whole AS (SELECT doc_id, list(norm ORDER BY i) AS l FROM seq GROUP BY doc_id
), runs AS (SELECT t.doc_id, t.i, t.n, md5(array_to_string(list_slice(l, t.i, t.i + t.n - 1), chr(10))) AS body FROM stretch t JOIN whole USING (doc_id)
), firsts AS (SELECT *, row_number() OVER (PARTITION BY n, body ORDER BY doc_id, i) AS r FROM runs
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM firsts WHERE r > 1
), marked AS (
  SELECT a.doc_id, a.pos, a.line, s.i, s.words, g.i IS NOT NULL AS del FROM lines a LEFT JOIN seq s ON a.doc_id = s.doc_id AND a.pos = s.pos LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT del), '') AS text, count(i) AS n_lines, count(*) FILTER (del) AS n_deleted_lines, CAST(coalesce(sum(words) FILTER (del), 0) AS BIGINT) AS n_deleted_words
FROM marked GROUP BY doc_id
"""
