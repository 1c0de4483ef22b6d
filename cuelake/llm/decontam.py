"""Benchmark decontamination with training suffix arrays.

Each shard (an Arrow batch of documents) gets a suffix array over its word ids by prefix doubling; every benchmark
suffix is binary-searched in it. The interval of a 13-word window gives all its occurrences and their places; words under
an occurrence are hit, and documents with enough hit words are contaminated. A binary search of each occurrence in the
benchmark's own suffix array tells how far the verbatim match goes on.

A verbatim match holds benchmark words only, so that runs of other words separate a shard's sequence and never enter
its suffix array; this loses nothing. The benchmark is read in blocks of at most BLOCK_CHARS characters, each broadcast
on its own. One block needs no shuffle. With several, rows get numbers first, and only rows with hits are shuffled, to
unite what the blocks found in a row; each row keeps a verdict of its own, whatever its id.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut
from .text import SLICE, fresh, per_batch, table

#: Words of a window; a shorter item is one window of its own length.
WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Documents of a shard.
SHARD = 4096
#: Characters of benchmark text that are broadcast at once.
BLOCK_CHARS = 16_000_000

#: For each byte: words' bytes as they are, A-Z in lower case, all others a space. Bytes from 0x80 are parts of word characters.
_WORD_BYTES = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their suffix, compared over at least ``depth`` tokens, by prefix doubling; ties by position."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    length = 1
    while length < depth and rank.max() < n:
        second = np.zeros(n, np.int64)
        if length < n:
            second[:-length] = rank[length:]
        rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64) + 1
        length *= 2
    return np.argsort(rank, kind="stable")


def bounds(tokens: np.ndarray, order: np.ndarray, needles: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each needle (a row of ``needles``, its first ``lengths`` tokens) the half-open interval of ``order`` whose suffixes start with it: two binary searches of all needles at once."""
    padded = np.concatenate([tokens, np.full(needles.shape[1], -1, tokens.dtype)])
    ends = []
    for upper in (False, True):
        lo, hi = np.zeros(len(needles), np.int64), np.full(len(needles), len(order), np.int64)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            at = order[mid]
            sign = np.zeros(len(live), np.int8)  # of suffix minus needle
            for k in range(needles.shape[1]):
                open_ = (sign == 0) & (k < lengths[live])
                if not open_.any():
                    break
                a, b = padded[at + k], needles[live, k]
                sign = np.where(open_, np.sign(a - b).astype(np.int8), sign)
            right = sign <= 0 if upper else sign < 0
            lo[live] = np.where(right, mid + 1, lo[live])
            hi[live] = np.where(right, hi[live], mid)
        ends.append(lo)
    return ends[0], ends[1]


#: Words that two suffixes are compared by at a time, and suffixes that are compared at a time.
_STEP, _TOGETHER = 16, 1 << 14


def common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words a[i:] and b[j:] share from their start, for each pair of places; 0 is no word and ends both. Both arrays end with _STEP zeros."""
    out, live, step = np.zeros(len(i), np.int64), np.arange(len(i)), np.arange(_STEP)
    while len(live):
        left = a[(i[live] + out[live])[:, None] + step]
        same = (left == b[(j[live] + out[live])[:, None] + step]) & (left != 0)
        run = np.where(same.all(axis=1), _STEP, same.argmin(axis=1))
        out[live] += run
        live = live[run == _STEP]
    return out


def longest(tokens: np.ndarray, order: np.ndarray, needles: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix ``needles[at:]``: the words of its longest match in ``tokens``, whose suffixes ``order`` sorts, and the index in ``order`` of one such match. Both arrays end with _STEP zeros."""
    lengths, places = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for part in (slice(k, k + _TOGETHER) for k in range(0, len(at) if len(order) else 0, _TOGETHER)):
        mine = at[part]
        lo, hi = np.zeros(len(mine), np.int64), np.full(len(mine), len(order), np.int64)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            same = common(tokens, order[mid], needles, mine[live])
            less = tokens[order[mid] + same] < needles[mine[live] + same]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        before, after = np.maximum(lo - 1, 0), np.minimum(lo, len(order) - 1)
        x, y = (common(tokens, order[k], needles, mine) for k in (before, after))
        lengths[part], places[part] = np.maximum(x, y), np.where(x > y, before, after)
    return lengths, places


class Benchmark(NamedTuple):
    """Word ids from 1; distinct windows as rows with their lengths; for each window the items that hold it; all items' words in a row, 0 after each, with each place's item and the sorted order of the suffixes."""

    ids: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    items: list[tuple]
    flat: np.ndarray
    item_at: np.ndarray
    names: list
    order: np.ndarray


def benchmark_of(rows: list[tuple]) -> Benchmark:
    """From (item_id, text) rows; null texts and texts without words hold no window."""
    ids: dict[bytes, int] = {}
    of: dict[tuple, set] = {}
    flat, sizes, names = [], [], []
    for item, text in rows:
        seq = tuple(ids.setdefault(w, len(ids) + 1) for w in words(text or ""))
        flat += [*seq, 0]
        sizes.append(len(seq) + 1)
        names.append(item)
        for at in range(max(1, len(seq) - WINDOW + 1)) if seq else ():
            of.setdefault(seq[at : at + WINDOW], set()).add(item)
    keys = list(of)
    matrix = np.zeros((len(keys), WINDOW), np.int32)
    for row, key in zip(matrix, keys, strict=True):
        row[: len(key)] = key
    whole = np.array(flat + [0] * _STEP, np.int32)
    order = suffix_array(whole, max(sizes, default=1))
    return Benchmark(ids, matrix, np.array([len(k) for k in keys], np.int64), [tuple(of[k]) for k in keys], whole, np.repeat(np.arange(len(sizes)), sizes), names, order[whole[order] != 0])


class Shard:
    """The word runs of some documents that can match, with their suffix array."""

    def __init__(self, batch: pa.Array, bench: Benchmark, depth: int = WINDOW):
        get = bench.ids.get
        least = int(bench.lengths.min()) if len(bench.lengths) else 1
        self.n_words, parts = [], []
        for at in range(0, len(batch), SLICE):
            for x in batch.slice(at, SLICE).to_pylist():
                found = words(x or "")
                parts.append(np.fromiter((get(w, 0) for w in found), np.int32, len(found)))
                parts.append(np.zeros(1, np.int32))
                self.n_words.append(len(found))
        whole = np.concatenate(parts) if parts else np.empty(0, np.int32)
        del parts
        starts = np.concatenate([[0], np.cumsum(np.array(self.n_words, np.int64) + 1)])
        known = whole != 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        run, end = edge[::2], edge[1::2]
        run, end = run[end - run >= least], end[end - run >= least]
        sizes = end - run + 1  # with the word after the run, which is 0
        at = np.repeat(run - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(run) else np.empty(0, np.int64)
        self.tokens = np.concatenate([whole[at], np.zeros(_STEP, np.int32)])
        self.doc = np.searchsorted(starts, at, "right") - 1
        self.pos = at - starts[self.doc]
        self.order = suffix_array(self.tokens[: len(at)], depth)


def _named(items: set) -> list:
    """As strings in their order; a null, which has no name, last."""
    return sorted(str(x) for x in items if x is not None) + [None] * (None in items)


def hits(batch: pa.Array, bench: Benchmark) -> list[list]:
    """Per document: its number of words; the first places of its stretches of hit words and the places behind them; the items whose windows occur; and its longest match of a whole window or more: the words, the place of the first, the item (the smallest of equals)."""
    shard = Shard(batch, bench)
    n, size = len(batch), len(shard.tokens) - _STEP
    starts, ends, items = [[] for _ in range(n)], [[] for _ in range(n)], [set() for _ in range(n)]
    best: list[tuple] = [(0, None, None)] * n
    if size and len(bench.windows):
        lo, hi = bounds(shard.tokens, shard.order, bench.windows, bench.lengths)
        counts = hi - lo
        window = np.repeat(np.arange(len(counts)), counts)
        at = shard.order[np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
        step = np.zeros(size + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + bench.lengths[window], -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            start = int(shard.pos[a])
            starts[shard.doc[a]].append(start)
            ends[shard.doc[a]].append(start + b - a)
        for d, w in np.unique(np.stack([shard.doc[at], window], 1), axis=0).tolist() if len(at) else ():
            items[d].update(bench.items[w])
        best = _best(shard, bench, at, window, n)
    return [shard.n_words, starts, ends, list(map(_named, items)), *map(list, zip(*best, strict=True))] if n else [[]] * 7


def _best(shard: Shard, bench: Benchmark, at: np.ndarray, window: np.ndarray, n: int) -> list[tuple]:
    """(words, place, item) of each document's longest match: of full windows how far the match goes on, of a short item its length."""
    full = bench.lengths[window] == WINDOW
    place = np.unique(at[full])
    length, found = longest(bench.flat, bench.order, shard.tokens, place)
    short = np.flatnonzero(~full)
    place, length = np.concatenate([place, at[short]]), np.concatenate([length, bench.lengths[window[short]]])
    of = np.concatenate([found, -1 - window[short]])
    doc, pos = shard.doc[place], shard.pos[place]
    out: list[tuple] = [(0, None, None)] * n
    # a document's rows by falling length, then place; those of its first length and place name their items
    for k in np.lexsort((pos, -length, doc)).tolist():
        d, key = doc[k], (int(length[k]), int(pos[k]))
        if out[d][0] and out[d][:2] != key:
            continue
        names = bench.items[-1 - of[k]] if of[k] < 0 else _holders(shard, bench, int(place[k]), key[0], int(of[k]))
        named = [str(x) for x in names if x is not None]
        out[d] = (*key, min([*named, *([out[d][2]] if out[d][2] is not None else [])], default=None))
    return out


def _holders(shard: Shard, bench: Benchmark, place: int, length: int, index: int) -> set:
    """The items with the ``length`` words from the shard's place: neighbours of the index in the order of the suffixes that share so many."""
    word = shard.tokens[place : place + length]
    out = set()
    for step in (1, -1):
        k = index if step > 0 else index - 1
        while 0 <= k < len(bench.order) and np.array_equal(bench.flat[bench.order[k] : bench.order[k] + length], word):
            out.add(bench.names[bench.item_at[bench.order[k]]])
            k += step
    return out


def pieces(benchmark: DataFrame, item: str, text: str, block_chars: int) -> DataFrame:
    """(item, text) of the benchmark, each row once. A text of more than a quarter of a block's characters is cut into pieces that overlap by all but one of a window's words, which keeps its windows."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    most = block_chars // 4
    seq = F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    size = max(2 * WINDOW, most // 16)
    long = rows.filter(F.length("text") > most).select("item", seq.alias("w"))
    parts = long.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)), F.lit(size - WINDOW + 1))).alias("at"))
    return rows.filter(F.length("text") <= most).unionByName(parts.select("item", F.array_join(F.slice("w", F.col("at") + 1, size), " ").alias("text")))


def blocks(benchmark: DataFrame, item: str, text: str, block_chars: int) -> list[DataFrame]:
    """The benchmark in parts of at most so many characters each; one if it is small. Rows are dealt by a hash to many more buckets than parts, whose sizes are then added up."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    if (rows.agg(F.sum(F.length("text"))).first()[0] or 0) <= block_chars:
        return [rows]
    rows = cut(pieces(benchmark, item, text, block_chars))
    total = rows.agg(F.sum(F.length("text"))).first()[0]
    bucket = F.pmod(F.xxhash64("item", "text"), F.lit(64 * -(-total // block_chars)))
    ends, held = [-1], 0
    for k, size in rows.groupBy(bucket.alias("k")).agg(F.sum(F.length("text"))).orderBy("k").collect():
        if held and held + size > block_chars:
            ends.append(k - 1)
            held = 0
        held += size
    return [rows.filter((bucket > a) & (bucket <= b)) for a, b in zip(ends, [*ends[1:], 1 << 62], strict=True)]


_FOUND = "n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>, longest bigint, longest_start bigint, longest_item string"


def _search(spark: SparkSession, part: DataFrame):
    """The struct function of a text for one block of the benchmark."""
    shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

    def prepare():
        bench = benchmark_of(shared.value)
        return lambda batch: hits(batch, bench)

    return per_batch(prepare, _FOUND, SHARD)


def _hit(f: str) -> Column:
    """The number of hit words from the places that were found in a row, which may overlap."""
    places = F.flatten(F.zip_with(f"{f}.starts", f"{f}.ends", lambda a, b: F.sequence(a, b - 1)))
    return F.size(F.array_distinct(places)).cast("bigint")


def _contaminated(f: str) -> Column:
    return (F.size(f"{f}.starts") > 0) & (_hit(f) * SHARE >= F.col(f"{f}.n_words"))


def _judged(f: str) -> list[Column]:
    """Verdict columns from a struct column of what was found in a row."""
    names = F.sha2(F.array_join(f"{f}.items", ","), 256)
    return [F.col(f"{f}.n_words").alias("n_words"), _hit(f).alias("n_hit"), F.size(f"{f}.items").cast("bigint").alias("n_items"), names.alias("items_sha256"), _contaminated(f).alias("contaminated"), *[F.col(f"{f}.{c}").alias(c) for c in ("longest", "longest_start", "longest_item")]]


def _found(spark: SparkSession, docs: DataFrame, text: str, parts: list[DataFrame]) -> tuple[DataFrame, str]:
    """All rows and columns with a struct column of what was found in the row besides, and its name."""
    name, row = fresh(docs, "_found"), fresh(docs, "_row")
    if len(parts) == 1:
        return docs.withColumn(name, _search(spark, parts[0])(F.col(text))), name
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    slim = numbered.select(F.col(row).alias("r"), F.col(text).alias("t"))
    each = None
    for part in parts:
        one = slim.select("r", _search(spark, part)(F.col("t")).alias("f")).filter(F.size("f.starts") > 0)
        each = one if each is None else each.unionByName(one)
    best = F.min(F.struct((-F.col("f.longest")).alias("n"), "f.longest_start", "f.longest_item")).alias("b")
    merged = each.groupBy("r").agg(F.max("f.n_words").alias("n_words"), *[F.flatten(F.collect_list(f"f.{c}")).alias(c) for c in ("starts", "ends")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.items")))).alias("items"), best)
    united = merged.select(F.col("r").alias(row), F.struct("n_words", "starts", "ends", "items", (-F.col("b.n")).alias("longest"), "b.longest_start", "b.longest_item").alias(name))
    n_words = F.regexp_count(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    none = F.struct(F.coalesce(n_words, F.lit(0)).cast("bigint").alias("n_words"), *[F.array().cast(t).alias(c) for c, t in (("starts", "array<bigint>"), ("ends", "array<bigint>"), ("items", "array<string>"))], F.lit(0).cast("bigint").alias("longest"), F.lit(None).cast("bigint").alias("longest_start"), F.lit(None).cast("string").alias("longest_item"))
    return numbered.join(united, row, "left").drop(row).withColumn(name, F.coalesce(name, none)), name


def judge(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated, and its longest verbatim match of a whole
    window or more: longest (words, 0 without one), longest_start (its first word, the first of equals), longest_item (the smallest, as a string).

    Null and empty texts have no words and are clean, as are all documents if the benchmark is empty. Items with equal
    ids count as one; one without an id counts and has no name. Each row gives a row of its own, whatever its id and
    however many blocks the benchmark has; only a match in an item that is cut, longer than a quarter of a block, is
    measured within a piece.
    """
    found, name = _found(spark, docs.select(F.col(key), F.col(text)), text, blocks(benchmark, item, item_text, block_chars))
    return found.select(F.col(key), *_judged(name))


def remove(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that aren't contaminated, with all their columns and repeats; each row is judged alone."""
    found, name = _found(spark, docs, text, blocks(benchmark, "item_id", "text", block_chars))
    return found.filter(~_contaminated(name)).select(docs.columns)


def longest_matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", least: int = 2, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For every benchmark suffix with a verbatim match of at least ``least`` words in the documents: item (as a string),
    suffix (its first word's place in the item, or in its piece if it was cut), length of the longest match, and the place (key, doc_word) of one such match.

    A shard proposes its longest for each suffix by binary search of its suffix array; the shards' meet by key of the
    suffix. Memory is linear in the block and the shard.
    """
    out = None
    for part in blocks(benchmark, "item_id", "text", block_chars):
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def search(batches, shared=shared):
            bench = benchmark_of(shared.value)
            at = np.flatnonzero(bench.flat)
            first = np.concatenate([[0], np.flatnonzero(np.diff(bench.item_at)) + 1])
            deepest = int(np.diff(np.concatenate([first, [len(bench.item_at)]])).max()) if len(bench.item_at) else 1
            for whole in batches:
                for k in range(0, whole.num_rows, SHARD):
                    batch = whole.slice(k, SHARD)
                    shard = Shard(batch.column(1), bench._replace(lengths=np.array([1])), deepest)
                    length, index = longest(shard.tokens, shard.order, bench.flat, at)
                    good = np.flatnonzero(length >= least)
                    place = shard.order[index[good]]
                    item = bench.item_at[at[good]]
                    columns = [pa.array([bench.names[i] for i in item.tolist()], pa.string()), pa.array(at[good] - first[item], pa.int64()), pa.array(length[good], pa.int64()), batch.column(0).take(pa.array(shard.doc[place], pa.int64())), pa.array(shard.pos[place], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["item_id", "suffix", "length", key, "doc_word"])

        one = docs.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(search, f"item_id string, suffix bigint, length bigint, {key} bigint, doc_word bigint")
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("item_id", "suffix").agg(F.min(F.struct((-F.col("length")).alias("n"), F.col(key), F.col("doc_word"))).alias("b"))
    return best.select("item_id", "suffix", (-F.col("b.n")).alias("length"), F.col(f"b.{key}").alias(key), F.col("b.doc_word").alias("doc_word"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document against the whole benchmark."""
    return judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, i AS j, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), grams AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)
), found AS (SELECT g.doc_id, g.i, g.n, v.item_id, v.j FROM grams g JOIN windows v ON g.n = v.n AND g.win = v.win
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), diagonal AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, n, i - j ORDER BY i) AS run FROM found
), runs AS (SELECT doc_id, item_id, min(i) - 1 AS start, min(n) + count(*) - 1 AS words FROM diagonal GROUP BY doc_id, item_id, n, i - j, run
), long AS (SELECT doc_id, words, start, min(CAST(item_id AS VARCHAR)) AS item FROM runs GROUP BY doc_id, words, start
), best AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, start) = 1
), named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated,
  CAST(coalesce(b.words, 0) AS BIGINT) AS longest, CAST(b.start AS BIGINT) AS longest_start, b.item AS longest_item
FROM words d LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id) LEFT JOIN best b USING (doc_id)
"""
