"""Lexical retrieval packing: a sharded BM25 inverted index returns unused neighbours that fill each seed's window.

Documents are tokenised where they are read and dealt to shards by a MinHash of their rarer tokens, so that lexically
close documents meet; the deal is a REBALANCE, so that a signature with a third of all documents is split over tasks.
Within a task, documents in order of signature and id form shards of a fixed size. Each shard's index holds the
postings of its documents' last pieces. A seed's window is filled with its best unused neighbours by BM25; the last one
is cut to fit and its rest stays unused. Only what a task has left at its end doesn't fill a window: that rest is cut
into sequences whose lengths are powers of two, which need no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .text import per_batch, table, tidy

WINDOW = 4096
END = 2
TOKENIZER = "word_bpe_49k.json"
#: A shard ends at so many documents or tokens, whichever is first; bounds memory and the cost of a retrieval.
SHARD_DOCS, SHARD_TOKENS = 1024, 1_000_000
#: Documents that are tokenised at a time.
TOKENISED = 1024
#: Token ids below this are the vocabulary's first merges, too common to sign a document.
COMMON_IDS = 2000
K1, B = 1.2, 0.75


def signature(ids: np.ndarray) -> int:
    """The id among the text's rarer ones with the smallest hash (of all ids if none is rare; -1 of none)."""
    rare = ids[ids >= COMMON_IDS]
    rare = rare if len(rare) else ids
    if not len(rare):
        return -1
    mixed = (rare.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return int(rare[np.argmin(mixed ^ (mixed >> np.uint64(29)))])


class Index:
    """BM25 over some token arrays: postings by term, with each document's weight for the term."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        sizes = np.array([len(d) for d in docs], np.float64)
        flat = np.concatenate(docs) if n else np.empty(0, np.int64)
        flat = flat.astype(np.int32 if flat.dtype.itemsize == 2 and n < 1 << 15 else np.int64)
        keys, tf = np.unique(flat * n + np.repeat(np.arange(n, dtype=flat.dtype), sizes.astype(np.int64)), return_counts=True)
        terms, self.doc = keys // max(n, 1), keys % max(n, 1)
        self.terms, first, df = np.unique(terms, return_index=True, return_counts=True)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(sizes.mean() if n else 1, 1))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc]) if n else np.empty(0)
        keep = df > 1  # every term that can join two documents, however many have it
        self.terms, self.first, self.df, self.n = self.terms[keep], first[keep], df[keep], n
        by_doc = np.flatnonzero(np.repeat(keep, df)) if n else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(self.terms)), self.df)
        order = np.argsort(self.doc[by_doc], kind="stable")
        self.own = row[order]
        self.own_at = np.searchsorted(self.doc[by_doc][order], np.arange(n + 1))

    def scores(self, doc: int) -> np.ndarray:
        """The BM25 score of every document for the document's distinct terms."""
        rows = self.own[self.own_at[doc] : self.own_at[doc + 1]]
        df = self.df[rows]
        at = np.repeat(self.first[rows] - np.concatenate([[0], np.cumsum(df)[:-1]]), df) + np.arange(df.sum()) if len(rows) else np.empty(0, np.int64)
        return np.bincount(self.doc[at], self.weight[at], self.n)


class Packer:
    """Windows over documents that come one by one; pieces are (doc, start, length, sequence, offset)."""

    def __init__(self, window: int = WINDOW, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS):
        self.window, self.most, self.most_tokens = window, shard_docs, shard_tokens
        self.sequence = 0
        self.docs: list[tuple[object, np.ndarray]] = []
        self.left: list[tuple] = []  # what the last shard could not fill a window with
        self.tokens = 0

    def add(self, key: object, ids: np.ndarray) -> list[tuple]:
        self.docs.append((key, ids))
        self.tokens += len(ids)
        return self.flush() if len(self.docs) >= self.most or self.tokens >= self.most_tokens else []

    def _piece(self, doc: tuple, start: int, length: int, offset: int) -> tuple:
        return (doc, start, length, self.sequence, offset)

    def flush(self, last: bool = False) -> list[tuple]:
        """Packs the shard; what doesn't fill a window waits for the next shard, or is cut into powers of two at the last."""
        out, tails = [], list(self.left)
        for doc in self.docs:
            full = len(doc[1]) // self.window * self.window
            for start in range(0, full, self.window):
                out.append(self._piece(doc, start, self.window, 0))
                self.sequence += 1
            if full < len(doc[1]):
                tails.append((doc, full, len(doc[1])))
        self.docs, self.left, self.tokens = [], [], 0
        index = Index([doc[1][a:b] for doc, a, b in tails])
        start, end = [a for _, a, _ in tails], [b for *_, b in tails]
        unused = np.ones(len(tails), bool)
        total, seed = sum(end) - sum(start), 0
        while total >= self.window:
            while not unused[seed]:
                seed += 1
            offset, used = 0, seed
            ranked: Iterator[int] | None = None
            while offset < self.window:
                take = min(end[used] - start[used], self.window - offset)
                out.append(self._piece(tails[used][0], start[used], take, offset))
                start[used] += take
                offset += take
                unused[used] = start[used] < end[used]
                if offset < self.window:
                    ranked = ranked if ranked is not None else self._neighbours(index, seed, unused)
                    used = next(ranked)
            total -= self.window
            self.sequence += 1
        rest = [(tails[k][0], start[k], end[k]) for k in np.flatnonzero(unused).tolist()]
        if not last:
            self.left = rest
            return out
        room = offset = 0
        for doc, a, b in rest:
            while a < b:
                if offset == room:
                    room, offset = 1 << (total.bit_length() - 1), 0
                take = min(b - a, room - offset)
                out.append(self._piece(doc, a, take, offset))
                a, offset, total = a + take, offset + take, total - take
                self.sequence += offset == room
        return out

    @staticmethod
    def _neighbours(index: Index, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents by falling score, ties by place; those without a common term come last."""
        scores = index.scores(seed)
        free = np.flatnonzero(unused)
        yield from free[np.argsort(-scores[free], kind="stable")].tolist()


_PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, window: int = WINDOW, ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``ids`` the piece's token ids.

    Null and empty texts are the end token alone. Every row is a document of its own, also if keys repeat or are null;
    an empty table gives no pieces. Other columns of the input are left out.
    """

    def prepare():
        of = tokens.tokenizer(tokenizer)
        end = np.array([END], of.dtype).tobytes()

        def encode(batch: pa.Array) -> list:
            found = of.many(batch)
            return [[x + end for x in found], [of.dtype.itemsize] * len(found), [signature(np.frombuffer(x, of.dtype)) for x in found]]

        return encode

    encoded = docs.select(F.col(key).cast("bigint").alias("key"), per_batch(prepare, "ids binary, width int, sign bigint", TOKENISED)(F.col(text)).alias("t")).select("key", "t.*")
    dealt = docs.sparkSession.sql("SELECT /*+ REBALANCE(sign) */ key, ids, width, sign FROM {encoded}", encoded=encoded).sortWithinPartitions("sign", "key", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = Packer(window), TaskContext.get().partitionId() << 40

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            parts = [doc[1][start : start + length].astype("<u4") for doc, start, length, _, _ in pieces]
            columns = [
                pa.array([p[0][0] for p in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()),
                pa.array([len(p[0][1]) for p in pieces], pa.int64()),
                pa.array([first + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ]
            names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if ids:
                columns.append(pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for k, data, width in zip(*(batch.column(c).slice(at, 256).to_pylist() for c in range(3)), strict=True):
                    out += packer.add(k, np.frombuffer(data, f"<u{width}"))
                if out:
                    yield rows(out)
        yield rows(packer.flush(last=True))
        del packer
        tidy()

    return dealt.mapInArrow(run, f"key bigint, {_PIECES}" + ", ids array<bigint>" * ids).withColumnRenamed("key", key)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
