"""WARC files, their records' Merkle trees, and the fixity audit of replicas.

A record is a leaf: the hash of its bytes, and its offset range in its file. Leaves go by page id, FANOUT ids to
a node, FANOUT nodes to a node above, up to one root a replica; a node hashes its children's places, hashes and summed
lengths. A place is arithmetic on the id, so that a lost record shifts no other one's
place. The audit compares roots and descends level by level, joining only the children of mismatching nodes, and so ends at the records that differ.

Files are laid out by id, so that a record's offset follows from the pages alone; a replica's files are read as bytes,
and what is no record in them becomes a row. Trees are DataFrame operations. A node has at most FANOUT children; repeated records of one id are counted before they meet.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, folder, remove
from .text import table, tidy

FANOUT = 64
#: Ids whose records share a file.
FILE_IDS = 4096
#: Records of one id that share a file with other ids' at most.
MOST_COPIES = 64
CRLF = "\r\n"
_END = CRLF * 2
_HEAD = re.compile(rb"WARC/1\.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:(-?[0-9]{1,19})>\r\nWARC-Target-URI: [^\r\n]*\r\nContent-Length: ([0-9]{1,12})")


def records(pages: DataFrame) -> DataFrame:
    """(page_id, record): each page as a WARC/1.0 response record without the blank lines that end it; null urls and pages are empty, null ids are -1."""
    body = F.coalesce("html", F.lit(""))
    page = F.coalesce(F.col("page_id").cast("bigint"), F.lit(-1)).alias("page_id")
    head = F.concat(F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-1")), F.lit(f">{CRLF}WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " "))
    return pages.select(page, F.concat(head, F.lit(f"{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_END), body).alias("record"))


def _crowded(found: DataFrame) -> DataFrame:
    """(page_id, slices) of ids with more than MOST_COPIES records: in so many slices these are about as many each."""
    counts = found.groupBy("page_id").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_COPIES)
    return counts.select("page_id", F.ceil(F.col("n") / MOST_COPIES).cast("bigint").alias("slices"))


def _file(page: Column) -> Column:
    return F.floor(page / FILE_IDS).cast("bigint")


def write(found: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files of the records by Spark's text writer, with the record end as its line end: FILE_IDS ids to a file, in the
    order of the ids, then of the records' hashes. An id with more than MOST_COPIES records has files of its own, of about so many each."""
    crowded = cut(_crowded(found))
    place = found.withColumn("file", _file(F.col("page_id"))).withColumn("slice", F.lit(0).cast("bigint"))
    if not crowded.isEmpty():
        dealt = found.withColumn("_at", F.monotonically_increasing_id()).join(crowded, "page_id", "left")
        place = dealt.select("page_id", "record", F.when(F.col("slices").isNull(), _file(F.col("page_id"))).alias("file"), F.coalesce(F.when(F.col("slices").isNotNull(), F.xxhash64("page_id", F.pmod(F.col("_at"), F.col("slices")))), F.lit(0)).alias("slice"))
    ordered = place.repartition("file", "slice").sortWithinPartitions("file", "slice", "page_id", F.sha2("record", 256))
    ordered.select("file", "slice", F.col("record").alias("value")).write.partitionBy("file", "slice").option("lineSep", _END).option("compression", compression).text(path)


def parse(data: bytes) -> Iterator[tuple[int, int, int | None]]:
    """(start, end, page id) of each record in a file's bytes, by its Content-Length, its end included; the id is None for a range without a well-formed record, which ends where the next one begins."""
    at = 0
    while at < len(data):
        end, page = _record(data, at)
        if page is None:
            following = data.find(b"\r\n\r\nWARC/1.0\r\n", at + 1)
            end = following + 4 if following >= 0 else len(data)
        yield at, end, page
        at = end


def _record(data: bytes, at: int) -> tuple[int, int | None]:
    """The end and the id of the record at a place; no id if there is no whole one."""
    head = data.find(b"\r\n\r\n", at)
    fields = _HEAD.fullmatch(data, at, head) if head >= 0 else None
    if fields is None:
        return at, None
    end = head + 4 + int(fields[2]) + len(_END)
    return (end, int(fields[1])) if data[end - len(_END) : end] == _END.encode() else (at, None)


def _plain(data: bytes) -> bytes:
    """A file's bytes, of a gzip file as far as they can be unpacked."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    out = []
    unpack = zlib.decompressobj(31)
    try:
        for at in range(0, len(data), 1 << 16):
            out.append(unpack.decompress(data[at : at + (1 << 16)]))
    except zlib.error:
        pass
    return b"".join(out)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """What lies in a folder of WARC files, read as bytes: (page_id, h, n, file, start, in_order, name), the hash and length of each record's bytes
    and where they start in its file; in_order is false behind a larger id. A range that is no record, however it was
    damaged, is a row without page_id. A file is read whole; ``write`` makes them of FILE_IDS pages or MOST_COPIES copies."""
    names = ["page_id", "h", "n", "file", "start", "in_order", "name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                data, last = _plain(batch.column(1)[k].as_py()), None
                found = re.search(r"/file=(-?[0-9]+)/", name)
                rows = []
                for start, end, page in parse(data):
                    record = data[start : end - len(_END)] if page is not None else data[start:end]
                    rows.append((page, hashlib.sha256(record).hexdigest(), end - start, int(found[1]) if found else None, start, page is None or last is None or page >= last, name))
                    last = last if page is None else page
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], names=names)
        tidy()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "page_id bigint, h string, n bigint, file bigint, start bigint, in_order boolean, name string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record) of the well-formed records in a folder of WARC files; bytes that are no UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                whole = _plain(data.as_py())
                found = [(page, whole[a : b - len(_END)].decode("utf-8", "replace")) for a, b, page in parse(whole) if page is not None]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([r for _, r in found], pa.string())], names=["page_id", "record"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, "page_id bigint, record string")


def planned(found: DataFrame) -> DataFrame:
    """The records' hashes and lengths as ``scan`` gives them for what ``write`` writes of them; starts are left to ``leaves``."""
    return found.select("page_id", F.sha2("record", 256).alias("h"), (F.octet_length("record") + len(_END)).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("file"), F.lit(None).cast("bigint").alias("start"), F.lit(True).alias("in_order"))


def leaves(each: DataFrame) -> DataFrame:
    """(node, hash, content, length, file, start): for each page id the hash of its records (in order of their hashes), their bytes with their ends,
    and their offset range: as read, or where ``write`` puts it. ``hash`` covers the content, the file and the order in the file. Ids with more than
    MOST_COPIES records have neither file nor start."""
    counted = each.filter(F.col("page_id").isNotNull()).groupBy("page_id", "h", "n").agg(F.count("*").alias("c"), F.min("file").alias("file"), F.min("start").alias("start"), F.min("in_order").alias("in_order"))
    content = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("h", "c"))), lambda x: F.concat_ws(":", x["h"], x["c"])), ","), 256)
    page = counted.groupBy("page_id").agg(content.alias("content"), F.sum(F.col("n") * F.col("c")).alias("length"), F.sum("c").alias("copies"), F.min("file").alias("file"), F.min("start").alias("start"), F.min("in_order").alias("in_order"))
    own = F.when(F.col("copies") <= MOST_COPIES, F.coalesce("file", _file(F.col("page_id"))))
    placed = page.select(F.col("page_id").alias("node"), "content", "length", own.alias("file"), F.when(F.col("copies") <= MOST_COPIES, F.col("start")).alias("start"), F.col("in_order") | (F.col("copies") > MOST_COPIES))
    placed = placed.toDF("node", "content", "length", "file", "start", "in_order")
    w = W.partitionBy("file", _file(F.col("node"))).orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    start = F.when(F.col("file").isNotNull(), F.coalesce("start", F.sum("length").over(w), F.lit(0)))
    whole = F.sha2(F.concat_ws("|", "content", "file", F.col("in_order").cast("string")), 256)
    return placed.select("node", whole.alias("hash"), "content", "length", "file", start.alias("start"))


def _up() -> Column:
    return F.floor(F.col("node") / FANOUT).cast("bigint")


def _above(level: DataFrame, up: Column) -> DataFrame:
    """The next level's nodes (node, hash, length)."""
    child = F.struct("node", "hash", "length")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda x: F.concat_ws(":", x["node"], x["hash"], x["length"])), ",")
    return level.groupBy(up.alias("node")).agg(F.sha2(joined, 256).alias("hash"), F.sum("length").alias("length"))


def trees(replicas: list[DataFrame]) -> list[list[DataFrame]]:
    """Each replica's levels (node, hash, length, and offsets at the leaves), from leaves to root; all as high as the ids of all need."""
    levels = [[cut(leaves(r))] for r in replicas]
    ends = [v for x in levels for v in x[0].agg(F.min("node"), F.max("node")).first() if v is not None]
    low, high = (min(ends), max(ends)) if ends else (0, 0)
    while low != high:
        halves = (low, high) == (-1, 0)  # division never brings the negative half's node and the other's together
        levels = [[*x, cut(_above(x[-1], F.lit(0).cast("bigint") if halves else _up()))] for x in levels]
        low, high = (0, 0) if halves else (low // FANOUT, high // FANOUT)
    return levels


_AUDIT = ("page_id", "status", "file", "start", "length", "replica_start", "replica_length")


def audit(reference: DataFrame, replica: DataFrame) -> DataFrame:
    """Where a replica differs from the reference, both as ``scan`` or ``planned`` give them: (page_id, status, file, start, length, replica_start, replica_length).

    status is missing, extra, changed, moved (the same bytes in another file or out of order), or unreadable: a range of
    the replica that is no record, without page_id and reference range. Offsets and lengths are null where a side lacks
    the id. Several records of one id are one leaf. Equal replicas, empty ones too, give no row and end at the roots.
    """
    a, b = trees([reference, replica])
    suspects = None
    for depth in range(len(a) - 1, -1, -1):
        left, right = a[depth], b[depth]
        if suspects is not None:
            root = depth == len(a) - 2  # its children are all the root's, whatever their numbers
            left, right = (x if root else x.withColumn("up", _up()).join(suspects, "up", "left_semi").drop("up") for x in (left, right))
        both = left.alias("l").join(right.alias("r"), F.col("l.node") == F.col("r.node"), "full").filter(~F.col("l.hash").eqNullSafe(F.col("r.hash")))
        if depth:
            suspects = cut(both.select(F.coalesce("l.node", "r.node").alias("up")))
            if suspects.isEmpty():
                break
    status = F.when(F.col("r.hash").isNull(), "missing").when(F.col("l.hash").isNull(), "extra").when(F.col("l.content") == F.col("r.content"), "moved").otherwise("changed")
    if depth:
        found = a[0].limit(0).select(F.col("node").alias("page_id"), F.lit("").alias("status"), "file", "start", "length", F.col("start").alias("replica_start"), F.col("length").alias("replica_length"))
    else:
        found = both.select(F.coalesce("l.node", "r.node").alias("page_id"), status.alias("status"), F.coalesce("l.file", "r.file").alias("file"), F.col("l.start").alias("start"), F.col("l.length").alias("length"), F.col("r.start").alias("replica_start"), F.col("r.length").alias("replica_length"))
    none = F.lit(None).cast("bigint")
    unreadable = replica.filter(F.col("page_id").isNull()).select("page_id", F.lit("unreadable").alias("status"), "file", none.alias("start"), none.alias("length"), F.col("start").alias("replica_start"), F.col("n").alias("replica_length"))
    return found.unionByName(unreadable).select(*_AUDIT)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known faults: of ids modulo 97, those with 5 have an altered page, with 11 are lost, with 23 are cut short."""
    fault = F.pmod(F.col("page_id"), F.lit(97))
    html = F.when(fault == 5, F.concat(F.col("html"), F.lit("?"))).when(fault == 23, F.expr("substring(html, 1, length(html) div 2)")).otherwise(F.col("html"))
    return pages.filter((fault != 11) | fault.isNull()).withColumn("html", html)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a damaged replica of all pages: its WARC files are written, read as bytes, and compared with what the pages give."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = f"{folder(spark)}/warc-{uuid.uuid4().hex}"
    write(records(damaged(pages)), path, "gzip")
    found = cut(scan(spark, path))
    remove(spark, path)
    return audit(planned(records(pages)), found)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT page_id, html, page_id % 97 AS fault,
    strlen('WARC/1.0' || 'WARC-Type: response' || 'WARC-Record-ID: <urn:page:' || page_id || '>' || 'WARC-Target-URI: ' || url || 'Content-Length: ') + 16 AS head FROM pages
), bodies AS (
  SELECT *, CAST(strlen(html) AS BIGINT) AS a, CASE WHEN fault = 11 THEN NULL WHEN fault = 5 THEN CAST(strlen(html) AS BIGINT) + 1 WHEN fault = 23 THEN CAST(strlen(substr(html, 1, length(html) // 2)) AS BIGINT) ELSE CAST(strlen(html) AS BIGINT) END AS b FROM sized
), lengths AS (
  SELECT page_id, fault, page_id // 4096 AS file, head + strlen(CAST(a AS VARCHAR)) + a AS length, head + strlen(CAST(b AS VARCHAR)) + b AS replica_length FROM bodies
), placed AS (
  SELECT *, coalesce(sum(length) OVER w, 0) AS start, CASE WHEN replica_length IS NOT NULL THEN coalesce(sum(replica_length) OVER w, 0) END AS replica_start
  FROM lengths WINDOW w AS (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT page_id, CASE WHEN fault = 11 THEN 'missing' ELSE 'changed' END AS status, CAST(file AS BIGINT) AS file, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
  CAST(replica_start AS BIGINT) AS replica_start, CAST(replica_length AS BIGINT) AS replica_length
FROM placed WHERE fault IN (5, 11, 23)
"""
