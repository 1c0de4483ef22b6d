"""Fill-in-middle transformation by DuckDB inside the tasks.

Each Arrow batch is registered as a table and goes through one SQL statement, in pieces of bounded text: code points by a
regular expression, cut points from a hash of the id, spans by list slices, Arrow back. No row is touched by Python.

A text becomes prefix, middle and suffix between three marks, in the order prefix, suffix, middle (psm) or suffix, prefix,
middle (spm), so that a model learns to fill in what lies between. Some texts stay plain: those by the share ``plain``,
empty ones, and those that hold a mark, which couldn't be told from ours. What was made is read back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import arrow_schema, table, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts in a hundred that stay plain, and of the others those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes of text that one statement works on; a longer text is one by itself. Lists of code points take some forty times as much.
PIECE = 1 << 20

_CUT_DDL = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_RESTORED_DDL = "doc_id bigint, text string"
_DIGEST_DDL = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"


def _cut_sql(source: str, plain: int, suffix_first: int) -> str:
    """Rows (doc_id, text) as (_CUT_DDL)."""
    group = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    return f"""SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '{PREFIX}' || array_to_string(list_slice(units, 1, a), '') || '{SUFFIX}' || array_to_string(list_slice(units, b + 1, n), '') || '{MIDDLE}' || array_to_string(list_slice(units, a + 1, b), '')
    ELSE '{SUFFIX}' || array_to_string(list_slice(units, b + 1, n), '') || '{PREFIX}' || array_to_string(list_slice(units, 1, a), '') || '{MIDDLE}' || array_to_string(list_slice(units, a + 1, b), '') END AS output
FROM (SELECT *, least({group(0)} % (n + 1), {group(1)} % (n + 1)) AS a, greatest({group(0)} % (n + 1), {group(1)} % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {group(2)} % 100 >= {100 - plain} THEN 'plain' WHEN {group(3)} % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form
  FROM (SELECT *, len(units) AS n
    FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '.', 0, 's') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {source})))"""


def _restored_sql(source: str) -> str:
    """Rows with form and output, and the text that they were made of."""
    return f"""SELECT * EXCLUDE (parts), CASE form WHEN 'psm' THEN parts[2] || parts[4] || parts[3] WHEN 'spm' THEN parts[3] || parts[4] || parts[2] ELSE output END AS text
FROM (SELECT *, CASE WHEN form <> 'plain' THEN regexp_split_to_array(output, '{PREFIX}|{SUFFIX}|{MIDDLE}') END AS parts FROM {source})"""


def pieces(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, cut where the text so far passes another ``most`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def _by_duckdb(rows: DataFrame, text: str, sql: str, ddl: str) -> DataFrame:
    """The statement over the table ``batch``, which holds some rows at a time."""
    at, schema = rows.columns.index(text), arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as db:  # all of it in memory: nothing is left on an executor's disk
            for batch in batches:
                for piece in pieces(batch, at, PIECE):
                    db.register("batch", pa.Table.from_batches([piece]))
                    yield from db.execute(sql).to_arrow_table().cast(schema).to_batches()
                    db.unregister("batch")
                tidy()

    return rows.mapInArrow(run, ddl)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def transform(docs: DataFrame, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each document's text for training, plain, psm or spm.

    Cut points, form and order follow from the id alone, so that a repeated row or a second run gives the same. A null text
    is an empty one, which stays plain; a null id counts as an empty string; other columns are left out. An empty table gives none.
    """
    return _by_duckdb(_texts(docs), "text", _cut_sql("batch", plain, suffix_first), _CUT_DDL)


def restore(transformed: DataFrame) -> DataFrame:
    """(doc_id, text): the texts that rows (doc_id, form, output) were made of."""
    return _by_duckdb(transformed.select("doc_id", "form", "output"), "output", f"SELECT doc_id, text FROM ({_restored_sql('batch')})", _RESTORED_DDL)


def digest(docs: DataFrame, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``transform`` and ``restore`` in one pass, with hashes in place of the texts."""
    both = _restored_sql(f"({_cut_sql('batch', plain, suffix_first)})")
    return _by_duckdb(_texts(docs), "text", f"SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM ({both})", _DIGEST_DDL)


#: The same rows by plain substrings of whole texts.
ORACLE_SQL = f"""SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || substr(text, 1, a) || '{SUFFIX}' || substr(text, b + 1) || '{MIDDLE}' || substr(text, a + 1, b - a)
    ELSE '{SUFFIX}' || substr(text, b + 1) || '{PREFIX}' || substr(text, 1, a) || '{MIDDLE}' || substr(text, a + 1, b - a) END) AS output_sha256, sha256(text) AS restored_sha256
FROM (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= {100 - PLAIN} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
FROM (SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
FROM (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents)))"""


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents transformed and read back."""
    return digest(table(spark, sf_dir, "documents"))
