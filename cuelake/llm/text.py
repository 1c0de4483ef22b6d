"""What the operators on texts share: reading a table, and Arrow-batched functions of one text column."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts taken out of an Arrow batch at a time, so that a batch never exists twice as Python strings.
SLICE = 256
#: ASCII white space that splits words: space, tab, LF, VT, FF, CR (what bytes.split() takes).
SPACE = b" \t\n\r\x0b\x0c"

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, read by Spark alone: the path may be in a store that only Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in T.StructType.fromDDL(ddl).fields])


def texts(batch: pa.Array) -> Iterator[str]:
    """The batch's texts as strings; null counts as empty."""
    for at in range(0, len(batch), SLICE):
        for x in batch.slice(at, SLICE).to_pylist():
            yield x or ""


def tidy() -> None:
    """Gives back what a worker has freed: Arrow's pool and the C heap keep it otherwise, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def per_text(prepare: Callable[[], Callable[[str], tuple]], ddl: str) -> Callable[[Column], Column]:
    """A struct column from a function of one text. ``prepare`` runs once a task and returns that function."""
    schema = arrow_schema(ddl)

    @F.arrow_udf(T.StructType.fromDDL(ddl))
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = prepare()
        for batch in batches:
            columns = [[] for _ in schema]
            for x in texts(batch):
                for column, value in zip(columns, one(x), strict=True):
                    column.append(value)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], fields=list(schema))
            del columns
        tidy()

    return apply


def per_batch(prepare: Callable[[], Callable[[pa.Array], list]], ddl: str, rows: int = 1 << 30) -> Callable[[Column], Column]:
    """A struct column from a function of an Arrow batch of texts, or of so many rows of it at a time, which returns one list or array a field."""
    schema = arrow_schema(ddl)

    @F.arrow_udf(T.StructType.fromDDL(ddl))
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = prepare()
        for batch in batches:
            for at in range(0, len(batch), rows):
                columns = of(batch.slice(at, rows))
                yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], fields=list(schema))
                del columns
        del of
        tidy()

    return apply


def with_fields(docs: DataFrame, key: str, text: str, fields: Callable[[Column], Column]) -> DataFrame:
    """The key and the fields of a struct function of the text; other columns, whatever their names, stay out."""
    return docs.select(F.col(key), F.col(text).alias("_text")).select(F.col(key), fields(F.col("_text")).alias("_fields")).select(key, "_fields.*")


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever its case."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name
