"""From raw documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns a DataFrame, which ``run`` and
the driver write as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cuelake.llm import decontam, line_dedup, packing, quality, shared, simhash
from cuelake.llm.text import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labelled ones among them, doesn't reject. Null texts score as empty ones."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines; those that lose their last line go."""
    return line_dedup.dedup_rows(docs)


def simhash_near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of those whose 5-word shingles are 0.8 alike or more, that with the smallest id."""
    return simhash.keep_one(docs, by=simhash.alike)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontam.remove(spark, docs, table(spark, sf_dir, "benchmark"))


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", simhash_near_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", retrieval_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder, so that a lost executor costs one stage at most."""
    folder = f"{shared.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: SQL can express neither the classifier, XXH64 fingerprints nor the packing.
ORACLE_SQL = None
