"""A training-corpus pipeline: quality, near copies, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet and read
again before the next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashtrend.llm.decontaminate import clean_documents
from hashtrend.llm.groups import shared_folder
from hashtrend.llm.jaccard import similarity_classes
from hashtrend.llm.labelled import crc_remainder
from hashtrend.llm.packing import pack_documents
from hashtrend.llm.quality import good_documents
from hashtrend.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_remainder(3) != 1)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id stays.

    A row without a doc_id has no similar ones.  Of rows that repeat doc_id (null or not) and text, one stays; rows
    that repeat the doc_id of a kept document with other texts stay.
    """
    own = uuid.uuid4().hex  # names that no column of documents has
    key, count = f"id_{own}", f"rows_{own}"
    kept = similarity_classes(docs).filter("component_id is null or doc_id = component_id")
    rows = F.when(F.col(key).isNull(), 2).otherwise(F.count("*"))
    kept = kept.groupBy(F.col("doc_id").alias(key)).agg(rows.alias(count))
    found = docs.join(kept, docs["doc_id"].eqNullSafe(kept[key]))
    # the count alone tells the branches apart, so both read one shuffle of the documents
    once, repeated = found.filter(F.col(count) == 1), found.filter(F.col(count) > 1).dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller doc_id holds too are cut out of the text; characters cut in part go whole."""
    return without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in token windows."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("benchmark passages", benchmark_passages),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{n}")
        docs = spark.read.parquet(f"{base}/{n}")
    return docs
