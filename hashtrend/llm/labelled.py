"""Bounded samples of labelled documents, and documents in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm.groups import documents_of

PIECE_BYTES = 4 << 20


def crc_remainder(divisor: int) -> F.Column:
    """crc32 of the doc_id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: F.Column, size: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most ``size`` labelled rows where ``train`` holds, half of each class (the rows of
    smallest id hash), and the number of labelled training rows of each class."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & train)
        .dropDuplicates(["doc_id"])
    )
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    spark = docs.sparkSession
    chosen = []
    for value in (0, 1):
        best = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size // 2)
        chosen += [(r.doc_id, r.label) for r in best.collect()]
    # an Arrow table: a list of rows would go through Python workers of another kind, which stay beside those of the operators
    ids, values = zip(*chosen, strict=True) if chosen else ((), ())
    picked = spark.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64()), "label": pa.array(values, pa.int32())}))
    rows = documents_of(docs).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    return rows.select("doc_id", "text", "label"), totals


def pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut to about ``limit`` bytes (a single larger row stays whole)."""
    for batch in batches:
        step = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)
