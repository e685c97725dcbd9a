"""How documents are dealt to tasks, and where lineage is cut.

A *group* is a set of documents of a few MB, chosen by a hash of the row, that one task handles at a time.
Operators that need corpus-wide knowledge of many small keys (byte substrings, shingles, words) do not shuffle a
row per key.  Each group sends its distinct keys, packed by key bucket; each bucket merges what all groups sent and
answers every group with what it has to know; and the answers meet the group's documents again in a cogroup.
However often a key occurs, a group sends it once, so a key that a third of all rows hold costs one entry a group.
"""

from __future__ import annotations

import ctypes
import inspect
import math
import os
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_BYTES = 4 << 20


def release_memory() -> None:
    """Hands memory that this Python worker has freed back to the machine; a worker lives on for many stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(handler):
    """``handler`` of a group (or cogroup), with the worker's freed memory given back after each."""
    if len(inspect.signature(handler).parameters) == 2:

        def of_group(key, table):
            out = handler(key, table)
            release_memory()
            return out

        return of_group

    def of_cogroup(key, left, right):
        out = handler(key, left, right)
        release_memory()
        return out

    return of_cogroup


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it (on a cluster it is
    installed, or shipped with --py-files)."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents_of(docs: DataFrame, also: list[F.Column] | None = None) -> DataFrame:
    """Only ``doc_id``, ``text`` and the columns in ``also``, so that others (of whatever name) cannot clash with ours."""
    importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(also or []))


def group_count(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """Groups for this corpus: one a ``group_bytes``, and at least one a shuffle partition."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), math.ceil(total / group_bytes))


def with_group(docs: DataFrame, groups: int) -> DataFrame:
    return docs.withColumn("gid", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local session without one gets a scratch folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def pack(data: np.ndarray | bytes, level: int = 1) -> bytes:
    """Compressed bytes, or an array as compressed byte planes (all first bytes, all second bytes, ...)."""
    if not isinstance(data, bytes):
        data = np.ascontiguousarray(data)
        data = data.view(np.uint8).reshape(-1, data.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=level).compress(data)


def unpack(blob: bytes, dtype) -> np.ndarray:
    """The array that ``pack`` got; ``dtype`` is its type."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def unpack_bytes(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)
