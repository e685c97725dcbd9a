"""Corpus-wide answers about distinct words.

``word_chunks`` turns documents into chunk rows: the documents of a few MB with their words as local ids, and the
distinct words of the chunk packed by word bucket.  ``ask`` sends those distinct words to their buckets, where each
word is looked at once for the whole corpus, and brings one answer per word back to every chunk that asked.  A word
travels once a chunk however often it occurs, so common words make no hot key.  Chunk rows are checkpointed: chunk
numbers are fixed from then on, and a lost executor costs only a read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm import text as tx
from hashtrend.llm.groups import checkpoint, pack, release_memory, shuffle_partitions, unpack, unpack_bytes

CHUNK_BYTES = 8 << 20

CHUNK_SCHEMA = (
    "chunk long, doc_ids binary, n_bytes binary, n_words binary, marks binary, sequence binary, freq binary,"
    " n_distinct int, parts array<struct<bucket:int, n:int, words:binary, weights:binary>>"
)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> tx.U64(40)) % tx.U64(buckets)).astype(np.int64)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with index and inverse; a hash table finds the distinct ones, so only these are sorted."""
    coded = pa.array(h, pa.uint64()).dictionary_encode()
    code = coded.indices.to_numpy()
    found = coded.dictionary.to_numpy()
    at = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1)) if len(code) else np.zeros(0, np.int64)
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], at[order], place[code]


def _one_chunk(number: int, ids, marks, data, offsets, fold: bool, buckets: int, weigh: bool, counted: bool) -> dict:
    if fold:
        data = tx.LOWER[data]
    starts, ends, first = tx.words(data, offsets, tx.NOT_SPACE)
    h = tx.word_hashes(data, starts, ends)
    distinct, at, inverse = _distinct(h)
    bucket = _bucket_of(distinct, buckets)
    order = np.argsort(bucket, kind="stable")
    local = np.empty(len(order), np.uint32)
    local[order] = np.arange(len(order), dtype=np.uint32)
    sequence = local[inverse]
    n_words = np.diff(first)
    freq = None
    raw = data.tobytes()
    weights = np.zeros(len(distinct), np.int64)
    if weigh:  # occurrences in marked documents
        weights = np.bincount(sequence[np.repeat(marks, n_words)], minlength=len(distinct))
    if counted:
        sequence, freq, n_words = document_frequencies(sequence, n_words, len(distinct))
    bucket = bucket[order]
    s, e = starts[at[order]].tolist(), ends[at[order]].tolist()
    cut = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
    parts = []
    for k in range(buckets):
        lo, hi = cut[k], cut[k + 1]
        if hi > lo:
            text = b" ".join([raw[s[i] : e[i]] for i in range(lo, hi)])
            parts.append(
                {"bucket": k, "n": hi - lo, "words": pack(text), "weights": pack(weights[lo:hi].astype(np.uint32)) if weigh else None}
            )
    return {
        "chunk": number,
        "doc_ids": pack(ids),
        "n_bytes": pack(np.diff(offsets)),
        "n_words": pack(n_words),
        "marks": pack(marks),
        "sequence": pack(sequence),
        "freq": pack(freq) if counted else None,
        "n_distinct": len(distinct),
        "parts": parts,
    }


def document_frequencies(sequence: np.ndarray, n_words: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct words in order, as differences, how often it has each, and how many there are."""
    doc = np.repeat(np.arange(len(n_words)), n_words)
    pair, freq = np.unique(doc * max(1, distinct) + sequence, return_counts=True)
    doc, word = np.divmod(pair, max(1, distinct))
    step = np.diff(word, prepend=0)
    first = np.diff(doc, prepend=-1) > 0
    step[first] = word[first]
    return step.astype(np.uint32), freq.astype(np.uint32), np.bincount(doc, minlength=len(n_words))


def distinct_words(step: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The words that ``document_frequencies`` wrote as differences; ``n`` is their number in each document."""
    total = np.concatenate(([0], np.cumsum(step, dtype=np.int64)))
    before = np.concatenate(([0], np.cumsum(n)))[:-1]
    return total[1:] - np.repeat(total[before], n)


def word_chunks(
    docs: DataFrame, fold: bool = False, chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None, counted: bool = False
) -> DataFrame:
    """Checkpointed chunk rows of (doc_id, text[, mark]) documents; words are runs without ASCII white space.

    ``fold`` lower-cases A-Z.  With a boolean ``mark`` column, each distinct word is sent along with its number of
    occurrences in marked documents.  With ``counted``, ``sequence``, ``freq`` and ``n_words`` are the documents' word
    frequencies (``document_frequencies``) instead of their words in order.
    """
    buckets = buckets or shuffle_partitions(docs.sparkSession)
    weigh = "mark" in docs.columns
    names = ["doc_id", "text", "mark"] if weigh else ["doc_id", "text"]
    schema = pa.schema(
        [
            ("chunk", pa.int64()),
            *((n, pa.binary()) for n in ("doc_ids", "n_bytes", "n_words", "marks", "sequence", "freq")),
            ("n_distinct", pa.int32()),
            ("parts", pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int32()), ("words", pa.binary()), ("weights", pa.binary())]))),
        ]
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        number = TaskContext.get().partitionId() << 16
        held: list[pa.RecordBatch] = []
        size = 0

        def emit():
            table = pa.Table.from_batches(held)
            data, offsets = tx.flat(table["text"])
            ids = tx.longs(table["doc_id"])
            marks = np.asarray(table["mark"].to_numpy()).astype(bool) if weigh else np.zeros(len(ids), bool)
            row = _one_chunk(number, ids, marks, data, offsets, fold, buckets, weigh, counted)
            release_memory()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            step = max(1, int(batch.num_rows * chunk_bytes / max(1, batch.nbytes)))
            for lo in range(0, batch.num_rows, step):
                piece = batch.slice(lo, step)
                bytes_ = piece.nbytes
                if held and size + bytes_ > chunk_bytes:
                    yield emit()
                    held.clear()
                    size = 0
                    number += 1
                held.append(piece)
                size += bytes_
        if held and sum(b.num_rows for b in held):
            yield emit()

    return checkpoint(docs.select(*names).mapInArrow(make, CHUNK_SCHEMA))


def ask(chunks: DataFrame, answer: Callable[[list[bytes], np.ndarray | None], np.ndarray], dtype, report=None) -> DataFrame:
    """(chunk, bucket, answers) rows: ``answer`` gets the distinct words of a bucket (and their summed weights) once.

    ``answers`` packs one ``dtype`` value per word the chunk sent to that bucket, in the order sent.  ``answer`` may
    return byte strings instead (``dtype`` None), as (length of each, all their bytes); they come back joined, with their
    lengths in front (``unpack_strings``).
    With ``report``, each bucket adds a row with ``chunk`` -1 and the bytes that ``report(words, sums)`` returns.
    """
    sent = chunks.select("chunk", F.explode("parts").alias("p")).select("p.bucket", "chunk", "p.words", "p.weights")

    def look(key, table):
        words, sums, where = merge_words(table)
        values = answer(words, sums)
        chunk, blob = ([-1], [report(words, sums)]) if report else ([], [])
        if dtype is None:
            lens, joined = values
            begin = np.cumsum(lens) - lens
        for c, which in zip(table["chunk"].to_pylist(), where, strict=True):
            chunk.append(c)
            if dtype is None:
                blob.append(pack_joined(lens[which], joined[tx.ranges(begin[which], lens[which])].tobytes()))
            else:
                blob.append(pack(np.asarray(values, dtype)[which]))
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(chunk), pa.int32()), "answers": pa.array(blob, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(look, "chunk long, bucket int, answers binary")


def merge_words(table: pa.Table):
    """Distinct words over the rows of a bucket, their summed weights, and for each row the places of its words."""
    index: dict[bytes, int] = {}
    where, amount = [], []
    for blob, weights in zip(table["words"].to_pylist(), table["weights"].to_pylist(), strict=True):
        own = unpack_bytes(blob).split(b" ")
        where.append(np.fromiter((index.setdefault(w, len(index)) for w in own), np.int64, len(own)))
        if weights is not None:
            amount.append(unpack(weights, np.uint32))
    sums = None
    if amount:
        sums = np.bincount(np.concatenate(where), weights=np.concatenate(amount), minlength=len(index)).astype(np.int64)
    return list(index), sums, where


def pack_strings(items: list[bytes]) -> bytes:
    return pack_joined(np.fromiter(map(len, items), np.int64, len(items)), b"".join(items))


def pack_joined(lens: np.ndarray, joined: bytes) -> bytes:
    head = np.concatenate(([len(lens)], lens)).astype(np.uint32).tobytes()
    return pack(head + joined)


def unpack_strings(blob: bytes) -> tuple[np.ndarray, bytes]:
    """(lengths, joined bytes)."""
    raw = unpack_bytes(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    return np.frombuffer(raw, np.uint32, n, 4).astype(np.int64), raw[4 + 4 * n :]


def with_answers(chunks: DataFrame, answers: DataFrame, finish: Callable[[dict, list], pa.Table], schema: str, columns=None) -> DataFrame:
    """``finish(chunk row, answer blobs in bucket order)`` for every chunk."""
    columns = columns or ["chunk", "doc_ids", "n_bytes", "n_words", "marks", "sequence"]

    def meet(key, left, right):
        order = np.argsort(right["bucket"].to_numpy()) if right.num_rows else []
        blobs = right["answers"].to_pylist()
        tables = [finish(row, [blobs[i] for i in order]) for row in left.to_pylist()]
        return pa.concat_tables(tables) if tables else empty_table(schema)

    return chunks.select(*columns).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def empty_table(schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(",")]
    return pa.table({n: pa.array([], _TYPES[t]) for n, t in fields})
