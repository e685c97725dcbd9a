"""Packing of documents into fixed token windows, neighbours found by BM25.

1. *Tokens.*  Every distinct pre-token of the corpus is encoded once (``lexicon``); a document's ids are the
   concatenation of its pre-tokens' ids and the closing id.  Document frequencies of token ids cover all documents
   (the vocabulary bounds them) and are summed over chunks.
2. *Shards.*  A chunk of documents (8 MB of text) is an index shard with an inverted index of token ids, whose BM25
   weights use the corpus-wide frequencies and mean length.
3. *Windows.*  A shard's documents are taken as seeds in order of first unused.  The seed opens a window; all its
   distinct ids but the closing one, which every document holds, query the index, and the best unused neighbours are
   appended until the window is full.  The piece that crosses the window's end is cut there and its rest opens the next
   window as the seed, so every window of a shard is full but for the last.  When no unused document of the shard scores
   above 0, the next unused one follows.
4. The last window of a shard is cut at powers of two, which need no padding.

Defined results: a null or empty text is its closing id alone; repeated rows are packed once each; null ids are kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm import text as tx
from hashtrend.llm.groups import checkpoint, documents_of, pack, unpack
from hashtrend.llm.lexicon import ask, unpack_strings, with_answers, word_chunks
from hashtrend.llm.token_counts import tokenizer_path, word_ids

WINDOW = 4096
CLOSING_ID = 2
K1, B = 1.2, 0.75
_VOCABULARY = 1 << 16


def document_terms(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token id, count) of each document's distinct ids, in order."""
    ids = np.concatenate([np.sort(ids[a:b], kind="stable") for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)] or [ids])
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    new[first[:-1]] = True  # every document holds at least its closing id
    at = np.flatnonzero(new)
    return np.searchsorted(first, at, side="right") - 1, ids[at].astype(np.int64), np.diff(np.concatenate((at, [len(ids)])))


class Shard:
    """Inverted index of token ids over one shard's documents."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, idf: np.ndarray, mean_length: float):
        lens = np.diff(first)
        self.n = len(lens)
        doc, term, count = document_terms(ids, first)
        self.by_doc = np.searchsorted(doc, np.arange(self.n + 1))
        self.doc_terms = term
        norm = K1 * (1 - B + B * lens / max(mean_length, 1e-9))
        weight = (idf[term] * count * (K1 + 1) / (count + norm[doc])).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.docs, self.weight = doc[order], weight[order]
        self.posting = np.searchsorted(term[order], np.arange(_VOCABULARY + 1))

    def forget(self, used: np.ndarray) -> None:
        """Takes the postings of used documents out of the index; they are never neighbours again."""
        keep = ~used[self.docs]
        self.posting = np.concatenate(([0], np.cumsum(keep)))[self.posting]
        self.docs, self.weight = self.docs[keep], self.weight[keep]

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        """All unused documents that score above 0 for a seed, best first (ties: earlier document)."""
        own = self.doc_terms[self.by_doc[seed] : self.by_doc[seed + 1]]
        own = own[own != CLOSING_ID]
        spans = self.posting[own]
        at = tx.ranges(spans, self.posting[own + 1] - spans)
        score = np.bincount(self.docs[at], weights=self.weight[at], minlength=self.n)
        score[used] = 0
        score[seed] = 0
        found = np.flatnonzero(score > 0)
        return found[np.lexsort((found, -score[found]))].tolist()


def fill_windows(shard: Shard, lens: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length); all full but the last."""
    used = np.zeros(shard.n, bool)
    windows: list[list[tuple[int, int, int]]] = []
    size = lens.tolist()
    n_used, step = 0, max(64, shard.n // 10)
    next_unused, pending = 0, None  # pending: (document, start) that a cut left
    while True:
        if pending is None:
            while next_unused < shard.n and used[next_unused]:
                next_unused += 1
            if next_unused == shard.n:
                break
            pending = (next_unused, 0)
            used[next_unused] = True
        seed, room, pieces = pending[0], window, []
        queue = None
        while room:
            doc, start = pending
            take = min(room, size[doc] - start)
            pieces.append((doc, start, take))
            room -= take
            if start + take < size[doc]:
                pending = (doc, start + take)
                break
            pending = None
            if not room:
                break
            if queue is None:
                if (now := int(used.sum())) - n_used >= step:
                    shard.forget(used)
                    n_used = now
                queue = iter(shard.neighbours(seed, used))
            following = next((d for d in queue if not used[d]), None)
            if following is None:
                while next_unused < shard.n and used[next_unused]:
                    next_unused += 1
                if next_unused == shard.n:
                    break
                following = next_unused
            used[following] = True
            pending = (following, 0)
        windows.append(pieces)
        if pending is None and used.all():
            break
    return windows


def at_powers_of_two(pieces: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """A partly filled window cut into sequences whose lengths are powers of two."""
    total = sum(n for *_, n in pieces)
    if total in (0, window):
        return [pieces] if pieces else []
    out, queue = [], list(reversed(pieces))
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        room, own = 1 << bit, []
        while room:
            doc, start, n = queue.pop()
            take = min(room, n)
            own.append((doc, start, take))
            room -= take
            if take < n:
                queue.append((doc, start + take, n - take))
        out.append(own)
    return out


_TOKENS = "chunk long, doc_ids binary, lens binary, ids binary, terms binary"
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """Checkpointed chunk rows with the token ids of whole documents (uint16; the vocabulary fits)."""
    chunks = word_chunks(documents_of(docs))

    def encode(words, _):
        ids, count = word_ids(path, words)
        return 2 * count, ids.astype(np.uint16).view(np.uint8)

    def finish(row: dict, blobs: list) -> pa.Table:
        sizes, raw = [np.zeros(0, np.int64)], []
        for b in blobs:
            n, joined = unpack_strings(b)
            sizes.append(n // 2)
            raw.append(joined)
        sizes, pool = np.concatenate(sizes), np.frombuffer(b"".join(raw), np.uint16)
        begin = np.cumsum(sizes) - sizes
        n_words, sequence = unpack(row["n_words"], np.int64), unpack(row["sequence"], np.uint32)
        word_len = sizes[sequence]
        doc = np.repeat(np.arange(len(n_words)), n_words)
        lens = np.bincount(doc, weights=word_len, minlength=len(n_words)).astype(np.int64) + 1
        stop = np.cumsum(lens)
        ids = np.empty(int(stop[-1]) if len(stop) else 0, np.uint16)
        body = np.ones(len(ids), bool)
        body[stop - 1] = False
        ids[body] = pool[tx.ranges(begin[sequence], word_len)]
        ids[stop - 1] = CLOSING_ID
        frequency = np.bincount(document_terms(ids, np.concatenate(([0], stop)))[1], minlength=_VOCABULARY)
        values = {"doc_ids": row["doc_ids"], "lens": pack(lens), "ids": pack(ids), "terms": pack(frequency.astype(np.uint32))}
        return pa.table({"chunk": pa.array([row["chunk"]], pa.int64()), **{n: pa.array([v], pa.binary()) for n, v in values.items()}})

    columns = ["chunk", "doc_ids", "n_words", "sequence"]
    return checkpoint(with_answers(chunks, ask(chunks, encode, None), finish, _TOKENS, columns))


def corpus_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document frequency of every id, documents and tokens, summed over all chunks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_VOCABULARY + 2, np.int64)
        for batch in batches:
            for terms, lens in zip(batch.column("terms").to_pylist(), batch.column("lens").to_pylist(), strict=True):
                n = unpack(lens, np.int64)
                total[:_VOCABULARY] += unpack(terms, np.uint32)
                total[-2:] += (len(n), n.sum())
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    rows = tokens.select("terms", "lens").mapInArrow(add, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(_VOCABULARY + 2, np.int64)
    for r in rows:
        total[r.k] = r.n
    return total[:_VOCABULARY], int(total[-2]), int(total[-1])


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens, with the ids of each piece."""
    tokens = tokenised(docs, path or tokenizer_path())
    frequency, n_docs, n_tokens = corpus_frequencies(tokens)
    idf = np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5))
    mean_length = n_tokens / max(1, n_docs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, lens, ids = unpack(row["doc_ids"], np.int64), unpack(row["lens"], np.int64), unpack(row["ids"], np.uint16)
                first = np.concatenate(([0], np.cumsum(lens)))
                filled = fill_windows(Shard(ids, first, idf, mean_length), lens, window)
                filled = filled[:-1] + at_powers_of_two(filled[-1], window) if filled else []
                wide = ids.astype("<u4")
                out: list[tuple] = []
                for s, pieces in enumerate(filled):
                    offset = 0
                    for doc, start, n in pieces:
                        lo = first[doc] + start
                        crc = zlib.crc32(wide[lo : lo + n].tobytes())
                        out.append((names[doc], start, n, crc, lens[doc], (row["chunk"] << 24) + s, offset))
                        offset += n
                columns = [np.array(c, np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 7
                arrays = [tx.ids_out(columns[0]), *map(pa.array, columns[1:])]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _OUT.split(", ")])

    return tokens.drop("terms").mapInArrow(place, _OUT)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
