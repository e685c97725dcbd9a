"""Alignment of two tokenizers over the same bytes, and how often their tokens end together.

Each text is encoded by a byte-level vocabulary (A, on a space and the text) and by a sentencepiece model (B, which adds
the space itself), one distinct word of a chunk at a time (``encoders``: both tokenizers give the ids of the whole).  The
byte offsets at which a token of each ends are two ascending arrays; where both have an offset, a *group* of tokens ends.
Tokens of both end with every word, so words are aligned once too and a text's groups are those of its words.

**Diagonal run skipping.**  While the arrays agree at the current index shift, tokens correspond one to one: the run is
probed by comparing slices of 1, 2, 4, ... ends at that shift, and the last slice that differs is halved down to the
place of the first difference.  There the smaller end advances until the two meet again; that irregular group sets the
new shift.

**Counts.**  A link is a pair of token occurrences that end together (the last tokens of a group).  Documents are read
once into chunk rows (a few MB: digests, token counts and each document's pairs with their frequencies), which are
checkpointed.  A chunk sends its distinct pairs, packed by bucket of the B id; a bucket sees all pairs of its B ids,
sums them, marks the commonest of each B id, and answers every chunk.  A pair costs one entry a chunk however often it
occurs, and buckets grow in number with the corpus (up to one per B id).

Defined results: texts that are null, empty, or that B's pieces do not spell byte for byte have no tokens: counts 0 and
an empty ``groups_sha256``.  Repeated rows and null ids each get their own row and count each; an empty table gives an
empty result; other columns are ignored.  Long texts are encoded in segments (``encoders.segments``), with the ids of
the whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm import text as tx
from hashtrend.llm.encoders import load_byte_level, load_pieces, tokenizer_path, words_of
from hashtrend.llm.groups import checkpoint, documents_of, group_count, pack, unpack
from hashtrend.llm.lexicon import distinct_words, document_frequencies, with_answers

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
MOST_BUCKETS = 32_000
KEPT_WORDS = 400_000
LINE_CHARS = 1 << 12  # words encoded together; both libraries take longer a character on longer lines
_U32 = tx.U64(32)
_JOINS = re.compile(r"\w(.*\w)?", re.DOTALL)


def run_length(a: list[int], b: list[int], i: int, j: int) -> int:
    """For how many tokens from ``i`` and ``j`` on, whose ends agree, the ends agree one to one."""
    most = min(len(a) - i, len(b) - j)
    have, step = 1, 1
    while have < most:
        step = min(2 * step, most - have)
        if a[i + have : i + have + step] != b[j + have : j + have + step]:
            break
        have += step
    else:
        return have
    # the first difference lies in the slice just compared
    while step > 1:
        half = step // 2
        if a[i + have : i + have + half] == b[j + have : j + have + half]:
            have += half
            step -= half
        else:
            step = half
    return have


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """For every group, how many tokens of either side end with it or before; ``a`` and ``b`` are ascending ends with
    the same last value."""
    cut_a: list[int] = []
    cut_b: list[int] = []
    i = j = 0
    n = len(a)
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            if i + 1 < n and a[i + 1] != b[j + 1]:  # a run of one
                i += 1
                j += 1
                cut_a.append(i)
                cut_b.append(j)
                continue
            run = run_length(a, b, i, j)
            cut_a.extend(range(i + 1, i + run + 1))
            cut_b.extend(range(j + 1, j + run + 1))
            i += run
            j += run
            continue
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        j += 1
        cut_a.append(i)
        cut_b.append(j)
    return cut_a, cut_b


def group_texts(ids_a: list[str], ids_b: list[str], cut_a: list[int], cut_b: list[int]) -> list[str]:
    """``a1,a2|b1`` of each group, from decimal ids."""
    out = []
    i = j = 0
    for p, q in zip(cut_a, cut_b, strict=True):
        left = ids_a[i] if p == i + 1 else ",".join(ids_a[i:p])
        right = ids_b[j] if q == j + 1 else ",".join(ids_b[j:q])
        out.append(left + "|" + right)
        i, j = p, q
    return out


class Encoders:
    """Both tokenizers of a task, with the bytes and decimal form of every id."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.bytes_a = load_byte_level(path_a)
        if hasattr(self.a.model, "_resize_cache"):  # every word comes once, so the library's own cache only costs
            self.a.model._resize_cache(0)
        self.b, self.bytes_b = load_pieces(path_b)
        self.length_a, self.length_b = np.array([len(t) for t in self.bytes_a]), np.array([len(t) for t in self.bytes_b])
        self.text_a, self.text_b = (np.array([str(i) for i in range(len(t))], object) for t in (self.bytes_a, self.bytes_b))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.links = np.zeros(0, np.uint64)
        self.count = np.zeros((3, 0), np.int64)  # A tokens, B tokens and links of each word
        self.spelt = np.zeros(0, bool)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, str] | None]:
        """(A tokens, B tokens, links, group string) of each text, None where it is empty or the bytes of A or B differ
        from it.  A link is the B id, shifted by 32 bits, and the A id.

        Tokens of both sides end with every word, so no group crosses words: a word is encoded and aligned once and its
        groups are kept, for at most ``KEPT_WORDS`` words before all are forgotten."""
        if len(self.place) > KEPT_WORDS:
            self._forget()
        place, known = self.place, len(self.place)
        coded = [[place.setdefault(w, len(place)) for w in words_of(t)] if t else [] for t in texts]
        groups, links, count, spelt = self._words(list(islice(place, known, None)))
        self.groups += groups
        self.links = np.concatenate((self.links, links))
        self.count = np.concatenate((self.count, count), axis=1)
        self.spelt = np.concatenate((self.spelt, spelt))
        first = np.cumsum(self.count[2]) - self.count[2]
        for code in coded:
            at = np.array(code, np.int64)
            if code and self.spelt[at].all():
                n_a, n_b, n = self.count[:, at]
                yield int(n_a.sum()), int(n_b.sum()), self.links[tx.ranges(first[at], n)], ";".join([self.groups[k] for k in code])
            else:
                yield None

    def _words(self, words: list[str]):
        """(group string of each word, links of all words, counts of each, whether the ids spell each).

        Words are encoded many at a time: joined by spaces where ``words_of`` could cut them again, the others alone."""
        lines: list[list[int]] = [[]]
        size = 0
        for k, w in enumerate(words):
            joins = _JOINS.fullmatch(w) is not None
            if lines[-1] and (not joins or size > LINE_CHARS):
                lines.append([])
                size = 0
            lines[-1].append(k)
            size = size + len(w) if joins else LINE_CHARS + 1
        lines = [line for line in lines if line]
        texts = [" ".join([words[k] for k in line]) for line in lines]
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1) if texts else []
        spelt = np.ones(len(words), bool)
        groups: list[str] = []
        links, counts = [np.zeros(0, np.uint64)], [np.zeros((3, 0), np.int64)]
        for line, text, x, y in zip(lines, texts, ids_a, ids_b, strict=True):
            want = b" " + text.encode()
            if b"".join([self.bytes_a[i] for i in x]) == want and b"".join([self.bytes_b[i] for i in y]) == want:
                ends = np.cumsum([1 + len(words[k].encode()) for k in line])
                found = self.aligned(np.array(x, np.int64), np.array(y, np.int64), ends)
                groups += found[0]
                links.append(found[1])
                counts.append(found[2])
            elif len(line) > 1:  # some word of the line is not spelt: each on its own
                for k in line:
                    own = self._words([words[k]])
                    groups += own[0]
                    links.append(own[1])
                    counts.append(own[2])
                    spelt[k] = own[3][0]
            else:
                spelt[line[0]] = False
                groups.append("")
                counts.append(np.zeros((3, 1), np.int64))
        return groups, np.concatenate(links), np.concatenate(counts, axis=1), spelt

    def aligned(self, x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(group string of each word, links, counts of each word) of the ids of words that end at the bytes ``ends``."""
        ends_a, ends_b = np.cumsum(self.length_a[x]), np.cumsum(self.length_b[y])
        cut_a, cut_b = align(ends_a.tolist(), ends_b.tolist())
        texts = group_texts(self.text_a[x].tolist(), self.text_b[y].tolist(), cut_a, cut_b)
        last_a, last_b = np.array(cut_a) - 1, np.array(cut_b) - 1
        stops = np.array([np.searchsorted(e, ends, side="right") for e in (ends_a, ends_b, ends_a[last_a])])
        stop = stops[2].tolist()
        groups = [";".join(texts[i:j]) for i, j in zip([0, *stop[:-1]], stop, strict=True)]
        links = (y[last_b].astype(np.uint64) << _U32) | x[last_a].astype(np.uint64)
        return groups, links, np.diff(stops, prepend=0, axis=1)


@lru_cache(maxsize=1)
def _encoders(path_a: str, path_b: str) -> Encoders:
    """One for all tasks of a worker."""
    return Encoders(path_a, path_b)


_PARTS = "array<struct<bucket:int,pairs:binary,counts:binary>>"
_CHUNK = f"chunk long, doc_ids binary, no_id binary, n_a binary, n_b binary, n_groups binary, digests binary, sequence binary, freq binary, n_pairs binary, parts {_PARTS}"
_BLOBS = ("doc_ids", "no_id", "n_a", "n_b", "n_groups", "digests", "sequence", "freq", "n_pairs")
_CHUNK_ARROW = pa.schema(
    [
        ("chunk", pa.int64()),
        *((n, pa.binary()) for n in _BLOBS),
        ("parts", pa.list_(pa.struct([("bucket", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())]))),
    ]
)


def _bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    """By the B id (the upper half) alone."""
    with np.errstate(over="ignore"):
        return (tx.mix((pairs >> _U32) + tx.U64(1)) % tx.U64(buckets)).astype(np.int64)


def _chunk_row(number: int, table: pa.Table, encoders: Encoders, buckets: int) -> dict:
    texts = [t or "" for t in table["text"].to_pylist()]
    n_a, n_b, n_groups = (np.zeros(len(texts), np.int64) for _ in range(3))
    links = []
    found = {}
    for k, own in enumerate(encoders.encode(texts)):
        if own is not None:
            n_a[k], n_b[k], linked, groups = own
            n_groups[k] = len(linked)
            links.append(linked)
            found[k] = hashlib.sha256(groups.encode()).digest()
    digests = b"".join(found.get(k, bytes(32)) for k in range(len(texts)))
    every = np.concatenate(links) if links else np.zeros(0, np.uint64)
    encoded = pa.array(every, pa.uint64()).dictionary_encode()
    pair, inverse = encoded.dictionary.to_numpy(), encoded.indices.to_numpy().astype(np.int64)
    count = np.bincount(inverse, minlength=len(pair))
    bucket = _bucket_of(pair, buckets)
    order = np.lexsort((pair, bucket))
    local = np.empty(len(pair), np.int64)
    local[order] = np.arange(len(pair))
    step, freq, n_pairs = document_frequencies(local[inverse], n_groups, len(pair))
    pair, count, bucket = pair[order], count[order].astype(np.uint32), bucket[order]
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    parts = [
        {"bucket": k, "pairs": pack(np.diff(pair[cut[k] : cut[k + 1]], prepend=tx.U64(0))), "counts": pack(count[cut[k] : cut[k + 1]])}
        for k in np.flatnonzero(np.diff(cut)).tolist()
    ]
    return {
        "chunk": number,
        "doc_ids": pack(tx.longs(table["doc_id"])),
        "no_id": pack(np.asarray(table["doc_id"].is_null()).astype(np.uint8)),
        "n_a": pack(n_a),
        "n_b": pack(n_b),
        "n_groups": pack(n_groups),
        "digests": digests,
        "sequence": pack(step),
        "freq": pack(freq),
        "n_pairs": pack(n_pairs),
        "parts": parts,
    }


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str, buckets: int, chunk_bytes: int) -> DataFrame:
    """Checkpointed chunk rows: chunk numbers are fixed from then on."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(path_a, path_b)
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            step = max(1, int(batch.num_rows * chunk_bytes / max(1, batch.nbytes)))
            for lo in range(0, batch.num_rows, step):
                row = _chunk_row(number, pa.Table.from_batches([batch.slice(lo, step)]), encoders, buckets)
                yield pa.RecordBatch.from_pylist([row], schema=_CHUNK_ARROW)
                number += 1

    return checkpoint(docs.mapInArrow(make, _CHUNK))


def pair_answers(chunks: DataFrame) -> DataFrame:
    """(chunk, bucket, answers): for each pair that the chunk sent, twice its count in the corpus, plus 1 where no pair
    of the same B id has a higher count."""
    sent = chunks.select("chunk", F.explode("parts").alias("p")).select("p.bucket", "chunk", "p.pairs", "p.counts")

    def look(key, table):
        own = [np.cumsum(unpack(p, np.uint64), dtype=np.uint64) for p in table["pairs"].to_pylist()]
        counts = [unpack(c, np.uint32) for c in table["counts"].to_pylist()]
        pair, inverse = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(pair)).astype(np.int64)
        first = np.flatnonzero(np.diff(pair >> _U32, prepend=tx.U64(0xFFFFFFFF)))
        most = np.repeat(np.maximum.reduceat(total, first), np.diff(np.append(first, len(pair))))
        answer = (total * 2 + (total == most)).astype(np.uint64)
        ends = np.cumsum([len(o) for o in own]).tolist()
        blobs = [pack(answer[inverse[e - len(o) : e]]) for o, e in zip(own, ends, strict=True)]
        return pa.table({"chunk": table["chunk"], "bucket": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "answers": pa.array(blobs, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(look, "chunk long, bucket int, answers binary")


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish(row: dict, blobs: list) -> pa.Table:
    answer = np.concatenate([unpack(b, np.uint64) for b in blobs]).astype(np.int64) if blobs else np.zeros(0, np.int64)
    n_groups, n_pairs = unpack(row["n_groups"], np.int64), unpack(row["n_pairs"], np.int64)
    pair, freq = distinct_words(unpack(row["sequence"], np.uint32), n_pairs), unpack(row["freq"], np.uint32).astype(np.int64)
    answer = answer[pair]
    ends = np.concatenate(([0], np.cumsum(n_pairs)))
    sums = [np.diff(np.concatenate(([0], np.cumsum(v)))[ends]) for v in (freq * (answer & 1), freq * (answer >> 1))]
    digests = row["digests"]
    sha = [digests[32 * k : 32 * k + 32].hex() if n else "" for k, n in enumerate(n_groups.tolist())]
    return pa.table(
        {
            "doc_id": pa.array(unpack(row["doc_ids"], np.int64), mask=unpack(row["no_id"], np.uint8).astype(bool)),
            "n_a": pa.array(unpack(row["n_a"], np.int64)),
            "n_b": pa.array(unpack(row["n_b"], np.int64)),
            "n_groups": pa.array(n_groups),
            "n_links": pa.array(n_groups),  # the last tokens of a group, and only they, end together
            "n_best": pa.array(sums[0], pa.int64()),
            "count_sum": pa.array(sums[1], pa.int64()),
            "groups_sha256": pa.array(sha, pa.string()),
        }
    )


def cross_token_links(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links that are the commonest of their B id, the links' counts
    in the corpus, and a digest of the groups."""
    path_a, path_b = path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)
    docs = documents_of(docs)
    buckets = min(group_count(docs, BUCKET_BYTES), MOST_BUCKETS)
    chunks = aligned_chunks(docs, path_a, path_b, buckets, chunk_bytes)
    return with_answers(chunks, pair_answers(chunks), _finish, _OUT, ["chunk", *_BLOBS])


def token_groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The groups themselves: doc_id and, for every group, its A and B ids."""
    path_a, path_b = path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(path_a, path_b)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                out = []
                for own in encoders.encode(texts):
                    sides = [g.split("|") for g in own[3].split(";")] if own is not None else []
                    out.append([{"a": list(map(int, s.split(","))), "b": list(map(int, t.split(",")))} for s, t in sides])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(out, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))],
                    ["doc_id", "groups"],
                )

    return documents_of(docs).mapInArrow(make, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


def op13_cross_tokens(spark, sf_dir: str) -> DataFrame:
    return cross_token_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))
