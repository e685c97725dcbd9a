"""Benchmark decontamination with suffix arrays over the training words.

Every task builds a suffix array over the words of its own documents (a shard; a few MB at a time) and looks up every
suffix of every benchmark item in it by binary search.  A suffix that finds its first ``window`` words (all of them,
for a shorter item) yields all places that hold it, with the longest verbatim match at each place.  Documents are
judged by the words inside such matches.

Training suffixes that cannot start a match are left out of the array before it is sorted: a match consists of
benchmark words only, so a suffix must start a run of at least as many benchmark words as the shortest window.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text, each broadcast on its own; a larger benchmark
means more blocks, over the same documents, whose matches are added up per document.  The matches of one block are
checkpointed before the next but one is read, so the driver holds two blocks and the executors one.

Defined results: a null or empty text has no words and is clean; an item without words matches nothing; repeated rows
are judged once each; items that repeat a text or an item_id each count; an item with a null item_id is matched like any other, but stands in
no list of item_ids; an empty table or
an empty benchmark gives clean results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm import text as tx
from hashtrend.llm.groups import checkpoint, documents_of, release_memory

WINDOW = 13
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20

_FOUND = "doc_id long, text_key long, n_words long, n_hit long, item_ids array<string>, spans array<struct<item_id:long,item_word:int,doc_word:long,n_words:long>>"


class Items:
    """The words of a block of benchmark items and their windows."""

    def __init__(self, rows: list[tuple[int | None, str]], window: int):
        texts = pa.array([t for _, t in rows], pa.string())
        data, offsets = tx.flat(texts)
        data = tx.LOWER[data]
        starts, ends, first = tx.words(data, offsets, tx.ALNUM)
        self.hash = tx.word_hashes(data, starts, ends)
        raw = data.tobytes()
        #: distinct words, for the exact comparison behind each hash
        self.vocabulary, at = np.unique(self.hash, return_index=True)
        spelt = [raw[starts[i] : ends[i]] for i in at.tolist()]
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_lens = np.array([len(w) for w in spelt], np.int64)
        self.spelt_from = np.cumsum(self.spelt_lens) - self.spelt_lens
        self.word = np.searchsorted(self.vocabulary, self.hash)
        lens = np.diff(first)
        self.names = [i for i, _ in rows]
        # windows: every run of ``window`` words; a shorter item is one window
        size = np.minimum(lens, window)
        count = np.where(lens > 0, lens - size + 1, 0)
        self.item = np.repeat(np.arange(len(rows)), count)
        self.place = tx.ranges(np.zeros(len(rows), np.int64), count)
        self.start = first[:-1][self.item] + self.place
        self.size = size[self.item]
        self.left = (first[1:][self.item] - self.start) if len(self.item) else np.zeros(0, np.int64)
        self.least = int(self.size.min()) if len(self.size) else 0
        self.window = window
        # a bit table that passes every benchmark word and few others
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.vocabulary & tx.U64((1 << 20) - 1)).astype(np.int64)] = True

    def spelt_as(self, word: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each document word has the very bytes of the benchmark word that shares its hash."""
        lens = ends - starts
        same = lens == self.spelt_lens[word]
        at = np.flatnonzero(same)
        for lo in range(0, len(at), 1 << 16):  # a bounded number of words at a time
            k = at[lo : lo + (1 << 16)]
            equal = data[tx.ranges(starts[k], lens[k])] == self.spelt[tx.ranges(self.spelt_from[word[k]], lens[k])]
            same[k] = np.logical_and.reduceat(equal, np.cumsum(lens[k]) - lens[k])
        return same


def shard_suffixes(items: Items, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
    """(benchmark word of every training word or -1, suffix array of the training suffixes that can start a match)."""
    h = tx.word_hashes(data, starts, ends)
    word = np.full(len(h), -1, np.int64)
    maybe = np.flatnonzero(items.table[(h & tx.U64((1 << 20) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.vocabulary, h[maybe]), len(items.vocabulary) - 1)
    word[maybe] = np.where(items.vocabulary[at] == h[maybe], at, -1)
    # words left in the run of benchmark words that starts here, within the document
    n = len(word)
    stop = np.zeros(n + 1, bool)
    stop[:n] = word < 0
    stop[first] = True  # first[-1] == n
    places = np.flatnonzero(stop)
    run = places[np.searchsorted(places, np.arange(1, n + 1))] - np.arange(n)
    run[word < 0] = 0
    suffixes = np.flatnonzero(run >= items.least)
    depth = np.minimum(run[suffixes], items.window)
    padded = np.concatenate((word, np.full(items.window, -1)))
    keys = [np.where(depth > k, padded[suffixes + k], -1) for k in range(items.window - 1, -1, -1)]
    order = np.lexsort(keys) if len(suffixes) else np.zeros(0, np.int64)
    return word, suffixes[order], run


def search(items: Items, word: np.ndarray, array: np.ndarray, run: np.ndarray):
    """Binary search of every benchmark window; (window, training word) of every occurrence."""
    lo = np.zeros(len(items.start), np.int64)
    hi = np.full(len(items.start), len(array), np.int64)
    padded = np.concatenate((word, np.full(items.window, -1)))
    for k in range(items.window):
        act = np.flatnonzero((items.size > k) & (hi > lo))
        if not len(act):
            break
        wanted = items.word[items.start[act] + k]
        lower, upper = lo[act], hi[act]
        for side in (0, 1):  # first place with word >= wanted, then with word > wanted
            a, b = (lower.copy(), upper.copy())
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) // 2
                suffix = array[np.minimum(mid, len(array) - 1)]
                have = np.where(np.minimum(run[suffix], items.window) > k, padded[suffix + k], -1)
                right = open_ & ((have < wanted) if side == 0 else (have <= wanted))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            if side == 0:
                lo[act] = a
            else:
                hi[act] = a
    count = np.maximum(hi - lo, 0)
    window = np.repeat(np.arange(len(lo)), count)
    return window, array[tx.ranges(lo, count)]


def _judge(items: Items, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> dict[str, list]:
    data = tx.LOWER[data]
    starts, ends, first = tx.words(data, offsets, tx.ALNUM)
    out: dict[str, list] = {"doc_id": ids, "n_words": np.diff(first)}
    hits, names, spans = np.zeros(len(ids), np.int64), [[] for _ in ids], [[] for _ in ids]
    if items.least and len(starts):
        word, array, run = shard_suffixes(items, data, starts, ends, first)
        window, at = search(items, word, array, run)
        # the words themselves, not only their hashes; each place of the documents once, however many windows hold it
        covered = np.zeros(len(starts) + 1, np.int32)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + items.size[window], -1)
        place = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
        bad = np.zeros(len(starts) + 1, np.int64)
        bad[place + 1] = ~items.spelt_as(word[place], data, starts[place], ends[place])
        bad = np.cumsum(bad)
        same = bad[at + items.size[window]] == bad[at]
        window, at = window[same], at[same]
        if len(at):
            doc = np.searchsorted(first, at, side="right") - 1
            mark = np.zeros(len(starts) + 1, np.int32)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + items.size[window], -1)
            hit = np.cumsum(mark)[:-1] > 0
            hits = np.add.reduceat(np.concatenate((hit, [False])).astype(np.int64), first[:-1])
            hits[np.diff(first) == 0] = 0
            # longest match of each occurrence: chains of windows that advance together
            order = np.lexsort((items.start[window], items.start[window] - at))
            window, at, doc = window[order], at[order], doc[order]
            chained = np.zeros(len(at), bool)
            chained[1:] = (
                (at[1:] == at[:-1] + 1)
                & (items.start[window][1:] == items.start[window][:-1] + 1)
                & (items.item[window][1:] == items.item[window][:-1])
                & (doc[1:] == doc[:-1])
            )
            heads = np.flatnonzero(~chained)
            lens = np.diff(np.concatenate((heads, [len(at)]))) - 1 + items.size[window[heads]]
            for i, n in zip(heads.tolist(), lens.tolist(), strict=True):
                w = window[i]
                spans[doc[i]].append(
                    {"item_id": items.names[items.item[w]], "item_word": int(items.place[w]), "doc_word": int(at[i] - first[doc[i]]), "n_words": n}
                )
                if (name := items.names[items.item[w]]) is not None:
                    names[doc[i]].append((int(items.item[w]), str(name)))
    out["n_hit"], out["spans"] = hits, spans
    out["item_ids"] = [[name for _, name in sorted(set(x), key=lambda p: p[1])] for x in names]
    return out


def benchmark_matches(docs: DataFrame, block: Broadcast) -> DataFrame:
    """Longest verbatim matches of one block of benchmark items (broadcast ``Items``) in every document."""
    docs = documents_of(docs).withColumn("text_key", F.xxhash64("text"))
    span = pa.struct([("item_id", pa.int64()), ("item_word", pa.int32()), ("doc_word", pa.int64()), ("n_words", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        own = block.value
        for batch in batches:
            step = max(1, int(batch.num_rows * SHARD_BYTES / max(1, batch.nbytes)))
            for lo in range(0, batch.num_rows, step):
                piece = batch.slice(lo, step)
                data, offsets = tx.flat(piece.column("text"))
                found = _judge(own, tx.longs(piece.column("doc_id")), data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        tx.ids_out(found["doc_id"]),
                        piece.column("text_key"),
                        pa.array(found["n_words"], pa.int64()),
                        pa.array(found["n_hit"], pa.int64()),
                        pa.array(found["item_ids"], pa.list_(pa.string())),
                        pa.array(found["spans"], pa.list_(span)),
                    ],
                    ["doc_id", "text_key", "n_words", "n_hit", "item_ids", "spans"],
                )

    return docs.mapInArrow(scan, _FOUND)


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark in blocks of bounded size, each read on its own."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(
        "text is not null"
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    if blocks <= 1:
        yield [(r.item_id, r.text) for r in rows.orderBy("item_id", "text").collect()]
        return
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * blocks)))
    for k in range(2 * blocks):
        yield [(r.item_id, r.text) for r in dealt.filter(F.col("block") == k).orderBy("item_id", "text").collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, item_ids (items with a window in the document, sorted as strings, one entry an item)
    and spans (longest verbatim matches) of every document.

    With several blocks, a word is hit by any of them; the hits of blocks are merged through their spans.
    """
    share = docs.sparkSession.sparkContext.broadcast
    blocks = blocks_of(benchmark, block_bytes) if block_bytes else iter(())
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        return benchmark_matches(docs, share(Items(block, window)))
    every, n = None, 0
    while block is not None:
        shared = share(Items(block, window))
        part = checkpoint(benchmark_matches(docs, shared))
        shared.unpersist()
        every = part if every is None else every.unionByName(part)
        block, following, n = following, next(blocks, None), n + 1
    return merge_blocks(every, n)


def merge_blocks(found: DataFrame, blocks: int) -> DataFrame:
    """One row a document from the rows of all blocks; rows that repeat a document stay as many as they were."""
    merged = found.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.count("*").alias("rows"),
    )
    copies = (F.col("rows") / blocks).cast("int")
    starts = F.array_sort(F.transform("spans", lambda s: F.struct(s["doc_word"].alias("a"), (s["doc_word"] + s["n_words"]).alias("b"))))
    zero = F.lit(0).cast("long")
    covered = F.aggregate(
        starts,
        F.struct(zero.alias("n"), zero.alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(zero, s["b"] - F.greatest(acc["end"], s["a"]))).alias("n"),
            F.greatest(acc["end"], s["b"]).alias("end"),
        ),
    )
    # a repeated row found the same items and spans again in each block
    merged = merged.withColumns({"n_hit": covered["n"], "copy": F.explode(F.sequence(F.lit(1), copies))})
    once = lambda c: F.when(copies > 1, F.filter(c, lambda _, i: i % copies == 0)).otherwise(F.col(c))
    return merged.select("doc_id", "n_words", "n_hit", once("item_ids").alias("item_ids"), once("spans").alias("spans"), "text_key")


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns; each row is judged by its own text, whether its
    doc_id is null or repeated."""
    bad = decontaminate(docs, benchmark).filter(contaminated())
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["bad_key"])
    return docs.join(bad, same, "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """The definition itself, for small tables."""

    def split(t):
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        return bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in b).split(b" ")

    want: dict[tuple, list] = {}
    for i, (name, t) in enumerate(items):
        w = [x for x in split(t) if x]
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            want.setdefault(tuple(w[p : p + n]), []).append((i, name))
    sizes = {len(k) for k in want}
    out = {}
    for d, t in docs:
        w = [x for x in split(t) if x]
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in want:
                    hit.update(range(p, p + n))
                    found.update(want[k])
        names = sorted(str(x) for _, x in found if x is not None)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w))
    return out
