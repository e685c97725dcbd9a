"""Spelling variants: words of a corpus that differ by one edit, grouped under their commonest form.

1. *Words.*  Runs of letters of the whole texts, lower-cased (A-Z only); ``typos`` deletes a code point of some runs, as
   a contract asks.  Each task counts words in a table of bounded size, and the counts are summed per word.
2. *Near words.*  Two words one edit apart agree in their first ``KEY`` code points, or else in their last ``KEY``.  So
   the vocabulary is scanned twice, in sorted order of the words and of the reversed words; a pair that the first scan
   finds is left out of the second.  A list is the sorted words that share ``KEY`` leading code points; lists of more
   than ``BLOCK`` words are cut into blocks, and every pair of blocks is a *tile* (``tiles``), so no task holds more
   than two blocks however common a beginning is.
3. *Scan.*  For each query word the sorted list of a tile is read from top to bottom.  The edit matrix between the list's
   word and the query is kept as a stack of rows, one per code point, only the band of three cells around the diagonal,
   with values above one edit as "two" (``_NEXT`` tabulates the step from row to row).  Neighbours in the list share
   rows up to their longest common prefix, so only the rest is computed; a row without a cell of at most one edit ends
   the word, and all words that share the prefix up to that row are skipped by links to the next smaller common prefix.
4. *Forms.*  A word's form is its near word of largest count, if that is at least ``RATIO`` times its own.  Counts grow
   at least ``RATIO``-fold along forms, so the chains are short; roots come from repeated doubling of the links.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one in the deletion rule; repeated
rows count again; ties for the form go to the smallest word in code-point order; an empty table gives an empty result;
other columns are ignored.  Long texts are read in pieces cut between runs.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm.groups import checkpoint, documents_of, shuffle_partitions
from hashtrend.llm.labelled import pieces

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
KEY = 3
BLOCK = 1 << 14
TASK_WORDS = 20_000
TABLE_WORDS = 1 << 19
PAIR_ROWS = 1 << 16
PIECE_CHARS = 1 << 20
_RUN = re.compile("[a-zÀ-ÿ]+")
_NOT_RUN = re.compile("[^a-zÀ-ÿ]")


def typos(prefix: int, run: str) -> str:
    """The run without the code point that its hash names, where 31 divides the hash; ``prefix`` is the crc32 of
    ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def runs_of(text: str) -> Iterator[list[str]]:
    """The runs of a lower-cased text, a bounded piece of text at a time."""
    lo = 0
    while lo < len(text):
        hi = lo + PIECE_CHARS
        if hi < len(text):
            m = _NOT_RUN.search(text, hi)
            hi = m.start() if m else len(text)
        yield _RUN.findall(text, lo, hi)
        lo = hi


def word_counts(docs: DataFrame, change: Callable[[int, str], str] | None = typos, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of all words of at least ``least`` code points; ``change`` is applied to every run of a document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in pieces(batches):
            for doc_id, blob in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                if not blob:
                    continue
                text = blob.lower().decode("utf-8", "replace")
                prefix = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for runs in runs_of(text):
                    for run, n in Counter(runs).items():
                        if len(run) >= least:
                            word = change(prefix, run) if change else run
                            if len(word) >= least:
                                held[word] += n
                    if len(held) >= TABLE_WORDS:
                        yield emit()
        if held:
            yield emit()

    rows = documents_of(docs).select("doc_id", F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- one sorted list, one query -----------------------------------------------------------------------------------


def _steps() -> tuple[list[int], list[tuple[int, int, int]]]:
    """Band rows (three cells, each 0, 1 or 2 for more) by number, and the row that follows each for the eight ways in
    which the list's code point can equal the query's at the three columns."""
    rows = [(a, b, c) for a in range(3) for b in range(3) for c in range(3)]
    number = {r: k for k, r in enumerate(rows)}
    out = []
    for left, mid, right in rows:
        for bits in range(8):
            x = min(mid + 1, left + (not bits & 1), 2)
            y = min(right + 1, mid + (not bits & 2), x + 1, 2)
            z = min(right + (not bits & 4), y + 1, 2)
            out.append(number[(int(x), int(y), int(z))])
    return out, rows


_NEXT, _ROWS = _steps()
_DEAD = _ROWS.index((2, 2, 2))
#: the row at a prefix that both words share: the diagonal is 0, one column off is 1
_START = _ROWS.index((1, 0, 1))
_NEAR_AT_END = {1: [r[0] < 2 for r in _ROWS], 0: [r[1] < 2 for r in _ROWS], -1: [r[2] < 2 for r in _ROWS]}


class SortedList:
    """A sorted list of distinct words with what a scan needs: common prefixes and where a smaller one follows."""

    def __init__(self, words: list[str]):
        self.words = words
        n = len(words)
        self.lcp = [0] * (n + 1)
        for k in range(1, n):
            a, b = words[k - 1], words[k]
            most = min(len(a), len(b))
            d = 0
            while d < most and a[d] == b[d]:
                d += 1
            self.lcp[k] = d
        self.lcp[n] = -1
        self.smaller = [n] * (n + 1)  # the next place with a smaller common prefix
        stack: list[int] = []
        for k in range(n + 1):
            while stack and self.lcp[stack[-1]] > self.lcp[k]:
                self.smaller[stack.pop()] = k
            stack.append(k)

    def near(self, query: str, shared: int) -> list[int]:
        """Places of the words one edit from ``query``; the list and the query share ``shared`` leading code points."""
        words, lcp, smaller, step = self.words, self.lcp, self.smaller, _NEXT
        n, m = len(words), len(query)
        # columns before the first and behind the last code point equal nothing
        padded = "\0" + query + "\0\0\0"
        rows = [_START] * (m + 2)  # rows[d]: after d code points of the list's word
        found = []
        k, depth = 0, shared  # rows up to ``depth`` hold for the word at k
        while k < n:
            word = words[k]
            length = len(word)
            d = depth
            state = rows[d]
            dead = 0  # nothing that shares so many code points is near
            while d < length:
                if d > m:
                    dead = d + 1
                    break
                c = word[d]
                state = step[state * 8 + (c == padded[d]) + 2 * (c == padded[d + 1]) + 4 * (c == padded[d + 2])]
                d += 1
                if state == _DEAD:
                    dead = d
                    break
                rows[d] = state
            k += 1
            if dead:
                while lcp[k] >= dead:
                    k = smaller[k]
            elif -1 <= length - m <= 1 and _NEAR_AT_END[length - m][state] and word != query:
                found.append(k - 1)
            depth = lcp[k]
        return found


def scan_tile(words: list[str], counts: list[int], block: list[int], p: int, q: int) -> Iterator[tuple[str, str, int]]:
    """(word, near word, its count) for the pairs of a tile; ``words`` is sorted, ``block`` says whose each word is."""
    if p == q:
        listing = SortedList(words)
        for query in words:
            for j in listing.near(query, KEY):
                yield query, words[j], counts[j]
        return
    listed = [k for k, b in enumerate(block) if b == p]
    listing = SortedList([words[k] for k in listed])
    for k, b in enumerate(block):
        if b == q:
            for at in listing.near(words[k], KEY):
                j = listed[at]
                yield words[k], words[j], counts[j]
                yield words[j], words[k], counts[k]


def tiles(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(back, key, p, q, block, item, n): every word in both scans, once per tile that holds its block."""
    both = vocabulary.select(
        F.explode(
            F.array(
                F.struct(F.lit(False).alias("back"), F.col("word").alias("item")),
                F.struct(F.lit(True).alias("back"), F.reverse("word").alias("item")),
            )
        ).alias("s"),
        "n",
    ).select("s.back", F.substring("s.item", 1, KEY).alias("key"), "s.item", "n")
    held = both.groupBy("back", "key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    cut = held.select("back", "key", F.ceil(F.col("held") / block).cast("int").alias("blocks"))
    dealt = both.join(cut, ["back", "key"]).withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    tile = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return dealt.select("*", tile).select(
        "back", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "item", "n"
    )


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): both directions of every pair of words one edit apart; ``vocabulary`` is (word, n) with
    distinct words of at least ``2 * KEY + 1`` code points."""

    def pairs(rows: Iterator[tuple]) -> Iterator[tuple[str, str, int]]:
        """Pairs of all tiles; rows come sorted by tile and word, and one tile is held at a time."""
        for (back, _, p, q), tile in groupby(rows, key=lambda r: r[:4]):
            own = list(tile)
            for word, near, n in scan_tile([r[5] for r in own], [r[6] for r in own], [r[4] for r in own], p, q):
                if not back:
                    yield word, near, n
                elif word[-KEY:] != near[-KEY:]:  # else they agree in front too, and the first scan has found them
                    yield word[::-1], near[::-1], n

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("back", "key", "p", "q", "block", "item", "n")
        rows = (r for batch in batches for r in zip(*[batch.column(c).to_pylist() for c in names], strict=True))
        found = pairs(rows)
        while some := list(islice(found, PAIR_ROWS)):
            word, near, n = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])

    # a scan costs far more than its bytes tell, so the number of tasks follows the words
    tasks = max(shuffle_partitions(vocabulary.sparkSession), math.ceil(vocabulary.count() / TASK_WORDS))
    sorted_ = tiles(vocabulary, block).repartition(tasks, "back", "key", "p", "q").sortWithinPartitions("back", "key", "p", "q", "item")
    return sorted_.mapInArrow(scan, "word string, near string, near_n long")


def roots(forms: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, root): the last form reached from each word of ``forms(word, form, form_n)``.

    Counts grow at least ``ratio``-fold from form to form, so a chain has at most log(largest count) steps; every round
    doubles the steps that a link spans."""
    forms = checkpoint(forms.select("word", F.col("form").alias("root"), "form_n"))
    largest = forms.agg(F.max("form_n")).first()[0]
    links = forms.select("word", "root")
    if largest is None:
        return links
    steps = max(1, math.ceil(math.log(max(2, largest), ratio)) + 1)
    for _ in range(math.ceil(math.log2(steps))):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = checkpoint(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return links


def spelling_variants(
    docs: DataFrame,
    change: Callable[[int, str], str] | None = None,
    least: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    block: int = BLOCK,
) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of at least ``least`` code points and ``least_count``
    occurrences."""
    if least < 2 * KEY + 1:
        raise ValueError(f"words need at least {2 * KEY + 1} code points, not {least}")
    vocabulary = checkpoint(word_counts(docs, change, least).filter(F.col("n") >= least_count))
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best")
    near = near_words(vocabulary, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    formed = F.col("best.minus_n") * -1 >= ratio * F.col("n")
    rows = checkpoint(
        vocabulary.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("best.near")).alias("form"),
            F.when(formed, F.col("best.minus_n") * -1).alias("form_n"),
        )
    )
    ends = roots(rows.filter("form is not null"), ratio)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), typos)
