"""Hidden Markov language model: Baum-Welch over all training documents, exact scaled forward scores.

Tokens are lower-cased words and one end per document.  The word counts of all training documents give the unigram
base.  The model writes a text as a walk through ``states`` hidden states, each of which emits a *class*; the class
emits the word.  The commonest ``top_words`` words are classes of their own, other known words fall into
``tail_classes`` classes by their last three bytes, the end is a class, and all unknown words together are one.
Within a class a word has its share of the unigram base, so with one state the model would be the base itself.

Training: every chunk of documents (``lexicon``) becomes class sequences, checkpointed once.  Each Baum-Welch round
broadcasts the parameters (states x classes, fixed by the parameters above), runs the scaled forward and backward
recursions over all training sequences in their partitions, and sums the expected counts.  For training, a document
is read as consecutive sequences of ``TRAIN_SPAN`` tokens; scores run the forward recursion over whole documents.

The class of unknown words gets the share that words seen once have among the training tokens.

Defined results: a null or empty text is the end alone; a row with a null doc_id is held out; repeated rows are scored
(and, outside the held-out part, learnt from) once each; without training documents the score is the base score; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm import text as tx
from hashtrend.llm.groups import checkpoint, documents_of, pack, shuffle_partitions, unpack, unpack_bytes
from hashtrend.llm.lexicon import ask, empty_table, pack_strings, unpack_strings, with_answers, word_chunks

STATES = 8
ROUNDS = 6
TOP_WORDS = 4096
TAIL_CLASSES = 1024
TRAIN_SPAN = 256
_BATCH = 4096  # training sequences at a time in a task
_SUMS = 32  # rows of expected counts that reach the driver


def remainder(divisor: int) -> F.Column:
    """crc32 of the doc_id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def _tail_class(word: bytes, tails: int) -> int:
    return zlib.crc32(word[-3:]) % tails


def _report(top: int, tails: int):
    """Of a bucket: distinct and all training occurrences, words seen once, class masses, commonest words."""

    def report(words, sums) -> bytes:
        known = np.flatnonzero(sums > 0)
        mass = np.zeros(tails)
        for i in known.tolist():
            mass[_tail_class(words[i], tails)] += sums[i] + 0.5
        best = sorted(known.tolist(), key=lambda i: (-sums[i], words[i]))[:top]
        head = np.array([len(known), sums.sum(), (sums == 1).sum()], np.float64)
        numbers = np.concatenate((head, mass, sums[best].astype(np.float64)))
        return pack_strings([numbers.tobytes(), *[words[i] for i in best]])

    return report


def _open_report(blob: bytes, tails: int):
    """(totals and class masses, [(word, count)]) of a report."""
    lens, raw = unpack_strings(blob)
    numbers = np.frombuffer(raw[: lens[0]], np.float64)
    at = np.concatenate((lens[:1], lens[0] + np.cumsum(lens[1:])))
    names = [raw[at[i] : at[i + 1]] for i in range(len(lens) - 1)]
    return numbers[: 3 + tails], list(zip(names, numbers[3 + tails :].tolist(), strict=True))


def _merge_reports(blobs: list[bytes], top: int, tails: int):
    opened = [_open_report(b, tails) for b in blobs]
    best = sorted((pair for _, words in opened for pair in words), key=lambda p: (-p[1], p[0]))[:top]
    return np.sum([n for n, _ in opened], axis=0), best


def _statistics(answers: DataFrame, top: int, tails: int):
    """(distinct, total, once, class masses, [(word, count)] of the commonest) over all buckets.

    Reports merge to a fixed number of rows, of bounded size each, before they reach the driver.
    """

    def merge(key, table):
        numbers, best = _merge_reports(table["answers"].to_pylist(), top, tails)
        numbers = np.concatenate((numbers, [n for _, n in best]))
        return pa.table({"answers": pa.array([pack_strings([numbers.tobytes(), *[w for w, _ in best]])], pa.binary())})

    rows = answers.filter("chunk = -1").select((F.col("bucket") % _SUMS).alias("s"), "answers").groupBy("s").applyInArrow(merge, "answers binary")
    numbers, best = _merge_reports([bytes(r.answers) for r in rows.collect()] or [_report(top, tails)([], np.zeros(0, np.int64))], top, tails)
    return numbers[0], numbers[1], numbers[2], numbers[3:].copy(), best


class Model:
    """Start, transition and emission probabilities; emissions by class, one row a class."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, base: np.ndarray, states: int, seed: int = 7) -> Model:
        draw = np.random.default_rng(seed)
        emit = base[:, None] * draw.uniform(0.5, 1.5, (len(base), states))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1.0 / states), move, emit / emit.sum(0))

    def size(self) -> int:
        k = len(self.start)
        return k + k * k + self.emit.size


def _steps(lens: np.ndarray) -> np.ndarray:
    """Sequences still running at each step, given descending lengths."""
    return np.searchsorted(-lens, -np.arange(lens[0]), side="left") if len(lens) else np.zeros(0, np.int64)


def forward(model: Model, classes: np.ndarray, first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """log10 probability of each class sequence ``classes[first : first + len]`` by the scaled recursion."""
    order = np.argsort(-lens, kind="stable")
    at, run = first[order], lens[order]
    score = np.zeros(len(lens))
    a = np.zeros((0, len(model.start)))
    for t, n in enumerate(_steps(run).tolist()):
        e = model.emit[classes[at[:n] + t]]
        a = model.start * e if t == 0 else (a[:n] @ model.move) * e
        c = a.sum(1)
        a /= c[:, None]
        score[:n] += np.log10(c)
    out = np.empty(len(lens))
    out[order] = score
    return out


def expected_counts(model: Model, classes: np.ndarray, first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Baum-Welch: expected starts, moves and emissions of the sequences, flattened."""
    k, n_classes = len(model.start), len(model.emit)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, n_classes))
    order = np.argsort(-lens, kind="stable")
    for lo in range(0, len(order), _BATCH):
        own = order[lo : lo + _BATCH]
        at, run = first[own], lens[own]
        steps = _steps(run).tolist()
        alpha, emitted, scale = [], [], []
        a = None
        for t, n in enumerate(steps):
            e = model.emit[classes[at[:n] + t]]
            a = model.start * e if t == 0 else (a[:n] @ model.move) * e
            c = a.sum(1)
            a = a / c[:, None]
            alpha.append(a)
            emitted.append(e)
            scale.append(c)
        beta = np.ones((0, k))
        gammas = [None] * len(steps)
        for t in range(len(steps) - 1, -1, -1):
            n = steps[t]
            ahead = len(beta)
            if ahead:
                right = emitted[t + 1] * beta / scale[t + 1][:, None]
                move += model.move * (alpha[t][:ahead].T @ right)
                beta = np.concatenate((right @ model.move.T, np.ones((n - ahead, k))))
            else:
                beta = np.ones((n, k))
            gammas[t] = alpha[t] * beta
        start += gammas[0].sum(0)
        seen = np.concatenate([classes[at[:n] + t] for t, n in enumerate(steps)])
        gamma = np.concatenate(gammas)
        for s in range(k):
            emit[s] += np.bincount(seen, weights=gamma[:, s], minlength=n_classes)
    return np.concatenate((start, move.ravel(), emit.T.ravel()))


def _updated(model: Model, counts: np.ndarray, base: np.ndarray, unknown: int) -> Model:
    k = len(model.start)
    start, move, emit = counts[:k] + 1, counts[k : k + k * k].reshape(k, k) + 0.1, counts[k + k * k :].reshape(-1, k)
    emit = emit + 10.0 * base[:, None]
    emit[unknown] = 0
    emit *= (1 - base[unknown]) / emit.sum(0)
    emit[unknown] = base[unknown]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit)


def _train_round(sequences: DataFrame, model: Model) -> np.ndarray:
    shared = sequences.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))
    size = model.size()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, seen = Model(*shared.value), np.zeros(size), 0
        for batch in batches:
            for row in batch.to_pylist():
                classes = unpack(row["classes"], np.uint16)
                lens = unpack(row["n_words"], np.int64) + 1
                first = np.cumsum(lens) - lens
                marks = unpack(row["marks"], np.bool_)
                lens, first = lens[marks], first[marks]
                parts = -(-lens // TRAIN_SPAN)
                piece = tx.ranges(np.zeros(len(lens), np.int64), parts)
                whole = np.repeat(lens, parts)
                if len(lens):
                    seen += 1
                    total += expected_counts(
                        own, classes, np.repeat(first, parts) + piece * TRAIN_SPAN, np.minimum(TRAIN_SPAN, whole - piece * TRAIN_SPAN)
                    )
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    def add(key, table):
        total = np.sum([np.frombuffer(b, np.float64) for b in table["counts"].to_pylist()], axis=0)
        return pa.table({"counts": pa.array([total.tobytes()], pa.binary())})

    counted = sequences.select("classes", "n_words", "marks").mapInArrow(count, "counts binary")
    rows = counted.withColumn("s", F.spark_partition_id() % _SUMS).groupBy("s").applyInArrow(add, "counts binary").collect()
    shared.unpersist()
    return np.sum([np.frombuffer(r.counts, np.float64) for r in rows], axis=0) if rows else np.zeros(size)


_SEQUENCES = "doc_ids binary, marks binary, n_words binary, classes binary, n_known binary, base binary, inside binary"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def hmm_scores(
    docs: DataFrame, train: F.Column, states: int = STATES, rounds: int = ROUNDS, top_words: int = TOP_WORDS, tail_classes: int = TAIL_CLASSES
) -> DataFrame:
    """Scores of every document under the model learnt from the rows where ``train`` (of doc_id) holds."""
    spark = docs.sparkSession
    docs = documents_of(docs).withColumn("mark", F.coalesce(train, F.lit(False)))
    chunks = word_chunks(docs, fold=True)
    answers = checkpoint(ask(chunks, lambda words, sums: sums, np.int64, _report(top_words, tail_classes)))
    distinct, total, once, mass, best = _statistics(answers, top_words, tail_classes)
    ends = docs.filter("mark").count()
    total, distinct = total + ends, distinct + (ends > 0)
    scale = total + 0.5 * (distinct + 1)
    top = {w: i for i, (w, _) in enumerate(best)}
    for w, n in best:
        mass[_tail_class(w, tail_classes)] -= n + 0.5
    unknown, end = top_words + tail_classes, top_words + tail_classes + 1
    base = np.zeros(end + 1)
    base[: len(best)] = [n + 0.5 for _, n in best]
    base[top_words:unknown] = np.maximum(mass, 0)
    base[unknown] = 0.5
    base[end] = ends + 0.5 if ends else 0
    base /= scale
    log_class = np.log10(np.maximum(base, 1e-300))
    start_top = top_words

    def sequence(row: dict, blobs: list) -> pa.Table:
        counts = np.concatenate([unpack(b, np.int64) for b in blobs]) if blobs else np.zeros(0, np.int64)
        words = [w for p in sorted(row["parts"], key=lambda p: p["bucket"]) for w in unpack_bytes(p["words"]).split(b" ")]
        kind = np.fromiter((top.get(w, -1) for w in words), np.int64, len(words))
        tail = np.flatnonzero((kind < 0) & (counts > 0))
        kind[tail] = [start_top + _tail_class(words[i], tail_classes) for i in tail.tolist()]
        kind[counts == 0] = unknown
        n_words = unpack(row["n_words"], np.int64)
        local = unpack(row["sequence"], np.uint32)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        log_word = np.log10((counts + 0.5) / scale)
        known_end = ends > 0
        n_known = np.bincount(doc, weights=counts[local] > 0, minlength=len(n_words)).astype(np.int64) + known_end
        base_score = np.bincount(doc, weights=log_word[local], minlength=len(n_words)) + np.log10((ends + 0.5) / scale)
        inside = np.bincount(doc, weights=(log_word - log_class[kind])[local], minlength=len(n_words))
        classes = np.full(len(local) + len(n_words), end if known_end else unknown, np.uint16)
        classes[np.arange(len(local)) + doc] = kind[local]
        values = {
            "doc_ids": row["doc_ids"],
            "marks": row["marks"],
            "n_words": row["n_words"],
            "classes": pack(classes),
            "n_known": pack(n_known),
            "base": pack(base_score),
            "inside": pack(inside),
        }
        return pa.table({n: pa.array([v], pa.binary()) for n, v in values.items()})

    columns = ["chunk", "doc_ids", "n_words", "marks", "sequence", "parts"]
    sequences = checkpoint(with_answers(chunks, answers.filter("chunk >= 0"), sequence, _SEQUENCES, columns))

    seen_once = min(0.5, (once + 0.5) / scale)
    prior = base.copy()
    prior[unknown] = 0
    prior *= (1 - seen_once) / max(prior.sum(), 1e-300)
    prior[unknown] = seen_once if total else 1.0
    model = Model.initial(prior, states)
    for _ in range(rounds if total else 0):
        model = _updated(model, _train_round(sequences, model), prior, unknown)
    shared = spark.sparkContext.broadcast((model.start, model.move, model.emit))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                lens = unpack(row["n_words"], np.int64) + 1
                base_score, inside = unpack(row["base"], np.float64), unpack(row["inside"], np.float64)
                score = base_score
                if total:
                    score = inside + forward(own, unpack(row["classes"], np.uint16), np.cumsum(lens) - lens, lens)
                yield pa.RecordBatch.from_arrays(
                    [
                        tx.ids_out(unpack(row["doc_ids"], np.int64)),
                        pa.array(~unpack(row["marks"], np.bool_)),
                        pa.array(lens),
                        pa.array(unpack(row["n_known"], np.int64)),
                        pa.array(np.full(len(lens), int(total), np.int64)),
                        pa.array(base_score),
                        pa.array(score),
                    ],
                    [f.split()[0] for f in _OUT.split(", ")],
                )

    return sequences.mapInArrow(score, _OUT)


def op10_hmm_lm(spark, sf_dir: str) -> DataFrame:
    return hmm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder(5) != 1)
