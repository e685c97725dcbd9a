"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are its lower-cased words, the shapes of its words (length, case, last character, repetition of the
word before), pairs of neighbouring shapes, and how varied and how long it is, hashed to ``TERMS`` places, with
logarithmic counts and inverse document frequencies.  The space is the span of the first ``RANK`` singular vectors of
a labelled sample of at most ``SAMPLE`` rows (half of each class); its labelled vectors, SAMPLE x RANK floats, are
broadcast.  Every document is projected and compared with all of them by exact blocked cosine products; its
``NEIGHBOURS`` nearest vote with their similarity, weighted so that the sample's classes count as often as they occur
among all labelled training rows.

Defined results: a null or empty text has the one-document-length term only and is scored like any other; without
labelled rows the score is 0.5; rows with a null doc_id are held out; repeated rows are scored once each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm import text as tx
from hashtrend.llm.groups import documents_of, release_memory
from hashtrend.llm.labelled import crc_remainder, labelled_sample, pieces

TERMS = 4096
SHAPES = 1024
RANK = 48
SAMPLE = 4096
NEIGHBOURS = 25
SHARPNESS = 8
_TERMS_AT_ONCE = 1 << 16
_PIECE_BYTES = 1 << 20  # of whole rows, in a pipeline whose workers hold what earlier stages left


def _kinds() -> np.ndarray:
    kind = np.full(256, 1, np.int64)  # other signs
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[0x80:] = 0
    for i, c in enumerate(b".,!?*%&#$|:;-()"):
        kind[c] = 4 + i
    return kind


_KIND = _kinds()


def term_counts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document, term, log count) of a column of texts, sorted by document, and the number of documents."""
    data, offsets = tx.flat(column)
    starts, ends, first = tx.words(data, offsets, tx.NOT_SPACE)
    n, n_words = len(offsets) - 1, np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    h = tx.word_hashes(tx.LOWER[data], starts, ends)
    lens = ends - starts
    places, docs_ = [], []
    if len(starts):
        upper = np.add.reduceat((_KIND[data] == 2).astype(np.int64), starts)
        case = np.where(upper == 0, 0, np.where(upper * 2 > lens, 2, 1))
        again = np.zeros(len(h), np.int64)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        coarse = (case * 20 + _KIND[data[ends - 1]]) * 2 + again
        shape = coarse * 8 + np.minimum(lens // 3, 7)
        pair = coarse[:-1] * 251 + coarse[1:]
        same = doc[:-1] == doc[1:]
        spread = lambda x, size: (tx.mix(x.astype(np.uint64) * tx.U64(0x9E3779B97F4A7C15)) % tx.U64(size)).astype(np.int64)
        with np.errstate(over="ignore"):
            places = [spread(shape, SHAPES), SHAPES + spread(pair[same], SHAPES), 2 * SHAPES + spread(h, TERMS - 2 * SHAPES - 64)]
        docs_ = [doc, doc[:-1][same], doc]
    key = np.concatenate([d * TERMS + p for d, p in zip(docs_, places, strict=True)]) if docs_ else np.zeros(0, np.int64)
    key, count = np.unique(key, return_counts=True)
    weight = np.log1p(count)
    # variety and length of the whole document
    distinct = np.zeros(n, np.int64)
    if len(h):
        order = np.lexsort((h, doc))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        distinct = np.bincount(doc[order][new], minlength=n)
    variety = np.where(n_words > 0, distinct * 15 // np.maximum(n_words, 1), 0)
    length = np.minimum(np.log2(n_words + 1).astype(np.int64), 15)
    extra = np.arange(n) * TERMS + TERMS - 64
    key = np.concatenate((key, extra + variety, extra + 16 + length))
    weight = np.concatenate((weight, np.full(n, 3.0), np.full(n, 1.0)))
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    return key // TERMS, key % TERMS, weight, n


def project(column, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit latent vectors of a column of texts."""
    doc, term, weight, n = term_counts(column)
    out = np.zeros((n, axes.shape[1]), np.float32)
    if not n:
        return out
    weight = (weight * idf[term]).astype(np.float32)
    first = np.searchsorted(doc, np.arange(n + 1))
    norm = np.sqrt(np.add.reduceat(weight * weight, first[:-1]))
    lo = 0
    while lo < n:  # a bounded number of terms at a time
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + _TERMS_AT_ONCE, side="right")) - 1)
        a, b = first[lo], first[hi]
        rows = axes[term[a:b]]
        rows *= weight[a:b, None]
        out[lo:hi] = np.add.reduceat(rows, first[lo:hi] - a, axis=0)
        lo = hi
    out /= np.maximum(norm, 1e-12)[:, None]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class Neighbours:
    """Labelled latent vectors and the space they live in."""

    def __init__(self, idf, axes, vectors, labels, class_weight):
        self.idf, self.axes, self.vectors, self.labels, self.class_weight = idf, axes, vectors, labels, class_weight

    @classmethod
    def fit(cls, sample: DataFrame, totals: dict[int, int], rank: int = RANK) -> Neighbours | None:
        schema = "doc_id long, label int, term array<int>, weight array<float>"

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                doc, term, weight, n = term_counts(batch.column("text"))
                cut = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                lists = lambda x, t: pa.ListArray.from_arrays(pa.array(cut), pa.array(x, t))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("label"), lists(term, pa.int32()), lists(weight, pa.float32())],
                    ["doc_id", "label", "term", "weight"],
                )

        rows = sample.mapInArrow(features, schema).toArrow().sort_by("doc_id")
        if not rows.num_rows:
            return None
        labels = rows["label"].to_numpy().astype(np.float64)
        x = np.zeros((rows.num_rows, TERMS), np.float32)
        lens = np.array([len(t) for t in rows["term"]])
        at = np.repeat(np.arange(rows.num_rows), lens)
        x[at, rows["term"].combine_chunks().flatten().to_numpy()] = rows["weight"].combine_chunks().flatten().to_numpy()
        idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
        x *= idf.astype(np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        # randomised range finder for the leading singular vectors
        draw = np.random.default_rng(11).standard_normal((TERMS, min(rank + 16, *x.shape))).astype(np.float32)
        q = np.linalg.qr(x @ draw)[0]
        for _ in range(4):
            q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
        axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
        vectors = x @ axes
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        share = np.array([max(1, (labels == k).sum()) for k in (0, 1)], np.float64)
        weight = np.array([totals.get(k, 0) for k in (0, 1)]) / share
        return cls(idf.astype(np.float32), axes, vectors.astype(np.float32), labels, weight)

    def score(self, column, neighbours: int = NEIGHBOURS, block: int = 1024) -> np.ndarray:
        z = project(column, self.idf, self.axes)
        out = np.empty(len(z))
        k = min(neighbours, len(self.labels))
        for lo in range(0, len(z), block):
            cos = z[lo : lo + block] @ self.vectors.T
            near = np.empty((len(cos), k), np.int64)
            for at in range(0, len(cos), 64):  # bounded intermediate
                near[at : at + 64] = np.argpartition(-cos[at : at + 64], k - 1, axis=1)[:, :k]
            label = self.labels[near]
            vote = np.maximum(np.take_along_axis(cos, near, 1), 1e-6).astype(np.float64) ** SHARPNESS
            vote *= np.where(label == 1, self.class_weight[1], self.class_weight[0])
            out[lo : lo + block] = (vote * label).sum(1) / vote.sum(1)
        return np.clip(out, 0.0, 1.0)


def quality_scores(docs: DataFrame, labels: DataFrame, train: F.Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    chosen, totals = labelled_sample(docs, labels, "quality", train, sample)
    model = docs.sparkSession.sparkContext.broadcast(Neighbours.fit(chosen, totals))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in pieces(batches):
            s = own.score(batch.column("text")) if own else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = documents_of(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (~F.coalesce(train, F.lit(False))).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, train: F.Column, sample: int = SAMPLE) -> DataFrame:
    """The documents predicted to be of good quality, with all their columns."""
    chosen, totals = labelled_sample(docs, labels, "quality", train, sample)
    model = docs.sparkSession.sparkContext.broadcast(Neighbours.fit(chosen, totals))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in pieces(batches, _PIECE_BYTES):
            text = batch.column("text")
            s = own.score(text) if own else np.full(batch.num_rows, 0.5)
            yield batch.filter(pa.array(s >= 0.5))
            del text, s
            release_memory()

    return docs.mapInArrow(keep, docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_scores(docs, labels, crc_remainder(3) != 1)
