"""Toxicity by a subsequence string kernel and a support vector machine over Nystroem landmarks.

*Kernel.*  A sentence is a bag of units: its words with signs and digits dropped, runs of single letters joined (so
``i.d-i_o t`` and ``i d i o t`` are units).  Two units are compared by their common subsequences of three letters
within a span of ``SPAN``, each weighted DECAY ** span at both ends and normalised, so gaps and inserted characters
cost similarity but do not break it.

*Learning.*  At most ``SAMPLE`` labelled rows train.  A sentence of a toxic document need not be toxic itself, so the
machine learns from witnesses: the units with most evidence (a likelihood ratio over documents) are the first positive
examples, units of clean documents the negative ones; after each fit, the best unit of every toxic document's best
sentence and the worst units of clean ones are the next examples.  Landmarks are bounded (``LANDMARKS``); an example's
features are its kernel values with them times the inverse root of their own kernel matrix.  As the machine is linear
in those, it folds into one weight per letter triple, which scores any unit.

*Documents.*  A sentence's margin is its best unit's; a document's score is a logistic function of its highest unit
margins and of how many are positive, fitted on the third of the sample that the machine did not see (near copies in the sample count once), weighted to the
class shares of all labelled training rows.

Defined results: a null or empty text has no units and scores like the least toxic unit; without labelled rows of both
classes the score is the share of toxic ones (0 without rows); rows with a null doc_id are held out; repeated rows are
scored once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm import text as tx
from hashtrend.llm.groups import documents_of
from hashtrend.llm.labelled import crc_remainder, labelled_sample, pieces

SPAN = 6  # a triple's last letter at most this far behind its first
DECAY = 0.6
LANDMARKS = 128
SAMPLE = 3000
ROUNDS = 3
EVIDENCE = 16.0  # likelihood-ratio statistic of a first positive example
_CODES = 1 << 15
_NO_MARGIN = -4.0

_PAIRS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]


def _symbols() -> np.ndarray:
    """Letters as 1..26, bytes of other letters as 27..31, all else 0 (dropped)."""
    s = np.zeros(256, np.uint8)
    s[ord("a") : ord("z") + 1] = np.arange(1, 27)
    s[0x80:] = 27 + np.arange(128) % 5
    return s


_SYMBOL = _symbols()


def units(column):
    """Distinct units of a column of texts.

    Returns (letters, begin, use, doc, n_docs): the letters of all distinct units, where each begins (one longer),
    and for every unit of the texts, in order, which distinct unit it is and its document.
    """
    data, offsets = tx.flat(column)
    data = tx.LOWER[data]
    n = len(offsets) - 1
    starts, ends, first = tx.words(data, offsets, tx.NOT_SPACE)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, np.zeros(1, np.int64), none, none, n
    symbol = _SYMBOL[data]
    letter = np.flatnonzero(symbol)
    word = np.searchsorted(starts, letter, side="right") - 1
    if not len(letter):
        return none, np.zeros(1, np.int64), none, none, n
    at = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    inside, count = word[at], np.diff(np.concatenate((at, [len(word)])))
    doc = np.searchsorted(first, inside, side="right") - 1
    # neighbouring words of one letter are one unit
    joins = np.zeros(len(inside), bool)
    joins[1:] = (count[1:] == 1) & (count[:-1] == 1) & (doc[1:] == doc[:-1]) & (inside[1:] == inside[:-1] + 1)
    head = np.flatnonzero(~joins)
    begin, doc = at[head], doc[head]
    letters = symbol[letter]
    stop = np.concatenate((begin[1:], [len(letters)]))
    h = tx.word_hashes(letters, begin, stop)
    distinct, where, use = np.unique(h, return_index=True, return_inverse=True)
    lens = (stop - begin)[where]
    own = letters[tx.ranges(begin[where], lens)].astype(np.int64)
    return own, np.concatenate(([0], np.cumsum(lens))), use, doc, n


def triples(letters: np.ndarray, begin: np.ndarray):
    """(unit, letter triple, weight) of every subsequence within the span, one pair of gaps at a time."""
    unit = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    for a, b in _PAIRS:
        if len(letters) > b:
            ok = np.flatnonzero(unit[b:] == unit[:-b])
            yield unit[ok], (letters[ok] << 10) | (letters[ok + a] << 5) | letters[ok + b], DECAY ** (b + 1)


def norms(begin: np.ndarray) -> np.ndarray:
    """Length of each unit's feature vector, from its number of letters."""
    lens = np.diff(begin)
    total = np.zeros(len(lens))
    for _, b in _PAIRS:
        total += np.maximum(lens - b, 0) * DECAY ** (2 * (b + 1))
    return np.sqrt(np.maximum(total, 1e-12))


def kernel_features(letters: np.ndarray, begin: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum over each unit's normalised triples of a table's values (one value or one row a triple)."""
    out = np.zeros((len(begin) - 1, *table.shape[1:]))
    for unit, code, weight in triples(letters, begin):
        if table.ndim == 1:
            out += np.bincount(unit, weights=table[code] * weight, minlength=len(out))
        else:
            np.add.at(out, unit, table[code] * weight)
    size = norms(begin)
    return out / (size if table.ndim == 1 else size[:, None])


def _flat_units(strings: list[bytes]):
    begin = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)
    return np.frombuffer(b"".join(strings), np.uint8).astype(np.int64), begin


def _table_of(strings: list[bytes]) -> np.ndarray:
    """Normalised feature vectors of a few units, one column each."""
    letters, begin = _flat_units(strings)
    size = norms(begin)
    table = np.zeros((_CODES, len(strings)))
    for unit, code, weight in triples(letters, begin):
        np.add.at(table, (code, unit), weight / size[unit])
    return table


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20000.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear support vector machine by gradient descent on the squared hinge loss."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-3
    weight = weight / weight.sum()
    top = 2 * c * np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + 1
    ahead, momentum = w.copy(), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        grad = ridge * ahead - 2 * c * (x.T @ (weight * slack * y))
        new = ahead - grad / top
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / faster * (new - w)
        w, momentum = new, faster
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def document_features(margin: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Three highest unit margins, positive units (log) and their share, per document."""
    out = np.full((n, 5), _NO_MARGIN)
    out[:, 3:] = 0
    order = np.lexsort((-margin, doc))
    d, m = doc[order], margin[order]
    first = np.searchsorted(d, np.arange(n + 1))
    count = np.diff(first)
    for k in range(3):
        has = count > k
        out[has, k] = np.maximum(m[first[:-1][has] + k], _NO_MARGIN)
    positive = np.bincount(doc, weights=margin > 0, minlength=n)
    out[:, 3] = np.log1p(positive)
    out[:, 4] = positive / np.maximum(count, 1)
    return out


class Machine:
    """One weight per letter triple, a constant, and the logistic function over documents."""

    def __init__(self, table: np.ndarray, constant: float, curve: np.ndarray):
        self.table, self.constant, self.curve = table, constant, curve

    def margins(self, letters: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return kernel_features(letters, begin, self.table) + self.constant

    def score(self, column) -> np.ndarray:
        letters, begin, use, doc, n = units(column)
        margin = self.margins(letters, begin)[use] if len(use) else np.zeros(0)
        x = np.hstack((document_features(margin, doc, n), np.ones((n, 1))))
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def _apart(rows: list[tuple[list[bytes], int]]) -> list[tuple[list[bytes], int]]:
    """One of each family of near copies (two equal minimum hashes of four, twice), so that a copied text's words do
    not look like evidence."""
    seen: set = set()
    out = []
    for own, y in rows:
        h = np.array([zlib.crc32(u) for u in own], np.uint64)
        if len(h) >= 5:
            with np.errstate(over="ignore"):
                least = [int(tx.mix(h * tx.U64(k)).min()) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
            bands = {(y, 0, *least[:2]), (y, 1, *least[2:])}
            if bands & seen:
                continue
            seen |= bands
        out.append((own, y))
    return out


def evidence(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Likelihood-ratio statistic of a unit's documents by class; 0 where toxic documents do not hold it more."""
    n = n_bad + n_good
    total = 0.0
    for seen, size in ((bad, n_bad), (good, n_good)):
        for have, expect in ((seen, (bad + good) * size / n), (size - seen, (n - bad - good) * size / n)):
            total = total + have * np.log(np.maximum(have, 1e-12) / np.maximum(expect, 1e-12))
    return np.where(bad * n_good > good * n_bad, 2 * total, 0.0)


def fit(rows: list[tuple[list[bytes], int]], totals: dict[int, int]) -> Machine:
    """From (distinct units, label) of the sample's documents."""
    rows = _apart(rows)
    seen = [r for i, r in enumerate(rows) if i % 3 != 2]
    index: dict[bytes, int] = {}
    member, owner = [], []
    for d, (own, _) in enumerate(seen):
        for u in own:
            member.append(index.setdefault(u, len(index)))
            owner.append(d)
    strings = list(index)
    member, owner = np.array(member, np.int64), np.array(owner, np.int64)
    label = np.array([y for _, y in seen])
    bad = np.bincount(member, weights=label[owner], minlength=len(strings))
    good = np.bincount(member, minlength=len(strings)) - bad
    n_bad, n_good = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    tells = evidence(bad, good, n_bad, n_good)
    lens = np.array([len(s) for s in strings])
    letters, begin = _flat_units(strings)
    draw = np.random.default_rng(5)
    long_enough = np.flatnonzero(lens >= 3)
    clean = long_enough[good[long_enough] * n_bad >= bad[long_enough] * n_good]
    best = long_enough[np.argsort(-tells[long_enough], kind="stable")]
    positive = best[tells[best] >= EVIDENCE][:LANDMARKS]
    if len(positive) < 4:
        positive = best[:4]
    negative = draw.permutation(clean)[:3000]
    machine = None
    for _ in range(ROUNDS):
        marks = np.concatenate((positive[: LANDMARKS // 2], negative[: LANDMARKS // 2]))
        basis = _table_of([strings[i] for i in marks])
        own = basis.T @ basis
        value, vector = np.linalg.eigh(own)
        root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
        examples = np.concatenate((positive, negative))
        part_letters, part_begin = _flat_units([strings[i] for i in examples])
        x = kernel_features(part_letters, part_begin, basis) @ root
        y = np.where(np.arange(len(examples)) < len(positive), 1.0, -1.0)
        weight = np.where(y > 0, (1 + np.log1p(bad[examples])) / max(1, len(positive)), 1.0 / max(1, len(negative)))
        w, constant = hinge(x, y, weight)
        table = basis @ (root @ w)
        machine = Machine(table, constant, np.zeros(6))
        margin = machine.margins(letters, begin)
        # witnesses of toxic documents, and the worst units of clean ones
        order = np.lexsort((-margin[member], owner))
        top = np.flatnonzero(np.concatenate(([True], owner[order][1:] != owner[order][:-1]))) if len(order) else order
        best, of = member[order][top], owner[order][top]
        witness = np.unique(best[(label[of] == 1) & (margin[best] > 0)])
        witness = witness[(good[witness] * n_bad * 4 <= bad[witness] * n_good) & (lens[witness] >= 3)]
        positive = np.union1d(positive, witness)
        positive = positive[np.argsort(-tells[positive], kind="stable")]
        hard = clean[np.argsort(-margin[clean], kind="stable")[:1500]]
        negative = draw.permutation(np.setdiff1d(np.union1d(hard, draw.permutation(clean)[:3000]), positive))
    held = [r for i, r in enumerate(rows) if i % 3 == 2]
    if len({y for _, y in held}) < 2:
        held = rows
    letters, begin = _flat_units([u for own, _ in held for u in own])
    doc = np.repeat(np.arange(len(held)), [len(own) for own, _ in held])
    x = document_features(machine.margins(letters, begin), doc, len(held))
    y = np.array([y for _, y in held])
    share = np.array([max(1, (y == k).sum()) for k in (0, 1)], np.float64)
    weight = np.array([totals.get(k, 0) for k in (0, 1)])[y] / share[y]
    weight *= len(y) / weight.sum()
    machine.curve = logistic(x, y, weight)
    return machine


def _train(docs: DataFrame, labels: DataFrame, train: F.Column, sample: int) -> Machine | float:
    chosen, totals = labelled_sample(docs, labels, "toxic", train, sample)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            letters, begin, use, doc, n = units(batch.column("text"))
            raw = letters.astype(np.uint8).tobytes()
            pair = np.unique(doc * max(1, len(begin)) + use)
            own: list[list[bytes]] = [[] for _ in range(n)]
            for d, u in zip((pair // max(1, len(begin))).tolist(), (pair % max(1, len(begin))).tolist(), strict=True):
                own[d].append(raw[begin[u] : begin[u + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(own, pa.list_(pa.binary()))], ["doc_id", "label", "units"]
            )

    rows = chosen.mapInArrow(split, "doc_id long, label int, units array<binary>").toArrow().sort_by("doc_id").to_pylist()
    if len({r["label"] for r in rows}) < 2:
        return totals.get(1, 0) / max(1, sum(totals.values()))
    return fit([(sorted(r["units"]), r["label"]) for r in rows], totals)


def toxicity_scores(docs: DataFrame, labels: DataFrame, train: F.Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(_train(docs, labels, train, sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in pieces(batches):
            s = own.score(batch.column("text")) if isinstance(own, Machine) else np.full(batch.num_rows, float(own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = documents_of(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (~F.coalesce(train, F.lit(False))).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity_scores(docs, labels, crc_remainder(5) != 0)
