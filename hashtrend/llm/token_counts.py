"""Token counts of whole texts without materialising ids.

The tokenizer drops white space and never joins characters across it, so a text's pre-tokens are its runs without
ASCII white space.  Each distinct pre-token of the corpus is encoded once (``lexicon.ask``); its number of pieces
meets the documents' pre-token frequencies, and the sum is the count.

Added special tokens written inside a text, Unicode normalisation, case and every other rule are the library's own:
a pre-token is encoded by the tokenizer itself, and none of its rules looks beyond white space.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows and null ids each get their own row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm import text as tx
from hashtrend.llm.groups import documents_of, unpack
from hashtrend.llm.lexicon import ask, distinct_words, with_answers, word_chunks

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
_PLAIN = re.compile(r"[^\W\d_]+([!-&(-/:-@\[-`{-~]*)")  # letters, then any signs but '


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_words(path: str, words: list[bytes], batch: int = 4096):
    """Encodings of distinct pre-tokens, each on its own."""
    tokenizer = load_tokenizer(path)
    for lo in range(0, len(words), batch):
        yield from tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[lo : lo + batch]], add_special_tokens=False)


@lru_cache(maxsize=2)
def _closes_word(path: str) -> np.ndarray:
    """Whether each id ends the run that the tokenizer's splitter cut out."""
    tokenizer = load_tokenizer(path)
    return np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(tokenizer.get_vocab_size())], bool)


def word_ids(path: str, words: list[bytes], line: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all distinct pre-tokens in order, how many of each).

    Letters, with or without ASCII signs behind them, are encoded ``line`` pre-tokens at a time, joined by spaces.  The
    splitter cuts each into one run (two with signs) at least, and every run ends with an id that closes it: where a
    line has no more closing ids than that, they tell the pre-tokens apart.  All others are encoded alone."""
    tokenizer, closes = load_tokenizer(path), _closes_word(path)
    texts = [w.decode("utf-8", "replace") for w in words]
    plain = [_PLAIN.fullmatch(t) for t in texts]
    runs = np.array([2 if m and m[1] else 1 for m in plain], np.int64)
    letters = [k for k, m in enumerate(plain) if m]
    alone = [k for k, m in enumerate(plain) if not m]
    order, flat, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lines = [letters[lo : lo + line] for lo in range(0, len(letters), line)]
    for lo in range(0, len(lines), 64):
        some = lines[lo : lo + 64]
        found = tokenizer.encode_batch_fast([" ".join([texts[k] for k in own]) for own in some], add_special_tokens=False)
        for own, e in zip(some, found, strict=True):
            ids = np.array(e.ids, np.int64)
            last, stop = np.flatnonzero(closes[ids]), np.cumsum(runs[own])
            if len(last) == stop[-1] and last[-1] == len(ids) - 1:
                last = last[stop - 1]
                order.append(np.array(own))
                flat.append(ids)
                count.append(np.diff(last, prepend=-1))
            else:
                alone += own
    for lo in range(0, len(alone), 4096):
        own = alone[lo : lo + 4096]
        ids = [e.ids for e in tokenizer.encode_batch_fast([texts[k] for k in own], add_special_tokens=False)]
        order.append(np.array(own))
        flat.append(np.fromiter(chain.from_iterable(ids), np.int64))
        count.append(np.fromiter(map(len, ids), np.int64, len(ids)))
    order, count = np.concatenate(order), np.concatenate(count)
    back = np.argsort(order)
    return np.concatenate(flat)[tx.ranges((np.cumsum(count) - count)[back], count[back])], count[back]


_OUT = "doc_id long, n_bytes long, n_tokens long"


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document."""
    path = path or tokenizer_path()
    chunks = word_chunks(documents_of(docs), counted=True)

    def pieces(words, _):
        return np.fromiter((len(e) for e in encode_words(path, words)), np.int64, len(words))

    def finish(row: dict, blobs: list) -> pa.Table:
        count = np.concatenate([unpack(b, np.uint32) for b in blobs]).astype(np.int64) if blobs else np.zeros(0, np.int64)
        n = unpack(row["n_words"], np.int64)
        word = distinct_words(unpack(row["sequence"], np.uint32), n)
        # frequencies of each document's distinct pre-tokens, times the pieces of each
        own = np.repeat(np.arange(len(n)), n)
        total = np.bincount(own, weights=unpack(row["freq"], np.uint32) * count[word], minlength=len(n)).astype(np.int64)
        return pa.table({"doc_id": tx.ids_out(unpack(row["doc_ids"], np.int64)), "n_bytes": pa.array(unpack(row["n_bytes"], np.int64)), "n_tokens": pa.array(total)})

    return with_answers(chunks, ask(chunks, pieces, np.uint32), finish, _OUT, ["chunk", "doc_ids", "n_bytes", "n_words", "sequence", "freq"])


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT)
