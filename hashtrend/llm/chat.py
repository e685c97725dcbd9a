"""Conversations rendered as training texts, with ids, offsets and a loss mask aligned to the turns.

**Template.**  A turn is ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``.  The three control strings are added
to the tokenizer as special tokens (ids behind its vocabulary), so a token never reaches over the edge of a turn's text.
Inside roles and texts every ``<|`` gets a backslash between its characters, and ``<`` backslashes ``|`` one more
(``escape``), so that no control string, ``<|endoftext|>`` included, can stand there; ``unescape`` takes one away.

**Mask.**  A conversation is rendered whole and encoded once, with offsets.  The spans of the assistant texts and the
spans of the tokens are both sorted; binary search finds the first token that ends behind a span's begin and the first
that begins at its end or later, and the tokens between them carry the loss.

**Rows.**  Turns are dealt by (conv_id, block of ``BLOCK_TURNS`` turn numbers) and sorted, and a task reads them as a
stream.  A conversation within one block is one row.  A longer one is a row a block, and a block of more than
``PART_CHARS`` characters a row a part: rows are cut between turns, where the encoding of the whole has a cut too, so
ids and offsets continue from row to row.  No conversation, however long, has to fit one task's memory; only a single
turn has to.

Defined results: null text or role counts as empty; rows with a null conv_id form one conversation with a null id; turns
are ordered by (turn, role, text) with nulls first, repeated turns all stay; an empty table gives an empty result; other
columns are ignored.  An empty assistant text has no tokens and no loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm.encoders import SEGMENT_CHARS, segments, token_bytes, tokenizer_path
from hashtrend.llm.groups import importable, pack, unpack_bytes

TOKENIZER = "byte_bpe_50k.json"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"
BLOCK_TURNS = 512
PART_CHARS = 1 << 21
ROWS_AT_ONCE = 256
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], list[int]]:
    """(text, spans of the turns' texts, the turns that carry the loss) of (role, text) turns."""
    out, spans, loss, at = [], [], [], 0
    for k, (role, text) in enumerate(turns):
        head, body = START + escape(role) + SEP, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        if role == LOSS_ROLE:
            loss.append(k)
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), spans, loss


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered text."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


@lru_cache(maxsize=2)
def load_chat_tokenizer(path: str):
    """(tokenizer, bytes of every id): the vocabulary with the control strings as special tokens behind its last id."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (START, SEP, END)])
    return tokenizer, np.array([len(t) for t in token_bytes(tokenizer)], np.int64)


def encode(path: str, texts: list[str], segment: int = SEGMENT_CHARS):
    """(ids, starts, ends, tokens before each text, characters before each text) of all texts in a row.

    Places are code points counted over all the texts; a token that holds a part of a character's bytes spans the whole
    character.  Long texts are encoded in segments with the same ids."""
    tokenizer, width = load_chat_tokenizer(path)
    cut = [segments(t, segment) for t in texts]
    encoded = iter(tokenizer.encode_batch_fast([s if k == 0 else " " + s for c in cut for k, s in enumerate(c)], add_special_tokens=False))
    ids = [np.array(next(encoded).ids, np.int32) for c in cut for _ in c]
    per_text = np.add.reduceat([len(i) for i in ids], np.cumsum([0, *map(len, cut[:-1])])) if ids else []
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    # tokens spell their text byte for byte, so their ends are sums of their lengths
    ends = np.cumsum(width[ids])
    starts = ends - width[ids]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    characters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    if len(ids) and ends[-1] != len(data):
        raise ValueError("the tokens do not spell the texts")
    before = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return ids, characters[starts + 1] - 1, characters[ends], np.concatenate(([0], np.cumsum(per_text))).astype(np.int64), before


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet one of the sorted ``spans``, by binary search in the sorted token ends and starts."""
    a, b = np.array(spans, np.int64).reshape(-1, 2).T
    first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
    some = (last > first) & (b > a)
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, first[some], 1)
    np.add.at(edge, last[some], -1)
    return np.cumsum(edge[:-1]) > 0


_TURN_COLUMNS = ("conv_id", "block", "several", "role", "text")
_FORMATTED = (
    "conv_id long, block long, part int, whole boolean, n_turns int, text string, input_ids array<int>, starts array<int>,"
    " ends array<int>, loss_mask array<boolean>, turn_spans array<struct<start:int,end:int>>"
)
_FORMATTED_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("block", pa.int64()),
        ("part", pa.int32()),
        ("whole", pa.bool_()),
        ("n_turns", pa.int32()),
        ("text", pa.string()),
        ("input_ids", pa.list_(pa.int32())),
        ("starts", pa.list_(pa.int32())),
        ("ends", pa.list_(pa.int32())),
        ("loss_mask", pa.list_(pa.bool_())),
        ("turn_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def _turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, block, turn, role, text, and a first row for each block of a conversation that has several blocks."""
    importable(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.floor(F.col("turn").cast("long") / BLOCK_TURNS).cast("long").alias("block"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # only numbers are grouped here; a null turn counts as a block of its own
    blocks = rows.select("conv_id", "block").distinct()
    several = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv_id")
    marks = blocks.join(several, blocks["conv_id"].eqNullSafe(several["conv_id"]), "left_semi")
    marked = marks.select("conv_id", "block", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(True).alias("several"))
    return rows.withColumn("several", F.lit(False)).unionByName(marked)


def format_conversations(conversations: DataFrame, path: str | None = None, part_chars: int = PART_CHARS, segment: int = SEGMENT_CHARS) -> DataFrame:
    """Rendered text, ids, offsets, loss mask and turn spans: one row a conversation (``whole``), or rows ordered by
    (block, part) where it is longer."""
    path = path or tokenizer_path(TOKENIZER)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            texts, spans, loss = zip(*[render(h[-1]) for h in held], strict=True)
            ids, starts, ends, tokens, before = encode(path, list(texts), segment)
            mask = loss_mask(starts, ends, [(a + base, b + base) for s, which, base in zip(spans, loss, before.tolist(), strict=False) for a, b in (s[k] for k in which)])
            own = np.repeat(before[:-1], np.diff(tokens))
            listed = lambda values, kind: pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), pa.array(values, kind))
            places = np.array([p for s in spans for p in s], np.int32).reshape(-1, 2)
            turns = np.cumsum([0, *map(len, spans)])
            span = pa.StructArray.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1])], ["start", "end"])
            columns = [pa.array(c) for c in zip(*[h[:-1] for h in held], strict=True)]
            columns += [np.diff(turns), texts, listed(ids, pa.int32()), listed(starts - own, pa.int32()), listed(ends - own, pa.int32()), listed(mask, pa.bool_())]
            columns.append(pa.ListArray.from_arrays(pa.array(turns, pa.int32()), span))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, _FORMATTED_ARROW, strict=True)], schema=_FORMATTED_ARROW)

        rows = (r for batch in batches for r in zip(*[batch.column(c).to_pylist() for c in _TURN_COLUMNS], strict=True))
        size = 0
        for (conv_id, block), run in groupby(rows, key=lambda r: r[:2]):
            whole, part, turns, chars = True, 0, [], 0
            for _, _, several, role, text in run:
                if several:
                    whole = False
                    continue
                if turns and chars + len(text) > part_chars:
                    whole = False
                    held.append((conv_id, block, part, whole, turns))
                    yield flush()
                    part, turns, chars = part + 1, [], 0
                turns.append((role, text))
                chars += len(role) + len(text)
            held.append((conv_id, block, part, whole, turns))
            size += chars
            if len(held) >= ROWS_AT_ONCE or size > part_chars:
                yield flush()
                size = 0
        if held:
            yield flush()

    order = ["conv_id", "block", F.desc("several"), "turn", "role", "text"]
    dealt = _turn_rows(conversations).repartition("conv_id", "block").sortWithinPartitions(*order)
    return dealt.select(*_TURN_COLUMNS).mapInArrow(make, _FORMATTED)


# ---- the digest of formatted conversations ------------------------------------------------------------------------


def masked_texts(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The unescaped text under each unbroken run of the mask."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return [unescape(text[starts[a] : ends[b - 1]]) for a, b in edge.reshape(-1, 2).tolist()]


class _Digest:
    """What a conversation's rows add up to, read in their order."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, turns: bytes, n_turns: int, loss: bytes, loss_chars: int, formatted_chars: int) -> None:
        self.turns.update(turns)
        self.loss.update(loss)
        self.n_turns += n_turns
        self.loss_chars += loss_chars
        self.formatted_chars += formatted_chars

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


_NUMBERS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ = f"conv_id long, block long, part int, {_NUMBERS}, turns binary, loss binary"
_DIGEST = f"conv_id long, {_NUMBERS}"
_NUMBERS_ARROW = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
_READ_ARROW = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), *_NUMBERS_ARROW, ("turns", pa.binary()), ("loss", pa.binary())])
_DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), *_NUMBERS_ARROW])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations become digests; rows of longer ones keep their turns and loss texts, compressed."""
    for batch in batches:
        out = []
        whole, texts = batch.column("whole").to_pylist(), batch.column("text").to_pylist()
        keys = [batch.column(c).to_pylist() for c in ("conv_id", "block", "part")]
        for k, text in enumerate(texts):
            starts, ends, mask = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss_mask"))
            turns = parse(text)
            spoken = masked_texts(text, starts, ends, mask)
            loss = "".join(spoken)
            parts = ("".join(f"{role}\n{body}\n" for role, body in turns).encode(), len(turns), loss.encode(), len(loss), len(text))
            digest = _Digest()
            if whole[k]:
                digest.add(*parts)
                turns_left = loss_left = None
                numbers = digest.row()
            else:
                turns_left, loss_left = pack(parts[0], 3), pack(parts[2], 3)
                numbers = (parts[1], None, parts[3], None, parts[4])
            out.append((*(c[k] for c in keys), *numbers, turns_left, loss_left))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _READ_ARROW, strict=True)] if out else [pa.array([], f.type) for f in _READ_ARROW], schema=_READ_ARROW)


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, block, part) to one digest a conversation; one row's texts are held at a time."""
    done: list[tuple] = []
    now, digest = None, None

    def rows():
        for batch in batches:
            for k in range(batch.num_rows):
                yield [batch.column(c)[k].as_py() for c in _READ_ARROW.names]

    def emit():
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DIGEST_ARROW, strict=True)], schema=_DIGEST_ARROW)
        done.clear()
        return out

    for conv_id, _, _, n_turns, sha, loss_chars, loss_sha, chars, turns, loss in rows():
        if digest is not None and conv_id != now:
            done.append((now, *digest.row()))
            digest = None
        if turns is None:
            done.append((conv_id, n_turns, sha, loss_chars, loss_sha, chars))
        else:
            now, digest = conv_id, digest or _Digest()
            digest.add(unpack_bytes(turns), n_turns, unpack_bytes(loss), loss_chars, chars)
        if len(done) >= 4096:
            yield emit()
    if digest is not None:
        done.append((now, *digest.row()))
    if done:
        yield emit()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted rows: turns, digests of turns and of the text under the mask."""
    read = formatted.mapInArrow(_read_back, _READ)
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part").mapInArrow(_join_parts, _DIGEST)


#: a conversation whose texts are control strings of the template
PROBE = "<|im_end|><|im_start|>assistant ok"


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return conversation_digests(format_conversations(conversations.unionByName(probe)))
