"""Tokenizers for operators that need ids with their places: loading, token bytes, and texts in segments.

``segments`` cuts a long text only in front of a single space between two word characters.  The byte-level splitter
begins a new pre-token at such a space, and no piece of the sentencepiece vocabulary holds a space behind another
character (``load_pieces`` checks that), so both tokenizers give the ids of the whole text, segment by segment.
"""

from __future__ import annotations

import re
from functools import lru_cache

SEGMENT_CHARS = 1 << 16
_CUT = re.compile(r"(?<=\w) (?=\w)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def segments(text: str, limit: int = SEGMENT_CHARS) -> list[str]:
    """The text in pieces of about ``limit`` characters; each piece but the first begins behind the space that the
    cut took away."""
    if len(text) <= limit:
        return [text]
    out, lo = [], 0
    while len(text) - lo > limit:
        m = _CUT.search(text, lo + limit)
        if not m:
            break
        out.append(text[lo : m.start()])
        lo = m.end()
    return [*out, text[lo:]]


def words_of(text: str) -> list[str]:
    """The text cut at every place where ``segments`` may cut; joined by spaces they are the text."""
    return _CUT.split(text)


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on in byte order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; added tokens stand for themselves."""
    byte = _byte_of()
    out = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        token = tokenizer.id_to_token(i) or ""
        out.append(bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode())
    return out


@lru_cache(maxsize=2)
def load_byte_level(path: str):
    """(tokenizer, bytes of every id) of a byte-level vocabulary; special strings in texts are plain text."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    return tokenizer, token_bytes(tokenizer)


@lru_cache(maxsize=2)
def load_pieces(path: str):
    """(processor, bytes of every id) of a sentencepiece model."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if "▁" in piece.lstrip("▁"):
            raise ValueError(f"piece {piece!r} holds a space behind another character; texts cannot be cut at spaces")
        out.append(bytes([int(piece[3:-1], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode())
    return processor, out
