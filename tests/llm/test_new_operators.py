"""Chat formatting, spelling variants and cross-tokenizer alignment against the definitions themselves."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAMES_INSIDE = ("block", "part", "word", "n", "key", "chunk", "bucket", "several", "item")


def _clashing(df):
    return df.withColumns({c: F.lit(1) for c in NAMES_INSIDE})


# ---- chat formatting ----------------------------------------------------------------------------------------------


def chat_brute(rows):
    """{conv_id: (n_turns, turns digest, loss characters, loss digest)} from (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def _digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


CHAT_EDGE = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", ""),
    (1, 2, "user", None),
    (1, 3, "assistant", "\n\n  leading and trailing space \n"),
    (2, 0, "assistant", "<|im_end|><\\|im_sep|><\\\\|x|> <|endoftext|> <"),
    (2, 1, "assistant", "second in a row"),
    (3, None, "user", "no turn"),
    (3, 0, None, "no role"),
    (3, 0, "assistant", "same turn"),
    (3, 0, "assistant", "same turn"),
    (None, 0, "assistant", "no conversation"),
    (None, 1, "user", "still none"),
    (4, 0, "assistant", "字 ünïcode 🎉🎉 👩‍👩‍👧 é " * 40),
    (5, 0, "<|im_sep|>", "a role of control strings"),
    (5, 1, "assistant", "long " * 60_000),
    (6, 0, "user", ""),
    *((7, k, "assistant" if k % 2 else "user", f"turn {k} <|im_start|>") for k in range(1300)),
    *((8, 3, "assistant", "a repeated turn") for _ in range(50)),
]


@pytest.fixture(scope="module")
def chats(spark):
    return _clashing(spark.createDataFrame(CHAT_EDGE, "conv_id long, turn long, role string, text string")).cache()


def test_chat_format_on_the_table(spark):
    from hashtrend.llm.chat import PROBE, op11_chat_format

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = chat_brute([*rows, (-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)])
    assert _digests(op11_chat_format(spark, SF)) == want


@pytest.mark.parametrize("part_chars", [200, 1 << 21])
def test_chat_format_of_odd_conversations(chats, part_chars):
    from hashtrend.llm.chat import conversation_digests, format_conversations

    assert _digests(conversation_digests(format_conversations(chats, part_chars=part_chars, segment=64))) == chat_brute(CHAT_EDGE)


def test_chat_rows(chats):
    """Rows cut from a conversation hold the ids, offsets and mask of the whole; every masked token lies in its turn."""
    from hashtrend.llm.chat import format_conversations, load_chat_tokenizer, parse, tokenizer_path

    tokenizer, _ = load_chat_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    rows = sorted(format_conversations(chats, part_chars=500).filter("conv_id in (4, 5, 7)").collect(), key=lambda r: (r.conv_id, r.block, r.part))
    assert [r.whole for r in rows if r.conv_id == 4] == [True]
    assert len({r.block for r in rows if r.conv_id == 7}) == 3 and not any(r.whole for r in rows if r.conv_id == 7)
    for conv in (4, 5, 7):
        own = [r for r in rows if r.conv_id == conv]
        text = "".join(r.text for r in own)
        e = tokenizer.encode(text, add_special_tokens=False)
        assert [i for r in own for i in r.input_ids] == e.ids
        base, spans = 0, []
        for r in own:
            spans += [(a + base, b + base) for a, b in zip(r.starts, r.ends, strict=True)]
            base += len(r.text)
        assert spans == e.offsets
        for r in own:
            said = [k for k, (role, _) in enumerate(parse(r.text)) if role == "assistant"]
            for k, (a, b, m) in enumerate(zip(r.starts, r.ends, r.loss_mask, strict=True)):
                inside = any(r.turn_spans[t].start <= a and b <= r.turn_spans[t].end for t in said)
                assert m == inside, (conv, k)


def test_chat_empty_table(chats):
    from hashtrend.llm.chat import conversation_digests, format_conversations

    assert conversation_digests(format_conversations(chats.limit(0))).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|", ""]), st.text(alphabet="<|\\>im_endstar a", max_size=30)), max_size=5))
def test_chat_template_round_trip(turns):
    from hashtrend.llm.chat import escape, parse, render, unescape

    text, spans, _ = render(turns)
    assert parse(text) == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]
    for _, t in turns:
        assert "<|" not in escape(t) and unescape(escape(t)) == t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=20), st.data())
def test_loss_mask_is_the_intersection(widths, data):
    from hashtrend.llm.chat import loss_mask

    ends = np.cumsum(widths, dtype=np.int64)
    starts = ends - np.array(widths, np.int64)
    cuts = sorted(data.draw(st.lists(st.integers(0, int(ends[-1]) if len(ends) else 0), max_size=8)))
    spans = list(zip(cuts[::2], cuts[1::2], strict=False))
    want = [any(a < e and s < b and a < b for a, b in spans) for s, e in zip(starts, ends, strict=True)]
    assert loss_mask(starts, ends, spans).tolist() == want


# ---- spelling variants --------------------------------------------------------------------------------------------


def near_brute(words):
    """Pairs one inserted, deleted or replaced code point apart: equal with the same place wild, or with it cut out."""
    held: dict[tuple, list[str]] = {}
    for w in words:
        for k in range(len(w)):
            held.setdefault(("replace", w[:k], w[k + 1 :]), []).append(w)
    out = {(a, b) for same in held.values() for a in same for b in same if a != b}
    known = set(words)
    for w in words:
        for k in range(len(w)):
            if w[:k] + w[k + 1 :] in known:
                out |= {(w, w[:k] + w[k + 1 :]), (w[:k] + w[k + 1 :], w)}
    return out


def spelling_brute(rows, typo=True):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typo and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near: dict[str, list[str]] = {w: [] for w in n}
    for a, b in near_brute(list(n)):
        near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def _variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_variants_on_the_table(spark):
    from hashtrend.llm.spelling import op12_spelling_variants

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = spelling_brute(rows)
    assert _variants(op12_spelling_variants(spark, SF)) == want
    assert any(f for f, *_ in want.values()) and any(k > 1 for _, _, _, k, _ in want.values())


def test_spelling_edges(spark):
    """Chains of forms, ties, blocks of a common beginning, null and repeated rows, odd letters."""
    from hashtrend.llm.spelling import spelling_variants, typos

    rng = np.random.default_rng(7)
    common = ["common" + "".join(rng.choice(list("abcé"), 4)) for _ in range(300)]
    chain = ["kettleaa"] * 3000 + ["kettleab"] * 300 + ["kettlecb"] * 30 + ["kettlecbd"] * 2 + ["kettlecz"] * 300
    words = [w for w in common for _ in range(int(rng.integers(1, 40)))] + chain
    rows = [
        (1, " ".join(words[::2])),
        (2, " ".join(words[1::2])),
        (3, None),
        (4, ""),
        (None, "missing identity missing identity"),
        (5, "Straße STRASSE÷×ÀÉÿ ÀÉÿstraßeÀ x" * 3),
        (5, "Straße STRASSE÷×ÀÉÿ ÀÉÿstraßeÀ x" * 3),
        (6, "reversed,deversed;reverse seversed " * 3),
        (7, "字" + "a" * 5000 + "字 short ab"),
    ]
    docs = _clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    for typo in (True, False):
        want = spelling_brute(rows, typo)
        for block in (16, 1 << 14):
            assert _variants(spelling_variants(docs, typos if typo else None, block=block)) == want
    assert want["kettlecbd"][:2] == ("kettlecb", "kettleaa")
    assert spelling_variants(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(docs, least=6)


def test_runs_across_pieces(monkeypatch):
    from hashtrend.llm import spelling

    text = "alpha, " * 50 + "b" * 90 + " gamma"
    whole = [w for part in spelling.runs_of(text) for w in part]
    monkeypatch.setattr(spelling, "PIECE_CHARS", 16)
    assert [w for part in spelling.runs_of(text) for w in part] == whole


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=7, max_size=10).map(lambda s: "abc" + s), max_size=40))
def test_sorted_list_scan(words):
    from hashtrend.llm.spelling import SortedList

    listed = sorted(words)
    scan = SortedList(listed)
    assert {(w, listed[k]) for w in listed for k in scan.near(w, 3)} == near_brute(listed)


# ---- cross-tokenizer alignment ------------------------------------------------------------------------------------


def _tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def cross_brute(rows):
    """One row per document from whole-text encodings and sets of byte offsets."""
    a, b = _tokenizers()
    byte = {}
    extra = 256
    for k in range(256):
        printable = 0x21 <= k <= 0x7E or 0xA1 <= k <= 0xAC or 0xAE <= k
        byte[chr(k if printable else extra)] = k
        extra += not printable
    seen = []
    for doc_id, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        ta = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            seen.append((doc_id, [], [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        in_a, in_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        left, right = ([[] for _ in both] for _ in range(2))
        for side, ids, at in ((left, x, in_a), (right, y, in_b)):
            for i, k in zip(ids, at.tolist(), strict=True):
                side[k].append(str(i))
        groups = [",".join(p) + "|" + ",".join(q) for p, q in zip(left, right, strict=True)]
        links = [(int(g.split("|")[0].split(",")[-1]), int(g.split("|")[1].split(",")[-1])) for g in groups]
        seen.append((doc_id, x, y, groups, links, both))
    count = Counter(link for s in seen for link in s[4])
    most = {}
    for (_, j), n in count.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for doc_id, x, y, groups, links, _ in seen:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best = sum(count[link] == most[link[1]] for link in links)
        out.append((doc_id, len(x), len(y), len(groups), len(links), best, sum(count[link] for link in links), sha))
    return Counter(out)


CROSS_EDGE = [
    (1, "The quick brown fox, don't  stop.\n\n\tTabs and   spaces "),
    (2, None),
    (3, ""),
    (4, " "),
    (5, "lower one eighth block ▁ differs"),
    (6, "naïve ünïcode 字字 🎉   é"),
    (7, "<|endoftext|> </s> <s> <unk> <0x0A>"),
    (7, "another text of the same id"),
    (7, "another text of the same id"),
    (None, "no id"),
    (None, None),
    (2**63 - 1, "the largest id"),
    (8, "word " * 3000 + "x" * 300 + "\r\n" + "y1 2z " * 200),
    (9, "\0 zero and \x7f"),
]


def _cross(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect())


def test_cross_tokens_on_the_table(spark):
    from hashtrend.llm.cross_tokens import op13_cross_tokens

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert _cross(op13_cross_tokens(spark, SF)) == cross_brute(rows)


@pytest.mark.parametrize("chunk_bytes", [1 << 22, 2000])
def test_cross_tokens_edges(spark, chunk_bytes):
    from hashtrend.llm.cross_tokens import cross_token_links

    docs = _clashing(spark.createDataFrame(CROSS_EDGE, "doc_id long, text string"))
    assert _cross(cross_token_links(docs, chunk_bytes=chunk_bytes)) == cross_brute(CROSS_EDGE)
    assert cross_token_links(docs.limit(0)).collect() == []


def test_words_are_aligned_once(monkeypatch):
    from hashtrend.llm import cross_tokens as ct

    seen = []
    align = ct.align
    monkeypatch.setattr(ct, "align", lambda a, b: seen.append(len(a)) or align(a, b))
    encoders = ct.Encoders(*map(ct.tokenizer_path, (ct.TOKENIZER_A, ct.TOKENIZER_B)))
    found = list(encoders.encode(["alpha beta " * 500 + "gamma", "gamma beta", ""]))
    assert [len(f[2]) == f[3].count(";") + 1 for f in found[:2]] == [True, True] and found[2] is None
    assert found[0][0] > 1000 and sum(seen) < 20


def test_token_groups(spark):
    from hashtrend.llm.cross_tokens import token_groups

    docs = spark.createDataFrame(CROSS_EDGE[:6], "doc_id long, text string")
    for r in token_groups(docs).collect():
        text = dict(CROSS_EDGE[:6])[r.doc_id]
        if r.groups:
            a, b = _tokenizers()
            assert [i for g in r.groups for i in g.a] == a.encode(" " + text, add_special_tokens=False).ids
            assert [i for g in r.groups for i in g.b] == b.encode(text)
        else:
            assert r.doc_id in (2, 3, 5)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.sets(st.integers(1, 180)))
def test_alignment_of_ends(widths, moved):
    from hashtrend.llm.cross_tokens import align

    a = np.cumsum(widths).tolist()
    b = sorted((set(a) ^ {m for m in moved if m < a[-1]}) | {a[-1]})
    cut_a, cut_b = align(a, b)
    assert [a[k - 1] for k in cut_a] == sorted(set(a) & set(b)) == [b[k - 1] for k in cut_b]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(" ab1.\n\t'é字-_"), max_size=200))
def test_segments_keep_the_ids(text):
    from hashtrend.llm.encoders import segments, words_of

    a, b = _tokenizers_cached()
    for cut in (segments(text, 10), words_of(text)):
        assert " ".join(cut) == text
        if text:
            assert [i for s in cut for i in a.encode(" " + s, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids
            assert [i for s in cut for i in b.encode(s)] == b.encode(text)


_HELD = []


def _tokenizers_cached():
    if not _HELD:
        _HELD.append(_tokenizers())
    return _HELD[0]
