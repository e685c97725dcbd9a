"""The training-data operators against brute force, exact round trips and their defined edge cases."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
EDGE = [
    (1, "alpha beta gamma delta epsilon zeta " * 4),
    (2, "alpha beta gamma delta epsilon zeta " * 4),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "x" * 70_000),
    (7, "one two"),
    (8, "One TWO"),
    (None, "alpha beta gamma delta epsilon zeta " * 4),
    (9, "naïve ünïcode 字 " * 30),
    (10, "naïve ünïcode 字 " * 30 + "end"),
    (7, "one two"),
    (11, "<|endoftext|> A.B 's Á İ " * 3),
]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string")
    # columns whose names the operators use inside
    return df.withColumns({c: F.lit(1) for c in ("gid", "bucket", "score", "node", "chunk", "mark")}).cache()


@pytest.fixture(scope="module")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_suffix_dedup(spark, docs, edge, none):
    from hashtrend.llm.suffix_dedup import brute_force, op1_suffix_dedup, suffix_dedup, without_repeats

    want = brute_force(_pairs(docs))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op1_suffix_dedup(spark, SF).collect()}
    assert got == want
    small = [(d, t) for d, t in _pairs(edge) if d is not None]
    rows = suffix_dedup(edge, hot_documents=2).collect()
    assert len(rows) == len(EDGE)
    want = brute_force(small)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, len(r.span_starts), hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id], r.doc_id
        else:
            assert r.n_removed == r.n_bytes  # larger than every id
    assert suffix_dedup(none).count() == 0
    cut = without_repeats(edge)
    assert cut.columns == edge.columns and cut.count() == len(EDGE)


def test_pipeline_stages_keep_one_python_worker_a_core(spark):
    """No stage of the pipeline starts Python workers beside those of its operators; each lives on for the whole session."""
    from hashtrend.llm.labelled import labelled_sample
    from hashtrend.llm.suffix_dedup import brute_force, without_repeats

    passage = "a passage of words that comes again and again in other documents "
    rows = [(1, "a", passage + "ü"), (2, None, "x" + passage + "ö end"), (3, "c", None), (None, "d", passage), (2, "e", ""), (4, "f", passage + "ú")]
    docs = spark.createDataFrame(pa.table(dict(zip(("doc_id", "rest", "text"), map(pa.array, zip(*rows, strict=True)), strict=True))))
    cut = without_repeats(docs)
    assert "MapInArrow" not in cut._jdf.queryExecution().toString()
    got = sorted((r.doc_id or 9, r.rest or "", r.text) for r in cut.collect() if r.text is not None)
    # ü, ö and ú begin with the same byte: where it goes with the passage, the character goes whole
    want = [(1, "a", passage + "ü"), (2, "", "x end"), (2, "e", ""), (4, "f", ""), (9, "d", "")]
    assert got == want and cut.filter("text is null").first().doc_id == 3
    assert brute_force([(1, rows[0][2]), (4, rows[5][2])])[4][1] == len(passage) + 1  # one of the two bytes of ú

    labels = spark.createDataFrame(pa.table({"doc_id": [1, 2, 4, 4], "quality": [1, 0, 1, 1]}))
    chosen, totals = labelled_sample(docs, labels, "quality", F.lit(True), 10)
    assert "ExistingRDD" not in chosen._jdf.queryExecution().toString()
    assert totals == {0: 1, 1: 2} and sorted((r.doc_id, r.label) for r in chosen.collect()) == [(1, 1), (2, 0), (4, 1)]
    chosen, totals = labelled_sample(docs, labels.limit(0), "quality", F.lit(True), 10)
    assert totals == {} and chosen.collect() == [] and chosen.dtypes == [("doc_id", "bigint"), ("text", "string"), ("label", "int")]


def test_maximal_repeats_hold_all_occurrences():
    from hashtrend.llm.suffix_dedup import maximal_repeats

    segs = [b"abcabcabcx", b"zabcabcw", b"qqbcabcw"]
    joined = b"\xff".join(segs)
    lens, around, sizes, members = maximal_repeats(segs, 3)
    at, found = 0, {}
    for n, m in zip(lens.tolist(), sizes.tolist(), strict=True):
        own = members[at : at + m]
        at += m
        text = {joined[p : p + n] for p in own.tolist()}
        assert len(text) == 1
        word = text.pop()
        assert sorted(own.tolist()) == [i for i in range(len(joined)) if joined.startswith(word, i)]
        found[word] = m
    assert found[b"abcabc"] == 3 and found[b"bcabcw"] == 2


def test_suffix_dedup_passages_that_end_at_a_sorted_word(spark):
    """Repeats of 56 and 112 bytes (what the suffixes are sorted by at a time), some of them at a text's end."""
    from hashtrend.llm.suffix_dedup import brute_force, maximal_repeats, suffix_dedup

    passage = "".join(chr(97 + k * k * 7 % 26) + str(k) for k in range(60))
    for n in (56, 112):
        p = passage[:n]
        lens, around, sizes, members = maximal_repeats([f"{p}\nOn".encode(), p.encode(), f"{p}\nEs".encode()], 50)
        assert sorted(zip(lens.tolist(), sizes.tolist(), strict=True)) == [(n, 3), (n + 1, 2)]
    ends = ["\nOnbleonat", "", "\nEsen", "\nThe", "", "\nThis"]
    rows = [(10 * n + k, "." * (k % 3) + passage[:n] + end) for n in (56, 112) for k, end in enumerate(ends)] + [(2**63 - 1, passage)]
    got = {
        r.doc_id: (r.n_bytes, r.n_removed, len(r.span_starts), hashlib.sha256(r.kept).hexdigest())
        for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    assert got == brute_force(rows)


def test_word_ids_of_joined_words(monkeypatch):
    from hashtrend.llm import token_counts as tc

    path = tc.tokenizer_path()
    words = "the Fox, fox... don't it's \u00e9t\u00e9 e\u0301t\u00e9! \u0130stanbul x\u00bd 3rd a_b \U0001f389 <|endoftext|> a<| |> b\u00a0c \u5b57\u5b57 a' s,".split(" ")
    words += [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" + "," * (k % 3) for k in range(400)]
    want = [e.ids for e in tc.encode_words(path, [w.encode() for w in words])]
    asked = []

    class Counting:
        def __init__(self, own):
            self.own = own

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.own.encode_batch_fast(texts, **options)

    counting = Counting(tc.load_tokenizer(path))
    tc._closes_word(path)
    monkeypatch.setattr(tc, "load_tokenizer", lambda _: counting)
    for line in (512, 3):
        asked.clear()
        ids, count = tc.word_ids(path, [w.encode() for w in words], line)
        stop = np.cumsum(count)
        assert [ids[b - n : b].tolist() for b, n in zip(stop.tolist(), count.tolist(), strict=True)] == want
    assert len(asked) < len(words)  # the long line held a word that is no run of its own, most short ones do not
    assert [len(x) for x in tc.word_ids(path, [])] == [0, 0]


def test_packing_index_forgets_used_documents():
    from hashtrend.llm.lexicon import _distinct
    from hashtrend.llm.packing import Shard, fill_windows

    draw = np.random.default_rng(5)
    lens = draw.integers(1, 90, 400)
    first = np.concatenate(([0], np.cumsum(lens)))
    ids = draw.integers(3, 500, first[-1]).astype(np.uint16)
    ids[first[1:] - 1] = 2
    idf = draw.random(1 << 16)
    shard, same = (Shard(ids, first, idf, float(lens.mean())) for _ in range(2))
    whole = len(shard.docs)
    same.forget = lambda used: None
    assert fill_windows(shard, lens, 256) == fill_windows(same, lens, 256)
    assert len(shard.docs) < whole / 2
    for h in (draw.integers(0, 50, 300).astype(np.uint64), np.zeros(0, np.uint64)):
        for got, want in zip(_distinct(h), np.unique(h, return_index=True, return_inverse=True), strict=True):
            assert np.array_equal(got, want)


def test_quality_scores_need_little_memory():
    import tracemalloc

    from hashtrend.llm import quality as q

    draw = np.random.default_rng(1)
    vectors = draw.standard_normal((4096, q.RANK)).astype(np.float32)
    axes = draw.standard_normal((q.TERMS, q.RANK)).astype(np.float32)
    model = q.Neighbours(np.ones(q.TERMS, np.float32), axes, vectors, draw.integers(0, 2, 4096).astype(float), np.ones(2))
    texts = pa.array([" ".join(f"w{int(x)}" for x in draw.integers(0, 5000, 400)) for _ in range(600)])
    whole = np.concatenate([model.score(texts[k : k + 1]) for k in range(20)])
    tracemalloc.start()
    score = model.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    np.testing.assert_allclose(score[:20], whole, rtol=1e-4)
    assert peak < 64 << 20, peak


def test_embedding_dedup(spark):
    from hashtrend.llm.embed_dedup import Quantised, brute_force, near_duplicates

    draw = np.random.default_rng(3)
    base = draw.standard_normal((40, 16))
    x = np.concatenate((base, base + 0.25 * draw.standard_normal(base.shape), base[:5], 3 * base[5:10]))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(200, None), (201, []), (202, [0.0] * 16), (203, [math.nan] + [1.0] * 15), (204, [None] + [1.0] * 15), (205, [math.inf] * 16), (206, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("node", F.lit(0))
    want = brute_force(rows + odd)
    for block in (4096, 7):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, block=block).collect()}
        assert got == want
    assert near_duplicates(df.limit(0)).count() == 0
    q = Quantised(x)  # the bound holds for every pair
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    coarse = (q.q.astype(np.int64) @ q.q.T.astype(np.int64)) * np.outer(q.scale, q.scale)
    bound = np.outer(q.error, q.length + q.error) + np.outer(q.length, q.error)
    assert (np.abs(unit @ unit.T - coarse) <= bound + 1e-12).all()


def test_token_counts(spark, docs, edge, none):
    from hashtrend.llm.token_counts import load_tokenizer, op3_token_counts, token_counts, tokenizer_path

    tok = load_tokenizer(tokenizer_path())
    n = lambda t: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids))
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in op3_token_counts(spark, SF).collect()} == {d: n(t) for d, t in _pairs(docs)}
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(edge).collect()) == Counter((d, *n(t)) for d, t in EDGE)
    assert token_counts(none).count() == 0


def _held_out(spark, query, label, recall, spare):
    labels = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in query(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    hit = [r.predicted == 1 for r in rows if labels[r.doc_id] == 1]
    miss = [r.predicted == 1 for r in rows if labels[r.doc_id] == 0]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean(hit) >= recall and np.mean(miss) <= spare


def test_toxicity(spark, edge, none):
    from hashtrend.llm.labelled import crc_remainder
    from hashtrend.llm.toxicity import op4_toxicity, toxicity_scores

    _held_out(spark, op4_toxicity, "toxic", 0.75, 0.05)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (99, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        assert toxicity_scores(edge, known, crc_remainder(5) != 0).count() == len(EDGE)
    assert toxicity_scores(none, labels, crc_remainder(5) != 0).count() == 0


def test_kernel_tolerates_gaps():
    import pyarrow as pa

    from hashtrend.llm.toxicity import _flat_units, _table_of, kernel_features, units

    encode = lambda w: [x for x in _strings(units(pa.array([w])))]
    insult = encode("stupid")
    table = _table_of(insult)
    near = [kernel_features(*_flat_units(encode(w)), table)[0, 0] for w in ("stupid", "s.t.u-p_i d", "stuxpid", "thereof")]
    assert near[0] == pytest.approx(1) and near[1] == pytest.approx(1, abs=0.2)
    assert near[2] > 5 * near[3]


def _strings(found):
    letters, begin, *_ = found
    raw = letters.astype(np.uint8).tobytes()
    return [raw[begin[i] : begin[i + 1]] for i in range(len(begin) - 1)]


def test_decontamination(spark, docs, edge, none):
    from hashtrend.llm.decontaminate import brute_force, clean_documents, decontaminate, op5_decontamination

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_force(_pairs(docs), items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op5_decontamination(spark, SF).collect()}
    assert got == want and any(v[4] for v in got.values())
    few = [(1, "beta gamma"), (2, ""), (3, "two"), (3, "TWO"), (10, "字"), (None, "one"), (4, None), (5, "one two three")]
    bench = spark.createDataFrame(few, "item_id long, text string")
    want = brute_force([(d, t) for d, t in EDGE], [(i, t) for i, t in few if t is not None])
    for block in (16 << 20, 4):
        rows = decontaminate(edge, bench, block_bytes=block).collect()
        assert len(rows) == len(EDGE)
        for r in rows:
            assert (r.n_words, r.n_hit, len(r.item_ids)) == want[r.doc_id][:3], (block, r.doc_id)
    assert clean_documents(edge, bench).columns == edge.columns
    assert decontaminate(none, bench).count() == 0 and decontaminate(edge, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_items_without_an_id_are_matched_but_not_listed(spark):
    from hashtrend.llm.decontaminate import clean_documents, decontaminate

    bench = spark.createDataFrame([(None, "alpha beta gamma"), (7, "three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so Alpha beta gamma"), (2, "three four"), (3, "alpha gamma"), (4, "alpha beta gamma three four")], "doc_id long, text string")
    for block in (16 << 20, 4):
        got = {r.doc_id: (r.n_hit, r.item_ids) for r in decontaminate(docs, bench, block_bytes=block).collect()}
        assert got == {1: (3, []), 2: (2, ["7"]), 3: (0, []), 4: (5, ["7"])}
    assert [r.doc_id for r in clean_documents(docs, bench).collect()] == [3]


def test_words_that_share_a_hash_do_not_match(monkeypatch):
    from hashtrend.llm import decontaminate as dc

    plain = dc.tx.word_hashes

    def by_length(data, starts, ends):  # every word of three letters shares one hash
        h = plain(data, starts, ends)
        h[(ends - starts) == 3] = 5
        return h

    monkeypatch.setattr(dc.tx, "word_hashes", by_length)
    items = dc.Items([(1, "one long sentence")], 13)
    texts = pa.array(["one long sentence", "two long sentence", "one long sentence and two long sentence"], pa.binary())
    data, offsets = dc.tx.flat(texts)
    found = dc._judge(items, np.arange(3), data, offsets)
    assert list(found["n_hit"]) == [3, 0, 3] and found["item_ids"] == [["1"], [], ["1"]]


def test_clean_documents_judge_every_row_by_its_text(spark):
    from hashtrend.llm.decontaminate import clean_documents

    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = [(1, "alpha beta gamma"), (1, "one two"), (None, "so alpha beta gamma"), (None, "three"), (None, None), (2, "four"), (2, "four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(1, "one two"), (None, "three"), (None, None), (2, "four"), (2, "four")]
    assert Counter(_pairs(clean_documents(docs, bench))) == Counter(kept)


def test_benchmark_blocks_are_used_one_at_a_time(spark, edge, monkeypatch):
    from hashtrend.llm import decontaminate as dc

    log = []

    def blocks_of(*_):
        for k, word in enumerate(("alpha", "two", "字", "beta")):
            log.append(f"read {k}")
            yield [(k, word)]

    checkpoint = dc.checkpoint
    monkeypatch.setattr(dc, "blocks_of", blocks_of)
    monkeypatch.setattr(dc, "checkpoint", lambda df: (checkpoint(df), log.append("written"))[0])
    found = {r.doc_id: sorted(r.item_ids) for r in dc.decontaminate(edge, edge).collect()}
    assert found[1] == ["0", "3"] and found[7] == ["1"] and found[9] == ["2"] and found[3] == []
    assert log == ["read 0", "read 1", "written", "read 2", "written", "read 3", "written", "written"]


def test_quality(spark, edge, none):
    from hashtrend.llm.labelled import crc_remainder
    from hashtrend.llm.quality import good_documents, op6_quality, quality_scores

    _held_out(spark, op6_quality, "quality", 0.98, 0.1)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        assert quality_scores(edge, known, crc_remainder(3) != 1).count() == len(EDGE)
    assert quality_scores(none, labels, crc_remainder(3) != 1).count() == 0
    assert good_documents(edge, labels.limit(0), crc_remainder(3) != 1).columns == edge.columns


PAGE = (
    "<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><a>Home</a></nav><div class='side-bar ad'>Buy</div>"
    "<div id=main><h1>T{0}</h1><p>First&nbsp;{0} <b>bold<br>text<p>Second &amp; {0}</div><div>Follow us today</div>"
    "<div class=comments><p>Nice {0}</div><footer>&copy; x</footer>"
)


def test_html_of_any_depth_and_open_quotes():
    from hashtrend.llm.html_wrapper import extract

    for tag in ("div", "b"):
        deep = [f"<{tag}>" * 1500 + f"own text {i}" for i in range(6)]
        assert extract(deep) == [f"own text {i}" for i in range(6)]
    assert extract(['<p class="x>Hello world</p><p>second</p>']) == ["Hello world\nsecond"]
    assert extract(["<p title='it\"s > 1'>Hello</p><p class=\"a>b\">second</p>"]) == ["Hello\nsecond"]


def test_html_extraction(spark):
    from hashtrend.llm.html_wrapper import extract, main_texts

    pages = [PAGE.format(i) for i in range(8)]
    want = [f"T{i}\nFirst {i} bold text\nSecond & {i}" for i in range(8)]
    assert extract(pages) == want  # the line that all pages share is template
    assert extract(pages[:1]) == [want[0] + "\nFollow us today"]  # nothing to align with
    rows = [(i, "http://h/x", p) for i, p in enumerate(pages)] + [(90, None, None), (91, "", ""), (92, "odd", "<p>a<p>b"), (92, "odd", "<p>a<p>b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "part": F.lit(2)})
    got = Counter((r.page_id, r.text, r.n_chars) for r in main_texts(df).collect())
    assert got == Counter([*((i, t, len(t)) for i, t in enumerate(want)), (90, "", 0), (91, "", 0), (92, "a\nb", 3), (92, "a\nb", 3)])
    assert main_texts(df.limit(0)).count() == 0


def test_html_pages_of_every_layout_are_aligned():
    from hashtrend.llm.html_wrapper import extract

    index = "<html><body class=index><h1>All pages</h1></body></html>"
    first = [f"<html><body class=a><div>Follow us</div><p>Story {i}</p></body></html>" for i in range(6)]
    second = [f"<html><body class=b><p>Report {i}</p><section><div>Write to us</div></section></body></html>" for i in range(6)]
    pages = [index, *[p for both in zip(first, second, strict=True) for p in both]]
    want = ["All pages", *[t for i in range(6) for t in (f"Story {i}", f"Report {i}")]]
    assert extract(pages) == want


def test_html_lists_drop_no_article():
    from hashtrend.llm.html_wrapper import extract

    story = [f"A long story {i} in which much is told" for i in range(6)]
    around = "<body><nav>Home {0}</nav>{1}<div class=comments>Nice {0}</div></body>"
    for page in ("<form><p>{0}</p></form>", "<div class='no-sidebar'><p>{0}</p></div>", "<div class='content social'><p>{0}</p></div>"):
        assert extract([around.format(i, page.format(t)) for i, t in enumerate(story)]) == story, page
    teaser = [f"<article>Next {i}</article><div><p>{t}</p></div>" for i, t in enumerate(story)]
    assert extract([around.format(i, p) for i, p in enumerate(teaser)]) == [f"Next {i}\n{t}" for i, t in enumerate(story)]
    # a footer that is longer than the article is still none of it
    assert extract([f"<article>Brief {i}</article><footer>{t}</footer>" for i, t in enumerate(story)]) == [f"Brief {i}" for i in range(6)]


def test_packing_is_an_exact_round_trip(spark, docs, edge, none):
    from hashtrend.llm.packing import pack_documents
    from hashtrend.llm.token_counts import load_tokenizer, tokenizer_path

    tok = load_tokenizer(tokenizer_path())
    for df, window in ((docs, 4096), (edge, 64)):
        rows = pack_documents(df, window=window).collect()
        by_seq, by_doc = defaultdict(list), defaultdict(list)
        for r in rows:
            by_seq[r.sequence_id].append(r)
            by_doc[r.doc_id].append(r)
        for pieces in by_seq.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at == window or at & (at - 1) == 0
        texts = defaultdict(list)
        for d, t in _pairs(df):
            texts[d].append(t)
        for d, own in texts.items():
            if len(own) > 1 or d is None:
                continue
            ids, at = np.array([*tok.encode(own[0] or "", add_special_tokens=False).ids, 2], "<u4"), 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
    assert pack_documents(none).count() == 0


def test_packing_ranks_every_document_that_scores(spark):
    from hashtrend.llm.packing import pack_documents

    # 100 documents share a word of the seed each; 100 that share nothing with it lie before them
    words = [chr(97 + i // 10) * 2 + chr(97 + i % 10) for i in range(100)]
    texts = [" ".join(words), *["!"] * 100, *words]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = sorted(pack_documents(df).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = list(dict.fromkeys(r.doc_id for r in rows))
    assert order[0] == 0 and set(order[1:101]) == set(range(101, 201))


def test_jaccard_join(spark, docs, edge, none):
    from hashtrend.llm.jaccard import brute_force, op9_jaccard_join, overlaps, similarity_classes

    want = brute_force(_pairs(docs))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op9_jaccard_join(spark, SF).collect()} == want
    # chains of edits around one text, in tiles of few documents
    draw = np.random.default_rng(9)
    text = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = list(text)
        for _ in range(int(draw.integers(0, 5))):
            own[int(draw.integers(60))] = f"v{draw.integers(1000)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_classes(df, block=8).collect()}
    assert got == brute_force(rows)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in similarity_classes(edge).collect()]
    assert len(got) == len(EDGE)
    want = brute_force([(d, t) for d, t in EDGE if d is not None])
    for d, n, c in got:
        assert (n, c) == want[d] if d is not None else c is None
    assert similarity_classes(none).count() == 0
    a, b = [np.array([1, 2, 3]), np.array([], np.int64)], [np.array([2, 3, 9])]
    assert overlaps(a, b).tolist() == [[2.0], [0.0]]


def test_hmm_lm(spark, docs, edge, none):
    from hashtrend.llm.hmm_lm import Model, expected_counts, forward, hmm_scores, op10_hmm_lm, remainder

    rows = op10_hmm_lm(spark, SF).collect()
    texts = dict(_pairs(docs))
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    words = {d: (t or "").encode().lower().split() + [None] for d, t in texts.items()}
    count = Counter(w for d, ws in words.items() if not held(d) for w in ws)
    total, kinds = sum(count.values()), len(count)
    for r in rows:
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(words[r.doc_id]), total)
        assert r.n_known == sum(count[w] > 0 for w in words[r.doc_id]) and r.base_score == pytest.approx(base, abs=1e-6)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert hmm_scores(edge, remainder(5) != 1).count() == len(EDGE) and hmm_scores(none, remainder(5) != 1).count() == 0
    assert hmm_scores(edge, F.lit(False)).filter("score <> base_score").count() == 0
    # scaled recursions against plain sums over all paths
    draw = np.random.default_rng(1)
    m = Model(np.array([0.3, 0.7]), np.array([[0.6, 0.4], [0.1, 0.9]]), draw.dirichlet(np.ones(3), 2).T)
    seq = np.array([0, 2, 1, 1, 0], np.uint16)
    paths = {}
    for k in range(2**5):
        s = [k >> i & 1 for i in range(5)]
        p = m.start[s[0]] * np.prod([m.move[s[i], s[i + 1]] for i in range(4)]) * np.prod([m.emit[c, x] for c, x in zip(seq, s, strict=True)])
        paths[tuple(s)] = p
    whole = sum(paths.values())
    assert forward(m, seq, np.array([0]), np.array([5]))[0] == pytest.approx(math.log10(whole))
    counts = expected_counts(m, seq, np.array([0]), np.array([5]))
    assert counts[1] == pytest.approx(sum(p for s, p in paths.items() if s[0] == 1) / whole)
    assert counts[2 + 1] == pytest.approx(sum(p * sum(s[i : i + 2] == (0, 1) for i in range(4)) for s, p in paths.items()) / whole)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    near = corpus_pipeline.near_copies(spark, docs, SF)
    from hashtrend.llm.jaccard import brute_force

    want = {d for d, (_, c) in brute_force(_pairs(docs)).items() if d == c}
    assert {r.doc_id for r in near.collect()} == want and near.columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[0] == "doc_id" and 0 < out.select("doc_id").distinct().count() <= docs.count()


def test_near_copies_of_odd_rows(spark):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (2, long), (3, "other text of its own"), (3, "other text of its own"), (4, "a b"), (4, "c d")]
    rows += [(None, long), (None, long), (None, "one"), (None, None), (None, None), (5, ""), (6, ""), (7, None)]
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, component_id long")
    got = corpus_pipeline.near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(1, long), (3, "other text of its own"), (4, "a b"), (4, "c d"), (None, long), (None, "one"), (None, None), (5, ""), (6, ""), (7, None)]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)
    assert corpus_pipeline.near_copies(spark, docs.limit(0), SF).count() == 0


def test_embeddings_of_any_scale_and_repeated_ids(spark):
    from hashtrend.llm.embed_dedup import near_duplicates

    base = np.array([1.0, 2.0, -3.0, 0.5])
    rows = [(k, (base * scale).tolist()) for k, scale in enumerate((1.0, 1e160, 1e200, 1e-170, 5e-320))]
    rows += [(10, [0.0, 0.0, 0.0, 1.0]), (None, base.tolist()), (20, [0.0, 1.0, 0.0, 0.0]), (20, [1.0, 0.0, 0.0, 0.0]), (21, [2.0, 0.0, 0.0, 0.0])]
    found = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found if r.vec_id not in (20, None)}
    assert [got[k] for k in range(5)] == [(4, 0, k == 0) for k in range(5)] and got[10] == (0, 10, True)
    assert sorted(r.n_links for r in found if r.vec_id == 20) == [0, 1] and got[21] == (1, 20, False)
    assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id is None] == [(0, None, False)]


def test_common_passages_stay_out_of_prefixes(spark):
    from hashtrend.llm import jaccard

    # a third of all documents hold one passage, which is half of their shingles
    passage = " ".join(f"p{i}" for i in range(54))
    texts = [" ".join(f"d{i}x{j}" for j in range(54)) + (" " + passage if i % 3 == 0 else "") for i in range(90)]
    table = pa.table({"gid": [0] * 90, "doc_id": list(range(90)), "text": texts})
    key = (pa.scalar(0, pa.int32()),)
    sent = jaccard._send_counts(4, jaccard.COUNTED, jaccard.SIZE)(key, table)
    back = [jaccard._add_counts((pa.scalar(b, pa.int32()),), sent.filter(pc.equal(sent["bucket"], b))) for b in range(4)]
    take = jaccard._take_prefixes(4, jaccard.COUNTED, jaccard.SIZE, jaccard.NUM, jaccard.DEN)
    found = take(key, table, pa.concat_tables(back))
    assert not any(found["tokens"].to_pylist())  # no list that a third of all documents share
