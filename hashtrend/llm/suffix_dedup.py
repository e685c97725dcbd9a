"""Exact removal of repeated passages with enhanced suffix arrays.

Every byte of a document that is covered by a ``length``-byte string which also starts in a document with a smaller
``doc_id`` is removed; strings are judged on the input.

1. *Anchors.*  The anchor of a ``length``-byte window is the smallest hash among its ``k``-byte substrings; equal
   windows have equal anchors.  Anchors that only one document holds cannot belong to a repeat and go no further
   (``_send_anchors``, ``_shared_anchors``).
2. *Segments.*  Consecutive windows with the same shared anchor form a segment.  Each group of documents sends every
   distinct segment once, with the smallest ``doc_id`` that holds it, to the bucket of its anchor.  The windows of an
   anchor held by very many documents (``HOT_DOCUMENTS``) travel one by one, dealt by their own hash, so that the
   contexts around a very common passage spread over all buckets.
3. *Suffix arrays.*  A bucket sorts its suffixes, takes the longest common prefixes of neighbours and stack-scans the
   interval tree.  Intervals whose occurrences differ in the byte to their left (or begin a segment) are maximal
   repeat groups; each carries all its occurrences, and the smallest ``doc_id`` among them goes to every window the
   repeat covers.  A repeat longer than a segment shows as overlapping groups that join again in step 4.
4. *Spans.*  Back at the documents, a window whose smallest holder is a smaller ``doc_id`` marks its bytes.

Defined results: a null text counts as empty; texts under ``length`` bytes lose nothing; a row with a null ``doc_id``
counts as the largest id there is, 2^63 - 1 (and not larger than another null); rows that repeat a ``doc_id`` do not
remove from each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hashtrend.llm import text as tx
from hashtrend.llm.groups import documents_of, group_count, pack, tidy, unpack, unpack_bytes, with_group

LENGTH = 50
HOT_DOCUMENTS = 20_000
_RUN = 256  # windows in a segment at most; longer runs (periodic text) become several segments
_SPOTS = 1 << 20  # windows that repeat groups cover, handled at a time
_LOW = tx.U64(0xFFFFFFFF)


class _Plan:
    """Parameters that every step shares."""

    def __init__(self, length: int, buckets: int, hot: int):
        self.length, self.buckets, self.hot = length, buckets, hot
        self.k = max(1, min(20, length * 2 // 5))
        self.words = length // 8 + 1

    def runs(self, b: np.ndarray):
        """(first window, number of windows, anchor hash) of each run of windows with one anchor."""
        m = tx.sliding_min(tx.byte_grams(b, self.k), self.length - self.k + 1)
        edge = np.flatnonzero(m[1:] != m[:-1]) + 1
        starts = np.concatenate(([0], edge))
        lens = np.diff(np.concatenate((starts, [len(m)])))
        if lens.max() > _RUN:
            parts = (lens + _RUN - 1) // _RUN
            piece = tx.ranges(np.zeros(len(lens), np.int64), parts)
            total = np.repeat(lens, parts)
            starts = np.repeat(starts, parts) + piece * _RUN
            lens = np.minimum(_RUN, total - piece * _RUN)
        return starts, lens, m[starts]

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> tx.U64(32)) % tx.U64(self.buckets)).astype(np.int64)


def _ordered(table: pa.Table):
    """Documents of a group by (doc_id, text): ids, byte arrays and their places in the table."""
    data, offsets = tx.flat(table["text"])
    ids = tx.longs(table["doc_id"])
    texts = [data[offsets[i] : offsets[i + 1]] for i in range(len(ids))]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i].tobytes() if len(texts[i]) else b""))
    return ids[order], [texts[i] for i in order], order


_SENT = "bucket int, gid int, one binary, many binary, counts binary"


def _send_anchors(plan: _Plan):
    def send(key, table):
        found = []
        data, offsets = tx.flat(table["text"])
        for i in range(len(offsets) - 1):
            b = data[offsets[i] : offsets[i + 1]]
            if len(b) >= plan.length:
                found.append(np.unique(plan.runs(b)[2]))
        out: dict[str, list] = {n: [] for n in ("bucket", "one", "many", "counts")}
        if found:
            h, n = np.unique(np.concatenate(found), return_counts=True)
            bucket = plan.bucket(h)
            order = np.argsort(bucket, kind="stable")
            h, n, bucket = (h[order] & _LOW).astype(np.uint32), n[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(plan.buckets + 1))
            for k in np.flatnonzero(np.diff(cut)):
                part, count = h[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]]
                out["bucket"].append(int(k))
                out["one"].append(np.sort(part[count == 1]).tobytes())
                out["many"].append(part[count > 1].tobytes())
                out["counts"].append(count[count > 1].astype(np.uint32).tobytes())
        out["gid"] = [key[0].as_py()] * len(out["bucket"])
        return _table(out, _ARROW_SENT)

    return send


def _shared_anchors(plan: _Plan):
    """Answers each group with the anchors of a bucket that at least two documents hold."""

    def shared(key, table):
        keys, counts, group = [], [], []
        gids = table["gid"].to_pylist()
        for at, (one, many, n) in enumerate(
            zip(table["one"].to_pylist(), table["many"].to_pylist(), table["counts"].to_pylist(), strict=True)
        ):
            one, many = np.frombuffer(one, np.uint32), np.frombuffer(many, np.uint32)
            keys += [one, many]
            counts += [np.ones(len(one), np.uint32), np.frombuffer(n, np.uint32)]
            group.append(np.full(len(one) + len(many), at, np.int32))
        h, n, g = np.concatenate(keys), np.concatenate(counts), np.concatenate(group)
        order = np.argsort(h, kind="stable")
        h, n, g = h[order], n[order], g[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        total = np.add.reduceat(n.astype(np.int64), first)
        total = np.repeat(total, np.diff(np.concatenate((first, [len(h)]))))
        keep = total > 1
        h, g, hot = h[keep], g[keep], total[keep] >= plan.hot
        order = np.argsort(g, kind="stable")
        h, g, hot = h[order], g[order], hot[order]
        cut = np.searchsorted(g, np.arange(len(gids) + 1))
        out: dict[str, list] = {n: [] for n in ("gid", "bucket", "a", "b", "c")}
        for i in np.flatnonzero(np.diff(cut)):
            out["gid"].append(gids[i])
            out["bucket"].append(key[0].as_py())
            out["a"].append(h[cut[i] : cut[i + 1]].tobytes())
            out["b"].append(np.packbits(hot[cut[i] : cut[i + 1]]).tobytes())
            out["c"].append(None)
        return _table(out, _ARROW_BACK)

    return shared


_BACK = "gid int, bucket int, a binary, b binary, c binary"
_ARROW_BACK = pa.schema([("gid", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_ARROW_SENT = pa.schema(
    [("bucket", pa.int32()), ("gid", pa.int32()), ("one", pa.binary()), ("many", pa.binary()), ("counts", pa.binary())]
)


def _table(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


class _Segments:
    """The distinct segments of a group, in the order that both later steps rebuild."""

    def __init__(self, plan: _Plan, table: pa.Table, answers: pa.Table):
        self.ids, self.texts, self.order = _ordered(table)
        keys, hot = [], []
        for bucket, a, b, c in zip(*(answers[n].to_pylist() for n in ("bucket", "a", "b", "c")), strict=True):
            if c is None:
                h = np.frombuffer(a, np.uint32)
                keys.append(h.astype(np.uint64) | (tx.U64(bucket) << tx.U64(32)))
                hot.append(np.unpackbits(np.frombuffer(b, np.uint8), count=len(h)))
        known = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        is_hot = np.concatenate(hot) if hot else np.zeros(0, np.uint8)
        order = np.argsort(known)
        known, is_hot = known[order], is_hot[order]
        index: dict[bytes, int] = {}
        self.seg: list[bytes] = []  # distinct segments
        self.bucket: list[int] = []
        self.holder: list[int] = []  # smallest doc_id
        docs, starts, which = [], [], []
        L = plan.length
        for d, b in enumerate(self.texts):
            if len(b) < L or not len(known):
                continue
            s, n, h = plan.runs(b)
            bucket = plan.bucket(h)
            full = (h & _LOW) | (bucket.astype(np.uint64) << tx.U64(32))
            at = np.minimum(np.searchsorted(known, full), len(known) - 1)
            hit = np.flatnonzero(known[at] == full)
            if not len(hit):
                continue
            lo, hi, where = s[hit], s[hit] + n[hit] + L - 1, bucket[hit]
            burning = is_hot[at[hit]] == 1
            if burning.any():  # windows one by one, dealt by their own hash
                cold = ~burning
                single = tx.ranges(lo[burning], n[hit][burning])
                lo = np.concatenate((lo[cold], single))
                hi = np.concatenate((hi[cold], single + L))
                own = tx.byte_grams_at(b, L, single) % tx.U64(plan.buckets)
                where = np.concatenate((where[cold], own.astype(np.int64)))
            raw, mine = b.tobytes(), self.ids[d]
            own = [raw[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
            for piece, k in zip(own, where.tolist(), strict=True):
                if piece not in index:
                    index[piece] = len(index)
                    self.bucket.append(k)
                    self.holder.append(mine)
            which.append([index[piece] for piece in own])
            starts.append(lo)
            docs.append(np.full(len(lo), d))
        self.seg = list(index)
        none = [np.zeros(0, np.int64)]
        self.doc, self.start = np.concatenate(docs or none), np.concatenate(starts or none)
        self.which = np.array([x for w in which for x in w], np.int64)

    def by_bucket(self):
        """(bucket, indices of its segments) in a fixed order."""
        bucket = np.array(self.bucket, np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cut):
            if len(part):
                yield int(bucket[part[0]]), part


_ARROW_SEG = pa.schema([("bucket", pa.int32()), ("gid", pa.int32()), ("bytes", pa.binary()), ("lens", pa.binary()), ("holders", pa.binary())])
_SEG = "bucket int, gid int, bytes binary, lens binary, holders binary"


def _send_segments(plan: _Plan):
    def send(key, table, answers):
        out: dict[str, list] = {f.name: [] for f in _ARROW_SEG}
        if table.num_rows:
            segs = _Segments(plan, table, answers)
            holder = np.array(segs.holder, np.int64)
            for bucket, part in segs.by_bucket():
                chosen = [segs.seg[i] for i in part.tolist()]
                out["bucket"].append(bucket)
                out["gid"].append(key[0].as_py())
                out["bytes"].append(pack(b"".join(chosen)))
                out["lens"].append(pack(np.array([len(x) for x in chosen], np.uint16 if plan.length < 4096 else np.uint32)))
                out["holders"].append(pack(holder[part]))
        return _table(out, _ARROW_SEG)

    return send


def interval_tree(lcp: np.ndarray, change: np.ndarray, least: int):
    """Left-diverse intervals (lcp, first, last, lcp of the interval around it) of one run of a suffix array.

    ``lcp[i]`` belongs to neighbours i-1 and i (``lcp[0]`` unused); ``change`` counts, up to each place, how often the
    left byte differs from its neighbour's, so an interval is left-diverse when the count grows inside it.
    """
    found, stack = [], []
    depth, left = lcp.tolist(), change.tolist()
    n = len(depth)
    for i in range(1, n + 1):
        now = depth[i] if i < n else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            high, first = stack.pop()
            if high >= least and left[i - 1] > left[first]:
                found.append((high, first, i - 1, max(now, stack[-1][0] if stack else 0, least - 1)))
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, first))
    return found


def maximal_repeats(segments: list[bytes], length: int, words: int | None = None):
    """Maximal repeat groups of at least ``length`` bytes in a list of distinct segments.

    Returns (lens, around, sizes, members): for each group its length, the length of the repeat group that encloses it
    (length - 1 if none does), its number of occurrences, and the concatenated occurrences as places in the segments
    joined by one 0xFF byte each.
    """
    words = words or length // 8 + 1
    longest = max(map(len, segments), default=0)
    joined = b"\xff".join(segments) + b"\xff" * (longest + 16 * words + 16)
    b = np.frombuffer(joined, np.uint8)
    seg_len = np.array([len(s) for s in segments], np.int64)
    begin = np.cumsum(seg_len + 1) - seg_len - 1
    windows = np.maximum(seg_len - length + 1, 0)
    pos = tx.ranges(begin, windows)
    end = np.repeat(begin + seg_len, windows)
    none = np.zeros(0, np.int64)
    if len(pos) < 2:
        return none, none, none, none
    # windows that occur once cannot be part of a repeat
    prints = tx.byte_grams_at(b, length, pos)
    order = np.argsort(prints)
    same = prints[order][1:] == prints[order][:-1]
    keep = np.zeros(len(pos), bool)
    keep[order[1:][same]] = True
    keep[order[:-1][same]] = True
    pos, end = pos[keep], end[keep]
    if len(pos) < 2:
        return none, none, none, none
    eight = np.lib.stride_tricks.sliding_window_view(b, 8)

    def word(places: np.ndarray) -> np.ndarray:
        """The 8 bytes at each place as a number that sorts like them."""
        return eight[places].reshape(-1).view(">u8").astype(np.uint64)

    order = np.lexsort([word(pos + 8 * w) for w in range(words - 1, -1, -1)])
    sa, end = pos[order], end[order]
    # longest common prefix of neighbours; places that still agree are sorted by their next words
    lcp = np.zeros(len(sa), np.int64)
    alive, done = np.arange(1, len(sa)), 0
    while True:
        for w in range(done, done + words):
            x = word(sa[alive] + 8 * w) ^ word(sa[alive - 1] + 8 * w)
            equal = x == 0
            rest = x[~equal]
            high = np.zeros(len(rest), np.int64)
            for shift in (32, 16, 8):
                big = rest >> tx.U64(64 - shift) == 0
                high += np.where(big, shift // 8, 0)
                rest = np.where(big, rest << tx.U64(shift), rest)
            lcp[alive[~equal]] = 8 * w + high
            alive = alive[equal]
        done += words
        lcp[alive] = 8 * done
        # one that ends just here still has to be sorted away from between two that go on
        alive = alive[np.minimum(end[alive] - sa[alive], end[alive - 1] - sa[alive - 1]) >= 8 * done]
        if not len(alive):
            break
        tied = np.zeros(len(sa), bool)
        tied[alive] = tied[alive - 1] = True
        at = np.flatnonzero(tied)
        head = np.ones(len(sa), bool)
        head[alive] = False
        keys = [word(sa[at] + 8 * w) for w in range(done + words - 1, done - 1, -1)]
        order = at[np.lexsort([*keys, np.cumsum(head)[at]])]
        sa[at], end[at] = sa[order], end[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(end[1:] - sa[1:], end[:-1] - sa[:-1]))
    lcp[lcp < length] = 0
    starts_segment = np.zeros(len(b) + 1, bool)
    starts_segment[begin] = True
    left = b[sa - 1].astype(np.int64)
    edge = starts_segment[sa]
    left[edge] = -1 - np.flatnonzero(edge)
    change = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))
    runs = np.flatnonzero(lcp == 0)
    stops = np.concatenate((runs[1:], [len(sa)]))
    diverse = (stops - runs > 1) & (change[stops - 1] > change[runs])
    groups: list[tuple[int, int, int, int]] = []
    for lo, hi in zip(runs[diverse].tolist(), stops[diverse].tolist(), strict=True):
        if hi - lo == 2:
            groups.append((int(lcp[lo + 1]), lo, lo + 1, length - 1))
        else:
            groups += [(n, lo + a, lo + z, m) for n, a, z, m in interval_tree(lcp[lo:hi], change[lo:hi], length)]
    if not groups:
        return none, none, none, none
    lens, first, last, around = np.array(groups, np.int64).T
    sizes = last - first + 1
    return lens, around, sizes, sa[tx.ranges(first, sizes)]


def _find_repeats(plan: _Plan):
    """Per bucket: the smallest doc_id that holds each window of the segments each group sent, run-length coded."""

    def find(key, table):
        index: dict[bytes, int] = {}
        segments: list[bytes] = []
        holder: list[int] = []
        sent = []
        size = np.uint16 if plan.length < 4096 else np.uint32
        for blob, lens, holders in zip(table["bytes"].to_pylist(), table["lens"].to_pylist(), table["holders"].to_pylist(), strict=True):
            raw, lens, at = unpack_bytes(blob), unpack(lens, size).tolist(), 0
            which = np.empty(len(lens), np.int64)
            for i, (n, d) in enumerate(zip(lens, unpack(holders, np.int64).tolist(), strict=True)):
                piece = raw[at : at + n]
                at += n
                x = index.get(piece)
                if x is None:
                    x = index[piece] = len(segments)
                    segments.append(piece)
                    holder.append(d)
                elif d < holder[x]:
                    holder[x] = d
                which[i] = x
            sent.append(which)
        del index
        L = plan.length
        seg_len = np.array([len(s) for s in segments], np.int64)
        begin = np.cumsum(seg_len + 1) - seg_len - 1
        windows = seg_len - L + 1
        first_window = np.cumsum(windows) - windows
        least = np.repeat(np.array(holder, np.int64), windows)
        lens, around, sizes, members = maximal_repeats(segments, L, plan.words)
        holder = np.array(holder, np.int64)
        group_first = np.cumsum(sizes) - sizes
        # the enclosing group holds all occurrences of the inner one: only windows beyond it are new
        work = np.cumsum(sizes * (lens - around))
        lo = 0
        while lo < len(lens):  # a bounded number of windows at a time
            hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + _SPOTS, side="right")))
            n = sizes[lo:hi]
            part = members[group_first[lo] : group_first[hi - 1] + sizes[hi - 1]]
            seg = np.searchsorted(begin, part, side="right") - 1
            smallest = np.minimum.reduceat(holder[seg], group_first[lo:hi] - group_first[lo])
            covered = np.repeat((lens - around)[lo:hi], n)
            spots = tx.ranges(first_window[seg] + part - begin[seg] + np.repeat(around[lo:hi] - L + 1, n), covered)
            np.minimum.at(least, spots, np.repeat(np.repeat(smallest, n), covered))
            lo = hi
        # run lengths that do not cross segments
        cut = np.ones(len(least), bool)
        cut[1:] = least[1:] != least[:-1]
        cut[first_window] = True
        run = np.flatnonzero(cut)
        run_len = np.diff(np.concatenate((run, [len(least)])))
        run_first = np.searchsorted(run, first_window)
        run_count = np.diff(np.concatenate((run_first, [len(run)])))
        out: dict[str, list] = {f.name: [] for f in _ARROW_BACK}
        for gid, which in zip(table["gid"].to_pylist(), sent, strict=True):
            take = tx.ranges(run_first[which], run_count[which])
            out["gid"].append(gid)
            out["bucket"].append(key[0].as_py())
            out["a"].append(pack(run_count[which].astype(np.uint16)))
            out["b"].append(pack(run_len[take].astype(np.uint16)))
            out["c"].append(pack(least[run[take]]))
        return _table(out, _ARROW_BACK)

    return find


_ARROW_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("span_starts", pa.list_(pa.int64())),
        ("span_ends", pa.list_(pa.int64())),
        ("kept", pa.binary()),
    ]
)
_OUT = "doc_id long, text_key long, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>, kept binary"


def _cut_documents(plan: _Plan):
    def finished(out, table, order):
        if "rest" not in table.column_names:
            return _table(out, _ARROW_OUT)
        text = pa.array([b.decode("utf-8", "ignore") for b in out["kept"]], pa.string())
        return pa.table({"text": text, "rest": table["rest"].take(pa.array(order, pa.int64()))})

    def cut(key, table, answers):
        out: dict[str, list] = {f.name: [] for f in _ARROW_OUT}
        if not table.num_rows:
            return finished(out, table, [])
        segs = _Segments(plan, table, answers)
        keys, no_id = table["text_key"].to_pylist(), np.asarray(table["doc_id"].is_null())[segs.order]
        sizes = np.array([len(t) for t in segs.texts], np.int64)
        offset = np.cumsum(sizes) - sizes
        mark = np.zeros(int(sizes.sum()) + 1, np.int32)
        if segs.seg:
            said = {
                bucket: (unpack(a, np.uint16), unpack(b, np.uint16), unpack(c, np.int64))
                for bucket, a, b, c in zip(*(answers[n].to_pylist() for n in ("bucket", "a", "b", "c")), strict=True)
                if c is not None
            }
            count = np.zeros(len(segs.seg), np.int64)
            place = np.zeros(len(segs.seg), np.int64)
            lens, least, at = [], [], 0
            for bucket, part in segs.by_bucket():
                n, run, m = said[bucket]
                count[part] = n
                place[part] = at + np.cumsum(n.astype(np.int64)) - n
                lens.append(run)
                least.append(m)
                at += len(run)
            lens, least = np.concatenate(lens).astype(np.int64), np.concatenate(least)
            inside = np.cumsum(lens) - lens  # windows before a run, within its segment
            inside -= np.repeat(inside[place[np.argsort(place)]], count[np.argsort(place)])
            n = count[segs.which]
            take = tx.ranges(place[segs.which], n)
            own = np.repeat(segs.ids[segs.doc], n)
            hit = least[take] < own
            lo = (np.repeat(offset[segs.doc] + segs.start, n) + inside[take])[hit]
            hi = lo + lens[take][hit] + plan.length - 1
            np.add.at(mark, lo, 1)
            np.add.at(mark, hi, -1)
        gone = np.cumsum(mark)[:-1] > 0
        for d, b in enumerate(segs.texts):
            own = gone[offset[d] : offset[d] + sizes[d]]
            step = np.diff(np.concatenate(([0], own.view(np.int8), [0])))
            out["doc_id"].append(None if no_id[d] else int(segs.ids[d]))
            out["n_bytes"].append(int(sizes[d]))
            out["n_removed"].append(int(own.sum()))
            out["span_starts"].append(np.flatnonzero(step == 1).tolist())
            out["span_ends"].append(np.flatnonzero(step == -1).tolist())
            out["kept"].append(b[~own].tobytes())
        out["text_key"] = [keys[i] for i in segs.order]
        return finished(out, table, segs.order)

    return cut


def suffix_dedup(docs: DataFrame, length: int = LENGTH, hot_documents: int = HOT_DOCUMENTS, carry: bool = False) -> DataFrame:
    """Repeated passages of every document: removed spans and the bytes that stay.

    Returns doc_id, text_key (xxhash64 of the text), n_bytes, n_removed, span_starts, span_ends (byte offsets of the maximal removed runs, ends
    exclusive) and kept (the remaining bytes).  With ``carry``, only ``text`` (the remaining bytes as characters; one cut
    in part goes whole) and ``rest``: a struct of the row's other columns and of ``is_null``, whether the text was null.
    """
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"], docs["text"].isNull().alias("is_null"))
    docs = documents_of(docs, [rest.alias("rest")] if carry else []).withColumn("text_key", F.xxhash64("text"))
    groups = group_count(docs)
    plan = _Plan(length, 2 * groups, hot_documents)
    rows = with_group(docs, groups)
    by_gid = lambda df: df.groupBy("gid")
    shared = by_gid(rows).applyInArrow(tidy(_send_anchors(plan)), _SENT).groupBy("bucket").applyInArrow(tidy(_shared_anchors(plan)), _BACK)
    holders = (
        by_gid(rows)
        .cogroup(by_gid(shared))
        .applyInArrow(tidy(_send_segments(plan)), _SEG)
        .groupBy("bucket")
        .applyInArrow(tidy(_find_repeats(plan)), _BACK)
    )
    schema = StructType([StructField("text", StringType()), docs.schema["rest"]]) if carry else StructType.fromDDL(_OUT)
    return by_gid(rows).cogroup(by_gid(shared.unionByName(holders))).applyInArrow(tidy(_cut_documents(plan)), schema)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their repeated passages cut out of ``text`` (a character cut in part goes whole) and their
    new ``n_chars``; all other columns and all rows stay.  The other columns travel with the text, so no row is looked
    up again, and the step that cuts a text also decodes it: a second Python step in the same tasks would keep a second
    worker a core for the rest of the session.

    Defined results are those of the module: null texts stay null, empty ones empty, rows that repeat a doc_id all stay,
    an empty table gives an empty result."""

    cut = suffix_dedup(docs, length, carry=True)
    text = F.when(~F.col("rest.is_null"), F.col("text"))
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in docs.columns else None}
    return cut.select(*[new.get(c) if c in new else F.col("rest").getField(c).alias(c) for c in docs.columns])


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("span_starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(rows: list[tuple[int | None, str | None]], length: int = LENGTH) -> dict:
    """The definition itself, for small tables: {doc_id: (n_bytes, n_removed, n_spans, sha256)}."""
    texts = [(tx.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, int] = {}
    for i, b in texts:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(least.get(w, i), i)
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
