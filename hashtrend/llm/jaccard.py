"""Exact similarity join of documents on word shingles, with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of ``SIZE``-word shingles is at least ``NUM / DEN``.

1. *Order.*  All shingles are counted over all documents (each group of documents sends each once, ``groups``); their
   order is by document frequency, ties by hash.  Any one order makes the prefix filter exact; this one puts the
   shingles of common passages behind those that only near copies share.  (With ``counted`` below 1 only that part of
   the hash range is counted, and the other shingles come last.)
2. *Prefixes.*  A similar document shares at least ``a = ceil(n * NUM / DEN)`` of a document's ``n`` shingles, and so
   at least ``l`` of its first ``n - a + l``.  Each document picks the ``l`` with the least estimated cost: the
   shingles it sends plus the candidates it may meet, at most (sum of document frequencies) / l.  Two documents with
   ``l`` of x and y must share min(x, y) prefix shingles.  A document with fewer than ``l`` shared prefix shingles
   links with nothing and sends none.
3. *Classes.*  Documents with equal sets are one class; only its smallest doc_id goes on.
4. *Links.*  First every document is compared with the most central document of each prefix shingle's list (the one
   whose shingles are commonest, as in the original among its near copies), which joins most of a group of near copies
   into one component without looking at all its pairs.  Then all pairs of a list whose
   ends still lie in different components are compared, so no link between components is lost.

Defined results: a document without words (null, empty, white space) has an empty set and links with nothing; rows that
repeat a doc_id share its component; a row with a null doc_id gets a null component and links with nothing; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm import text as tx
from hashtrend.llm.components import connected_components, forest
from hashtrend.llm.groups import checkpoint, documents_of, group_count, pack, shuffle_partitions, tidy, unpack, unpack_bytes, with_group
from hashtrend.llm.labelled import pieces

SIZE = 5
NUM, DEN = 3, 4
COUNTED = 1.0
MOST_MATCHES = 8
VERIFY_COST = 4.0
BLOCK = 2048
PAIR_BYTES = 1 << 20  # compressed texts of pairs that are compared at a time
_LOW = tx.U64(0xFFFFFFFF)


def shingle_sets(column, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = tx.flat(column)
    data = tx.LOWER[data]
    starts, ends, first = tx.words(data, offsets, tx.NOT_SPACE)
    h = tx.word_hashes(data, starts, ends)
    every = tx.shingles(h, size)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(every[lo : hi - size + 1]))
        elif hi > lo:  # fewer words: the whole sequence is one shingle, apart from longer ones
            out.append(tx.shingles(h[lo:hi], hi - lo) ^ tx.U64(hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _limit(counted: float) -> np.uint64:
    return tx.U64(min(int(counted * (1 << 64)), (1 << 64) - 1))


_SENT = "bucket int, gid int, keys binary, counts binary"
_BACK = "gid int, bucket int, keys binary, counts binary"
_ARROW = {"bucket": pa.int32(), "gid": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}


def _arrow(columns: dict[str, list]) -> pa.Table:
    return pa.table({n: pa.array(v, _ARROW[n]) for n, v in columns.items()})


def _pack_keys(ascending: np.ndarray) -> bytes:
    return pack(np.diff(ascending, prepend=np.uint32(0)))


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint32), dtype=np.uint32)


def _send_counts(buckets: int, counted: float, size: int):
    limit = _limit(counted)

    def send(key, table):
        sets = [s[s < limit] for s in shingle_sets(table["text"], size)]
        h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        bucket = ((h >> tx.U64(32)) % tx.U64(buckets)).astype(np.int64)
        low = (h & _LOW).astype(np.uint32)
        order = np.lexsort((low, bucket))
        low, n = low[order], n[order]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out: dict[str, list] = {"bucket": [], "gid": [], "keys": [], "counts": []}
        for k in np.flatnonzero(np.diff(cut)).tolist():
            part, count = low[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]]
            out["bucket"].append(k)
            out["gid"].append(key[0].as_py())
            out["keys"].append(_pack_keys(part))
            out["counts"].append(pack(count.astype(np.uint32)))
        return _arrow(out)

    return send


def _add_counts(key, table):
    """Document frequencies of the keys of a bucket that at least two documents hold, to each group that sent them."""
    gids = table["gid"].to_pylist()
    keys, counts, group = [], [], []
    for at, (blob, n) in enumerate(zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True)):
        k = _unpack_keys(blob)
        keys.append(k)
        counts.append(unpack(n, np.uint32))
        group.append(np.full(len(k), at, np.int32))
    h, n, g = np.concatenate(keys), np.concatenate(counts), np.concatenate(group)
    order = np.argsort(h, kind="stable")
    h, n, g = h[order], n[order], g[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    total = np.repeat(np.add.reduceat(n.astype(np.int64), first), np.diff(np.concatenate((first, [len(h)]))))
    keep = total > 1
    h, g, total = h[keep], g[keep], np.minimum(total[keep], 0xFFFFFFFF).astype(np.uint32)
    order = np.argsort(g, kind="stable")
    h, g, total = h[order], g[order], total[order]
    cut = np.searchsorted(g, np.arange(len(gids) + 1))
    out: dict[str, list] = {"gid": [], "bucket": [], "keys": [], "counts": []}
    for i in np.flatnonzero(np.diff(cut)).tolist():
        out["gid"].append(gids[i])
        out["bucket"].append(key[0].as_py())
        out["keys"].append(_pack_keys(h[cut[i] : cut[i + 1]]))
        out["counts"].append(pack(total[cut[i] : cut[i + 1]]))
    return _arrow(out)


def prefix(own: np.ndarray, frequency: np.ndarray, num: int, den: int, most: int = MOST_MATCHES) -> tuple[int, int, np.ndarray]:
    """(matches required, shingles behind the prefix, shared prefix shingles) of a set whose members have these
    document frequencies (0: not counted, so behind all counted ones)."""
    n = len(own)
    need = -(-n * num // den)
    rank = np.where(frequency > 0, frequency, np.iinfo(np.int64).max)
    order = np.lexsort((own, rank))[: n - need + min(most, need)]
    # uncounted shingles may be shared by any number of documents; they count as shared by two
    df = np.where(frequency[order] > 0, frequency[order], 2)
    sends, meets = np.cumsum(df > 1), np.cumsum(df - 1)
    matches = np.arange(1, min(most, need) + 1)
    last = n - need + matches - 1
    cost = sends[last] + VERIFY_COST * meets[last] / matches
    best = int(np.argmin(cost))
    if sends[last[best]] < matches[best]:
        return int(matches[best]), 0, own[:0]
    chosen = order[: last[best] + 1]
    return int(matches[best]), n - len(chosen), own[chosen[df[: len(chosen)] > 1]]


_DOCS = "doc_id long, n_shingles long, set_key binary, matches int, rest long, central double, tokens array<long>, members binary"


def _take_prefixes(buckets: int, counted: float, size: int, num: int, den: int):
    limit = _limit(counted)

    def take(key, table, answers):
        keys, counts = [], []
        for bucket, k, n in zip(*(answers[c].to_pylist() for c in ("bucket", "keys", "counts")), strict=True):
            keys.append(_unpack_keys(k).astype(np.uint64) | (tx.U64(bucket) << tx.U64(32)))
            counts.append(unpack(n, np.uint32).astype(np.int64))
        known = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        order = np.argsort(known)
        known, count = known[order], count[order]
        sets = shingle_sets(table["text"], size)
        set_key, matches, rest, central, tokens, members = [], [], [], [], [], []
        data, at_text = tx.flat(table["text"])
        for own, lo, hi in zip(sets, at_text[:-1].tolist(), at_text[1:].tolist(), strict=True):
            set_key.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            l, behind, chosen, weight = 0, 0, own[:0], 0.0
            if len(own):
                frequency = np.zeros(len(own), np.int64)
                low = np.flatnonzero(own < limit)
                frequency[low] = 1
                if len(known):
                    h = own[low]
                    full = (h & _LOW) | (((h >> tx.U64(32)) % tx.U64(buckets)) << tx.U64(32))
                    at = np.minimum(np.searchsorted(known, full), len(known) - 1)
                    frequency[low] = np.where(known[at] == full, count[at], 1)
                weight = float(np.log2(np.maximum(frequency, 1)).sum() / len(own))
                l, behind, chosen = prefix(own, frequency, num, den)
            matches.append(l)
            rest.append(behind)
            central.append(weight)
            tokens.append(chosen.view(np.int64))
            members.append(pack(data[lo:hi].tobytes()) if len(chosen) else None)
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_key": pa.array(set_key, pa.binary()),
                "matches": pa.array(matches, pa.int32()),
                "rest": pa.array(rest, pa.int64()),
                "central": pa.array(central, pa.float64()),
                "tokens": pa.array(tokens, pa.list_(pa.int64())),
                "members": pa.array(members, pa.binary()),
            }
        )

    return take


def member_sets(blobs: list[bytes], size: int) -> list[np.ndarray]:
    """The shingle sets of compressed texts."""
    return shingle_sets(pa.array([unpack_bytes(b) for b in blobs], pa.large_binary()), size)


def verified(pairs: DataFrame, sets: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, as edges (u, v)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PAIR_BYTES):
            # a text that several pairs of the batch share is taken apart once
            place: dict[bytes, int] = {}
            ends = [[place.setdefault(b, len(place)) for b in batch.column(c).to_pylist()] for c in ("x", "y")]
            own = member_sets(list(place), size)
            keep = []
            for i, j in zip(*ends, strict=True):
                x, y = own[i], own[j]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["u", "v"])

    side = lambda name, blob: sets.select(F.col("node").alias(name), F.col("members").alias(blob))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(check, "u long, v long")


_TILES = "array<struct<p:int,q:int,side:int>>"
_LONG_LIST = 64


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of distinct-valued sets.

    Values held by many sets are columns of a matrix product; for the others their few pairs are added up.
    """
    n, m = len(left), len(right)
    value = np.concatenate(left + right)
    owner = np.repeat(np.arange(n + m), [len(x) for x in left + right])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
    held = np.diff(np.concatenate((first, [len(value)])))
    in_left = np.add.reduceat((owner < n).astype(np.int64), first) if len(first) else held
    in_right = held - in_left
    out = np.zeros((n, m), np.float32)
    long_ = np.flatnonzero((in_left > 0) & (in_right > 0) & (held > _LONG_LIST))
    for lo in range(0, len(long_), 4096):
        cols = long_[lo : lo + 4096]
        at = tx.ranges(first[cols], held[cols])
        grid = np.zeros((n + m, len(cols)), np.float32)
        grid[owner[at], np.repeat(np.arange(len(cols)), held[cols])] = 1
        out += grid[:n] @ grid[n:].T
    short = np.flatnonzero((in_left > 0) & (in_right > 0) & (held <= _LONG_LIST))
    for lo in range(0, len(short), 1 << 16):
        some = short[lo : lo + (1 << 16)]
        a, b = in_left[some], in_right[some]
        x = np.repeat(tx.ranges(first[some], a), np.repeat(b, a))
        y = np.repeat(first[some] + a, a * b) + tx.ranges(np.zeros(int(a.sum()), np.int64), np.repeat(b, a))
        pair, count = np.unique(owner[x] * m + owner[y] - n, return_counts=True)
        out.ravel()[pair] += count
    return out


def _tile_links(size: int, num: int, den: int):
    """The links of a tile, as edges of a spanning forest."""

    def links(key, table):
        side = table["side"].to_numpy()
        node, n, matches, rest = (table[c].to_numpy().astype(np.int64) for c in ("node", "n", "matches", "rest"))
        at = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
        same = -1 - key[1].as_py() == key[2].as_py()  # a block against itself
        i, j = (at[0], at[0]) if same else at
        none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        if not len(i) or not len(j):
            return none
        tokens = [np.array(t, np.int64) for t in table["tokens"].to_pylist()]
        shared = overlaps([tokens[x] for x in i], [tokens[y] for y in j])
        whole = n[i][:, None] + n[j][None, :]
        need = np.maximum(
            np.minimum(matches[i][:, None], matches[j][None, :]),
            -(-whole * num // (num + den)) - np.maximum(rest[i][:, None], rest[j][None, :]),
        )
        maybe = (shared >= np.maximum(need, 1)) & (node[i][:, None] != node[j][None, :])
        maybe &= den * np.minimum(n[i][:, None], n[j][None, :]) >= num * np.maximum(n[i][:, None], n[j][None, :])
        if same:
            maybe = np.triu(maybe, 1)
        x, y = np.nonzero(maybe)
        if not len(x):
            return none
        met = np.unique(np.concatenate((i[x], j[y])))
        members = dict(zip(met.tolist(), member_sets(table["members"].take(pa.array(met)).to_pylist(), size), strict=True))
        if len(x) > 4 * (len(i) + len(j)):
            empty = np.zeros(0, np.uint64)
            both = overlaps([members.get(k, empty) for k in i.tolist()], [members.get(k, empty) for k in j.tolist()])[x, y].astype(np.int64)
        else:
            both = np.array([len(np.intersect1d(members[i[a]], members[j[b]], assume_unique=True)) for a, b in zip(x, y, strict=True)])
        good = den * both >= num * (whole[x, y] - both)
        u, v = forest(node[i[x[good]]], node[j[y[good]]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return links


def similarity_classes(
    docs: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN, counted: float = COUNTED, block: int = BLOCK
) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links) of every document."""
    spark = docs.sparkSession
    docs = documents_of(docs)
    groups = group_count(docs)
    buckets = max(groups, shuffle_partitions(spark))
    rows = with_group(docs, groups)
    counts = (
        rows.groupBy("gid").applyInArrow(tidy(_send_counts(buckets, counted, size)), _SENT).groupBy("bucket").applyInArrow(tidy(_add_counts), _BACK)
    )
    base = checkpoint(rows.groupBy("gid").cogroup(counts.groupBy("gid")).applyInArrow(tidy(_take_prefixes(buckets, counted, size, num, den)), _DOCS))

    named = base.filter("doc_id is not null and set_key is not null")
    classes = checkpoint(named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n")))
    of_class = named.select("doc_id", "set_key").join(classes.select("set_key", "node"), "set_key").select("doc_id", "node", "set_key")

    # one row a class: its node, shingle count, required matches, prefix and members
    sets = (
        named.filter(F.size("tokens") > 0)
        .select("set_key", F.col("doc_id").alias("node"), "n_shingles", "matches", "rest", "central", "tokens", "members")
        .join(classes.select("set_key", "node"), ["set_key", "node"])
        .dropDuplicates(["set_key", "node"])
    )
    sets = checkpoint(sets.select("node", F.col("n_shingles").alias("n"), "matches", "rest", "central", "tokens", "members"))
    postings = sets.select("node", "n", "matches", "rest", "central", F.explode("tokens").alias("token"))
    fits = lambda n, m: den * F.least(n, m) >= num * F.greatest(n, m)

    def required(l, m, n, k, r, q):
        """Prefix shingles two documents must share: the smaller of their matches, and what the whole overlap needs
        beyond the shingles behind the prefix that ends first in the order."""
        overlap = F.ceil((F.col(n) + F.col(k)) * num / (num + den))
        return F.greatest(F.least(l, m).cast("long"), overlap - F.greatest(r, q))

    # each document against the most central one of each of its lists
    rank = F.struct("central", (-F.col("node")).alias("order"), "node", "n", "matches", "rest")
    heads = (
        postings.groupBy("token")
        .agg(F.max(rank).alias("head"), F.count("*").alias("held"))
        .filter("held > 1")
        .select("token", "head")
    )
    first = (
        postings.join(heads, "token")
        .filter((F.col("node") != F.col("head.node")) & fits(F.col("n"), F.col("head.n")))
        .groupBy(F.col("head.node").alias("a"), F.col("node").alias("b"))
        .agg(F.count("*").alias("shared"), F.min(required("matches", "head.matches", "n", "head.n", "rest", "head.rest")).alias("required"))
        .filter("shared >= required")
        .select("a", "b")
    )
    first = checkpoint(first)
    edges = checkpoint(verified(first, sets, size, num, den))
    joined = connected_components(edges)

    # all other pairs of a list whose ends lie in different components, in tiles of the lists' heads
    place = lambda name: joined.select(F.col("node").alias(name), F.col("component").alias(f"{name}_in"))
    met = (
        postings.join(heads, "token")
        .select(F.col("head.node").alias("head"), "node")
        .distinct()
        .join(place("node"), "node", "left")
        .join(place("head"), "head", "left")
        .select("head", "node", (F.coalesce("node_in", "node") == F.coalesce("head_in", "head")).alias("inside"))
    )
    met = checkpoint(met)
    size_of = met.groupBy("head").agg(F.count_if("inside").alias("a"), F.count_if(~F.col("inside")).alias("b")).filter("b > 0")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    dealt = met.join(size_of.select("head", blocks("a").alias("na"), blocks("b").alias("nb")), "head")
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("na")).otherwise(F.col("nb"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tile = lambda p, q, side: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), side.cast("int").alias("side"))
    across = F.transform(upto("nb"), lambda j: tile(F.col("k"), j, F.lit(0)))
    back = F.when(F.col("na") > 0, F.transform(upto("na"), lambda i: tile(i, F.col("k"), F.lit(1)))).otherwise(F.array().cast(_TILES))
    among = F.transform(upto("nb"), lambda j: tile(-1 - F.least(j, "k"), F.greatest(j, "k"), F.when(j < F.col("k"), 1).otherwise(0)))
    tiles = dealt.select("head", "node", F.explode(F.when(F.col("inside"), across).otherwise(F.concat(back, among))).alias("t")).select("head", "t.*", "node")
    second = (
        tiles.join(sets.drop("central"), "node")
        .groupBy("head", "p", "q")
        .applyInArrow(tidy(_tile_links(size, num, den)), "u long, v long")
    )
    # rows that repeat a doc_id with different sets tie their classes together
    repeated = of_class.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).filter("u <> v").select("u", "v")
    final = connected_components(edges.union(second).union(repeated))

    node_component = checkpoint(
        classes.join(final.withColumnRenamed("node", "j"), F.col("node") == F.col("j"), "left").select(
            "set_key", F.coalesce("component", "node").alias("component")
        )
    )
    return base.select("doc_id", "n_shingles", "set_key").join(node_component, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows: list[tuple], size: int = SIZE, num: int = NUM, den: int = DEN) -> dict:
    """The definition itself, for small tables: {doc_id: (n_shingles, component)}."""
    sets: dict = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}
