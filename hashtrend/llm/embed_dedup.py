"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors are one class (links of copies are counted, not made).  Classes are dealt to blocks of ``BLOCK`` vectors;
every pair of blocks is a tile.  A vector u (of unit length, in double precision) is quantised to s*q + e with int8 q,
its own scale s and its exactly measured error |e|.  For two vectors

    | u.v - s_u s_v (q_u . q_v) |  <=  |e_u| |s_v q_v| + |s_u q_u| |e_v| + |e_u| |e_v|

so a tile multiplies the int8 vectors (as float32, whose sums of these products are exact), and only pairs whose
product can reach the threshold under that bound are computed again from the original vectors in double precision.
Pairs stay in their tile: it sends each vector's link count and a spanning forest of its links, at most one row a
vector, however many pairs link.  Components come from those forests.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, not even
with their copies; vectors of different lengths do not link; a null vec_id takes no part and gets a null component;
rows that repeat a vec_id are one vector each with links of their own and share a component; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm.components import connected_components, forest
from hashtrend.llm.groups import checkpoint, importable, pack, unpack

THRESHOLD = 0.9
BLOCK = 4096
_STRIP = 1024  # rows of a tile multiplied at a time
_SLACK = 1e-9  # covers rounding of the bound itself


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that the largest component lies in [0.5, 1): directions and cosines stay,
    bit for bit, and no square overflows or vanishes, whatever the vector's own scale."""
    _, power = np.frexp(np.abs(x).max(1))
    return np.ldexp(x, -power[:, None])


class Quantised:
    """Unit vectors as int8 with scale, quantised length and error length."""

    def __init__(self, x: np.ndarray):
        self.norm = np.sqrt((x * x).sum(1))
        unit = x / self.norm[:, None]
        self.scale = np.abs(unit).max(1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        coarse = self.q * self.scale[:, None]
        self.length = np.sqrt((coarse * coarse).sum(1))
        self.error = np.sqrt(((unit - coarse) ** 2).sum(1)) + 1e-12


def linked_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """(i, j) of all pairs with cosine of at least ``threshold``; within x (i < j) if y is None."""
    x, y = scaled(x), None if y is None else scaled(y)
    a = Quantised(x)
    b = a if y is None else Quantised(y)
    other = x if y is None else y
    right = b.q.astype(np.float32).T.copy()
    found_i, found_j = [], []
    for lo in range(0, len(x), _STRIP):
        hi = min(len(x), lo + _STRIP)
        start = lo if y is None else 0
        product = a.q[lo:hi].astype(np.float32) @ right[:, start:]
        # smallest product of int8 vectors with which a pair can still reach the threshold
        bound = np.outer(a.error[lo:hi], b.length[start:] + b.error[start:]) + np.outer(a.length[lo:hi], b.error[start:])
        least = (threshold - _SLACK - bound) / np.outer(a.scale[lo:hi], b.scale[start:])
        i, j = np.nonzero(product >= least)
        i, j = i + lo, j + start
        if y is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            good = (x[p] * other[q]).sum(1) / (a.norm[p] * b.norm[q]) >= threshold
            found_i.append(p[good])
            found_j.append(q[good])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def _block_row(key, table):
    ids = table["node"].to_numpy()
    flat = table["v"].combine_chunks().flatten().to_numpy()
    return pa.table(
        {
            "block": pa.array([key[0].as_py()], pa.int32()),
            "dim": pa.array([key[1].as_py()], pa.int32()),
            "nodes": pa.array([pack(ids.astype(np.int64))], pa.binary()),
            "copies": pa.array([pack(table["n"].to_numpy().astype(np.int64))], pa.binary()),
            "vectors": pa.array([pack(flat.astype(np.float64))], pa.binary()),
        }
    )


def _tile(threshold: float):
    def tile(key, table):
        rows = {r["block"]: r for r in table.to_pylist()}
        dim = key[0].as_py()
        parts = []
        for k in sorted(rows):
            r = rows[k]
            parts.append((unpack(r["nodes"], np.int64), unpack(r["copies"], np.int64), unpack(r["vectors"], np.float64).reshape(-1, dim)))
        p, q = key[1].as_py(), key[2].as_py()
        none = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if p != q and len(parts) < 2:
            return none
        if p == q:
            nodes, copies, x = parts[0]
            i, j = linked_pairs(x, None, threshold)
            u, v, cu, cv = nodes[i], nodes[j], copies[i], copies[j]
        else:
            (n1, c1, x), (n2, c2, y) = parts
            i, j = linked_pairs(x, y, threshold)
            u, v, cu, cv = n1[i], n2[j], c1[i], c2[j]
        if not len(u):
            return none
        name, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        links = np.bincount(at, weights=np.concatenate((cv, cu))).astype(np.int64)
        root = name.copy()
        child, top = forest(u, v)
        root[np.searchsorted(name, child)] = top
        return pa.table({"node": pa.array(name), "links": pa.array(links), "root": pa.array(root)})

    return tile


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    importable(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    valid = F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda c: c != 0) & F.col("vec_id").isNotNull()
    # negative zeros are zeros; the key of a vector is its text, so that equal vectors meet by a plain string
    rows = rows.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0))).withColumn("ok", F.coalesce(valid, F.lit(False)))
    rows = rows.withColumn("vector_key", F.when(F.col("ok"), F.sha2(F.to_json("v"), 256)))
    usable = rows.filter("ok")
    classes = checkpoint(usable.groupBy("vector_key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v")))
    # a vec_id may stand for several vectors; the node of a class is a number of its own
    classes = classes.withColumn("node", F.col("least"))
    repeated = usable.groupBy("vec_id").agg(F.min("vector_key").alias("a"), F.max("vector_key").alias("b")).filter("a <> b")
    clash = repeated.limit(1).count() > 0
    if clash:  # nodes by hash of the vector, tied together through their ids
        classes = classes.withColumn("node", F.xxhash64("vector_key"))
    total = classes.count()
    blocks = max(1, -(-total // block))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("vector_key"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("v"))
    packed = checkpoint(
        dealt.select("block", "dim", "node", "n", "v")
        .groupBy("block", "dim")
        .applyInArrow(_block_row, "block int, dim int, nodes binary, copies binary, vectors binary")
    )
    sides = F.transform(
        F.sequence(F.lit(0), F.lit(blocks - 1)),
        lambda k: F.struct(F.least(k, F.col("block")).alias("p"), F.greatest(k, F.col("block")).alias("q")),
    )
    tiles = packed.withColumn("t", F.explode(sides)).select("dim", "t.p", "t.q", "block", "nodes", "copies", "vectors")
    found = checkpoint(tiles.groupBy("dim", "p", "q").applyInArrow(_tile(threshold), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    members = usable.select("vec_id", "vector_key").join(classes.select("vector_key", "node", "n"), "vector_key")
    if clash:
        ties = members.groupBy("vec_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).filter("u <> v").select("u", "v")
        edges = edges.union(ties)
    parts = connected_components(edges)
    answer = classes.select("vector_key", "node", "n", "least").join(links, "node", "left").join(parts, "node", "left")
    answer = answer.withColumn("component", F.coalesce("component", "node"))
    if clash:  # back from nodes to the smallest vec_id
        smallest = answer.groupBy("component").agg(F.min("least").alias("smallest"))
        answer = answer.join(smallest, "component").withColumn("component", F.col("smallest"))
    answer = checkpoint(answer.select("vector_key", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return rows.select("vec_id", "vector_key").join(answer, "vector_key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def brute_force(rows: list[tuple], threshold: float = THRESHOLD) -> dict:
    """The definition itself, for small tables with distinct ids: {vec_id: (n_links, component, kept)}."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            good[i] = scaled(np.array([v], np.float64))[0]
    root = {i: i for i, _ in rows if i is not None}
    links = dict.fromkeys(root, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(good)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            x, y = good[i], good[j]
            if len(x) == len(y) and (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (links[i], find(i), find(i) == i) for i in root}
