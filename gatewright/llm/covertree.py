"""Exact top-k search by inner product: dual-tree search over cover trees that index queries and data together.

Spark deals data into shards and queries into blocks, both of bounded size. For each shard and block one cover tree holds all their
points: a node's points lie within its covering radius of its centre, and the centres of its children are a farthest-first net, at
least as far apart as the children's radii. Pairs of a query node and a data node are visited depth first, best bound first; a pair
is pruned when the largest product that its centres and radii allow is below the worst k-th score within the query node.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewright.llm.hnsw import _vectors, usable

LEAF, FANOUT = 48, 12


class Node:
    __slots__ = ("center", "radius", "norm", "children", "queries", "data", "asks", "holds")


def cover_tree(x: np.ndarray, is_query: np.ndarray, is_data: np.ndarray) -> Node:
    """The tree of all points; leaves list their queries and their data."""

    def node(idx: np.ndarray, center: int, dist: np.ndarray) -> Node:
        e = Node()
        e.center, e.radius, e.norm = center, float(dist.max()), float(np.linalg.norm(x[center]))
        e.children, e.queries, e.data = [], None, None
        e.asks, e.holds = idx[is_query[idx]], bool(is_data[idx].any())
        return e

    def distances(idx, c):
        return np.linalg.norm(x[idx] - x[c], axis=1)

    idx = np.arange(len(x))
    top = node(idx, 0, distances(idx, 0))
    todo = [(top, idx)]
    while todo:
        e, idx = todo.pop()
        if len(idx) <= LEAF or e.radius == 0:
            e.queries, e.data = e.asks, idx[is_data[idx]]
            continue
        near, owner = distances(idx, e.center), np.zeros(len(idx), int)
        centers = [e.center]
        while len(centers) < FANOUT and near.max() > 0:
            c = int(idx[near.argmax()])
            d = distances(idx, c)
            closer = d < near
            near[closer], owner[closer] = d[closer], len(centers)
            centers.append(c)
        for k, c in enumerate(centers):
            own = owner == k
            child = node(idx[own], c, near[own])
            e.children.append(child)
            todo.append((child, idx[own]))
    return top


def dual_search(x: np.ndarray, ids: np.ndarray, is_query: np.ndarray, is_data: np.ndarray, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per query's position: ids and scores of its k best data points other than those of its own id; ties to smaller ids.

    Coordinates are whole numbers in float64; products are exact below 2**53, beyond that they are redone in 64-bit integers.
    """
    top = cover_tree(x, is_query, is_data)
    best_ids = {int(q): np.zeros(0, np.int64) for q in np.flatnonzero(is_query)}
    best = {q: np.zeros(0, np.int64) for q in best_ids}
    worst = np.full(len(x), -np.inf)
    exact = (np.abs(x).max(initial=0) ** 2) * x.shape[1] < 2**53
    whole = x if exact else x.astype(np.int64)

    def bound(q: Node, r: Node) -> float:
        product = float(x[q.center] @ x[r.center])
        most = product + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius
        return most + 1e-9 * (abs(most) + q.norm * r.norm + 1)

    def compare(q: Node, r: Node) -> None:
        scores = (whole[q.queries] @ whole[r.data].T).astype(np.int64)
        for at, row in zip(q.queries.tolist(), scores):
            keep = (row >= worst[at]) & (ids[r.data] != ids[at])
            if keep.any():
                s, i = np.concatenate([best[at], row[keep]]), np.concatenate([best_ids[at], ids[r.data[keep]]])
                order = np.lexsort((i, -s))[:k]
                best[at], best_ids[at] = s[order], i[order]
                if len(order) == k:
                    worst[at] = s[order[-1]]

    todo = [(np.inf, top, top)]
    while todo:
        most, q, r = todo.pop()
        if not len(q.asks) or not r.holds or most < worst[q.asks].min():
            continue
        if not q.children and not r.children:
            compare(q, r)
        elif q.children and (not r.children or q.radius >= r.radius):
            todo += [(bound(c, r), c, r) for c in q.children if len(c.asks)]
        else:  # the last in is the first out: best bound first
            todo += sorted(((bound(q, c), q, c) for c in r.children if c.holds), key=lambda z: z[0])
    return {q: (best_ids[q], best[q]) for q in best}


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, shard_rows: int = 8192, block_rows: int = 2048, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query the k highest inner products of floor(scale * x), ties to smaller ids.

    Candidates are all other rows of the query's dimension. Rows with a null id, or a vector that is null, empty or has null or
    non-finite components, take no part; an empty table gives no rows. Rows that repeat an id all count, but never for that id.
    """
    rows = usable(vectors, id_col, vector, nonzero=False).withColumn("vector", F.transform("vector", lambda v: F.floor(v * scale).cast("double")))
    queries = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id"])
    shards = max(1, math.ceil(rows.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / block_rows))
    spread = F.xxhash64(F.lit(9), "vec_id")
    data = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(9), "vec_id", "vector"), F.lit(shards)).cast("int"))
    data = data.withColumn("block", F.explode(F.lit(list(range(blocks))))).withColumn("asks", F.lit(False))
    asked = queries.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.lit(list(range(shards))))).withColumn("asks", F.lit(True))

    def search(key, both):
        dim = key[2].as_py()
        ids, asks, x = both["vec_id"].to_numpy(), both["asks"].to_numpy(zero_copy_only=False).astype(bool), _vectors(both["vector"], dim)
        found = dual_search(x, ids, asks, ~asks, k) if asks.any() and not asks.all() else {}
        n = [len(i) for i, _ in found.values()]
        query = np.repeat(ids[list(found)] if found else np.zeros(0, np.int64), n)
        near = [np.concatenate(z) if found else np.zeros(0, np.int64) for z in (tuple(i for i, _ in found.values()) or ([],), tuple(s for _, s in found.values()) or ([],))]
        return pa.table([pa.array(query, pa.int64()), pa.array(near[0], pa.int64()), pa.array(near[1], pa.int64())], ["query_id", "vec_id", "score"])

    found = data.unionByName(asked).groupBy("shard", "block", "dim").applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
