"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, shard results merged.

Shards hold a bounded number of vectors. A graph is built once per shard and stored as flat neighbour arrays; query blocks visit the
stored graphs and the best of all shards are kept. Inner product is turned into distance by one more component (the missing part of
the shard's largest norm). All products are in double precision: one vector of a thousand times the others' length leaves differences
that single precision cannot hold. Vectors that are equal are one node with several members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewright.llm.common import stored

DEGREE = 16
GRAPH = "shard int, dim int, vec_ids binary, owners binary, vectors binary, levels int, links binary"


def usable(vectors: DataFrame, id_col: str, vector: str, nonzero: bool = True) -> DataFrame:
    """id, vector (array<double>) and dim of the rows that take part: no null, NaN or infinite component, and not all zero."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND size(vector) > 0")
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if nonzero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    return rows.withColumn("dim", F.size(v))


class Graph:
    """Links of level l in links[l], one row of neighbours per node, -1 for none; level 0 has twice the degree."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray]):
        self.x, self.links = x, links

    def beam(self, q: np.ndarray, start: np.ndarray, level: int, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """For many queries at once: the ef best nodes found from the start nodes, and their similarities; -1 for none."""
        x, links = self.x, self.links[level]
        n_q, rows = len(q), np.arange(len(q))
        seen = np.zeros((n_q, len(x) + 1), bool)  # the last column takes the -1
        ids = np.full((n_q, ef), -1, np.int32)
        sims = np.full((n_q, ef), -np.inf, x.dtype)
        done = np.ones((n_q, ef), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = start, np.einsum("ij,ij->i", q, x[start]), False
        seen[rows, start] = True
        live = rows
        width = min(width, ef)
        while len(live):
            open_ = np.where(done[live], -np.inf, sims[live])
            pick = np.argpartition(-open_, width - 1, 1)[:, :width] if width < ef else np.tile(np.arange(ef), (len(live), 1))
            use = np.take_along_axis(open_, pick, 1) > -np.inf
            keep = use.any(1)
            live, pick, use = live[keep], pick[keep], use[keep]
            if not len(live):
                break
            done[live[:, None], pick] = True
            near = np.where(use[:, :, None], links[np.where(use, ids[live[:, None], pick], 0)], -1).reshape(len(live), -1)
            near[seen[live[:, None], near]] = -1
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1  # found twice in this step
            seen[live[:, None], near] = True
            found = np.where(near >= 0, np.einsum("ij,ikj->ik", q[live], x[near]), -np.inf)
            all_sims = np.concatenate([sims[live], found], 1)
            best = np.argpartition(-all_sims, ef - 1, 1)[:, :ef]
            sims[live] = np.take_along_axis(all_sims, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], near < 0], 1), best, 1)
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.zeros(len(q), np.int32)
        for level in range(len(self.links) - 1, 0, -1):
            start = self.beam(q, start, level, 1)[0][:, 0]
        return self.beam(q, start, 0, ef)


def diverse(x: np.ndarray, at: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (best first) those nearer to the row's node than to one already chosen; free places go to the rest."""
    v = x[np.maximum(ids, 0)]
    between = np.einsum("ikd,ild->ikl", v, v)
    usable_ = ids >= 0
    chosen = np.zeros_like(usable_)
    for k in range(ids.shape[1]):
        # all vectors have one norm, so a larger product is a smaller distance
        blocked = (chosen & (between[:, k] > sims[:, k : k + 1])).any(1)
        chosen[:, k] = usable_[:, k] & ~blocked & (chosen.sum(1) < degree)
    rank = np.where(chosen, 0, np.where(usable_, 1, 2))
    order = np.argsort(rank, 1, kind="stable")[:, :degree]
    out = np.take_along_axis(np.where(usable_, ids, -1), order, 1)
    return out if out.shape[1] == degree else np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


def build(x: np.ndarray, seed: int, ef: int = 64, batch: int = 512) -> Graph:
    """A graph of vectors of one norm. Nodes enter by level, highest first, in batches of at most what is there."""
    n = len(x)
    level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / math.log(DEGREE)).astype(int), 5)
    level[0] = level.max()
    order = np.concatenate([[0], 1 + np.argsort(-level[1:], kind="stable")]).astype(np.int32)
    top = int(level.max())
    g = Graph(x, [np.full((n, DEGREE * (2 if k == 0 else 1)), -1, np.int32) for k in range(top + 1)])
    at = 1
    while at < n:
        new = order[at : at + min(batch, at)]
        at += len(new)
        q, start = x[new], np.zeros(len(new), np.int32)
        for k in range(top, -1, -1):
            joins = level[new] >= k
            if not joins.all():
                start[~joins] = g.beam(q[~joins], start[~joins], k, 1)[0][:, 0]
            if joins.any():
                ids, sims = g.beam(q[joins], start[joins], k, ef)
                start[joins] = ids[:, 0]
                own = new[joins]
                peers = x[own] @ x[own].T  # those that enter together don't find each other by search
                np.fill_diagonal(peers, -np.inf)
                few = min(16, len(own))
                p = np.argpartition(-peers, few - 1, 1)[:, :few]
                ids = np.concatenate([ids, np.where(np.isfinite(np.take_along_axis(peers, p, 1)), own[p], -1)], 1)
                sims = np.concatenate([sims, np.take_along_axis(peers, p, 1)], 1)
                best = np.argsort(-sims, 1, kind="stable")[:, :48]
                _connect(g, k, own, np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1))
    return g


def _connect(g: Graph, k: int, own: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
    links, degree = g.links[k], g.links[k].shape[1]
    picked = diverse(g.x, own, ids, sims, DEGREE)
    links[own, :DEGREE] = picked
    # back links: of each target the old and the new ones compete for its places
    source, target = np.repeat(own, picked.shape[1]), picked.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, count)
    sim = np.einsum("ij,ij->i", g.x[source], g.x[target])
    most = min(int(count.max(initial=0)), 2 * degree)
    if most and count.max() > most:  # a hub keeps its nearest newcomers
        order = np.lexsort((-sim, target))
        source, target, sim = source[order], target[order], sim[order]
        keep = place < most
        source, target, sim, place = source[keep], target[keep], sim[keep], place[keep]
    row = np.searchsorted(nodes, target)
    extra = np.full((len(nodes), most), -1, np.int32)
    extra[row, place] = source
    both = np.concatenate([links[nodes], extra], 1)
    s = np.where(both >= 0, np.einsum("ij,ikj->ik", g.x[nodes], g.x[both]), -np.inf)
    best = np.argsort(-s, 1, kind="stable")
    both, s = np.take_along_axis(both, best, 1), np.take_along_axis(s, best, 1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    for at in range(0, len(nodes), 512):
        links[nodes[at : at + 512]] = diverse(g.x, nodes[at : at + 512], both[at : at + 512], s[at : at + 512], degree)


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lift(x: np.ndarray) -> np.ndarray:
    """The vectors with one more component that gives all one norm, and that norm 1."""
    square = (x * x).sum(1)
    return np.hstack([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]]) / math.sqrt(square.max())


def build_shards(vectors: DataFrame, shard_rows: int = 8192, seed: int = 3) -> DataFrame:
    """One row per shard and dimension: its members' ids, and the graph in flat arrays. `vectors` as from usable()."""
    n = vectors.count()
    shards = max(1, math.ceil(n / shard_rows))

    def one(key, rows):
        dim = key[1].as_py()
        ids, x = rows["vec_id"].to_numpy(), _vectors(rows["vector"], dim)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        nodes, first, owner = np.unique(x.view(f"V{x.itemsize * dim}").ravel(), return_index=True, return_inverse=True)
        x = x[first]
        g = build(lift(x), seed)
        flat = np.concatenate([a.ravel() for a in g.links])
        columns = [[key[0].as_py()], [dim], [ids.tobytes()], [owner.astype("<i4").tobytes()], [x.tobytes()], [len(g.links)], [flat.astype("<i4").tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "dim", "vec_ids", "owners", "vectors", "levels", "links"])

    shard = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(shards)).cast("int")
    return stored(vectors.withColumn("shard", shard).groupBy("shard", "dim").applyInArrow(one, GRAPH), "graphs")


def nearest(vectors: DataFrame, is_query, k: int = 20, ef: int = 128, shard_rows: int = 8192, block_rows: int = 4096, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query the k found with the largest inner product, ties to smaller ids.

    Candidates are all other rows of the query's dimension. Scores are in double precision on the original vectors. Rows without a
    usable vector or id take no part; an empty table gives no rows. Rows that repeat an id all count, but never for that id's query.
    """
    rows = usable(vectors, id_col, vector)
    graphs = build_shards(rows, shard_rows)
    queries = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id"])
    blocks = max(1, math.ceil(queries.count() / block_rows))
    queries = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(blocks)).cast("int"))
    keys = graphs.select("shard", "dim").collect()  # one small row per shard
    by_dim: dict[int, list[int]] = {}
    for s, d in keys:
        by_dim.setdefault(d, []).append(s)
    if not keys:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    visits = F.element_at(F.create_map(*[z for d, s in by_dim.items() for z in (F.lit(d), F.lit(s))]), F.col("dim"))
    asked = queries.withColumn("shard", F.explode(visits))
    held = graphs.withColumn("block", F.explode(F.lit(list(range(blocks)))))

    def others(members, own):
        """The k smallest of sorted ids but the query's own, which may be there many times."""
        a, z = np.searchsorted(members, [own, own + 1]) if own < np.iinfo(np.int64).max else (np.searchsorted(members, own), len(members))
        return [*members[: min(a, k)], *members[z : z + max(0, k - a)]]

    def search(key, asked, held):
        names = ["query_id", "vec_id", "score"]
        if not held.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        own = held.to_pylist()[0]
        dim = own["dim"]
        ids, owners = np.frombuffer(own["vec_ids"], "<i8"), np.frombuffer(own["owners"], "<i4")
        x = np.frombuffer(own["vectors"], "<f8").reshape(-1, dim)
        flat, links, at = np.frombuffer(own["links"], "<i4"), [], 0
        for level in range(own["levels"]):
            width = DEGREE * (2 if level == 0 else 1)
            links.append(flat[at : at + len(x) * width].reshape(-1, width))
            at += len(x) * width
        g = Graph(lift(x), links)
        members = np.argsort(owners, kind="stable")  # by node, then by id
        of_nodes = ids[members]
        begin = np.searchsorted(owners[members], np.arange(len(x) + 1))
        q_ids, q = asked["vec_id"].to_numpy(), _vectors(asked["vector"], dim)
        out = []
        for a in range(0, len(q), 512):
            part = q[a : a + 512]
            unit = np.hstack([part / np.linalg.norm(part, axis=1, keepdims=True), np.zeros((len(part), 1))])
            found, _ = g.search(unit, max(ef, k + 1))
            for q_id, v, nodes in zip(q_ids[a : a + 512], part, found):
                nodes = nodes[nodes >= 0]
                score = x[nodes] @ v
                several = begin[nodes + 1] - begin[nodes] > 1
                near = of_nodes[begin[nodes]]
                alone = ~several & (near != q_id)
                pairs = list(zip((-score[alone]).tolist(), near[alone].tolist()))
                pairs += [(-s, int(i)) for s, node in zip(score[several].tolist(), nodes[several]) for i in others(of_nodes[begin[node] : begin[node + 1]], q_id)]
                out += [(int(q_id), i, -s) for s, i in sorted(pairs)[:k]]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names)

    found = asked.groupBy("shard", "dim", "block").cogroup(held.groupBy("shard", "dim", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
