"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Rows are sharded by a hash, SHARD rows each.  A shard's graph is built in numpy
over its different vectors by inserting blocks of nodes: a beam search over the
nodes so far (for many nodes at once), a diversity rule for the links, and pruned
back links.  Largest inner product becomes nearest neighbour by one more
component that makes all norms equal.  A shard is stored as one row of flat
arrays (ids, vectors, levels, neighbours), so a lost executor rereads it and
builds nothing again.  Queries, in blocks, search every shard; the shards'
results are merged.  Rows of equal vectors hang on one node, so that copies,
however many, neither crowd the graph nor are lost.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, take no part; only vectors of a query's
length are its candidates; every row is a candidate, also where ids repeat, but
for one row equal to the query in id and vector, its own; a query row that
repeats is answered as often; ties go to the smaller id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, small_batches

#: Rows of a shard: about 16 MB of vectors of 64 components and their links.
SHARD = 16_384
LINKS = 16
BUILD = 64
SEARCH = 160
#: Queries sent to a shard at once; a graph is read once for each block.
QUERY_BLOCK = 32_768


def levels(ids: np.ndarray, links: int = LINKS) -> np.ndarray:
    """The top layer of each node, drawn from a hash of its id."""
    x = (ids.astype(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return np.minimum((-np.log(u) / np.log(links)).astype(np.int64), 12)


def beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best `ef` nodes (similarities and ids, best first; id -1 where fewer) reached from each query's entry."""
    n, rows = len(q), np.arange(len(q))[:, None]
    ids = np.full((n, ef), -1, np.int64)
    sims = np.full((n, ef), -np.inf, np.float32)
    todo = np.zeros((n, ef), bool)
    ids[:, 0], sims[:, 0], todo[:, 0] = entry, np.einsum("qd,qd->q", q, x[entry]), True
    seen = np.zeros((n, len(x)), bool)
    seen[rows[:, 0], entry] = True
    act = np.arange(n)
    while len(act):
        rank = np.where(todo[act], sims[act], -np.inf)
        pick = np.argpartition(-rank, min(wide, ef) - 1, axis=1)[:, : min(wide, ef)]
        r = np.arange(len(act))[:, None]
        good = np.isfinite(rank[r, pick])
        todo[act[:, None], pick] = False
        new = np.where(good[:, :, None], near[np.where(good, ids[act[:, None], pick], 0)], -1).reshape(len(act), -1)
        new.sort(axis=1)
        fresh = (new >= 0) & np.c_[np.ones((len(act), 1), bool), new[:, 1:] != new[:, :-1]]
        safe = np.where(fresh, new, 0)
        fresh &= ~seen[act[:, None], safe]
        a, b = np.nonzero(fresh)
        node = new[a, b]
        seen[act[a], node] = True
        got = np.full(new.shape, -np.inf, np.float32)
        got[a, b] = np.einsum("kd,kd->k", q[act[a]], x[node])
        all_sims = np.c_[sims[act], got]
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
        sims[act] = all_sims[r, top]
        ids[act] = np.c_[ids[act], np.where(np.isfinite(got), new, -1)][r, top]
        todo[act] = np.c_[todo[act], np.isfinite(got)][r, top]
        act = act[todo[act].any(axis=1)]
    return sims, ids


def diverse(x: np.ndarray, sims: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, best first, those nearer to their node than to any kept one; then the best of the rest."""
    n, c = ids.shape
    v = x[np.where(ids >= 0, ids, 0)]
    among = np.matmul(v, v.transpose(0, 2, 1))
    kept, worst, count = np.zeros((n, c), bool), np.full((n, c), -np.inf, np.float32), np.zeros(n, np.int64)
    for k in range(c):
        ok = (ids[:, k] >= 0) & (sims[:, k] > worst[:, k]) & (count < most)
        kept[:, k] = ok
        count += ok
        worst = np.where(ok[:, None], np.maximum(worst, among[:, k]), worst)
    order = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.where(np.arange(c)[None, : order.shape[1]] < (ids >= 0).sum(1)[:, None], np.take_along_axis(ids, order, 1), -1)


def augment(v: np.ndarray) -> np.ndarray:
    square = (v**2).sum(1)
    return np.c_[v, np.sqrt(np.maximum(square.max() - square, 0))].astype(np.float32)


class Graph:
    """layers[k]: neighbours (node x links, -1 for none) in layer k."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, links: int = LINKS, build: int = BUILD):
        self.x, self.top = augment(v), levels(ids, links)
        n = len(v)
        self.order = np.lexsort((ids, -self.top))  # entry node first, so upper layers exist when they are needed
        self.layers = [np.full((n, 2 * links if k == 0 else links), -1, np.int64) for k in range(int(self.top.max()) + 1)]
        done = 1
        while done < n:
            block = self.order[done : done + min(256, max(1, done))]
            self.insert(block, links, build)
            done += len(block)

    def insert(self, block: np.ndarray, links: int, build: int) -> None:
        q = self.x[block]
        entry = np.full(len(block), self.order[0])
        inside = q @ q.T
        for k in range(len(self.layers) - 1, -1, -1):
            mine = self.top[block] >= k
            sims, ids = beam(self.x, self.layers[k], q, entry, build if mine.any() else 1)
            entry = ids[:, 0]
            if not mine.any():
                continue
            # nodes of the same block see each other directly
            own = np.where(mine[None, :] & ~np.eye(len(block), dtype=bool), inside, -np.inf)[mine]
            part = min(build, len(block))
            best = np.argsort(-own, axis=1)[:, :part]
            s = np.c_[sims[mine], np.take_along_axis(own, best, 1)]
            i = np.c_[ids[mine], np.where(np.isfinite(np.take_along_axis(own, best, 1)), block[best], -1)]
            # the entry may lie above nodes of this layer only; all ids reached are nodes of the layer
            at = np.argsort(-s, axis=1, kind="stable")[:, :build]
            s, i = np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)
            chosen = diverse(self.x, s, i, links)
            layer, nodes = self.layers[k], block[mine]
            layer[nodes, : chosen.shape[1]] = chosen
            a, b = np.nonzero(chosen >= 0)
            self.back(layer, chosen[a, b], nodes[a])

    def back(self, layer: np.ndarray, target: np.ndarray, source: np.ndarray) -> None:
        """Links target -> source; a node with too many keeps a diverse choice."""
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(nodes), int(count.max())), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.c_[layer[nodes], extra]
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        for low in range(0, len(nodes), 256):
            part, own = both[low : low + 256], nodes[low : low + 256]
            sims = np.einsum("nd,ncd->nc", self.x[own], self.x[np.where(part >= 0, part, 0)])
            sims = np.where(part >= 0, sims, -np.inf).astype(np.float32)
            at = np.argsort(-sims, axis=1, kind="stable")[:, : layer.shape[1] * 2]
            got = diverse(self.x, np.take_along_axis(sims, at, 1), np.take_along_axis(part, at, 1), layer.shape[1])
            layer[own] = -1
            layer[own, : got.shape[1]] = got

    def flat(self) -> tuple[bytes, bytes]:
        """(order's first node and links per layer, all neighbours as int32)."""
        head = np.array([self.order[0], len(self.x), *[a.shape[1] for a in self.layers]], np.int32)
        return head.tobytes(), b"".join(a.astype(np.int32).tobytes() for a in self.layers)


def search(v: np.ndarray, head: bytes, flat: bytes, q: np.ndarray, ef: int = SEARCH) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, positions) of the best `ef` nodes of a stored graph for each query."""
    h = np.frombuffer(head, np.int32)
    n, data, at, layers = int(h[1]), np.frombuffer(flat, np.int32), 0, []
    for width in h[2:]:
        layers.append(data[at : at + n * width].reshape(n, width))
        at += n * width
    x = augment(v)
    q = np.c_[q, np.zeros(len(q))].astype(np.float32)
    sims, found = [], []
    for low in range(0, len(q), 256):
        part = q[low : low + 256]
        entry = np.full(len(part), int(h[0]))
        for layer in layers[:0:-1]:
            entry = beam(x, layer, part, entry, 4)[1][:, 0]
        s, i = beam(x, layers[0], part, entry, min(ef, max(n, 1)))
        sims.append(s)
        found.append(i)
    return np.concatenate(sims), np.concatenate(found)


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>), dim of the rows that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return rows.where(~bad & F.exists(v, lambda e: e != 0)).withColumn("dim", F.size("v"))


def grouped(v: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids in order of their vectors, first place of each different vector and the end, those vectors)."""
    kind = np.ascontiguousarray(v + 0.0).view([("", np.void, 8 * v.shape[1])]).ravel()  # -0.0 is 0.0
    _, group = np.unique(kind, return_inverse=True)
    order = np.lexsort((ids, group))
    first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    return ids[order], np.r_[first, len(ids)], v[order[first]]


def build(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per shard: dim, shard, ids and the first place of each vector's (int64), different vectors (little-endian doubles), head, neighbours.

    rows: vec_id, v, dim and row, a number of its own for every row.
    """
    n = rows.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    keyed = rows.join(F.broadcast(n), "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", "row"), F.col("shards")).cast("int"))

    def make(group: pd.DataFrame) -> pd.DataFrame:
        ids, first, v = grouped(np.array(group["v"].tolist(), np.float64), group["vec_id"].to_numpy())
        head, flat = Graph(v, ids[first[:-1]]).flat()
        return pd.DataFrame({"dim": [v.shape[1]], "shard": [group["shard"].iloc[0]], "ids": [ids.astype(np.int64).tobytes()], "first": [first.astype(np.int64).tobytes()], "vectors": [v.tobytes()], "head": [head], "neighbours": [flat]})

    return keyed.select("dim", "shard", "vec_id", "v").groupBy("dim", "shard").applyInPandas(make, "dim int, shard int, ids binary, first binary, vectors binary, head binary, neighbours binary")


def _expand(found: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of found, place among the ids): the first `most` rows of each vector found."""
    a, b = np.nonzero(found >= 0)
    node = found[a, b]
    size = np.minimum(first[node + 1] - first[node], most)
    start = np.repeat(first[node], size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(a, size), start + inside


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, ef: int = SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each query row."""
    small_batches(df.sparkSession, 16 << 20)
    # written, so that the numbers of rows stay as they are
    rows = materialise(usable(df, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    graphs = materialise(build(rows, shard), "ann-graphs")
    discard(rows)
    asked = materialise(usable(queries, id_col, vec_col).withColumn("query", F.monotonically_increasing_id()), "ann-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "query"), F.lit(blocks)).cast("int"))
    shards = graphs.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    sent = asked.join(F.broadcast(shards), "dim").select("dim", "block", "query", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    stored = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    names = ["query", "query_id", "vec_id", "score", "own"]

    def run(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(g):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "own": np.zeros(0, bool)})
        stored = g.iloc[0]
        ids, first = np.frombuffer(stored["ids"], np.int64), np.frombuffer(stored["first"], np.int64)
        v = np.frombuffer(stored["vectors"], np.float64).reshape(-1, int(stored["dim"]))
        node = np.repeat(np.arange(len(v)), np.diff(first))
        parts = []
        for low in range(0, len(q), 1024):
            some = q.iloc[low : low + 1024]
            asked_v, asked_id, number = np.array(some["v"].tolist(), np.float64), some["vec_id"].to_numpy(), some["query"].to_numpy()
            _, found = search(v, stored["head"], stored["neighbours"], asked_v, max(ef, k + 1))
            a, at = _expand(found, first, k + 1)
            score = np.concatenate([np.einsum("kd,kd->k", asked_v[a[s : s + 65536]], v[node[at[s : s + 65536]]]) for s in range(0, len(a), 65536)] or [np.zeros(0)])
            own = (asked_id[a] == ids[at]) & (asked_v[a] == v[node[at]]).all(1)
            out = pd.DataFrame(dict(zip(names, (number[a], asked_id[a], ids[at], score, own), strict=True)))
            out = out.sort_values(["query", "score", "vec_id"], ascending=[True, False, True], kind="stable")
            parts.append(out[out["own"] | (out.groupby(["query", "own"], sort=False).cumcount() < k)])
        return pd.concat(parts)

    found = sent.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(run, "query long, query_id long, vec_id long, score double, own boolean")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    owned = F.sum(F.col("own").cast("int")).over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the first row equal to the query is its own and leaves the ranks
    found = found.withColumn("owned", owned).withColumn("rank", F.row_number().over(best) - F.least("owned", F.lit(1)))
    return found.where(~(F.col("own") & (F.col("owned") == 1)) & (F.col("rank") <= k)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
