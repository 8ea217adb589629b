"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Vectors are hashed to shards of bounded size and each shard gets a graph.
Every vector then queries every shard: vectors are hashed to tiles too, and
each meeting of a shard and a tile is a task of its own, keyed by both numbers.
The queries of a meeting are searched together; their beam is doubled until an
audit passes.  The audit searches exhaustively for some of the queries and for
as many vectors of the shard that were moved off a little, so that each audit
has true neighbours to find (a query's own vector counts as none), and the beam
must find at least ``recall`` of them.  Any query whose beam holds nothing but
neighbours at the threshold is searched again with a beam as wide as the shard,
which is an exhaustive search, so that no number of partners is cut off; beams
in between cost more, as each step sorts the beam again.  What is found is
verified by the cosine of the vectors as given, in double precision, and
connected vectors are united, first those of a meeting.

There are at least MIN_SHARDS shards, so that graphs are built side by side,
and more as soon as one would hold over SHARD vectors; from there on queries
times shards grow with the square of the vectors over SHARD, which is the price
of querying every shard.

Defined cases: vectors that are null, empty, zero or hold a null, NaN or
infinity have no neighbours, and stay components of their own; vectors of
different lengths are never compared; equal vectors are united before any
search, so thousands of copies cost as much as one; rows with a null id are
left out; a repeated id is one vertex, with all its vectors; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _contract, components, cut, isolate, table

COSINE = 0.95
SHARD = 65_536
MIN_SHARDS = 4
M = 12
EF_BUILD = 48
EF = 32
RECALL = 0.99
AUDIT = 64
BATCH = 256
#: Queries that are searched together.
QUERIES = 1024
#: Similarities of an exhaustive search that are held at a time.
WIDE = 1 << 23


def _level(ids: np.ndarray, m: int) -> np.ndarray:
    from .common import mix

    u = (mix(ids.astype("u8") + np.uint64(0x51ED270B)) >> np.uint64(11)).astype("f8") / float(1 << 53)
    return np.minimum(30, np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(m))).astype("i4")


class Graph:
    """Vectors in the order of their levels, the highest first, so that the nodes of a layer are the first ones."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, heads: np.ndarray | None = None, m: int = M, ef: int = EF_BUILD) -> None:
        """``ids`` differ; ``heads`` are the vertices that the vectors belong to, the ids if not given."""
        level = _level(ids, m)
        order = np.lexsort((ids, -level))
        self.ids, self.raw, self.level = ids[order], np.ascontiguousarray(raw[order], "f4"), level[order]
        self.heads = self.ids if heads is None else heads[order]
        self.x = _unit(self.raw)
        self.m, n = m, len(ids)
        self.sizes = [int((self.level >= k).sum()) for k in range(int(self.level[0]) + 1)] if n else []
        # lists may grow to their width and are thinned by half then
        self.near = [np.full((s, 4 * m if k == 0 else 2 * m), -1, "i4") for k, s in enumerate(self.sizes)]
        self.many = [np.zeros(s, "i4") for s in self.sizes]
        at = 1
        while at < n:
            # upper nodes come one by one, the others in batches that grow with the graph
            b = at + 1 if self.level[at] > 0 else min(n, at + max(1, min(BATCH, at // 8)))
            self._insert(at, b, ef)
            at = b

    def _insert(self, a: int, b: int, ef: int) -> None:
        q = self.x[a:b]
        top = int(self.level[a])
        entry = self._descend(q, top, a)
        for k in range(min(top, len(self.sizes) - 1), -1, -1):
            ids, sims = self._layer(q, entry, max(ef, 1), k)
            entry = np.maximum(ids[:, 0], 0)
            if b - a > 1:  # those of a batch may be neighbours too
                own = q @ q.T
                np.fill_diagonal(own, -np.inf)
                few = min(8, b - a - 1)
                pick = np.argpartition(-own, few - 1, axis=1)[:, :few]
                ids = np.hstack([ids, pick + a])
                sims = np.hstack([sims, np.take_along_axis(own, pick, 1)])
            for r in range(b - a):
                ok = ids[r] >= 0
                chosen = self._select(ids[r][ok], sims[r][ok], self.m)
                self._link(k, a + r, chosen)

    def _select(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Neighbours in diverse directions first, then the closest of the rest."""
        order = np.argsort(-sims, kind="stable")
        ids, sims = ids[order], sims[order]
        if len(ids) <= m:
            return ids
        v = self.x[ids]
        to = v @ v.T
        worst = np.full(len(ids), -np.inf, "f4")
        taken, rest = [], []
        for c in range(len(ids)):
            if sims[c] >= worst[c] and len(taken) < m:
                taken.append(c)
                np.maximum(worst, to[c], out=worst)
            else:
                rest.append(c)
        return ids[taken + rest[: m - len(taken)]]

    def _link(self, k: int, node: int, chosen: np.ndarray) -> None:
        near, many = self.near[k], self.many[k]
        for other in chosen.tolist():
            for a, b in ((node, other), (other, node)):
                n = many[a]
                if b in near[a, :n]:
                    continue
                if n == near.shape[1]:
                    kept = self._select(near[a, :n], self.x[near[a, :n]] @ self.x[a], near.shape[1] // 2)
                    near[a] = -1
                    near[a, : len(kept)] = kept
                    n = len(kept)
                near[a, n] = b
                many[a] = n + 1

    def _descend(self, q: np.ndarray, down_to: int, limit: int) -> np.ndarray:
        entry = np.zeros(len(q), "i4")
        for k in range(len(self.sizes) - 1, down_to, -1):
            entry = np.maximum(self._layer(q, entry, 1, k)[0][:, 0], 0)
        return entry

    def _layer(self, q: np.ndarray, entry: np.ndarray, ef: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the best ``ef`` of layer ``k`` for each query, the best first; -1 where there are fewer."""
        near, rows = self.near[k], np.arange(len(q))
        ef = max(1, min(ef, self.sizes[k]))
        seen = np.zeros((len(q), self.sizes[k]), bool)
        ids = np.full((len(q), ef), -1, "i4")
        sims = np.full((len(q), ef), -np.inf, "f4")
        done = np.zeros((len(q), ef), bool)
        ids[:, 0], sims[:, 0] = entry, (self.x[entry] * q).sum(1)
        seen[rows, entry] = True
        live = rows
        while len(live):
            s = np.where(done[live], -np.inf, sims[live])
            best = s.argmax(1)
            some = s[np.arange(len(live)), best] > -np.inf
            live, best = live[some], best[some]
            if not len(live):
                break
            done[live, best] = True
            to = near[ids[live, best]]
            new = (to >= 0) & ~seen[live[:, None], to]
            r, c = np.nonzero(new)
            seen[live[r], to[r, c]] = True
            sim = np.full(to.shape, -np.inf, "f4")
            sim[r, c] = np.einsum("ij,ij->i", self.x[to[r, c]], q[live[r]])
            all_ids, all_sims = np.hstack([ids[live], to]), np.hstack([sims[live], sim])
            all_done = np.hstack([done[live], np.zeros(to.shape, bool)])
            if all_sims.shape[1] > ef:
                pick = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
                all_ids, all_sims, all_done = (np.take_along_axis(v, pick, 1) for v in (all_ids, all_sims, all_done))
            all_ids[all_sims == -np.inf] = -1
            ids[live], sims[live], done[live] = all_ids, all_sims, all_done
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        if ef >= len(self.x):
            sims = q @ self.x.T
            order = np.argsort(-sims, axis=1, kind="stable")
            return order.astype("i4"), np.take_along_axis(sims, order, 1)
        return self._layer(q, self._descend(q, 0, 0), ef, 0)

    # -- as bytes

    def dump(self) -> bytes:
        head = np.array([len(self.x), self.x.shape[1], self.m, len(self.sizes)], "<i8")
        parts = [head, np.array(self.sizes, "<i8"), self.ids.astype("<i8"), self.heads.astype("<i8"), self.level.astype("<i4"), self.raw.astype("<f4"), *(v.astype("<i4") for v in self.near)]
        return b"".join(p.tobytes() for p in parts)

    @staticmethod
    def load(blob: bytes) -> Graph:
        g, at = object.__new__(Graph), 0

        def take(kind: str, *shape: int) -> np.ndarray:
            nonlocal at
            n = int(np.prod(shape))
            v = np.frombuffer(blob, kind, n, at).reshape(shape)
            at += v.nbytes
            return v

        n, d, g.m, layers = take("<i8", 4).tolist()
        g.sizes = take("<i8", layers).tolist()
        g.ids, g.heads, g.level, g.raw = take("<i8", n), take("<i8", n), take("<i4", n), take("<f4", n, d)
        g.x = _unit(g.raw)
        g.near = [take("<i4", s, 4 * g.m if k == 0 else 2 * g.m) for k, s in enumerate(g.sizes)]
        return g


def _margin(cosine: float) -> float:
    return cosine - 1e-4  # single precision may be so far off; what is found is verified


def _moved(x: np.ndarray, cosine: float) -> np.ndarray:
    """Unit vectors at a cosine half-way between the threshold and 1 with ``x``."""
    c = (1 + cosine) / 2
    noise = np.random.default_rng(len(x)).normal(size=x.shape).astype("f4")
    noise -= (noise * x).sum(1, keepdims=True) * x
    long = np.linalg.norm(noise, axis=1, keepdims=True)
    return np.where(long > 1e-6, c * x + np.sqrt(max(0.0, 1 - c * c)) * noise / np.maximum(long, 1e-6), x).astype("f4")  # with one dimension there is nowhere to go


def audited_beam(graph: Graph, ids: np.ndarray, x: np.ndarray, cosine: float = COSINE, ef: int = EF, recall: float = RECALL, audit: int = AUDIT) -> int:
    """The beam, doubled from ``ef``, that finds ``recall`` of the true neighbours of queries and of moved vectors of the shard; that of an exhaustive search if none does."""
    n, least = len(graph.x), np.float32(_margin(cosine))
    probe = np.unique(np.linspace(0, len(x) - 1, min(audit, len(x))).astype("i8"))
    own = np.unique(np.linspace(0, n - 1, min(audit, n)).astype("i8"))
    q, who = np.concatenate([x[probe], _moved(graph.x[own], cosine)]), np.concatenate([ids[probe], np.full(len(own), -1, "i8")])
    is_self = (who[:, None] == graph.ids[None, :]) & (np.arange(len(q)) < len(probe))[:, None]
    truth = (q @ graph.x.T >= least) & ~is_self
    while ef < n:
        hit = 0
        for r, (g, s) in enumerate(zip(*_wide(graph, q, ef, least))):
            hit += int(truth[r, np.unique(g[s >= least])].sum())
        if hit >= recall * truth.sum():
            return ef
        ef *= 2
    return n


def query_block(graph: Graph, ids: np.ndarray, x: np.ndarray, cosine: float = COSINE, ef: int = EF, recall: float = RECALL, audit: int = AUDIT) -> tuple[np.ndarray, np.ndarray, int]:
    """(place of the query, place in the graph) at the threshold, and the beam at which the audit passed."""
    least = np.float32(_margin(cosine))
    if not len(graph.x) or not len(x):
        return np.zeros(0, "i8"), np.zeros(0, "i8"), ef
    ef = audited_beam(graph, ids, x, cosine, ef, recall, audit)
    a, b = [], []
    for k in range(0, len(x), QUERIES):
        got, sims = _wide(graph, x[k : k + QUERIES], ef, least)
        for r, (g, s) in enumerate(zip(got, sims)):
            g = g[s >= least]
            if len(g):
                a.append(np.full(len(g), k + r))
                b.append(g)
    return np.concatenate([np.zeros(0, "i8"), *a]).astype("i8"), np.concatenate([np.zeros(0, "i8"), *b]).astype("i8"), ef


def _wide(graph: Graph, q: np.ndarray, ef: int, least: np.float32) -> tuple[list, list]:
    """As search(), but all neighbours at the threshold, by an exhaustive search, for queries whose beam is full of these."""
    ids, sims = graph.search(q, ef)
    out_ids, out_sims = list(ids), list(sims)
    full = np.flatnonzero(sims[:, -1] >= least) if ef < len(graph.x) else np.zeros(0, "i8")
    some = max(1, WIDE // len(graph.x))
    for k in range(0, len(full), some):  # so many similarities at a time
        at = full[k : k + some]
        for r, s in zip(at.tolist(), q[at] @ graph.x.T):
            out_ids[r] = np.flatnonzero(s >= least).astype("i4")
            out_sims[r] = s[out_ids[r]]
    return out_ids, out_sims


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(v, "f4") for v in pdf["x"]])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)).astype("f4")


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    graph = Graph(pdf["v"].to_numpy("i8"), _matrix(pdf), pdf["head"].to_numpy("i8"))
    return pd.DataFrame({"dim": [key[0]], "s": [key[1]], "graph": [graph.dump()]})


def _search(cosine: float, ef: int, recall: float, audit: int, forest: bool):
    """A meeting of a shard and a tile: (a, b) of vertices with vectors at the threshold; ``forest``: of each vertex and the least one it is connected with there."""

    def run(key: tuple, shard: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, "i8"), np.zeros(0, "i8"))]
        if len(shard) and len(tile):
            graph, tile = Graph.load(shard["graph"].iloc[0]), tile.sort_values("v")
            ids, heads, raw = tile["v"].to_numpy("i8"), tile["head"].to_numpy("i8"), _matrix(tile)
            del tile
            i, j, _ = query_block(graph, ids, _unit(raw), cosine, ef, recall, audit)
            apart = heads[i] != graph.heads[j]
            i, j = i[apart], j[apart]
            for k in range(0, len(i), 100_000):  # the cosine of the vectors as given
                u, v = raw[i[k : k + 100_000]].astype("f8"), graph.raw[j[k : k + 100_000]].astype("f8")
                # scaled first, so that no square overflows
                u, v = u / np.abs(u).max(1, keepdims=True), v / np.abs(v).max(1, keepdims=True)
                ok = (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1)) >= cosine
                found.append((heads[i[k : k + 100_000]][ok], graph.heads[j[k : k + 100_000]][ok]))
        a, b = (np.concatenate(c) for c in zip(*found))
        pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
        if forest:
            pairs = next(_contract(iter([pairs]))).query("a != b")
        return pairs

    return run


def _valid(v):
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, bad), F.lit(False)) & F.exists(v, lambda e: e != 0)


def _prepared(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, (id, head) of each with a vector, (v, head, dim, x) of each distinct vector)."""
    inner, (i, v) = isolate(vectors, id_col, vector_col)
    rows = inner.select(i.cast("long").alias("id"), v.cast("array<float>").alias("x")).where("id is not null")
    ok = cut(rows.where(_valid(F.col("x"))).withColumn("h", F.xxhash64("x")))
    # checkpointed, so the numbers stay
    distinct = cut(ok.groupBy("h", "x").agg(F.min("id").alias("head")).withColumn("v", F.monotonically_increasing_id()))
    return rows.select("id").distinct(), ok.join(distinct, ["h", "x"]).select("id", "head"), distinct.select("v", "head", F.size("x").alias("dim"), "x")


def near_pairs(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, shard: int = SHARD, min_shards: int = MIN_SHARDS, ef: int = EF, recall: float = RECALL, audit: int = AUDIT) -> DataFrame:
    """(a, b), a < b, of vectors with a cosine at the threshold or above; equal vectors as pairs with the smallest id of theirs."""
    _, same, distinct = _prepared(vectors, id_col, vector_col)
    return _pairs(same, distinct, cosine, shard, min_shards, ef, recall, audit, False)


def _pairs(same: DataFrame, distinct: DataFrame, cosine, shard, min_shards, ef, recall, audit, forest: bool) -> DataFrame:
    shards = max(min_shards, -(-distinct.count() // shard))
    part = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(shards)).cast("int")
    graphs = cut(distinct.withColumn("s", part(1)).groupBy("dim", "s").applyInPandas(_build, "dim int, s int, graph binary"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    left = graphs.select("dim", "s", every.alias("t"), "graph")
    right = distinct.select("dim", every.alias("s"), part(2).alias("t"), "v", "head", "x")
    meetings = shards * shards
    left, right = (d.repartition(min(meetings, 100_000), "dim", "s", "t") for d in (left, right))
    found = left.groupBy("dim", "s", "t").cogroup(right.groupBy("dim", "s", "t")).applyInPandas(_search(cosine, ef, recall, audit, forest), "a long, b long").distinct()
    return found.unionByName(same.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())


def near_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, shard: int = SHARD, min_shards: int = MIN_SHARDS, ef: int = EF, recall: float = RECALL, audit: int = AUDIT) -> DataFrame:
    """(vec_id, component) of every vector: the smallest id it is connected with."""
    ids, same, distinct = _prepared(vectors, id_col, vector_col)
    groups = components(cut(_pairs(same, distinct, cosine, shard, min_shards, ef, recall, audit, True)))
    return ids.join(groups, "id", "left").select(F.col("id").alias("vec_id"), F.coalesce("component", "id").alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.x, b.x) >= {COSINE}),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT vec_id, min(other) AS component FROM reach GROUP BY vec_id
"""
