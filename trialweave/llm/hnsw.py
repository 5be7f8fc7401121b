"""Approximate nearest neighbours by cosine: one hierarchical small-world graph per shard.

Rows fall into shards of bounded size by a hash. A shard's graph is built in batches, in a seeded random order: the
nodes of a batch search the graph of those before them, link to a diverse choice of the nodes found and of one
another and are linked back.
Equal vectors are one node with all its ids. Graphs are kept as flat arrays of neighbour numbers, one row per
shard of a written table; every query searches every shard and the shards' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.shared import Steps
from trialweave.llm.vectors import best, clean, matrix, meet

SHARD_ROWS = 2048
#: Links of a node in upper layers (twice as many in the lowest), and nodes kept in building and in searching.
LINKS = 12
BUILD = 48
SEARCH = 64
BATCH = 64
INDEX = "shard long, ids binary, at binary, vectors binary, layers binary, links array<binary>"


class Graph:
    """Nodes as unit vectors; ``links[l]`` is an array (nodes, links of the layer), -1 where there is none."""

    def __init__(self, unit: np.ndarray, layers: np.ndarray, links: list[np.ndarray]):
        self.unit, self.layers, self.links = unit, layers, links

    @classmethod
    def build(cls, unit: np.ndarray, layers: np.ndarray) -> Graph:
        """Insert nodes in order of their layer, high ones first, so entry points are there from the start."""
        n = len(unit)
        g = cls(unit, layers, [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(layers.max(initial=0)) + 1)])
        order = np.argsort(-layers, kind="stable")
        i = 0
        while i < n:
            size = max(1, min(BATCH, i))
            new = order[i : i + size]
            if i:
                g._insert(new, order[0])
            i += size
        g.entry = int(order[0]) if n else -1
        return g

    def _insert(self, new: np.ndarray, entry: int) -> None:
        top = int(self.layers[entry])
        beam = np.full((len(new), 1), entry, np.int32)
        for layer in range(top, -1, -1):
            here = self.layers[new] >= layer
            ef = BUILD if here.any() else 1
            ids, sims = self._walk(self.unit[new], beam, layer, ef)
            if here.any():
                self._link(new[here], *self._with_batch(new[here], ids[here], sims[here]), layer)
            beam = ids

    def _with_batch(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates from the graph and the other nodes of the batch, best first; a group may lie in one batch."""
        among = self.unit[new] @ self.unit[new].T
        np.fill_diagonal(among, -np.inf)
        others = np.where(np.eye(len(new), dtype=bool), -1, new[None, :]).astype(np.int32)
        ids, sims = np.concatenate([ids, others], axis=1), np.concatenate([sims, among], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """From candidates, nearest first, those nearer to the node than to any chosen before; the rest if places stay."""
        rows, width = ids.shape
        among = np.einsum("ncd,nkd->nck", self.unit[ids], self.unit[ids])
        taken, count = np.zeros((rows, width), bool), np.zeros(rows, int)
        for spare in (False, True):
            for c in range(width):
                free = (ids[:, c] >= 0) & ~taken[:, c] & (count < most)
                if not spare:
                    free &= ~((among[:, c] >= sims[:, c, None]) & taken).any(axis=1)
                taken[:, c] |= free
                count += free
        out = np.full((rows, most), -1, np.int32)
        r, c = np.nonzero(taken)
        out[r, np.arange(len(r)) - np.searchsorted(r, r)] = ids[r, c]
        return out

    def _link(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int) -> None:
        table = self.links[layer]
        most = table.shape[1]
        table[new] = chosen = self._choose(ids, sims, most)[:, :most]
        source, target = np.repeat(new, most), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, n = np.unique(target, return_index=True, return_counts=True)
        more = np.full((len(nodes), int(n.max(initial=0))), -1, np.int32)
        more[np.repeat(np.arange(len(nodes)), n), np.arange(len(target)) - np.repeat(first, n)] = source
        # Two nodes of a batch can choose one another.
        more[(more[:, :, None] == table[nodes][:, None, :]).any(axis=2)] = -1
        both = np.concatenate([table[nodes], more], axis=1)
        sims = np.where(both >= 0, np.einsum("ncd,nd->nc", self.unit[both], self.unit[nodes]), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        both, sims = np.take_along_axis(both, order, 1), np.take_along_axis(sims, order, 1)
        full = (both >= 0).sum(axis=1) > most
        table[nodes[~full]] = both[~full][:, :most]
        if full.any():
            table[nodes[full]] = self._choose(both[full], sims[full], most)

    def _walk(self, q: np.ndarray, start: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of one layer for all queries at once: nodes and similarities, best first."""
        n, table = len(q), self.links[layer]
        every = np.arange(n)
        ids = np.full((n, ef), -1, np.int32)
        width = min(ef, start.shape[1])
        ids[:, :width] = start[:, :width]
        sims = np.where(ids >= 0, np.einsum("nd,ncd->nc", q, self.unit[ids]), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        seen = np.zeros((n, len(self.unit)), bool)
        for c in range(ids.shape[1]):
            ok = ids[:, c] >= 0
            seen[every[ok], ids[ok, c]] = True
        done = ids < 0
        while True:
            act = np.flatnonzero(~done.all(axis=1))
            if not len(act):
                return ids, sims
            pick = (~done[act]).argmax(axis=1)  # sorted, so the first open one is the best
            done[act, pick] = True
            near = table[ids[act, pick]]
            fresh = (near >= 0) & ~seen[act[:, None], near]
            seen[act[:, None], np.where(fresh, near, ids[act, pick][:, None])] = True
            s = np.where(fresh, np.einsum("nd,ncd->nc", q[act], self.unit[near]), -np.inf)
            s = np.where(s > sims[act, -1:], s, -np.inf)
            all_ids = np.concatenate([ids[act], np.where(np.isfinite(s), near, -1)], axis=1)
            all_sims = np.concatenate([sims[act], s], axis=1)
            all_done = np.concatenate([done[act], ~np.isfinite(s)], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            ids[act] = np.take_along_axis(all_ids, order, 1)
            sims[act] = np.take_along_axis(all_sims, order, 1)
            done[act] = np.take_along_axis(all_done, order, 1) | (ids[act] < 0)

    def search(self, q: np.ndarray, ef: int = SEARCH) -> tuple[np.ndarray, np.ndarray]:
        beam = np.full((len(q), 1), self.entry, np.int32)
        for layer in range(int(self.layers[self.entry]), 0, -1):
            beam, _ = self._walk(q, beam, layer, 1)
        return self._walk(q, beam, 0, ef)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x**2).sum(axis=1, keepdims=True))).astype(np.float32)


def _layers(nodes: int) -> np.ndarray:
    """Geometric layer numbers from a seeded generator, so a rebuilt shard is the same."""
    return np.floor(-np.log(1 - np.random.default_rng(nodes).random(nodes)) / np.log(LINKS)).astype(np.int32)


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard, as a written table; ``rows`` has ``id`` and ``v`` (no zero vectors)."""
    spark = rows.sparkSession
    steps = Steps(spark, "hnsw")
    shards = max(1, -(-rows.count() // shard_rows))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shards, 4096))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "v")
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "id")

    def one(shard: int, table: pa.Table) -> pa.RecordBatch:
        ids, x = table.column("id").to_numpy(), matrix(table.column("v").combine_chunks())
        nodes, of = np.unique(x, axis=0, return_inverse=True)
        # Sorted nodes would put near ones into one batch.
        turn = np.random.default_rng([7, len(nodes)]).permutation(len(nodes))
        nodes, of = nodes[turn], np.argsort(turn)[of.ravel()]
        order = np.lexsort((ids, of))
        at = np.searchsorted(of[order], np.arange(len(nodes) + 1)).astype(np.int64)
        g = Graph.build(_unit(nodes), _layers(len(nodes)))
        links = [k.tobytes() for k in g.links]
        values = [[shard], [ids[order].astype(np.int64).tobytes()], [at.tobytes()], [nodes.tobytes()], [g.layers.tobytes()], [links]]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for b in batches:
            names = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(names)) + 1), len(names)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if names[i] != shard and held:
                    yield one(shard, pa.Table.from_batches(held))
                    held = []
                shard = int(names[i])
                held.append(b.slice(i, j - i))
        if held:
            yield one(shard, pa.Table.from_batches(held))

    return steps.write(dealt.mapInArrow(run, INDEX))


def _load(table: pa.Table):
    row = {c: table.column(c)[0].as_py() for c in ("ids", "at", "vectors", "layers", "links")}
    at = np.frombuffer(row["at"], np.int64)
    n = len(at) - 1
    x = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
    g = Graph(_unit(x), np.frombuffer(row["layers"], np.int32), [np.frombuffer(k, np.int32).reshape(n, -1) for k in row["links"]])
    g.entry = int(np.argsort(-g.layers, kind="stable")[0])
    return g, np.frombuffer(row["ids"], np.int64), at, x, np.sqrt((x**2).sum(axis=1))


def _solver(k: int, ef: int):
    def solve(state, qids: np.ndarray, q: np.ndarray):
        g, ids, at, x, norm = state
        nodes, _ = g.search(_unit(q), ef)
        size = np.sqrt((q**2).sum(axis=1))
        rows, found, scores = [], [], []
        for r in range(len(q)):
            near = nodes[r][nodes[r] >= 0]
            cosine = (x[near] @ q[r]) / (norm[near] * size[r])
            # Of each node's ids only the first k others can be among the k best.
            own = [m[m != qids[r]][:k] for m in (ids[at[v] : at[v + 1]] for v in near)]
            each = np.array([len(m) for m in own])
            m, s = np.concatenate([*own, np.zeros(0, np.int64)]), np.repeat(cosine, each)
            top = np.lexsort((m, -s))[:k]
            rows.append(np.full(len(top), r))
            found.append(m[top])
            scores.append(s[top])
        return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)

    return solve


def nearest(
    vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5, ef: int = SEARCH, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest other rows that the graphs find, by cosine.

    Null ids and vectors that are null, zero, hold null or non-finite components or have an odd length take no part;
    an empty table or no query gives no rows. Repeated rows are candidates of their own; a query is compared with no
    row of its id. Other columns are ignored. Every row is in a graph; shards are of bounded size by a hash of the id.
    """
    spark = vectors.sparkSession
    rows = clean(vectors, key, vector, zero=False)
    index = build_index(rows, shard_rows)
    shards = [r.shard for r in index.select("shard").collect()]
    queries = rows.filter(is_query(F.col("id"))).dropDuplicates(["id", "v"])
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = queries.select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(shards)).cast("long"))).alias("block"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(shards), 4096))
    payload = "ids binary, at binary, vectors binary, layers binary, links array<binary>"
    found = meet(index.withColumnRenamed("shard", "block"), sent, _load, _solver(k, ef), payload, parts)
    return best(found, k)
