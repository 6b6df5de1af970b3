"""Embedding near-duplicates by hierarchical navigable small-world graphs, one a shard.

Equal vectors become one node with a weight. Nodes are dealt to shards by hash, a graph is built in
each, and every node queries every shard, many queries in step. A beam that comes back full of links is
widened, up to one as wide as the shard, which is a look at all its vectors. A task's beams are
audited: for ``AUDIT`` of its queries the links to others are held against all vectors of the shard,
and the task starts again with twice the beam until at least ``RECALL`` of them are found. Links are
verified in double precision and folded slice by slice into counts and a spanning forest, so that
memory follows vectors, not pairs; components are joined by Spark.

Defined cases: a vector that is null, zero, or holds null or non-finite components links with
nothing, nor does one without vec_id, nor vectors of different lengths with each other; every row
keeps a row; repeated vec_ids with one vector count as copies; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import connected_components, cut, discard, longs

SIMILARITY = 0.9
#: Nodes and bytes of vectors (in double precision) of a shard at most, and shards at least, so that small tables still use several tasks.
SHARD_NODES, SHARD_BYTES, SHARDS = 32_768, 16 << 20, 6
#: The same of the queries that a task asks of a shard.
QUERY_NODES, QUERY_BYTES = 32_768, 16 << 20
#: Similarities that a task holds at once.
CELLS = 4 << 20
DEGREE, BUILD_BEAM, BEAM = 12, 40, 24
AUDIT, RECALL = 256, 0.99


class Graph:
    """Unit vectors ``v`` with neighbour lists by layer; ``nodes[l]`` are the members of layer l, layer 0 has all."""

    def __init__(self, v: np.ndarray, seed: int = 1):
        self.v = v.astype(np.float32)
        n = len(v)
        level = np.minimum(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(DEGREE), 8).astype(int)
        order = np.argsort(-level, kind="stable")  # higher nodes come first, so each layer is a prefix of the order
        self.order, self.v = order, self.v[order]
        level = level[order]
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)] or [0]
        self.layers = [np.zeros((0, 0), np.int32)] * len(self.sizes)
        for k in range(len(self.sizes) - 1, -1, -1):
            self._build(k)

    def _build(self, k: int) -> None:
        n, width = self.sizes[k], 2 * DEGREE if k == 0 else DEGREE
        links = self.layers[k] = np.full((n, width), -1, np.int32)
        done = min(n, 128)
        first = self.v[:done] @ self.v[:done].T
        np.fill_diagonal(first, -2)
        near = np.argsort(-first, axis=1)[:, : min(width * 2, max(done - 1, 0))]
        if done > 1:
            picked = self._diverse(np.arange(done), near, width)
            links[:done, : picked.shape[1]] = picked
        while done < n:
            batch = np.arange(done, min(n, done + max(64, min(done // 4, 1024))))
            found, _ = self._search(self.v[batch], BUILD_BEAM, k, done)
            inner = self.v[batch] @ self.v[batch].T
            np.fill_diagonal(inner, -2)
            take = min(8, len(batch) - 1)
            if take > 0:
                mates = batch[np.argpartition(-inner, take - 1, axis=1)[:, :take]]
                found = np.concatenate((found, mates), axis=1)
            picked = self._diverse(batch, found, DEGREE)
            links[batch, : picked.shape[1]] = picked
            self._link_back(links, batch, picked, width)
            done = int(batch[-1]) + 1

    def _diverse(self, of: np.ndarray, found: np.ndarray, keep: int) -> np.ndarray:
        """For each row up to ``keep`` candidates, best first, preferring those closer to it than to one already taken."""
        out = np.full((len(of), keep), -1, np.int32)
        for i in range(0, len(of), 256):
            ids = found[i : i + 256].astype(np.int64)
            me = of[i : i + 256]
            sim = np.einsum("bcd,bd->bc", self.v[np.maximum(ids, 0)], self.v[me])
            ids = np.where(ids == me[:, None], -1, ids)
            sim[ids < 0] = -9
            order = np.argsort(-sim, axis=1, kind="stable")
            ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
            vec = self.v[np.maximum(ids, 0)]
            among = np.einsum("bcd,bed->bce", vec, vec)
            state = np.zeros(ids.shape, np.int8)  # 1 taken, 2 passed over
            count = np.zeros(len(ids), int)
            for c in range(ids.shape[1]):
                taken = state[:, :c] == 1
                crowded = (taken & (among[:, c, :c] > sim[:, c, None])).any(axis=1)
                again = ((ids[:, :c] == ids[:, c, None]) & (state[:, :c] > 0)).any(axis=1)
                ok = (ids[:, c] >= 0) & ~again & (count < keep)
                state[:, c] = np.where(ok, np.where(crowded, 2, 1), 0)
                count += ok & ~crowded
            rank = np.where(state == 1, 0, np.where(state == 2, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
            best = np.argsort(rank, axis=1, kind="stable")[:, :keep]
            got = np.where(np.take_along_axis(state, best, 1) > 0, np.take_along_axis(ids, best, 1), -1)
            out[i : i + 256, : got.shape[1]] = got
        return out

    def _link_back(self, links: np.ndarray, batch: np.ndarray, picked: np.ndarray, width: int) -> None:
        src, dst = np.repeat(batch, picked.shape[1]), picked.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        sim = np.einsum("ed,ed->e", self.v[src], self.v[dst])
        order = np.lexsort((-sim, dst))
        src, dst = src[order], dst[order]
        nodes, start, n = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(start, n)
        keep = place < 2 * width
        new = np.full((len(nodes), int(min(n.max(), 2 * width))), -1, np.int32)
        new[np.repeat(np.arange(len(nodes)), n)[keep], place[keep]] = src[keep]
        links[nodes] = self._diverse(nodes, np.concatenate((links[nodes], new), axis=1), width)

    def _search(self, q: np.ndarray, beam: int, layer: int = 0, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the ``beam`` best nodes found in a layer for each query, in blocks of bounded memory."""
        n = self.sizes[layer] if limit is None else limit
        step = int(max(16, min(512, (64 << 20) // max(n, 1))))
        got = [self._block(q[i : i + step], min(beam, n), layer, n) for i in range(0, len(q), step)]
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def _block(self, q: np.ndarray, beam: int, layer: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(q), np.int64)
        top = np.einsum("bd,bd->b", self.v[at], q)
        for k in range(len(self.sizes) - 1, layer, -1):
            moving = np.arange(len(q))
            while len(moving):
                near = self.layers[k][at[moving]].astype(np.int64)
                sim = np.einsum("bmd,bd->bm", self.v[np.maximum(near, 0)], q[moving])
                sim[(near < 0) | (near >= n)] = -9  # a layer that is being built doesn't hold all of those above yet
                best = sim.argmax(axis=1)
                value = sim[np.arange(len(moving)), best]
                up = value > top[moving]
                at[moving[up]] = near[up, best[up]]
                top[moving[up]] = value[up]
                moving = moving[up]
        ids = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -9, np.float32)
        ids[:, 0], sims[:, 0] = at, top
        waiting = np.zeros((len(q), beam), bool)
        waiting[:, 0] = True
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        seen[np.arange(len(q)), at] = True
        live = np.arange(len(q))
        links = self.layers[layer]
        while len(live):
            rows = np.arange(len(live))[:, None]
            i, s, w = ids[live], sims[live], waiting[live]
            width = min(4, beam)
            pick = np.argpartition(np.where(w, -s, 9), width - 1, axis=1)[:, :width]
            chosen = w[rows, pick]
            w[rows, pick] = False
            near = np.where(chosen[:, :, None], links[np.maximum(i[rows, pick], 0)], -1).reshape(len(live), -1).astype(np.int64)
            near[(near < 0) | (near >= n)] = n
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near[seen[live[:, None], near]] = n
            seen[live[:, None], near] = True
            sim = np.einsum("bmd,bd->bm", self.v[np.minimum(near, n - 1)], q[live])
            sim[near == n] = -9
            i, s = np.concatenate((i, near), axis=1), np.concatenate((s, sim), axis=1)
            w = np.concatenate((w, near < n), axis=1)
            best = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], waiting[live] = i[rows, best], s[rows, best], w[rows, best]
            live = live[waiting[live].any(axis=1)]
        return ids, sims


class Links:
    """What the links of one task come to: the weight of linked others of each query and of each place of the shard, and a spanning forest of both.

    A link counts where the smaller node asks, at both ends, so both ends always agree on it.
    """

    def __init__(self, ids: np.ndarray, weight: np.ndarray, asked: np.ndarray, own: np.ndarray):
        self.weight, self.own = weight, own
        self.names, at = np.unique(np.concatenate((ids, asked)), return_inverse=True)
        self.v_at, self.q_at = at[: len(ids)], at[len(ids) :]
        self.root = np.arange(len(self.names))
        self.linked, self.back = np.zeros(len(asked), np.int64), np.zeros(len(ids), np.int64)

    def add(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Take in links of queries to places in the shard; the queries of those that count."""
        larger = self.q_at[q] < self.v_at[v]  # names are sorted, so places compare as nodes do
        q, v = q[larger], v[larger]
        np.add.at(self.linked, q, self.weight[v])
        np.add.at(self.back, v, self.own[q])
        a, b = self.q_at[q], self.v_at[v]
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]
        return q

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.names[child], self.names[self.root[child]]


def _all_of(v: np.ndarray, q: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, place) of all vectors at ``least`` or more, some queries at a time."""
    step = max(1, CELLS // max(len(v), 1))
    for i in range(0, len(q), step):
        x, y = np.nonzero(q[i : i + step] @ v.T >= least)
        yield x + i, y


def _found(graph: Graph, v: np.ndarray, q: np.ndarray, beam: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, place) of the links that beams find, where a beam is full of links one four times as wide, then one as wide as the shard."""
    n, loose, qf = len(v), np.float32(least - 1e-4), q.astype(np.float32)
    rest, width = np.arange(len(q)), min(beam, n)
    while len(rest):
        if width == n and n > BEAM:  # as wide as the shard
            for x, y in _all_of(v, q[rest], least):
                yield rest[x], y
            return
        step, full = max(1, CELLS // (width * 16)), []
        for i in range(0, len(rest), step):
            some = rest[i : i + step]
            ids, sims = graph._search(qf[some], width)
            more = (sims.min(axis=1) >= loose) & (width < n)
            x, y = np.nonzero((sims >= loose) & ~more[:, None])
            x, y = some[x], graph.order[ids[x, y]]
            good = np.einsum("ed,ed->e", q[x], v[y]) >= least
            yield x[good], y[good]
            full.append(some[more])
        rest, width = np.concatenate(full), 4 * beam if width == beam and 16 * beam <= n else n


def links_of(graph: Graph, v: np.ndarray, ids: np.ndarray, weight: np.ndarray, q: np.ndarray, asked: np.ndarray, own: np.ndarray, least: float = SIMILARITY) -> Links:
    """Links of queries (unit vectors ``q`` of nodes ``asked``, weights ``own``) to a shard's (``v`` of nodes ``ids``)."""
    audit = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    truth = Links(ids, weight, asked[audit], own[audit])
    there = sum(len(truth.add(x, y)) for x, y in _all_of(v, q[audit], least))
    beam = BEAM
    while True:
        out, met = Links(ids, weight, asked, own), 0
        for x, y in _found(graph, v, q, beam, least):
            met += int(np.isin(out.add(x, y), audit).sum())
        if met >= RECALL * there or beam >= len(v):
            return out
        beam *= 2


def _rows(column) -> np.ndarray:
    """An array of vectors as one, in the precision it came in."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    v = rows.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v


def packed(rows: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> bytes:
    """A shard and its graph as bytes: each vector once, as it came; unit vectors are worked out again on arrival."""
    graph = Graph(_unit(rows))
    graph.v = None
    return pickle.dumps((graph, rows, ids, weight), protocol=5)


def unpacked(held) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """(graph, unit vectors, ids, weights) of :func:`packed` bytes."""
    graph, rows, ids, weight = pickle.loads(held)
    v = _unit(rows)
    graph.v = v.astype(np.float32)[graph.order]
    return graph, v, ids, weight


def near_vectors(table: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    sound = F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("v"))
    rows = rows.select("vec_id", "v", F.when(F.coalesce(sound, F.lit(False)), F.md5(F.col("v").cast("string"))).alias("key"))
    nodes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("v").alias("v"))
    nodes = cut(nodes, "nodes")
    total = nodes.count()
    widest = nodes.agg(F.max(F.size("v"))).first()[0] or 1
    per_shard, per_block = (max(1, min(n, size // (8 * widest))) for n, size in ((SHARD_NODES, SHARD_BYTES), (QUERY_NODES, QUERY_BYTES)))
    shards, blocks = max(SHARDS, -(-total // per_shard)), max(1, -(-total // per_block))
    # vectors that came as floats travel as floats, which loses nothing
    sent = F.col("v").cast("array<float>") if isinstance(getattr(table.schema["embedding"].dataType, "elementType", None), FloatType) else F.col("v")
    dealt = nodes.select("node", "weight", sent.alias("v"), F.size("v").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"))

    def build(group: pa.Table) -> pa.Table:
        held = packed(_rows(group.column("v")), group.column("node").to_numpy(), group.column("weight").to_numpy())
        return pa.table({"dim": group.column("dim")[:1], "shard": group.column("shard")[:1], "graph": pa.array([held], pa.binary())})

    graphs = cut(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, graph binary"), "graphs", "none")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    queries = dealt.select("node", "weight", "v", "dim", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(blocks)).cast("int").alias("block"), every.alias("shard"))
    copies = graphs.select("dim", "shard", "graph", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def query(graph: pa.Table, asked: pa.Table) -> pa.Table:
        a, b, w = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if graph.num_rows and asked.num_rows:
            small_world, v, ids, weight = unpacked(graph.column("graph")[0].as_buffer())
            me = asked.column("node").to_numpy()
            found = links_of(small_world, v, ids, weight, _unit(_rows(asked.column("v"))), me, asked.column("weight").to_numpy(), least)
            some, back = np.flatnonzero(found.linked), np.flatnonzero(found.back)
            child, root = found.forest()
            a, b = np.concatenate((me[some], ids[back], child)), np.concatenate((me[some], ids[back], root))
            w = np.concatenate((found.linked[some], found.back[back], np.zeros(len(child), np.int64)))
        return pa.table({"a": longs(a), "b": longs(b), "w": longs(w)})

    keys = ["dim", "shard", "block"]
    found = cut(copies.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(query, "a long, b long, w long"), "links")
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("linked"))
    roots = connected_components(found.where("a <> b").select("a", "b"))
    named = nodes.select("key", "node", "weight").join(counts, "node", "left").join(roots, "node", "left")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    n_links = F.coalesce(F.col("weight") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))
    out = out.select("vec_id", n_links.cast("long").alias("n_links"), F.coalesce("root", "node", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.9 or more among all rows of ``embeddings``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
