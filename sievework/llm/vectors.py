"""Approximate nearest neighbours: a navigable small-world graph per shard."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import staged, workers_can_import


class Graph:
    """A hierarchical graph over unit-length rows, held as flat neighbour arrays.

    Largest inner product becomes nearness on a sphere by one more coordinate,
    sqrt(M^2 - |x|^2) with M the largest norm; a query has 0 there. ``layers[l]`` is an
    (n, width) array of neighbours, -1 where there is none; in layers above 0 most rows are empty,
    so those are stored with the list of their nodes.
    """

    def __init__(self, vectors: np.ndarray, links: int = 12, width: int = 64, seed: int = 3):
        self.points = _lifted(vectors)
        self.links, self.width = links, width
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.levels = np.minimum((-np.log(1 - rng.random(n)) / math.log(links)).astype(np.int64), 12)
        self.layers = [np.full((n, 2 * links if layer == 0 else links), -1, np.int32) for layer in range(int(self.levels.max(initial=0)) + 1)]
        self.degree = [np.zeros(n, np.int32) for _ in self.layers]
        self.stamp, self.visit = np.zeros(n, np.int64), 0
        self.entry = -1
        for node in range(n):
            self._insert(node)

    def _insert(self, node: int) -> None:
        level = int(self.levels[node])
        if self.entry < 0:
            self.entry, self.top = node, level
            return
        q = self.points[node]
        near = [(float(self.points[self.entry] @ q), self.entry)]
        for layer in range(self.top, level, -1):
            near = self._search(q, near, 1, layer)
        for layer in range(min(level, self.top), -1, -1):
            near = self._search(q, near, self.width, layer)
            ids = np.array([i for _, i in near], np.int64)
            chosen = self._spread(q, ids, self.links)
            table, degree = self.layers[layer], self.degree[layer]
            table[node, : len(chosen)] = chosen
            degree[node] = len(chosen)
            for other in chosen:
                if degree[other] < table.shape[1]:
                    table[other, degree[other]] = node
                    degree[other] += 1
                else:
                    # trim to three quarters, so that not every later link trims again
                    kept = self._spread(self.points[other], np.append(table[other], node), table.shape[1] * 3 // 4)
                    table[other] = -1
                    table[other, : len(kept)] = kept
                    degree[other] = len(kept)
        if level > self.top:
            self.entry, self.top = node, level

    def _spread(self, q: np.ndarray, ids: np.ndarray, most: int) -> list[int]:
        """Of ``ids`` the nearest that are nearer to ``q`` than to any taken before; then the nearest of the rest."""
        points = self.points[ids]
        to_q = points @ q
        order = np.argsort(-to_q, kind="stable")
        if len(ids) <= most // 2:
            return ids[order].tolist()
        points, to_q, among = points[order], to_q[order], None
        taken, passed = [], []
        among = points @ points.T
        closest = np.full(len(ids), -np.inf)
        for i in range(len(ids)):
            if len(taken) == most:
                break
            if closest[i] < to_q[i]:
                taken.append(i)
                np.maximum(closest, among[i], out=closest)
            else:
                passed.append(i)
        taken += passed[: most - len(taken)]
        return ids[order][taken].tolist()

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The best-first walk of one layer: up to ``width`` of the nearest nodes, nearest first."""
        self.visit += 1
        stamp, visit, table, points = self.stamp, self.visit, self.layers[layer], self.points
        todo = [(-s, i) for s, i in start]
        best = list(start)
        heapq.heapify(todo)
        heapq.heapify(best)
        for _, i in start:
            stamp[i] = visit
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            ids = table[i, : self.degree[layer][i]]
            ids = ids[stamp[ids] != visit]
            if not len(ids):
                continue
            stamp[ids] = visit
            sims = points[ids] @ q
            if len(best) >= width:
                good = sims > best[0][0]
                ids, sims = ids[good], sims[good]
            for sim, other in zip(sims.tolist(), ids.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (sim, other))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, other))
                else:
                    continue
                heapq.heappush(todo, (-sim, other))
        return sorted(best, reverse=True)

    def nearest(self, query: np.ndarray, width: int) -> np.ndarray:
        if self.entry < 0:
            return np.empty(0, np.int64)
        q = np.append(_scaled(query).astype(np.float32), np.float32(0))
        near = [(float(self.points[self.entry] @ q), self.entry)]
        for layer in range(self.top, 0, -1):
            near = self._search(q, near, 1, layer)
        return np.array([i for _, i in self._search(q, near, width, 0)], np.int64)

    def pack(self) -> list[bytes]:
        """The flat arrays as bytes: levels, layer 0, and for each layer above its nodes and their rows."""
        upper = []
        for table in self.layers[1:]:
            nodes = np.flatnonzero(table[:, 0] >= 0).astype(np.int32)
            upper += [nodes.tobytes(), table[nodes].tobytes()]
        return [np.array([self.entry, self.top if self.entry >= 0 else 0, self.links], np.int64).tobytes(), self.layers[0].tobytes(), *upper]

    @classmethod
    def unpack(cls, vectors: np.ndarray, parts: list[bytes]) -> Graph:
        g = cls.__new__(cls)
        g.points = _lifted(vectors)
        n = len(vectors)
        g.entry, g.top, g.links = np.frombuffer(parts[0], np.int64).tolist()
        g.layers = [np.frombuffer(parts[1], np.int32).reshape(n, -1)]
        for nodes, rows in zip(parts[2::2], parts[3::2], strict=True):
            table = np.full((n, g.links), -1, np.int32)
            at = np.frombuffer(nodes, np.int32)
            table[at] = np.frombuffer(rows, np.int32).reshape(len(at), g.links)
            g.layers.append(table)
        g.degree = [(t >= 0).sum(axis=1).astype(np.int32) for t in g.layers]
        g.stamp, g.visit = np.zeros(n, np.int64), 0
        return g


def _scaled(x: np.ndarray) -> np.ndarray:
    """Doubles times the power of two that brings the largest to about 1, so that single precision can hold them."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max(initial=0))[1]))


def _lifted(vectors: np.ndarray) -> np.ndarray:
    x = _scaled(vectors)
    square = (x**2).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(square.max(initial=0) - square, 0))]).astype(np.float32)


def _norm_bins(vectors: np.ndarray) -> np.ndarray:
    """Which span of eight octaves a norm lies in: vectors of one graph are close enough in length for single precision."""
    most = np.abs(vectors).max(axis=1)
    log = np.log2(most) + 0.5 * np.log2(((vectors / most[:, None]) ** 2).sum(axis=1))
    return np.floor((log + 4) / 8).astype(np.int32)


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, vec)`` without rows whose id or vector is null, or whose vector is empty, zero, or holds a null or non-finite component."""
    wide = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return wide.where("vec_id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0").where(~bad & F.exists("vec", lambda x: x != 0))


def _as_rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _merge_copies(vectors: np.ndarray, ids: list[np.ndarray], most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct vectors, each with the ``most`` smallest ids that have it."""
    view = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, inverse = np.unique(view, return_index=True, return_inverse=True)
    sizes = np.array([len(x) for x in ids])
    owner, flat = np.repeat(inverse, sizes), np.concatenate(ids)
    order = np.lexsort((flat, owner))
    owner, flat = owner[order], flat[order]
    cuts = np.searchsorted(owner, np.arange(len(first) + 1))
    return vectors[first], [np.unique(flat[a:b])[:most] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_STORE = "shard int, dim int, bin int, vectors binary, ids binary, sizes binary, parts array<binary>"


def build_index(rows: DataFrame, k: int, shards: int | None = None, shard_rows: int = 100_000, links: int = 12, width: int = 64) -> DataFrame:
    """Graphs of ``usable`` vectors: ``(shard, dim, bin, vectors, ids, sizes, parts)``, one row for each shard, length and span of norms.

    A vector's shard is a hash of it, so copies meet; they become one node that knows its
    ``k`` + 1 smallest ids, which is all that an answer of ``k`` can need. Copies are merged in
    the map tasks first, so a vector that a third of all rows share sends few rows. There is one
    shard for each ``shard_rows`` rows, 12 at least; a shard is one task, whatever the hash of its number.
    Vectors whose norms lie more than some octaves apart are in graphs of their own, as single precision could not tell the short ones apart.
    """
    spark = rows.sparkSession
    workers_can_import(spark)
    shards = shards or max(12, -(-rows.count() // shard_rows))
    keyed = rows.select("vec_id", "vec", F.size("vec").alias("dim")).select(F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), "dim", "vec", "vec_id")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                vectors, shard = _as_rows(part.column(2)), part.column(0).to_numpy()
                order = np.column_stack([shard.astype(np.float64), vectors])
                kept, ids = _merge_copies(order, [np.array([i]) for i in part.column(3).to_numpy()], k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0].astype(np.int32)), pa.array(np.full(len(kept), dim, np.int32)), pa.array(_norm_bins(kept[:, 1:])), pa.array([v.tobytes() for v in kept[:, 1:]]), pa.array([i.tobytes() for i in ids])], ["shard", "dim", "bin", "vec", "ids"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, dim, span), vecs, held in _runs(batches):
            vectors = np.frombuffer(b"".join(vecs), np.float64).reshape(-1, dim)
            vectors, ids = _merge_copies(vectors, [np.frombuffer(i, np.int64) for i in held], k + 1)
            # inserted in an order that doesn't follow the values
            order = np.random.default_rng(1).permutation(len(vectors))
            vectors, ids = vectors[order], [ids[i] for i in order]
            parts = Graph(vectors, links, width).pack()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([dim], pa.int32()), pa.array([span], pa.int32()), pa.array([vectors.tobytes()]), pa.array([np.concatenate(ids).tobytes()]), pa.array([np.array([len(i) for i in ids], np.int32).tobytes()]), pa.array([parts], pa.list_(pa.binary()))],
                ["shard", "dim", "bin", "vectors", "ids", "sizes", "parts"],
            )

    merged = keyed.mapInArrow(combine, "shard int, dim int, bin int, vec binary, ids binary")
    return merged.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim", "bin").mapInArrow(build, _STORE)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list, list]]:
    """The rows of each run of equal (shard, dim, bin) of sorted batches."""
    key, vecs, ids = None, [], []
    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        for name, vec, held in zip(names, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if name != key:
                if vecs:
                    yield key, vecs, ids
                key, vecs, ids = name, [], []
            vecs.append(vec)
            ids.append(held)
    if vecs:
        yield key, vecs, ids


class Store:
    """One row of the index, ready to be asked."""

    def __init__(self, dim: int, vectors: bytes, ids: bytes, sizes: bytes, parts: list[bytes]):
        self.vectors = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.sizes = np.frombuffer(sizes, np.int32)
        self.ids, self.cuts = np.frombuffer(ids, np.int64), np.concatenate(([0], np.cumsum(self.sizes)))
        self.graph = Graph.unpack(self.vectors, parts)

    def ask(self, me: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        near = self.graph.nearest(q, width)
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.repeat((self.vectors[near] * q).sum(axis=1), self.sizes[near])
        who = np.concatenate([self.ids[self.cuts[i] : self.cuts[i + 1]] for i in near])
        return score[who != me], who[who != me]


def best(score: np.ndarray, who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best ids, each by its best score, best first and ties to the smaller id."""
    order = np.lexsort((who, -score))
    score, who = score[order], who[order]
    first = np.sort(np.unique(who, return_index=True)[1])[:k]
    return score[first], who[first]


def search(index: DataFrame, queries: DataFrame, k: int, width: int = 96) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each of ``queries(vec_id, vec)``.

    A shard's graphs come first in its task and its queries stream past them in batches, so a task holds one
    shard and one batch, and the index moves once. Each shard is asked with every query: on vectors without
    clusters no smaller choice of shards keeps the recall. A shard answers with its best ``k`` by exact inner product in double precision, and
    the shards' answers are merged by score, then by smaller id. A query's own id is left out. Queries repeated with
    the same vector are asked once; an id with several vectors, as query or candidate, is one whose score is its best.
    """
    workers_can_import(queries.sparkSession)
    shards = index.agg(F.max("shard")).first()[0]
    if shards is None:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    none = lambda t: F.lit(None).cast(t)
    stores = index.select("shard", F.lit(0).alias("turn"), "dim", none("bigint").alias("me"), none("array<double>").alias("q"), "vectors", "ids", "sizes", "parts")
    homes = F.explode(F.sequence(F.lit(0), F.lit(shards)))
    asked = queries.select("vec_id", "vec").distinct().select(homes.alias("shard"), F.lit(1).alias("turn"), F.size("vec").alias("dim"), F.col("vec_id").alias("me"), F.col("vec").alias("q"), *[none(t).alias(n) for n, t in (("vectors", "binary"), ("ids", "binary"), ("sizes", "binary"), ("parts", "array<binary>"))])
    rows = stores.union(asked).repartitionById(shards + 1, F.col("shard")).sortWithinPartitions("shard", "turn")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Store]] = {}
        at = None
        for batch in batches:
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            for i, (shard, turn, dim, me) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if shard != at:
                    at, held = shard, {}
                if turn == 0:
                    held.setdefault(dim, []).append(Store(dim, *(batch.column(c)[i].as_py() for c in range(5, 9))))
                elif dim in held:
                    q = batch.column(4)[i].values.to_numpy(zero_copy_only=False)
                    answers = [s.ask(me, q, max(width, k + 1)) for s in held[dim]]
                    found.append((me, *best(np.concatenate([a for a, _ in answers]), np.concatenate([b for _, b in answers]), k)))
            flat = lambda c, t: np.concatenate([np.empty(0, t), *[x[c] for x in found]]).astype(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([m for m, _, _ in found], np.int64), [len(b) for _, _, b in found])), pa.array(flat(2, np.int64)), pa.array(flat(1, np.float64))], ["query_id", "vec_id", "score"])

    answers = rows.mapInArrow(answer, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return answers.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 20, **options) -> DataFrame:
    """``query_id, rank, vec_id, score`` of ``queries`` against all ``rows``; both are tables of ``usable`` rows.

    Fewer than ``k`` candidates give them all. Rows repeated with the same id and vector are one
    candidate, and so is an id with several vectors, by its best. Vectors of different lengths never meet; products beyond a double's range are infinite. An empty table gives no rows.
    """
    index = staged(build_index(rows, k, **options), "graph")
    return search(index, queries, k)


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op9 over the whole ``embeddings`` table."""
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest_neighbours(rows, rows.where("vec_id % 20 = 0"))
