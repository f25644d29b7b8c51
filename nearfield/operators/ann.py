"""Approximate search: cells around centroids (inverted file), and a navigable graph for each part of the vectors.

Cells: centroids are fitted on a bounded sample, every vector is assigned to its nearest, and a query looks at the ``nprobe``
cells nearest to it. With all cells probed the result is exact. Graphs: every part of the rows gets a hierarchical navigable
small-world graph, which is searched in the task that built it; the parts' hits are merged. Either is approximate, so report
its results with the recall measured by nearfield.evaluate.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nearfield.functions.distance import Metric, distance_matrix
from nearfield.operators.knn import Nearest, hits_batch, matrix, query_blocks, top_k, where_column
from nearfield.session import ship_package

#: Bytes of distances or vectors that the building of a graph holds at a time, about.
BLOCK = 16 << 20
#: Vectors that centroids are fitted on at most (those whose ids hash lowest).
SAMPLE_ROWS = 50_000


@dataclass(frozen=True)
class Cells:
    metric: Metric
    centroids: np.ndarray

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each vector, nearest first, ties by number."""
        d = distance_matrix(self.metric if self.metric is not Metric.DOT else Metric.EUCLIDEAN, vectors, self.centroids)
        return np.argsort(d, axis=1, kind="stable")[:, :n]


def fit_cells(vectors: DataFrame, cells: int, metric: Metric | str = Metric.COSINE, id_col: str = "id", vector_col: str = "vector", rounds: int = 15, sample: int = SAMPLE_ROWS, seed: int = 0) -> Cells:
    """Centroids by k-means on at most ``sample`` vectors (unit length for cosine); an empty cell takes the farthest vector."""
    metric = Metric(metric)
    rows = vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(sample).select(vector_col).toArrow()
    v = matrix(rows.column(0).combine_chunks()).astype(np.float64)
    if not len(v):
        raise ValueError("no vectors to fit cells on")
    if metric is Metric.COSINE:
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    centres = v[rng.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(rounds):
        d = (v * v).sum(1)[:, None] - 2 * v @ centres.T + (centres * centres).sum(1)
        own = d.argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        n = np.bincount(own, minlength=len(centres))
        new = sums / np.maximum(n, 1)[:, None]
        for e in np.flatnonzero(n == 0):
            far = int(d[np.arange(len(v)), own].argmax())
            new[e] = v[far]
            own[far] = e
        if np.allclose(new, centres):
            break
        centres = new
    return Cells(metric, centres)


def assign(vectors: DataFrame, cells: Cells, vector_col: str = "vector") -> DataFrame:
    """``vectors`` with the cell of each; write it partitioned by cell to have searches read only the cells they probe."""
    ship_package(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.nearest(np.stack(v.to_numpy()).astype(np.float64), 1)[:, 0]) if len(v) else pd.Series([], dtype="int32")

    return vectors.where(F.col(vector_col).isNotNull()).withColumn("cell", cell(F.col(vector_col)))


def search_cells(
    assigned: DataFrame, cells: Cells, queries: DataFrame, k: int, nprobe: int, where: Mapping[str, Any] | Column | None = None,
    id_col: str = "id", vector_col: str = "vector", qid_col: str = "qid", qvec_col: str = "qvec",
) -> DataFrame:
    """(qid, rank, id, distance) among the vectors in the ``nprobe`` nearest cells of each query."""
    ship_package(assigned.sparkSession)
    spark = assigned.sparkSession
    test = where_column(assigned, where)
    rows = assigned if test is None else assigned.where(test)
    asked = queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).cast("array<double>").alias("qvec"))
    schema = T.StructType([asked.schema["qid"], T.StructField("id", T.LongType()), T.StructField("distance", T.DoubleType())])
    out: DataFrame | None = None
    for qids, block in query_blocks(asked, "auto"):
        probed = cells.nearest(block, nprobe)
        by_cell = {c: np.flatnonzero((probed == c).any(1)) for c in np.unique(probed).tolist()}

        def run(batches: Iterator[pa.RecordBatch], qids=qids, block=block, by_cell=by_cell) -> Iterator[pa.RecordBatch]:
            best = Nearest(block, k, cells.metric)
            for batch in batches:
                ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                v = matrix(batch.column(1), block.shape[1])
                for c in np.unique(cell).tolist():
                    at = cell == c
                    best.add(v[at], ids[at], own=by_cell[c])
            yield from hits_batch(best, pa.array(qids), to_arrow_schema(schema))

        source = rows.where(F.col("cell").isin(sorted(by_cell))).select(F.col(id_col).cast("bigint"), vector_col, "cell")
        hits = source.mapInArrow(run, schema)
        out = hits if out is None else out.unionByName(hits)
    return top_k(spark.createDataFrame([], schema) if out is None else out, k).select("qid", "rank", "id", "distance")


@dataclass(frozen=True)
class GraphOptions:
    """Links of a node above and (twice as many) on the lowest layer, and candidates kept while building and searching."""

    m: int = 16
    ef_construction: int = 100
    ef_search: int = 50
    seed: int = 42

    def __post_init__(self) -> None:
        if self.m < 2 or self.ef_construction < 1 or self.ef_search < 1:
            raise ValueError("m must be at least 2, and both ef at least 1")


class Graph:
    """A hierarchical navigable small-world graph over the rows of a matrix (Malkov and Yashunin, 2016)."""

    def __init__(self, vectors: np.ndarray, metric: Metric, options: GraphOptions):
        self.metric, self.o = metric, options
        v = vectors.astype(np.float64)
        self.v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12) if metric is Metric.COSINE else v
        self.links: list[dict[int, list[int]]] = []
        levels = (-np.log(1.0 - np.random.default_rng(options.seed).random(len(v))) / math.log(options.m)).astype(int)
        self.top = int(levels.max(initial=-1))
        self.entry = int(levels.argmax()) if len(v) else -1
        for layer in range(self.top + 1):
            self.links.append(self._linked(np.flatnonzero(levels >= layer), options.m * 2 if layer == 0 else options.m))

    def _far(self, q: np.ndarray, rows: Sequence[int]) -> np.ndarray:
        w = self.v[rows]
        if self.metric is Metric.EUCLIDEAN:
            w = w - q
            return np.einsum("ij,ij->i", w, w)
        return -(w @ q)

    def _layer(self, q: np.ndarray, start: list[tuple[float, int]], ef: int, layer: int, live: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The ``ef`` nearest nodes that a best-first walk on one layer finds, nearest first; others than ``live`` ones only lead on."""
        links = self.links[layer]
        seen = {i for _, i in start}
        todo, best = list(start), [(-d, i) for d, i in start if live is None or live[i]]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in links[i] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for dj, j in zip(self._far(q, new).tolist(), new, strict=True):
                if len(best) < ef or dj < -best[0][0]:
                    heapq.heappush(todo, (dj, j))
                    if live is not None and not live[j]:
                        continue
                    heapq.heappush(best, (-dj, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What _far() gives, for all pairs of two (stacks of) matrices."""
        far = -(a @ np.swapaxes(b, -1, -2))
        if self.metric is Metric.EUCLIDEAN:
            far = np.maximum((a * a).sum(-1)[..., :, None] + 2 * far + (b * b).sum(-1)[..., None, :], 0.0)
        return far

    def _choose(self, w: np.ndarray, found: np.ndarray, far: np.ndarray, m: int) -> np.ndarray:
        """``m`` of each row of candidates ``found`` (nearest first; at infinity there is none), -1 where there are fewer.

        They lie in different directions: one that is nearer to a chosen one than to the node only fills up.
        """
        there = np.isfinite(far)
        open_, chosen, rows = there.copy(), np.zeros_like(there), np.arange(len(found))
        v = w[found]
        for _ in range(min(m, found.shape[1])):
            has = open_.any(1)
            if not has.any():
                break
            pick = open_.argmax(1)
            chosen[rows[has], pick[has]] = True
            open_ &= (self._apart(v, v[rows, pick][:, None])[:, :, 0] >= far) | ~has[:, None]
            open_[rows, pick] = False
        first = np.argsort(np.where(chosen, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :m]
        return np.where(np.take_along_axis(there, first, 1), np.take_along_axis(found, first, 1), -1)

    def _linked(self, nodes: np.ndarray, room: int) -> dict[int, list[int]]:
        """Links of one layer: each node's to the nearest among those before it, both ways, and all reached from the entry.

        Nodes are inserted one after the other as in the paper, except that the ``ef_construction`` candidates of a node are
        the nearest of all before it, which products of matrices find, and that links beyond ``room`` are cut once, at the end.
        """
        w, n = self.v[nodes], len(nodes)
        ends: list[np.ndarray] = []
        step = max(1, BLOCK // (8 * n))
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            far = self._apart(w[lo:hi], w[:hi])
            far[np.arange(hi)[None] >= np.arange(lo, hi)[:, None]] = np.inf
            some = min(self.o.ef_construction, hi)
            found = np.argpartition(far, some - 1, axis=1)[:, :some] if some < hi else np.tile(np.arange(hi), (hi - lo, 1))
            far = np.take_along_axis(far, found, 1)
            order = np.lexsort((found, far), axis=1)
            found, far = np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1)
            part = max(1, BLOCK // (8 * some * w.shape[1]))
            for s in range(0, hi - lo, part):
                to = self._choose(w, found[s : s + part], far[s : s + part], self.o.m)
                i, j = np.nonzero(to >= 0)
                ends.append(np.stack([lo + s + i, to[i, j]]))
        pairs = np.concatenate(ends, axis=1)
        pairs = np.unique(np.concatenate([pairs, pairs[::-1]], axis=1), axis=1)  # by node
        counts = np.bincount(pairs[0], minlength=n)
        starts = np.cumsum(counts) - counts
        links = np.full((n, room), -1)
        few = counts[pairs[0]] <= room
        links[pairs[0][few], (np.arange(pairs.shape[1]) - starts[pairs[0]])[few]] = pairs[1][few]
        many = np.flatnonzero(counts > room)
        many = many[np.argsort(counts[many], kind="stable")]
        while len(many):  # as many at once as the widest of them allows
            wide = np.cumsum(np.ones(len(many), int)) * counts[many] * w.shape[1] * 8 <= BLOCK
            some, many = np.split(many, [max(1, int(wide.sum()))])
            found = starts[some][:, None] + np.minimum(np.arange(counts[some].max()), counts[some][:, None] - 1)
            far = self._apart(w[some][:, None], w[pairs[1][found]])[:, 0]
            far[np.arange(found.shape[1])[None] >= counts[some][:, None]] = np.inf
            found = pairs[1][found]
            order = np.lexsort((found, far), axis=1)
            links[some] = self._choose(w, np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1), room)
        self._reach(w, links, int(np.searchsorted(nodes, self.entry)))
        return {int(i): nodes[own[own >= 0]].tolist() for i, own in zip(nodes, links, strict=True)}

    def _reach(self, w: np.ndarray, links: np.ndarray, entry: int) -> None:
        """Have every node reached from the entry: one that isn't gets a link from the nearest reached node that can spare one."""
        tree = np.zeros(links.shape, bool)  # links that a node is reached by
        seen = np.zeros(len(links), bool)
        seen[entry] = True
        front, left = np.array([entry]), 0
        while True:
            while len(front):
                to = links[front]
                at = np.flatnonzero((to >= 0).ravel() & ~seen[to].ravel())
                new, first = np.unique(to.ravel()[at], return_index=True)
                tree[front[at[first] // links.shape[1]], at[first] % links.shape[1]] = True
                seen[new] = True
                front = new
            while left < len(seen) and seen[left]:
                left += 1
            if left == len(seen):
                return
            spare = np.flatnonzero(seen & ~tree.all(1))  # leaves of the tree at least
            near = int(spare[self._apart(w[left][None], w[spare])[0].argmin()])
            slots = np.flatnonzero(~tree[near])
            at = slots[-1]  # free ones stand last
            links[near, at], tree[near, at], seen[left] = left, True, True
            front = np.array([left])

    def search(self, query: np.ndarray, k: int, ef: int | None = None, live: np.ndarray | None = None) -> list[int]:
        """The ``k`` nearest nodes that a walk with ``ef`` candidates finds, of those that ``live`` marks."""
        if self.entry < 0:
            return []
        q = query / (np.linalg.norm(query) + 1e-12) if self.metric is Metric.COSINE else query
        near = first = [(float(self._far(q, [self.entry])[0]), self.entry)]
        for layer in range(self.top, 0, -1):
            near = self._layer(q, near, 1, layer)
        start = near if near[0][1] == self.entry else near + first  # from the entry all nodes are reached
        return [i for _, i in self._layer(q, start, max(ef or self.o.ef_search, k), 0, live)[:k]]

    def arrays(self) -> dict[str, np.ndarray]:
        """The links as arrays, for from_arrays(): entry and top layer, and by layer its nodes, links of each, links."""
        out = {"at": np.array([self.entry, self.top])}
        for layer, links in enumerate(self.links):
            out[f"n{layer}"] = np.fromiter(links, np.int32, len(links))
            out[f"c{layer}"] = np.fromiter(map(len, links.values()), np.int32, len(links))
            out[f"l{layer}"] = np.array([j for own in links.values() for j in own], np.int32)
        return out

    @classmethod
    def from_arrays(cls, data: Mapping[str, np.ndarray], metric: Metric, options: GraphOptions) -> Graph:
        v = data["raw"].astype(np.float64)
        graph = cls(v[:0], metric, options)
        graph.v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12) if metric is Metric.COSINE else v
        graph.entry, graph.top = (int(x) for x in data["at"])
        for layer in range(graph.top + 1):
            parts = np.split(data[f"l{layer}"], np.cumsum(data[f"c{layer}"])[:-1])
            graph.links.append({int(i): own.tolist() for i, own in zip(data[f"n{layer}"], parts, strict=True)})
        return graph


#: Vectors of one graph at most: graphs are built in numpy, and larger parts become several.
GRAPH_ROWS = 20_000


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of runs of GRAPH_ROWS rows at most."""
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, GRAPH_ROWS):
            part = batch.slice(lo, GRAPH_ROWS)
            if held and held + part.num_rows > GRAPH_ROWS:
                yield np.concatenate(ids), np.concatenate(rows)
                ids, rows, held = [], [], 0
            ids.append(part.column(0).to_numpy())
            rows.append(matrix(part.column(1)).astype(np.float64))
            held += part.num_rows
    if held:
        yield np.concatenate(ids), np.concatenate(rows)


def build_graphs(vectors: DataFrame, metric: Metric | str = Metric.COSINE, options: GraphOptions | None = None, id_col: str = "id", vector_col: str = "vector", parts: int | None = None) -> DataFrame:
    """(n, layers, graph): a graph over each run of at most GRAPH_ROWS rows of a partition. Write it, to search it often.

    More than GRAPH_ROWS rows are dealt to as many partitions as there are cores or graphs, whichever is more; ``parts`` asks
    for that many instead of the cores.
    """
    metric, options = Metric(metric), options or GraphOptions()
    ship_package(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _parts(batches):
            graph = Graph(v, metric, options)
            packed = io.BytesIO()
            single = v.astype(np.float32)
            np.savez(packed, ids=ids, raw=single if np.array_equal(single, v) else v, **graph.arrays())
            yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([graph.top + 1], pa.int32()), pa.array([packed.getvalue()], pa.binary())], names=["n", "layers", "graph"])

    source = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint"), vector_col)
    least = -(-source.count() // GRAPH_ROWS)
    if parts or least > 1:  # a graph costs more than its rows, so every core gets one
        source = source.repartition(max(parts or vectors.sparkSession.sparkContext.defaultParallelism, least))
    return source.mapInArrow(run, "n bigint, layers int, graph binary")


def _with_deleted(graphs: DataFrame, deleted: DataFrame) -> DataFrame:
    """(graph, gone): the ids of ``deleted`` that a graph holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, packed in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.load(io.BytesIO(packed.as_py()))["ids"]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(ids), pa.string()), pa.array(ids, pa.int64())], names=["part", "id"])

    named = graphs.select(F.sha2("graph", 256).alias("part"), "graph")
    gone = named.mapInArrow(run, "part string, id bigint").join(deleted.select("id"), "id", "left_semi")
    return named.join(gone.groupBy("part").agg(F.collect_list("id").alias("gone")), "part", "left").select("graph", "gone")


def search_built(
    graphs: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE, options: GraphOptions | None = None,
    ef_search: int | None = None, qid_col: str = "qid", qvec_col: str = "qvec", deleted: DataFrame | None = None,
) -> DataFrame:
    """(qid, rank, id, distance): hits of the graphs of build_graphs(), merged. ``options`` give ef_search by default.

    Nodes whose id ``deleted`` has lead a walk on, but are no candidates. A walk with as many candidates as a graph has nodes
    reaches them all, so there the graph's vectors are compared one after the other.
    """
    metric, options = Metric(metric), options or GraphOptions()
    if ef_search is not None and ef_search < 1:
        raise ValueError("ef_search must be at least 1")
    spark = graphs.sparkSession
    ship_package(spark)
    asked = queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).cast("array<double>").alias("qvec"))
    schema = T.StructType([asked.schema["qid"], T.StructField("id", T.LongType()), T.StructField("distance", T.DoubleType())])
    ef = max(ef_search or options.ef_search, k)
    source = graphs.select("graph", F.lit(None).cast("array<bigint>").alias("gone")) if deleted is None else _with_deleted(graphs, deleted)
    out: DataFrame | None = None
    for qids, block in query_blocks(asked, "auto"):

        def run(batches: Iterator[pa.RecordBatch], qids=qids, block=block) -> Iterator[pa.RecordBatch]:
            best = Nearest(block, k, metric)
            for batch in batches:
                for packed, gone in zip(batch.column(0), batch.column(1), strict=True):
                    data = dict(np.load(io.BytesIO(packed.as_py())))
                    ids, raw = data["ids"], data["raw"]
                    live = ~np.isin(ids, gone.values.to_numpy()) if gone.is_valid else np.ones(len(ids), bool)
                    if ef >= live.sum():
                        best.add(raw[live], ids[live])
                        continue
                    graph = Graph.from_arrays(data, metric, options)
                    near = [graph.search(q, k, ef, live) for q in block]
                    best.pairs(raw, ids, np.concatenate(near).astype(int), np.repeat(np.arange(len(near)), [len(x) for x in near]))
            yield from hits_batch(best, pa.array(qids), to_arrow_schema(schema))

        hits = source.mapInArrow(run, schema)
        out = hits if out is None else out.unionByName(hits)
    return top_k(spark.createDataFrame([], schema) if out is None else out, k).select("qid", "rank", "id", "distance")


def search_graphs(
    vectors: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE, options: GraphOptions | None = None,
    ef_search: int | None = None, id_col: str = "id", vector_col: str = "vector", qid_col: str = "qid", qvec_col: str = "qvec",
) -> DataFrame:
    """(qid, rank, id, distance): graphs built for this search alone; write those of build_graphs() to search more than once."""
    return search_built(build_graphs(vectors, metric, options, id_col, vector_col), queries, k, metric, options, ef_search, qid_col, qvec_col)
