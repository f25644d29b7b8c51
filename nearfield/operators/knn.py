"""Exact k-nearest-neighbour search.

The batch form takes a DataFrame of queries; a single query is a batch of one row. Hits are ordered by distance and then id,
so that results are the same in every run and plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nearfield.functions.distance import EPSILON, Metric, Screen, distance, distance_matrix, distance_pairs, norm, unrounded
from nearfield.operators.filters import compile_filter
from nearfield.plans import KnnPlan, choose
from nearfield.session import ship_package

#: Queries that make a block without further ado.
FEW_QUERIES = 1024
#: Dimensions up to which the column plan compares vectors component by component.
FLAT_DIMS = 128
#: Distances of rows and queries that a task holds at a time.
TILE = 1 << 20
#: From stored values (rows x dimensions) to vectors: what quantised search decodes with.
Decoder = Callable[[np.ndarray], np.ndarray]


def where_column(df: DataFrame, where: Mapping[str, Any] | Column | None) -> Column | None:
    return where if where is None or isinstance(where, Column) else compile_filter(where, df)


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column without nulls as a matrix; ValueError if lengths differ."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not len(column):
        return np.zeros((0, dim or 0))
    if len(flat) % len(column) or dim is not None and len(flat) != dim * len(column):
        raise ValueError(f"vectors aren't of dimension {dim}" if dim is not None else "vectors differ in dimension")
    return flat.reshape(len(column), -1)


class Nearest:
    """The ``k`` nearest rows of each query among all that were added, ties by id.

    Holds TILE distances at a time, and besides at most half as many hits more than ``k`` for each query, whatever the
    numbers of rows and queries. ``distances`` are computed only for pairs that a Screen lets through.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: Metric | str):
        self.queries, self.k, self.metric = queries.astype(np.float64, copy=False), k, Metric(metric)
        self.screen = Screen(metric, self.queries)
        self.limit = np.full(len(queries), np.nan)  # distance and id of the last of k hits
        self.last: np.ndarray | None = None
        self.hits: list[tuple[np.ndarray, ...]] = []  # (query, distance, id, row of the held columns)
        self.first, self.new = 0, 0  # hits after the last merge, and since
        self.held: list[pa.Table] = []

    def add(self, vectors: np.ndarray, ids: np.ndarray, rows: pa.Table | None = None, decode: Decoder | None = None, own: np.ndarray | None = None) -> None:
        """Rows, with columns to hold for those that are among some query's best; ``own``: only for these queries."""
        own = None if own is not None and len(own) == len(self.queries) else own
        screen = self.screen if own is None else self.screen.of(own)
        step = max(1, TILE // max(1, len(screen.squares)))
        for lo in range(0, len(ids), step):
            v = vectors[lo : lo + step]
            self._tile(screen, v if decode is None else decode(v), ids[lo : lo + step], None if rows is None else rows.slice(lo, step), own)

    def _tile(self, screen: Screen, v: np.ndarray, ids: np.ndarray, rows: pa.Table | None, own: np.ndarray | None) -> None:
        products, longest = screen.products(v)
        limit = self.limit if own is None else self.limit[own]
        limit = np.where(np.isnan(limit), np.inf, limit)
        near = ~(products > screen.limits(limit, longest))  # what can't be compared stays
        if len(ids) > self.k and np.count_nonzero(near) > 4 * self.k * near.shape[1]:
            bound = screen.farthest(np.partition(products, self.k - 1, axis=0)[self.k - 1], longest)
            near &= ~(products > screen.limits(np.fmin(limit, bound), longest))
        at, of = np.nonzero(near)
        self.pairs(v, ids, at, of if own is None else own[of], rows)

    def pairs(self, v: np.ndarray, ids: np.ndarray, at: np.ndarray, of: np.ndarray, rows: pa.Table | None = None) -> None:
        """Rows ``at`` as candidates of the queries ``of``."""
        if not len(at):
            return
        d, mine = distance_pairs(self.metric, v, self.queries, at, of), ids[at]
        if self.last is not None:
            within = ~((d > self.limit[of]) | (d == self.limit[of]) & (mine > self.last[of]))
            at, of, d, mine = at[within], of[within], d[within], mine[within]
            if not len(at):
                return
        row = at
        if rows is not None:
            used, row = np.unique(at, return_inverse=True)
            row = row + sum(t.num_rows for t in self.held)
            self.held.append(rows.take(pa.array(used)))
        self.hits.append((of, d, mine, row))
        self.new += len(of)
        if self.last is None or self.new > max(1 << 12, self.first // 2):
            self._merge()

    def _merge(self) -> None:
        of, d, own, row = (np.concatenate(x) for x in zip(*self.hits, strict=True))
        order = np.lexsort((own, d, of))
        place = of[order]
        starts = np.searchsorted(place, np.arange(len(self.queries)))
        order = order[np.arange(len(order)) - starts[place] < self.k]
        of, d, own, row = of[order], d[order], own[order], row[order]
        if self.held:
            used, row = np.unique(row, return_inverse=True)
            self.held = [pa.concat_tables(self.held).take(pa.array(used)).combine_chunks()]
        self.hits, self.first, self.new = [(of, d, own, row)], len(of), 0
        counts = np.bincount(of, minlength=len(self.queries))
        ends = np.cumsum(counts) - 1
        full = counts == self.k
        self.last = np.zeros(len(self.queries), own.dtype)
        self.limit[full], self.last[full] = d[ends[full]], own[ends[full]]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table | None]:
        """Queries by number, distances and ids of all hits, and their held columns."""
        if not self.hits:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), None
        self._merge()
        of, d, own, row = self.hits[0]
        return of, d, own, self.held[0].take(pa.array(row)) if self.held else None


def top_k(hits: DataFrame, k: int, by: Sequence[str] = ("qid",)) -> DataFrame:
    """The ``k`` nearest of each query, with their rank. Spark keeps ``k`` per query and task before it shuffles."""
    order = Window.partitionBy(*by).orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def id_type(df: DataFrame, id_col: str) -> T.DataType:
    """Text ids stay text and sort as it does; others are bigint."""
    kind = df.schema[id_col].dataType
    return kind if isinstance(kind, T.StringType) else T.LongType()


def hits_batch(nearest: Nearest, qids: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What Nearest found as (qid, id, distance, held columns)."""
    of, d, own, rows = nearest.found()
    if len(of):
        columns = [qids.take(pa.array(of)), pa.array(own, schema.types[1]), pa.array(d), *(rows.columns if rows is not None else ())]
        yield from pa.Table.from_arrays(columns, names=schema.names).combine_chunks().to_batches()


def _local_top_k(queries: np.ndarray, qids: list, k: int, metric: Metric, dim: int, decode: Decoder | None, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, vector, kept columns) to hits; only rows that are among some query's best so far are held."""
        best = Nearest(queries, k, metric)
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch]).drop_columns(batch.schema.names[:2]) if batch.num_columns > 2 else None
                best.add(matrix(batch.column(1), dim), batch.column(0).to_numpy(zero_copy_only=False), rows, decode)
        yield from hits_batch(best, pa.array(qids), to_arrow_schema(schema))

    return run


def knn(
    vectors: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE, where: Mapping[str, Any] | Column | None = None,
    id_col: str = "id", vector_col: str = "vector", qid_col: str = "qid", qvec_col: str = "qvec", keep: Sequence[str] = (),
    plan: str | KnnPlan = "auto", decode: Decoder | None = None,
) -> DataFrame:
    """(qid, rank, id, distance, ``keep``) of the ``k`` nearest vectors of every query, among rows that ``where`` accepts.

    The filter applies below the distances, so a query gets min(k, accepted rows) hits. Null vectors are never hits. The
    queries go to all tasks in blocks of bounded size; each block reads the vectors once. Only local top-k are shuffled.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    metric = Metric(metric)
    ship_package(vectors.sparkSession)
    test = where_column(vectors, where)
    rows = vectors if test is None else vectors.where(test)
    rows = rows.where(F.col(vector_col).isNotNull())
    asked = queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).cast("array<double>").alias("qvec"))
    if plan == "sql" or isinstance(plan, KnnPlan) and plan.kind == "sql":
        hits = _sql_hits(rows, asked, k, metric, id_col, vector_col, keep)
    else:
        hits = _arrow_hits(rows, asked, k, metric, id_col, vector_col, keep, plan, decode)
    return top_k(hits, k).select("qid", "rank", "id", "distance", *keep)


def _sql_hits(rows: DataFrame, asked: DataFrame, k: int, metric: Metric, id_col: str, vector_col: str, keep: Sequence[str]) -> DataFrame:
    """Distances as columns, query block by query block; the plan to read, and the one to compare others with.

    Every vector meets every query in a join. The ``k``-th hit among one in sqrt(n / k) vectors is a bound for each query:
    the join's condition leaves about k sqrt(n / k) pairs of a query at or before it, which are ranked by rounded distance.
    """
    v = rows.select(F.col(id_col).cast(id_type(rows, id_col)).alias("id"), F.col(vector_col).alias("_v"), norm(F.col(vector_col)).alias("_vn"), *keep)
    far = distance(metric, F.col("_v"), F.col("qvec"), F.col("_vn"), F.col("_qn")).alias("distance")
    share = 0
    out: DataFrame | None = None
    for qids, block in query_blocks(asked, "sql"):
        share = share or max(1, int((rows.count() / k) ** 0.5))
        local = rows.sparkSession.createDataFrame(pa.table({"qid": pa.array(qids), "qvec": pa.array(block.tolist(), pa.list_(pa.float64()))}))
        local = local.withColumn("_qn", norm(F.col("qvec")))
        some = v.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).crossJoin(F.broadcast(local))  # a block is bounded
        bound = top_k(some.select("qid", "id", far), k).where(F.col("rank") == k)
        bound = bound.select("qid", F.col("distance").alias("_d"), F.col("id").alias("_last"))
        local = local.join(bound, "qid", "left").withColumn("_to", F.col("_d") + 1e-9 + 1e-12 * F.abs("_d"))
        dim = block.shape[1]
        flat = dim <= FLAT_DIMS
        part = lambda c, i, name: F.coalesce(F.get(c, F.lit(i)).cast("double"), F.lit(float("nan"))).alias(f"{name}{i}")  # noqa: E731  # never null: shorter code
        left = v.select("*", *(part("_v", i, "_v") for i in range(dim))) if flat else v
        right = local.select("*", *(part("qvec", i, "_q") for i in range(dim))) if flat else local
        pairs = left.join(F.broadcast(right), F.col("_d").isNull() | (_raw(metric, dim if flat else 0) <= F.col("_to")))
        # exploded, so that the filter on it isn't pushed into the join, which would compute it for all pairs
        hits = pairs.select("qid", "id", F.explode(F.array(far)).alias("distance"), *keep, "_d", "_last")
        hits = hits.where(F.col("_d").isNull() | (F.col("distance") < F.col("_d")) | (F.col("distance") == F.col("_d")) & (F.col("id") <= F.col("_last"))).drop("_d", "_last")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        q = asked.limit(0)
        out = v.crossJoin(q).select("qid", "id", F.lit(0.0).alias("distance"), *keep)
    return out


def _raw(metric: Metric, dim: int) -> Column:
    """The distance of _v and qvec before rounding, from a column for each component if there are ``dim`` of them: compiled."""
    if not dim:
        return unrounded(metric, F.col("_v"), F.col("qvec"), F.col("_vn"), F.col("_qn"))
    apart = [F.col(f"_v{i}") - F.col(f"_q{i}") for i in range(dim)] if metric is Metric.EUCLIDEAN else []
    terms = [x * x for x in apart] or [F.col(f"_v{i}") * F.col(f"_q{i}") for i in range(dim)]
    while len(terms) > 1:  # a balanced tree
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) & ~1 :]  # noqa: B905
    if metric is Metric.EUCLIDEAN:
        return F.sqrt(terms[0])
    if metric is Metric.DOT:
        return -terms[0]
    return F.lit(1.0) - terms[0] / ((F.col("_vn") + EPSILON) * (F.col("_qn") + EPSILON))


def _arrow_hits(
    rows: DataFrame, asked: DataFrame, k: int, metric: Metric, id_col: str, vector_col: str, keep: Sequence[str], plan: str | KnnPlan, decode: Decoder | None
) -> DataFrame:
    spark = rows.sparkSession
    kept = rows.select(*keep).schema.fields if keep else []
    kind = id_type(rows, id_col)
    schema = T.StructType([asked.schema["qid"], T.StructField("id", kind), T.StructField("distance", T.DoubleType()), *kept])
    out: DataFrame | None = None
    source = rows.select(F.col(id_col).cast(kind).alias("_id"), F.col(vector_col).alias("_vector"), *keep)
    for qids, block in query_blocks(asked, plan):
        hits = source.mapInArrow(_local_top_k(block, qids, k, metric, block.shape[1], decode, schema), schema)
        out = hits if out is None else out.unionByName(hits)
    return spark.createDataFrame([], schema) if out is None else out


def query_blocks(asked: DataFrame, plan: str | KnnPlan) -> Iterator[tuple[list, np.ndarray]]:
    """The queries as (ids, matrix) blocks of bounded size, which travel with the plan. Null query vectors are left out."""
    asked = asked.where("qvec is not null")
    few = min(FEW_QUERIES, plan.query_rows) if isinstance(plan, KnnPlan) else FEW_QUERIES
    head = asked.limit(few + 1).toArrow()  # one job, if that is all
    if head.num_rows <= few:
        if head.num_rows:
            yield head.column("qid").to_pylist(), matrix(head.column("qvec").combine_chunks()).astype(np.float64)
        return
    first = asked.select(F.size("qvec")).first()
    if first is None:
        return
    chosen = choose(plan, first[0])
    blocks = max(1, -(-asked.count() // chosen.query_rows))
    for b in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)).toArrow()
        if part.num_rows:
            yield part.column("qid").to_pylist(), matrix(part.column("qvec").combine_chunks()).astype(np.float64)


def search(
    vectors: DataFrame, query: Sequence[float], k: int = 10, metric: Metric | str = Metric.COSINE, where: Mapping[str, Any] | Column | None = None,
    id_col: str = "id", vector_col: str = "vector", keep: Sequence[str] = (),
) -> DataFrame:
    """(rank, id, distance, ``keep``) of the ``k`` nearest vectors of one query: one scan with a bounded top-k in each task."""
    if k < 1:
        raise ValueError("k must be at least 1")
    test = where_column(vectors, where)
    rows = (vectors if test is None else vectors.where(test)).where(F.col(vector_col).isNotNull() & (F.size(vector_col) == len(query)))
    q = F.lit([float(x) for x in query])
    length = F.lit(float(np.sqrt(np.dot(query, query))))
    d = distance(metric, F.col(vector_col), q, None, length)
    hits = rows.select(F.col(id_col).cast("bigint").alias("id"), d.alias("distance"), *keep).orderBy("distance", "id").limit(k)
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))  # of k rows
    return ranked.select("rank", "id", "distance", *keep)


def pairwise(vectors: DataFrame, queries: DataFrame, metric: Metric | str, id_col: str = "id", vector_col: str = "vector", plan: str | KnnPlan = "auto") -> DataFrame:
    """(a, b, distance) of every vector ``a`` of ``queries`` and every vector ``b``: the whole matrix if both are the same."""
    metric = Metric(metric)
    ship_package(vectors.sparkSession)
    asked = queries.select(F.col(id_col).cast("bigint").alias("qid"), F.col(vector_col).cast("array<double>").alias("qvec"))
    source = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint"), vector_col)
    out: DataFrame | None = None
    for qids, block in query_blocks(asked, plan):

        def run(batches: Iterator[pa.RecordBatch], qids=qids, block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                step = max(1, (1 << 21) // max(1, len(qids)))
                for s in range(0, len(ids), step):
                    d = distance_matrix(metric, matrix(batch.column(1).slice(s, step), block.shape[1]), block)
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.asarray(qids, np.int64), len(d))), pa.array(np.repeat(ids[s : s + step], len(qids))), pa.array(d.ravel())], names=["a", "b", "distance"])

        found = source.mapInArrow(run, "a bigint, b bigint, distance double")
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], "a bigint, b bigint, distance double") if out is None else out


def _of_ids(vectors: DataFrame, ids: Sequence[int] | DataFrame, id_col: str) -> DataFrame:
    """The rows of a few given ids, or of those in a DataFrame's first column."""
    if isinstance(ids, DataFrame):
        return vectors.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")
    return vectors.where(F.col(id_col).isin(list(ids)))


def vector_by_id(vectors: DataFrame, ids: Sequence[int] | DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The vectors of given ids; an id that isn't there gives no row."""
    return _of_ids(vectors, ids, id_col).select(id_col, vector_col)


def distances_to(vectors: DataFrame, query: Sequence[float], ids: Sequence[int] | DataFrame, metric: Metric | str, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, distance) of the vectors of given ids to one query; no ids give no rows."""
    d = distance(metric, F.col(vector_col), F.lit([float(x) for x in query]))
    return _of_ids(vectors, ids, id_col).select(F.col(id_col).alias("id"), d.alias("distance"))


def live_count(vectors: DataFrame, deleted_col: str = "deleted") -> int:
    """Rows that aren't deleted."""
    return vectors.where(~F.col(deleted_col)).count()
