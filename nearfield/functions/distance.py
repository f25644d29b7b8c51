"""Distances between vectors, as Spark columns and as numpy kernels.

Both compute in double precision. Lower is nearer for every metric.
"""

from __future__ import annotations

from copy import copy
from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals that distances are rounded to: equal vectors tie, whatever order a kernel adds their products in.
DECIMALS = 10
#: Differences of components that a Euclidean kernel holds at a time, and components of pairs that are computed one by one.
DIFFERENCES = 1 << 18
#: Added to norms so that a zero vector is at cosine distance 1 of everything.
EPSILON = 1e-12


class Metric(str, Enum):
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"
    DOT = "dot"


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays of equal length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """1 - cosine; norms may be given where a column holds them."""
    a_norm = norm(a) if a_norm is None else a_norm
    b_norm = norm(b) if b_norm is None else b_norm
    return F.lit(1.0) - dot(a, b) / ((a_norm + EPSILON) * (b_norm + EPSILON))


def distance(metric: Metric | str, a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """Distance column for a metric or its name, to DECIMALS; ValueError for an unknown name."""
    return F.round(unrounded(metric, a, b, a_norm, b_norm), DECIMALS) + F.lit(0.0)


def unrounded(metric: Metric | str, a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    metric = Metric(metric)
    if metric is Metric.EUCLIDEAN:
        return euclidean(a, b)
    if metric is Metric.COSINE:
        return cosine(a, b, a_norm, b_norm)
    return -dot(a, b)


def distance_matrix(metric: Metric | str, vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances (vectors x queries). Euclidean ones go through differences, a bounded block at a time, which keeps near ones exact."""
    metric = Metric(metric)
    v, q = vectors.astype(np.float64, copy=False), queries.astype(np.float64, copy=False)
    if metric is Metric.EUCLIDEAN:
        step = max(1, DIFFERENCES // max(1, q.size))
        parts = [np.square(v[lo : lo + step, None, :] - q[None]).sum(2) for lo in range(0, len(v), step)]
        out = np.sqrt(np.concatenate(parts)) if parts else np.empty((0, len(q)))
    elif metric is Metric.DOT:
        out = -(v @ q.T)
    else:
        lengths = np.sqrt(np.einsum("ij,ij->i", v, v)) + EPSILON
        out = 1.0 - (v @ q.T) / (lengths[:, None] * (np.sqrt(np.einsum("ij,ij->i", q, q)) + EPSILON))
    return np.round(out, DECIMALS) + 0.0


def distance_pairs(metric: Metric | str, vectors: np.ndarray, queries: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Distances of pairs: of row ``at[i]`` of ``vectors`` and row ``of[i]`` of ``queries``, the same for a pair wherever it stands."""
    metric = Metric(metric)
    out = np.empty(len(at))
    step = max(1, DIFFERENCES // max(1, queries.shape[1]))
    for lo in range(0, len(at), step):
        v = vectors[at[lo : lo + step]].astype(np.float64, copy=False)
        q = queries[of[lo : lo + step]].astype(np.float64, copy=False)
        if metric is Metric.EUCLIDEAN:
            d = np.sqrt(np.square(v - q).sum(1))
        elif metric is Metric.DOT:
            d = -np.einsum("ij,ij->i", v, q)
        else:
            d = 1.0 - np.einsum("ij,ij->i", v, q) / ((np.sqrt(np.einsum("ij,ij->i", v, v)) + EPSILON) * (np.sqrt(np.einsum("ij,ij->i", q, q)) + EPSILON))
        out[lo : lo + step] = np.round(d, DECIMALS) + 0.0
    return out


class Screen:
    """Which pairs may lie within a distance: products of matrices, compared with limits that allow for their rounding.

    A product is a cosine distance less 1, a dot distance, or a squared Euclidean one less the query's squared length, give
    or take some units in the last place; distance_pairs() is for the pairs that are left.
    """

    def __init__(self, metric: Metric | str, queries: np.ndarray):
        self.metric = Metric(metric)
        q = queries.astype(np.float64, copy=False)
        self.squares = np.einsum("ij,ij->i", q, q)
        self.slack = 16.0 * (q.shape[1] + 8) * np.finfo(np.float64).eps
        if self.metric is Metric.COSINE:
            right = -q / (np.sqrt(self.squares) + EPSILON)[:, None]
        elif self.metric is Metric.EUCLIDEAN:
            right = np.hstack([-2.0 * q, np.ones((len(q), 1))])
        else:
            right = -q
        self.right = np.ascontiguousarray(right.T)

    def products(self, vectors: np.ndarray) -> tuple[np.ndarray, float]:
        """Products (vectors x queries), and the largest squared length of the vectors."""
        v = vectors.astype(np.float64, copy=False)
        squares = np.einsum("ij,ij->i", v, v)
        if self.metric is Metric.COSINE:
            v = v / (np.sqrt(squares) + EPSILON)[:, None]
        elif self.metric is Metric.EUCLIDEAN:
            v = np.hstack([v, squares[:, None]])
        return v @ self.right, float(squares.max(initial=0.0))

    def of(self, own: np.ndarray) -> Screen:
        """The same for some of the queries."""
        out = copy(self)
        out.squares, out.right = self.squares[own], self.right[:, own]
        return out

    def _error(self, longest: float) -> np.ndarray | float:
        """What a product may be off by."""
        if self.metric is Metric.COSINE:
            return self.slack
        return self.slack * (self.squares + longest)

    def limits(self, distances: np.ndarray, longest: float) -> np.ndarray:
        """What no product of a pair within ``distances`` (one for each query) exceeds."""
        d = distances + 10.0**-DECIMALS + self.slack * np.abs(distances)
        if self.metric is Metric.COSINE:
            d = d - 1.0
        elif self.metric is Metric.EUCLIDEAN:
            d = d * d - self.squares
        return d + self._error(longest)

    def farthest(self, products: np.ndarray, longest: float) -> np.ndarray:
        """What no distance of a pair exceeds whose product is at most ``products``."""
        p = products + self._error(longest)
        if self.metric is Metric.COSINE:
            p = p + 1.0
        elif self.metric is Metric.EUCLIDEAN:
            p = np.sqrt(np.maximum(p + self.squares, 0.0))
        return p + 10.0**-DECIMALS + self.slack * np.abs(p)
