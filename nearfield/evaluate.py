"""Test data, recall, and sweeps of approximate search."""

from __future__ import annotations

import csv
import time
from collections.abc import Iterable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.distance import Metric
from nearfield.operators import ann
from nearfield.operators.knn import knn


def clustered(n: int, dim: int, clusters: int = 20, noise: float = 0.15, seed: int = 0) -> np.ndarray:
    """float32 vectors around standard normal centres."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    return (centres[rng.integers(0, clusters, n)] + noise * rng.standard_normal((n, dim))).astype(np.float32)


def normal_queries(n: int, dim: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)


def frame(spark: SparkSession, vectors: np.ndarray, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """A matrix as a DataFrame of ids from 0 and float arrays."""
    import pyarrow as pa

    table = pa.table({id_col: pa.array(np.arange(len(vectors), dtype=np.int64)), vector_col: pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))})
    return spark.createDataFrame(table)


def recall(truth: DataFrame, found: DataFrame, qid: str = "qid", hit: str = "id") -> DataFrame:
    """(qid, recall) of each query of ``truth``: the share of its hits that ``found`` has too."""
    both = truth.select(qid, hit).distinct().join(found.select(qid, hit).distinct().withColumn("_f", F.lit(1)), [qid, hit], "left")
    return both.groupBy(qid).agg((F.count("_f") / F.count("*")).alias("recall"))


def mean_recall(truth: DataFrame, found: DataFrame, qid: str = "qid", hit: str = "id") -> float:
    """Mean recall over queries; 1 if there is nothing to find."""
    value = recall(truth, found, qid, hit).agg(F.avg("recall")).first()[0]
    return 1.0 if value is None else float(value)


def sweep(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: Metric | str = Metric.COSINE, cells: int = 45, probes: Iterable[int] = (1, 2, 4, 8), m: Iterable[int] = (8, 16), ef: Iterable[int] = (10, 50, 200)) -> list[dict]:
    """A row for exact search, for each number of probed cells, and for each graph setting: recall, seconds, queries a second."""
    n = queries.count()
    rows: list[dict] = []

    def timed(name: str, **settings):
        def decorate(fn):
            start = time.perf_counter()
            found = fn()
            hits = found.sparkSession.createDataFrame(found.toArrow())
            seconds = time.perf_counter() - start
            rows.append({"method": name, "settings": str(settings), "recall": 1.0 if not rows else mean_recall(truth[0], hits), "seconds": seconds, "qps": n / seconds})
            return hits

        return decorate

    truth = [None]
    truth[0] = timed("exact", k=k)(lambda: knn(vectors, queries, k, metric))
    model = ann.fit_cells(vectors, cells, metric)
    assigned = ann.assign(vectors, model).cache()
    for p in probes:
        timed("cells", cells=cells, nprobe=p)(lambda p=p: ann.search_cells(assigned, model, queries, k, p))
    assigned.unpersist()
    for one in m:
        for e in ef:
            timed("graph", m=one, ef=e)(lambda one=one, e=e: ann.search_graphs(vectors, queries, k, metric, ann.GraphOptions(one), e))
    return rows


def write_csv(rows: list[dict], path: str | Path) -> None:
    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, fieldnames=list(rows[0]))
        out.writeheader()
        out.writerows(rows)
