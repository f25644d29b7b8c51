"""The service's requests and responses as plain functions, and a client over them.

Any HTTP framework can carry these: a request is a mapping, a response too, and ServiceError has the status code.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import SparkSession

from nearfield.sources.store import FREE, Config, QuantizerNotFitted, VectorStore

MAX_K = 1000


class ServiceError(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


def config_from_env(env: Mapping[str, str] = os.environ) -> tuple[str, Config]:
    """The store's folder and configuration from VDB_DATA_DIR, VDB_DIM, VDB_METRIC, VDB_QUANTIZE, VDB_M and both VDB_EF_..."""
    quantize = env.get("VDB_QUANTIZE", "").lower() in ("1", "true", "yes")
    number = lambda name, default: int(env.get(name, default))
    config = Config(number("VDB_DIM", 128), env.get("VDB_METRIC", "cosine"), quantize, m=number("VDB_M", 16), ef_construction=number("VDB_EF_CONSTRUCTION", 200), ef_search=number("VDB_EF_SEARCH", 50))
    return env.get("VDB_DATA_DIR", "data"), config


def _checked(request: Mapping[str, Any], *names: str) -> Mapping[str, Any]:
    if unknown := request.keys() - set(names):
        raise ServiceError(422, f"unknown fields {sorted(unknown)}")
    return request


class Service:
    """Requests against one store."""

    def __init__(self, store: VectorStore):
        self.store = store

    @classmethod
    def from_env(cls, spark: SparkSession, env: Mapping[str, str] = os.environ) -> Service:
        return cls(VectorStore(spark, *config_from_env(env)))

    def _vector(self, v: Any, what: str = "vector") -> list[float]:
        if not isinstance(v, Sequence) or isinstance(v, str) or not v or not all(isinstance(x, (int, float)) for x in v):
            raise ServiceError(422, f"{what} must be a list of numbers that isn't empty")
        if len(v) != self.store.config.dim:
            raise ServiceError(400, f"{what} must be of dimension {self.store.config.dim}")
        return [float(x) for x in v]

    def _write(self, vectors: list[list[float]], metadata: list[Mapping[str, Any]]) -> list[int]:
        try:
            return self.store.insert_batch(vectors, metadata)
        except QuantizerNotFitted as e:
            raise ServiceError(409, str(e)) from e
        except ValueError as e:
            raise ServiceError(400, str(e)) from e

    def insert(self, request: Mapping[str, Any]) -> dict[str, Any]:
        _checked(request, "vector", "metadata")
        return {"id": self._write([self._vector(request.get("vector"))], [request.get("metadata") or {}])[0]}

    def insert_batch(self, request: Mapping[str, Any]) -> dict[str, Any]:
        _checked(request, "vectors", "metadatas")
        vectors = [self._vector(v) for v in request.get("vectors") or []]
        metadata = request.get("metadatas") or [{} for _ in vectors]
        return {"ids": self._write(vectors, list(metadata))}

    def search(self, request: Mapping[str, Any]) -> dict[str, Any]:
        """vector, k (1 to MAX_K, 10 by default), and filter; hits with id, distance and metadata, and the time it took."""
        _checked(request, "vector", "k", "ef_search", "filter")
        query, k = self._vector(request.get("vector")), request.get("k", 10)
        if not isinstance(k, int) or not 1 <= k <= MAX_K:
            raise ServiceError(422, f"k must be from 1 to {MAX_K}")
        ef = request.get("ef_search")
        if ef is not None and (not isinstance(ef, int) or ef < 1):
            raise ServiceError(422, "ef_search must be at least 1")
        began = time.perf_counter()
        names = list(self.store.config.metadata)
        try:
            hits = self.store.search(query, k, request.get("filter") or None, ef_search=ef).orderBy("rank").collect()  # k hits
        except ValueError as e:
            raise ServiceError(400, str(e)) from e
        results = [{"id": r["id"], "distance": r["distance"], "metadata": {c: r[c] for c in names if r[c] is not None} | json.loads(r[FREE] or "{}")} for r in hits]
        return {"results": results, "query_time_ms": (time.perf_counter() - began) * 1000}

    def delete(self, id: int) -> dict[str, Any]:
        return {"id": id, "deleted": self.store.delete(id)[0]}

    def compact(self) -> dict[str, Any]:
        self.store.compact()
        return self.store.stats()

    def health(self) -> dict[str, Any]:
        return {"status": "ok", "stats": self.store.stats()}

    def fit_quantizer(self, request: Mapping[str, Any]) -> dict[str, Any]:
        _checked(request, "vectors", "metadatas")
        if not self.store.config.quantize:
            raise ServiceError(400, "the store isn't quantised")
        vectors = [self._vector(v) for v in request.get("vectors") or []]
        if not vectors:
            raise ServiceError(422, "vectors must not be empty")
        self.store.fit_quantizer(self.store.spark.createDataFrame([(v,) for v in vectors], "vector array<float>"))
        return {"fitted_on": len(vectors)}

    def close(self) -> None:
        self.store.close()


class Client:
    """The service as methods; requests that it refuses raise ServiceError."""

    def __init__(self, service: Service):
        self.service = service

    def insert(self, vector: Sequence[float], metadata: Mapping[str, Any] | None = None) -> int:
        return self.service.insert({"vector": list(vector), "metadata": metadata})["id"]

    def insert_batch(self, vectors: Sequence[Sequence[float]], metadata: Sequence[Mapping[str, Any]] | None = None) -> list[int]:
        return self.service.insert_batch({"vectors": [list(v) for v in vectors], "metadatas": None if metadata is None else list(metadata)})["ids"]

    def search(self, vector: Sequence[float], k: int = 10, ef_search: int | None = None, filter: Mapping[str, Any] | None = None) -> list[dict[str, Any]]:
        return self.service.search({"vector": list(vector), "k": k, "ef_search": ef_search, "filter": filter})["results"]

    def delete(self, id: int) -> bool:
        return self.service.delete(id)["deleted"]

    def compact(self) -> dict[str, Any]:
        return self.service.compact()

    def health(self) -> dict[str, Any]:
        return self.service.health()
