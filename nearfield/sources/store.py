"""A durable collection of vectors: an operation log, snapshots, and a manifest that says which of both count.

Every batch of operations is a Parquet folder of the log, named by its first sequence number, and is written before it
counts: each commit writes a new manifest, under a temporary name first, that lists the committed folders, and the manifest
with the highest number holds. Readers keep to the manifest that they read, so writing, compacting and publishing a new
version don't disturb them. One writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.distance import Metric
from nearfield.operators import ann
from nearfield.operators import knn as exact
from nearfield.operators.filters import compile_filter, typed_fields, variant_fields
from nearfield.operators.quantize import MARGIN, Quantizer, clip_stats
from nearfield.operators.quantize import fit as fit_quantizer
from nearfield.sources import oplog
from nearfield.sources.files import Files

#: Ids that one task numbers, about.
NUMBER_ROWS = 100_000
#: Column of the metadata that a store's configuration doesn't declare, as JSON; filters see its keys as fields.
FREE = "_free"


class QuantizerNotFitted(RuntimeError):
    """A quantised store was written to before its quantizer was fitted."""


@dataclass(frozen=True)
class Config:
    dim: int
    metric: str = Metric.COSINE.value
    quantize: bool = False
    #: Writes after which a snapshot is taken.
    snapshot_every: int = 1000
    #: Spark types of metadata columns by name.
    metadata: dict[str, str] = field(default_factory=dict)
    #: Of graphs: links of a node, candidates while building and by default while searching, seed of the levels.
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    seed: int = 42

    def __post_init__(self) -> None:
        if self.dim < 1:
            raise ValueError("dim must be at least 1")
        Metric(self.metric)
        if FREE in self.metadata:
            raise ValueError(f"{FREE} is the column of undeclared metadata")
        self.graph  # noqa: B018

    @property
    def graph(self) -> ann.GraphOptions:
        return ann.GraphOptions(self.m, self.ef_construction, self.ef_search, self.seed)


class VectorStore:
    """Open or create the store at ``path``; a configuration that differs from the stored one is refused."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.files = spark, Files(spark, path)
        if self._current():
            self._load()
            if config is not None and config != self.config:
                raise ValueError(f"the store has another configuration: {self.config}")
        elif config is None:
            raise ValueError("a new store needs a configuration")
        else:
            self.config = config
            self.manifest: dict[str, Any] = {"version": 0, "next_seq": 0, "next_id": 0, "writes": 0, "snapshot": None, "snapshot_seq": -1, "log": [], "quantizer": None, "index": None, "config": asdict(config)}
            self._publish()

    def __enter__(self) -> VectorStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _current(self) -> str | None:
        return max((n for n in self.files.list("manifests") if n.endswith(".json")), default=None)

    def _load(self) -> None:
        self.manifest = json.loads(self.files.read_text(f"manifests/{self._current()}"))
        self.config = Config(**self.manifest["config"])

    def refresh(self) -> None:
        """Take up what another writer has published."""
        self._load()

    def _publish(self) -> None:
        """Write the manifest under the next number."""
        self.manifest["version"] += 1
        self.files.write_text(f"manifests/{self.manifest['version']:012d}.json", json.dumps(self.manifest))

    # ---- schemas

    @property
    def quantizer(self) -> Quantizer | None:
        q = self.manifest["quantizer"]
        return Quantizer(tuple(q["low"]), tuple(q["scale"])) if q else None

    @property
    def _stored(self) -> str:
        return "array<smallint>" if self.config.quantize else "array<float>"

    @property
    def _fields(self) -> list[str]:
        return ["vector", *self.config.metadata, FREE]

    @property
    def _kept(self) -> list[str]:
        return [*self.config.metadata, FREE]

    def where(self, spec: Mapping[str, Any] | Column | None) -> Column | None:
        """The predicate of a filter over declared metadata (columns) and undeclared (keys of JSON)."""
        if spec is None or isinstance(spec, Column):
            return spec
        own = typed_fields(T._parse_datatype_string(", ".join(f"`{c}` {t}" for c, t in self.config.metadata.items())) if self.config.metadata else T.StructType())
        free = variant_fields(F.parse_json(FREE))
        return compile_filter(spec, lambda name, operand: (own if name in self.config.metadata else free)(name, operand))

    def _log_schema(self) -> T.StructType:
        columns = ["seq bigint", "ts double", "op string", "id bigint", f"vector {self._stored}", *(f"`{c}` {t}" for c, t in self.config.metadata.items()), f"`{FREE}` string"]
        return T._parse_datatype_string(", ".join(columns))

    # ---- writing

    def fit_quantizer(self, sample: DataFrame, vector_col: str = "vector", margin: float = MARGIN) -> Quantizer:
        """Fit on a sample; only for a quantised store that holds nothing yet."""
        if not self.config.quantize:
            raise ValueError("the store isn't quantised")
        if self.manifest["next_seq"]:
            raise ValueError("the store holds codes of another quantizer; compact(refit=True) changes it")
        fitted = fit_quantizer(sample, vector_col, margin)
        if fitted.dim != self.config.dim:
            raise ValueError(f"vectors aren't of dimension {self.config.dim}")
        self.manifest["quantizer"] = asdict(fitted)
        self._publish()
        return fitted

    def _append(self, rows: DataFrame, count: int) -> None:
        """Write one folder of the log and commit it."""
        folder = f"log/{self.manifest['next_seq']:018d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(self.files.at(folder))
        self.manifest["log"].append(folder)
        self.manifest["next_seq"] += count
        self.manifest["writes"] += count
        self._publish()
        if self.manifest["writes"] >= self.config.snapshot_every:
            self.snapshot()

    def insert(self, vector: Sequence[float], metadata: Mapping[str, Any] | None = None) -> int:
        return self.insert_batch([vector], [metadata or {}])[0]

    def insert_batch(self, vectors: Sequence[Sequence[float]], metadata: Sequence[Mapping[str, Any]] | None = None) -> list[int]:
        """Insert vectors with metadata of the same number; their new ids. Keys that aren't declared are kept as JSON."""
        metadata = [{} for _ in vectors] if metadata is None else metadata
        if len(metadata) != len(vectors):
            raise ValueError(f"{len(vectors)} vectors, but metadata for {len(metadata)}")
        names = list(self.config.metadata)
        for v in vectors:
            if len(v) != self.config.dim:
                raise ValueError(f"vectors aren't of dimension {self.config.dim}")
        if not vectors:
            return []
        schema = ", ".join(["_at bigint", "vector array<float>", *(f"`{c}` {t}" for c, t in self.config.metadata.items()), f"`{FREE}` string"])
        first = self.manifest["next_id"]
        free = [json.dumps(rest) if (rest := {c: x for c, x in (m or {}).items() if c not in names}) else None for m in metadata]
        rows = [(i, [float(x) for x in v], *((m or {}).get(c) for c in names), f) for i, (v, m, f) in enumerate(zip(vectors, metadata, free, strict=True))]
        df = self.spark.createDataFrame(rows, schema).withColumn("id", F.col("_at") + first)
        self._insert(df.withColumn("_n", F.col("_at")), len(rows))
        return list(range(first, first + len(rows)))

    def insert_frame(self, df: DataFrame, vector_col: str = "vector", order_col: str | None = None) -> tuple[int, int]:
        """Insert all rows of a DataFrame; (first id, past the last). Ids are dense, by ``order_col`` or in no set order.

        Metadata columns that ``df`` lacks are null; a string column ``_free`` has undeclared metadata as JSON. Null vectors and
        other dimensions raise.
        """
        rows = df.select(
            F.col(vector_col).cast("array<float>").alias("vector"), *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in {**self.config.metadata, FREE: "string"}.items()),
            (F.col(order_col) if order_col else F.xxhash64(vector_col)).alias("_o"),
        )
        n, bad = rows.agg(F.count("*"), F.count_if(F.coalesce(F.size("vector") != self.config.dim, F.lit(True)) | F.exists("vector", lambda x: x.isNull()))).first()
        if bad:
            raise ValueError(f"{bad} vectors aren't of dimension {self.config.dim}")
        if not n:
            return self.manifest["next_id"], self.manifest["next_id"]
        parts = max(1, -(-n // NUMBER_ROWS))
        rows = rows.repartitionByRange(parts, "_o").sortWithinPartitions("_o").withColumn("_p", F.spark_partition_id())
        temp = self.files.at(f"staged/{uuid.uuid4().hex}")
        rows.write.parquet(temp)  # range partitions depend on a sample, so they are fixed before ids are
        rows = self.spark.read.schema(rows.schema).parquet(temp)
        sizes = rows.groupBy("_p").agg(F.count("*").alias("_c"))
        starts = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
        place = F.row_number().over(Window.partitionBy("_p").orderBy("_o")) - 1
        numbered = rows.withColumn("_place", place).join(starts, "_p").withColumn("_n", (F.col("_before") + F.col("_place")).cast("bigint"))
        first = self.manifest["next_id"]
        self._insert(numbered.withColumn("id", F.col("_n") + first), n)
        self.files.delete(f"staged/{temp.rsplit('/', 1)[1]}")
        return first, first + n

    def _insert(self, df: DataFrame, n: int) -> None:
        vector = F.col("vector")
        if self.config.quantize:
            if self.quantizer is None:
                raise QuantizerNotFitted("fit the quantizer before inserting")
            vector = self.quantizer.encode(vector)
        rows = df.select(
            (F.col("_n") + self.manifest["next_seq"]).cast("bigint").alias("seq"), F.lit(time.time()).alias("ts"), F.lit("insert").alias("op"),
            F.col("id").cast("bigint").alias("id"), vector.cast(self._stored).alias("vector"), *self._kept,
        )
        self.manifest["next_id"] += n
        self._append(rows, n)

    def delete(self, *ids: int) -> list[bool]:
        """Delete ids; whether each was there and live (False the second time)."""
        there = {r[0] for r in self.live().where(F.col("id").isin(list(ids))).select("id").collect()}
        out, seen = [], set()
        for i in ids:
            out.append(i in there and i not in seen)
            seen.add(i)
        gone = sorted(there)
        if gone:
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._log_schema() if f.name not in ("seq", "ts", "op", "id")]
            rows = self.spark.createDataFrame([(self.manifest["next_seq"] + k, i) for k, i in enumerate(gone)], "seq bigint, id bigint")
            self._append(rows.select("seq", F.lit(time.time()).alias("ts"), F.lit("delete").alias("op"), "id", *nothing), len(gone))
        return out

    def delete_frame(self, ids: DataFrame, id_col: str = "id") -> int:
        """Delete all ids of a DataFrame that are live; how many were."""
        gone = self.live().select("id").join(ids.select(F.col(id_col).cast("bigint").alias("id")).distinct(), "id", "left_semi")
        numbered = dense_ids(gone).select((F.col("new_id") + self.manifest["next_seq"]).alias("seq"), F.col("old_id").alias("id"))
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._log_schema() if f.name not in ("seq", "ts", "op", "id")]
        n = gone.count()
        if n:
            self._append(numbered.select("seq", F.lit(time.time()).alias("ts"), F.lit("delete").alias("op"), "id", *nothing), n)
        return n

    # ---- reading

    def _log(self) -> DataFrame:
        schema = self._log_schema()
        folders = [self.files.at(f) for f in self.manifest["log"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _snapshot(self) -> DataFrame | None:
        return self.spark.read.parquet(self.files.at(self.manifest["snapshot"])) if self.manifest["snapshot"] else None

    def rows(self) -> DataFrame:
        """(id, vector or codes, metadata, deleted) of every id, deleted ones too."""
        snapshot = self._snapshot()
        if snapshot is not None and not self.manifest["log"]:
            return snapshot
        return oplog.replay(self._log(), snapshot, self._fields)

    def live(self) -> DataFrame:
        snapshot = self._snapshot()
        if snapshot is not None and not self.manifest["log"]:
            return snapshot.where(~F.col("deleted")).drop("deleted")
        return oplog.live(self._log(), snapshot, self._fields)

    def vectors(self) -> DataFrame:
        """live() with decoded vectors."""
        q = self.quantizer
        return self.live().withColumn("vector", q.decode(F.col("vector"))) if self.config.quantize and q else self.live()

    def search(self, query: Sequence[float], k: int = 10, where: Mapping[str, Any] | Column | None = None, ef_search: int | None = None, nprobe: int | None = None) -> DataFrame:
        """(rank, id, distance, metadata) of the nearest live vectors; the query itself isn't quantised.

        Exact, unless ``ef_search`` or ``nprobe`` asks for the kept graphs or cells; without those, and with a filter, search
        stays exact.
        """
        if len(query) != self.config.dim:
            raise ValueError(f"the query isn't of dimension {self.config.dim}")
        if where is None and self._index_for(ef_search, nprobe):
            asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "qid bigint, qvec array<double>")
            hits = self.approximate(asked, k, ef_search, nprobe)
            ids = [r["id"] for r in hits.collect()]  # k hits
            rows = self.live().where(F.col("id").isin(ids)).select("id", *self._kept)
            return hits.join(rows, "id").select("rank", "id", "distance", *self._kept)
        return exact.search(self.vectors(), query, k, self.config.metric, self.where(where), keep=self._kept)

    def knn(self, queries: DataFrame, k: int = 10, where: Mapping[str, Any] | Column | None = None, plan: str = "auto") -> DataFrame:
        """(qid, rank, id, distance, metadata) for a DataFrame of queries (qid, qvec)."""
        q = self.quantizer
        decode = q.decode_matrix if self.config.quantize and q else None
        rows = self.vectors() if plan == "sql" else self.live()
        return exact.knn(rows, queries, k, self.config.metric, self.where(where), keep=self._kept, plan=plan, decode=None if plan == "sql" else decode)

    def stats(self) -> dict[str, Any]:
        total, deleted = self.rows().agg(F.count("*"), F.count_if("deleted")).first()
        c, index = self.config, self.manifest.get("index") or {}
        out = {"total": total, "live": total - deleted, "tombstoned": deleted, "dim": c.dim, "metric": c.metric, "version": self.manifest["version"], "quantized": c.quantize}
        out |= {"total_nodes": total, "live_nodes": total - deleted, "max_layer": index.get("layers", 0) - 1, "M": c.m, "ef_construction": c.ef_construction, "ef_search": c.ef_search, "index": index.get("kind")}
        if self.config.quantize and self.quantizer:
            out["quantizer"] = clip_stats(self.vectors(), self.quantizer).first().asDict()
        return out

    # ---- a kept index

    def build_graphs(self, parts: int | None = None) -> None:
        """Build navigable graphs over the live vectors and keep them; they hold until the next build, compaction or refit.

        ``parts`` is the number of partitions whose graphs are built side by side; there are more if graphs would hold more
        than ann.GRAPH_ROWS rows.
        """
        folder = f"indexes/{uuid.uuid4().hex}"
        ann.build_graphs(self.vectors(), self.config.metric, self.config.graph, parts=parts).write.parquet(self.files.at(folder))
        layers = self.spark.read.parquet(self.files.at(folder)).agg(F.max("layers")).first()[0]
        self._keep_index({"kind": "graphs", "folder": folder, "layers": layers or 0})

    def build_cells(self, cells: int) -> None:
        """Fit centroids, write the live vectors by cell, and keep both; a search reads the cells it probes only."""
        rows = self.vectors()
        fitted = ann.fit_cells(rows, cells, self.config.metric)
        folder = f"indexes/{uuid.uuid4().hex}"
        by_cell = ann.assign(rows.select("id", "vector"), fitted).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8)))
        by_cell.write.partitionBy("cell").parquet(self.files.at(folder))
        self._keep_index({"kind": "cells", "folder": folder, "centroids": fitted.centroids.tolist()})

    def _keep_index(self, index: dict[str, Any]) -> None:
        self.manifest["index"] = index | {"next_id": self.manifest["next_id"], "seq": self.manifest["next_seq"]}
        self._publish()

    def _index_for(self, ef_search: int | None, nprobe: int | None) -> bool:
        kind = (self.manifest.get("index") or {}).get("kind")
        return kind == "graphs" and ef_search is not None or kind == "cells" and nprobe is not None

    def approximate(self, queries: DataFrame, k: int = 10, ef_search: int | None = None, nprobe: int | None = None) -> DataFrame:
        """(qid, rank, id, distance) by the kept graphs or cells; vectors inserted since are searched exactly.

        Ids that were deleted since the index was built are no candidates.
        """
        index = self.manifest.get("index")
        if not index:
            raise ValueError("no index is kept; build_graphs() or build_cells()")
        later = self.manifest["log"] or self.manifest["next_seq"] > index["seq"]
        deleted = self.rows().where(F.col("deleted") & (F.col("id") < index["next_id"])).select("id") if later else None
        rows = self.spark.read.parquet(self.files.at(index["folder"]))
        if index["kind"] == "graphs":
            hits = ann.search_built(rows, queries, k, self.config.metric, self.config.graph, ef_search, deleted=deleted)
        else:
            cells = ann.Cells(Metric(self.config.metric), np.asarray(index["centroids"]))
            live = rows if deleted is None else rows.join(deleted, "id", "left_anti")
            hits = ann.search_cells(live, cells, queries, k, nprobe or max(1, len(cells.centroids) // 8))
        if later:
            new = exact.knn(self.vectors().where(F.col("id") >= index["next_id"]), queries, k, self.config.metric)
            hits = hits.select("qid", "id", "distance").unionByName(new.select("qid", "id", "distance"))
        return exact.top_k(hits.select("qid", "id", "distance"), k).select("qid", "rank", "id", "distance")

    # ---- snapshots

    def _write_snapshot(self, rows: DataFrame) -> None:
        """Publish ``rows`` as the snapshot of all operations so far; the log up to here no longer counts."""
        folder = f"snapshots/{self.manifest['next_seq']:018d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(self.files.at(folder))
        self.manifest |= {"snapshot": folder, "snapshot_seq": self.manifest["next_seq"] - 1, "log": [], "writes": 0}
        self._publish()

    def snapshot(self) -> None:
        """Fold the log into a new snapshot, deleted ids included. Old files stay until vacuum()."""
        self._write_snapshot(self.rows())

    def compact(self, renumber: bool = False, refit: bool = False) -> DataFrame | None:
        """Drop deleted rows. With ``renumber`` ids become 0, 1, ... in their order, and (old_id, new_id) is returned.

        ``refit`` fits the quantizer of a quantised store on the live vectors first; without live vectors it stays.
        """
        rows, mapping = self.live(), None
        if refit and self.config.quantize and self.quantizer and not rows.isEmpty():
            decoded = self.vectors()
            fitted = fit_quantizer(decoded)
            rows = decoded.withColumn("vector", fitted.encode(F.col("vector")))
            self.manifest["quantizer"] = asdict(fitted)
        if renumber:
            kept = f"mappings/{self.manifest['next_seq']:018d}-{uuid.uuid4().hex[:8]}"
            dense_ids(rows).write.parquet(self.files.at(kept))
            mapping = self.spark.read.parquet(self.files.at(kept))  # stays readable when the files it came from are gone
            rows = rows.join(mapping, F.col("id") == F.col("old_id")).drop("id", "old_id").withColumnRenamed("new_id", "id")
        rows = rows.select("id", *self._fields).withColumn("deleted", F.lit(False))
        if renumber:  # the counter is published with the snapshot, in one manifest
            self.manifest["next_id"] = mapping.count()
        self.manifest["index"] = None
        self._write_snapshot(rows)
        return mapping

    def vacuum(self) -> None:
        """Delete files that the manifest doesn't name. Readers of older manifests lose them."""
        used = {*self.manifest["log"], self.manifest["snapshot"], (self.manifest.get("index") or {}).get("folder")}
        for top in ("log", "snapshots", "indexes"):
            for name in self.files.list(top):
                if f"{top}/{name}" not in used:
                    self.files.delete(f"{top}/{name}")
        current = self._current()
        for name in self.files.list("manifests"):
            if name != current:
                self.files.delete(f"manifests/{name}")
        self.files.delete("staged")

    def close(self) -> None:
        """Take a snapshot if the log holds anything."""
        if self.manifest["log"]:
            self.snapshot()


def dense_ids(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """(old_id, new_id): ids numbered from 0 in their order, by counts of ranges of ids and ranks within them."""
    ids = rows.select(F.col(id_col).alias("old_id"))
    n, low, high = ids.agg(F.count("*"), F.min("old_id"), F.max("old_id")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // max(1, -(-n // NUMBER_ROWS))))
    ids = ids.withColumn("_r", F.floor((F.col("old_id") - F.lit(low or 0)) / width))
    sizes = ids.groupBy("_r").agg(F.count("*").alias("_c"))
    starts = sizes.select("_r", (F.sum("_c").over(Window.orderBy("_r")) - F.col("_c")).alias("_before"))  # one row for each range
    place = F.row_number().over(Window.partitionBy("_r").orderBy("old_id")) - 1
    return ids.withColumn("_place", place).join(starts, "_r").select("old_id", (F.col("_before") + F.col("_place")).cast("bigint").alias("new_id"))


