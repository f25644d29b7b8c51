"""Near-duplicate embeddings by p-stable hashing for Euclidean distance.

Unit vectors are projected on Gaussian directions, shifted and quantised with a bucket width; several such values make the
key of one table. Vectors of one label that share a key in some table meet in bounded groups, where their exact cosine is
checked. Equal vectors are collapsed first, each pair counts in the first table in which it meets, and a group reports sums
and spanning links instead of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm._blocks import binary_matrix, groups, regrouped, roots, shared_buckets
from nearfield.llm._common import checkpointed, mix, read, small_batches
from nearfield.llm._graph import components

#: Tables, values in a key, and bucket width. Unit vectors at cosine 0.93 are 0.374 apart and agree in a value with
#: probability 0.85, so that 1 - (1 - 0.85^10)^24 = 0.99 of such pairs meet; unrelated ones (distance 1.4) agree with 0.49.
TABLES, VALUES, WIDTH = 24, 10, 2.0


@lru_cache(8)
def _projections(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([20, dim])
    odd = rng.integers(0, 1 << 63, (TABLES, VALUES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return rng.standard_normal((dim, TABLES * VALUES)), rng.uniform(0, WIDTH, TABLES * VALUES), odd


def table_keys(unit: np.ndarray) -> np.ndarray:
    """64-bit keys (vectors x tables) of unit vectors."""
    directions, shift, odd = _projections(unit.shape[1])
    q = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), TABLES, VALUES)
    return mix((mix(q + np.uint64(97)) * odd).sum(2, dtype=np.uint64) + np.arange(TABLES, dtype=np.uint64))


def _units(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # keeps very large and very small components in range
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, embedding) to (id, key, lab, vec, keys) of the vectors that can link."""
    for batch in batches:
        ids, labels, column = batch.columns
        wide = pa.types.is_float64(column.type.value_type)
        kind = np.float64 if wide else np.float32
        values = column.flatten()
        sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        flat = values.to_numpy(zero_copy_only=False).astype(kind)  # null components become NaN
        starts = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == dim)
            v = flat[starts[rows][:, None] + np.arange(dim)]
            ok = np.isfinite(v).all(1) & (v != 0).any(1)
            rows, v = rows[ok], v[ok] + kind(0)  # -0 becomes 0
            if not len(rows):
                continue
            keys = table_keys(_units(v))
            own = labels.take(pa.array(rows))
            coded = own.dictionary_encode()
            tags = np.array([xxhash.xxh64_intdigest(f"{dim} {lab!r}") for lab in coded.dictionary.to_pylist()], np.uint64)
            keys = mix(keys ^ tags[coded.indices.to_numpy()][:, None]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), own, pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                names=["id", "lab", "vec", "bits", "keys"],
            )


def _compare(threshold: float, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups to (node, links, root): weighted links counted in this group, and a node of the same component."""
        for batch, starts in groups(batches):
            node, copies, blk = (batch.column(c).to_numpy() for c in ("node", "copies", "blk"))
            x, y, bucket = (batch.column(c).to_numpy() for c in ("x", "y", "bucket"))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(starts.tolist(), np.append(starts[1:], batch.num_rows).tolist(), strict=True):
                if b - a < 2:
                    continue
                unit = _units(binary_matrix(batch.column("vec"), a, b, "<f8" if wide else "<f4"))
                linked = unit @ unit.T >= threshold
                np.fill_diagonal(linked, False)
                if x[a] != y[a]:
                    linked &= blk[a:b, None] != blk[None, a:b]
                i, j = np.nonzero(linked)
                if not len(i):
                    continue
                keys = binary_matrix(batch.column("bits"), a, b, "<i8")
                counts = np.zeros(b - a, np.int64)
                for s in range(0, len(i), 1 << 16):
                    p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    first = (keys[p] == keys[q]).argmax(1)
                    here = keys[p, first] == bucket[a]
                    counts += np.bincount(p[here], copies[a:b][q[here]], b - a).astype(np.int64)
                some = linked.any(1)
                out.append((node[a:b][some], counts[some], roots(linked, node[a:b])[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in range(3)], names=["node", "links", "root"])

    return run


def link(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per input row: its id, n_links, component_id, kept.

    Vectors link when labels are equal and not null and their cosine is at least ``threshold``. Vectors that are null,
    zero, or hold null or non-finite components, and rows without an id, link with nothing. Rows that repeat an id with
    the same vector are one vector; vectors of other sizes have no cosine. Ids are cast to bigint.
    """
    small_batches(df.sparkSession)
    id_type = df.schema[vec_id].dataType
    wide = df.schema[embedding].dataType.elementType.typeName() == "double"
    rows = df.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).alias("lab"), F.col(embedding).alias("embedding"))
    lab = df.schema[label].dataType.simpleString()
    valid = rows.mapInArrow(_encode, f"id bigint, lab {lab}, vec binary, bits binary, keys array<bigint>")
    valid = valid.withColumn("same", F.md5(F.concat(F.col("lab").cast("string").cast("binary"), F.lit(b"\0"), F.col("vec"))))
    members = checkpointed(valid.dropDuplicates(["id", "same"]))
    nodes = checkpointed(members.groupBy("same").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("vec").alias("vec"), F.first("bits").alias("bits"), F.first("keys").alias("keys")))
    keys = nodes.select("node", F.explode("keys").alias("bucket"))
    met = shared_buckets(keys, "node").join(nodes.select("node", "copies", "vec", "bits"), "node")
    found = checkpointed(regrouped(met.select("bucket", "x", "y", "blk", "node", "copies", "vec", "bits")).mapInArrow(_compare(threshold, wide), "node bigint, links bigint, root bigint"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    # an id with several vectors joins their components
    split = members.groupBy("id").agg(F.min("same").alias("s"), F.max("same").alias("t")).where("s <> t").select("id")
    tied = members.join(split, "id").join(nodes.select("same", "node"), "same").select(F.col("id").alias("a"), F.col("node").alias("b"))
    labelled = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(tied))
    nodes = nodes.select("same", "node", "copies").join(counts, "node", "left").join(labelled, "node", "left")
    nodes = nodes.select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    by_id = members.select("id", "same").join(nodes, "same").groupBy(F.col("id").alias("_id")).agg(F.sum("n").alias("_n"), F.min("c").alias("_c"))
    out = df.select(vec_id).join(by_id, F.col(vec_id).cast("bigint") == F.col("_id"), "left")
    component = F.coalesce(F.col("_c").cast(id_type), F.col(vec_id))
    return out.select(vec_id, F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col(vec_id).eqNullSafe(component).alias("kept"))


def op10_embedding_links(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every embedding, linked at cosine 0.93 within labels.

    Null ids, labels and vectors, zero vectors and those with null or non-finite components link with nothing; rows that
    repeat an id with its vector are one; an empty table gives no rows.
    """
    return link(read(spark, sf_dir, "embeddings"), threshold=0.93)


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda t: t IS NULL OR NOT isfinite(t))) = 0 AND len(list_filter(embedding, lambda t: t <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.93
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = e.vec_id), e.vec_id)) AS kept
FROM embeddings e
"""
