"""Candidates that share a bucket, compared in bounded groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a bucket that one group holds at most, about; larger buckets are split into blocks and compared block by block.
BLOCK = 1024


#: Parts that the members of a bucket are dealt to while its size is looked up and it is split.
SALTS = 8


def with_sizes(keys: DataFrame, node: str, size: str) -> DataFrame:
    """The ``keys`` (bucket, node) whose bucket has other members, with their number; a common bucket goes to SALTS tasks."""
    sizes = keys.groupBy("bucket").agg(F.count("*").alias(size)).where(F.col(size) > 1)
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = keys.withColumn("salt", F.pmod(F.xxhash64(node, F.lit(5)), F.lit(SALTS)).cast("int"))
    return rows.join(sizes, ["bucket", "salt"]).drop("salt")


def shared_buckets(keys: DataFrame, node: str, block: int = BLOCK) -> DataFrame:
    """(bucket, x, y, blk, node) of the ``keys`` (bucket, node) whose bucket has other members.

    A bucket of ``n`` members becomes ``ceil(n / block)`` blocks, and each member goes to every pair (x, y) of blocks that
    holds its own ``blk``; so every pair of members meets, in a group of about two blocks.
    """
    rows = with_sizes(keys, node, "n").withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64(node, F.lit(11)), F.col("nb")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.select("bucket", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), "blk", node)


def regrouped(rows: DataFrame) -> DataFrame:
    """Rows of one (bucket, x, y) together in a partition, blocks in order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "blk")


def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole groups of (bucket, x, y) only, with where each group begins."""
    carry: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if carry is not None:
            batch = pa.concat_batches([carry, batch])
        k = [batch.column(c).to_numpy() for c in ("bucket", "x", "y")]
        new = np.flatnonzero((k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])) + 1
        if len(new):
            yield batch.slice(0, int(new[-1])), np.append(0, new[:-1])
            carry = batch.slice(int(new[-1]))
        else:
            carry = batch
    if carry is not None:
        yield carry, np.zeros(1, np.int64)


def binary_matrix(column: pa.Array, a: int, b: int, dtype: str) -> np.ndarray:
    """Rows a to b of a binary column whose values there are of one length, as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset + a : column.offset + b + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(b - a, -1) if data.ctypes.data % 8 == 0 else np.frombuffer(data.tobytes(), dtype).reshape(b - a, -1)


def roots(linked: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the smallest of ``values`` in its connected component."""
    order = np.argsort(values, kind="stable")
    n = len(linked)
    near = linked[np.ix_(order, order)] | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(n, values.dtype)
    out[order] = values[order][label]
    return out
