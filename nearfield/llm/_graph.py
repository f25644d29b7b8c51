"""Connected components of large graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm._common import written

#: Parts that the nodes of one label are dealt to.
SALTS = 16
#: Links up to which one task joins them all (4 MB of them); more take rounds over all tasks, with the same result.
SMALL = 1 << 18


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few links (u, v) to (node, component)."""
    every = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()]) for b in batches if b.num_rows]
    if not every:
        return
    nodes, at = np.unique(np.concatenate(every, axis=1), return_inverse=True)
    u, v = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        for a, b in ((u, v), (v, u)):
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, label[a], label[b])  # else a label only spreads from node to node along a chain
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node that links reach.

    Each round takes the smallest label among neighbours and then halves the path to it, until no label changes. Only sums and
    minima by node are shuffled, so a node with many links needs no room in one task. Labels are written each round. Up to
    SMALL links are joined by one task, which spares the rounds.
    """
    pairs = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"))
    if pairs.count() <= SMALL:
        return pairs.coalesce(1).mapInArrow(_joined, "node bigint, component bigint")
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = written(pairs.select(both.alias("e")).select("e.u", "e.v").distinct())
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("m", "node").alias("c")))
    while True:
        # each node takes the smallest label that it or a neighbour has, and then that label's own label
        seen = both.join(labels.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v").groupBy(F.col("u").alias("node")).agg(F.min("cv").alias("m"))
        step = labels.join(seen, "node").select("node", "c", F.least("c", "m").alias("n"))
        # a label that many nodes have is dealt by salt, and the few labels in use are copied for each salt
        used = step.select("n").distinct().join(step.select(F.col("node").alias("n"), F.col("n").alias("nn")), "n")
        jump = used.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        step = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        new = written(step.join(jump, ["n", "salt"], "left").select("node", F.col("c").alias("old"), F.least("n", F.coalesce("nn", "n")).alias("c")))
        changed = new.where("old <> c").limit(1).count()
        labels = new.select("node", "c")
        if not changed:
            return labels.select("node", F.col("c").alias("component"))


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, c): the components ``labels`` (node, c) joined further by ``edges`` (a, b) between any nodes.

    A node that is alone in ``labels`` may be left out.
    Only the graph of the labels that ``edges`` join goes through components().
    """
    edges = written(edges.select("a", "b"))
    if edges.count() + labels.count() <= SMALL:
        every = components(labels.select(F.col("node").alias("a"), F.col("c").alias("b")).unionByName(edges))
        return every.withColumnRenamed("component", "c")
    of = lambda side: F.coalesce(f"c_{side}", side)
    named = edges
    for side in ("a", "b"):
        named = named.join(labels.select(F.col("node").alias(side), F.col("c").alias(f"c_{side}")), side, "left")
    named = written(named.select("a", "b", of("a").alias("ca"), of("b").alias("cb")))
    joined = components(named.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    nodes = labels.select("node", "c").unionByName(named.select(F.col("a").alias("node"), F.col("ca").alias("c"))).unionByName(named.select(F.col("b").alias("node"), F.col("cb").alias("c"))).distinct()
    return written(nodes.join(joined.select(F.col("node").alias("c"), "component"), "c", "left").select("node", F.coalesce("component", "c").alias("c")))
