"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's word shingles give 32 minimum hashes of 16 bits. Signatures are cut into 8 chunks of 4 symbols: two that
differ in at most 15 symbols have a chunk with at most one error (pigeonhole), so keys of each chunk with each symbol left
out in turn bring together every such pair. At Jaccard similarity 0.8 a pair differs in 16 or more with probability
below 2e-4. Pairs within the distance are confirmed on the full shingle sets.

Equal sets are collapsed first. A bucket reports which of its members hang together, with a link for each member at most;
larger buckets do so block by block, and then once more for members that the blocks left apart. The full shingle sets of each
cluster that arises are compared exactly, whether or not they shared a bucket: first block by block, then representatives of
what the blocks joined, round after round, and at last every member outside the largest component with all others. Members of
one component need no further comparison, so a cluster of copies costs what it holds, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm._blocks import binary_matrix, groups, regrouped, roots, with_sizes
from nearfield.llm._common import checkpointed, mix, read, small_batches, text_chunks, word_hashes, written
from nearfield.llm._graph import components, merged

SYMBOLS, CHUNKS = 32, 8
PER_CHUNK = SYMBOLS // CHUNKS
#: Keys of a signature; a bucket's low bits hold which of them it is.
KEYS = CHUNKS * PER_CHUNK
#: Differing symbols up to which every pair is found: less than two for each chunk.
DISTANCE = 2 * CHUNKS - 1
#: Members of a bucket that one group holds, about.
BLOCK = 256
#: Documents of a cluster whose shingle sets one block holds, about, and bytes of these sets.
CLUSTER_BLOCK, CLUSTER_BYTES = 256, 16 << 20
#: Rounds in which representatives are compared at most, as long as they spare more than they cost; what they leave apart is
#: compared in full.
ROUNDS = 6
#: Shingles that a comparison of sets takes at a time.
COLUMNS = 1 << 13
_rng = np.random.default_rng(4)
_SLOPES = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_CHAIN = np.uint64(0x9E6C63D0876A9A47)


def shingle_hashes(words: np.ndarray, per_doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of documents (repeats included), and the number in each.

    A document of fewer words has one shingle, its whole sequence; one without words has none.
    """
    n = len(words)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    own = np.minimum(per_doc, size)[doc] if n else np.zeros(0, np.int64)
    place = np.arange(n) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    begins = place <= np.maximum(per_doc - size, 0)[doc] if n else np.zeros(0, bool)
    at = np.flatnonzero(begins)
    acc = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = own[at] > k
        acc = np.where(inside, acc * _CHAIN + words[np.minimum(at + k, n - 1)], acc)
    return mix(acc + own[at].astype(np.uint64) * (own[at] < size)), np.bincount(doc[at], minlength=len(per_doc))


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) to (id, n, fp, sig) of every row; fp and sig are null without words."""
        for batch in batches:
            count = np.zeros(batch.num_rows, np.int64)
            fp: list[bytes | None] = [None] * batch.num_rows
            sig: list[bytes | None] = [None] * batch.num_rows

            def sign(rows: np.ndarray, words: np.ndarray, per_doc: np.ndarray) -> None:
                h, each = shingle_hashes(words, per_doc, size)
                some = np.flatnonzero(each)
                if not len(some):
                    return
                starts = (np.cumsum(each) - each)[some]
                low = np.empty((len(some), SYMBOLS), np.uint64)
                for k in range(SYMBOLS):
                    low[:, k] = np.minimum.reduceat(h * _SLOPES[k] + _SHIFTS[k], starts)
                symbols = (mix(low) >> np.uint64(48)).astype("<u2")
                for j, (d, a) in enumerate(zip(some.tolist(), starts.tolist(), strict=True)):
                    u = np.unique(h[a : a + each[d]])
                    i = int(rows[d])
                    count[i] = len(u)
                    fp[i] = np.array([u.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(u)), len(u)], np.uint64).tobytes()
                    sig[i] = symbols[j].tobytes()

            left = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            begun: list[np.ndarray] = []
            for data, starts, rows in text_chunks(batch.column("text")):
                words, per_doc = word_hashes(data, starts)
                left[rows] -= np.diff(np.append(starts, len(data)))
                if left[rows[-1]]:  # a piece that isn't the last of its text is a run of its own; the last may share one
                    begun.append(words)
                    continue
                per_doc[0] += sum(map(len, begun))
                sign(rows, np.concatenate([*begun, words]), per_doc)
                begun = []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n", "fp", "sig"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sig) to (node, bucket) for every chunk and symbol left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        s = binary_matrix(batch.column("sig"), 0, batch.num_rows, "<u2").astype(np.uint64).reshape(-1, CHUNKS, PER_CHUNK)
        keys = np.empty((batch.num_rows, CHUNKS, PER_CHUNK), np.uint64)
        for left in range(PER_CHUNK):
            rest = [k for k in range(PER_CHUNK) if k != left]
            packed = (s[:, :, rest[0]] << np.uint64(32)) | (s[:, :, rest[1]] << np.uint64(16)) | s[:, :, rest[2]]
            keys[:, :, left] = packed
        number = np.arange(KEYS, dtype=np.uint64)
        keys = mix(mix(keys.reshape(batch.num_rows, KEYS)) + number)
        keys = ((keys & ~np.uint64(KEYS - 1)) | number).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), keys.shape[1])), pa.array(keys.ravel())], names=["node", "bucket"])


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups to links (a, b): members whose signatures are within the distance, and sizes within the ratio, hang together.

        Members with the same label c already do. Each link joins a label to the smallest that it hangs together with.
        """
        for batch, starts in groups(batches):
            n, c = (batch.column(k).to_numpy() for k in ("n", "c"))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(starts.tolist(), np.append(starts[1:], batch.num_rows).tolist(), strict=True):
                if b - a < 2:
                    continue
                sizes, own = n[a:b], c[a:b]
                s = binary_matrix(batch.column("sig"), a, b, "<u2")
                differ = np.zeros((b - a, b - a), np.uint8)
                for k in range(SYMBOLS):
                    differ += s[:, None, k] != s[None, :, k]
                near = (differ <= DISTANCE) & (100 * np.minimum(sizes[:, None], sizes[None]) >= percent * np.maximum(sizes[:, None], sizes[None]))
                root = roots(near | (own[:, None] == own[None]), own)
                some = root != own
                if some.any():
                    found.append((root[some], own[some]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in range(2)], names=["a", "b"])

    return run


def _met(keys: DataFrame, sigs: DataFrame) -> DataFrame:
    """(bucket, x, y, blk, nb, node, n, sig) of the members of buckets that have others, in groups of a block each."""
    rows = with_sizes(keys, "node", "m").withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("node", F.lit(11)), F.col("nb")).cast("int"))
    return rows.join(sigs, "node").select("bucket", F.col("blk").alias("x"), F.col("blk").alias("y"), "blk", "nb", "node", "n", "sig")


def _labelled(rows: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``rows``, one for each node, with the label c that ``labels`` (node, c) have for it as ``name``, or else its own number."""
    return rows.join(labels.select("node", F.col("c").alias(name)), "node", "left").withColumn(name, F.coalesce(name, "node"))


def _met_again(large: DataFrame, labels: DataFrame, sigs: DataFrame) -> DataFrame:
    """Members of ``large`` buckets with labels c, dealt so that all members of different labels meet.

    Members of the most frequent label stay in their block and the others go to every block; if the others are more than
    BLOCK, all go to every pair of blocks instead. A node's label is looked up once for all of its buckets.
    """
    own = _labelled(large.groupBy("node").agg(F.collect_list(F.struct("bucket", "blk", "nb")).alias("own")), labels, "c")
    rows = written(own.select("node", "c", F.inline("own")))
    each = rows.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    most = each.groupBy("bucket").agg(F.max_by("c", F.struct("k", "c")).alias("most"), (F.sum("k") - F.max("k")).alias("others"))
    rows = rows.join(most.where("others > 0"), "bucket").join(sigs, "node").withColumn("by_label", F.col("others") <= BLOCK)
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    rows = rows.withColumn("o", F.explode(F.when(F.col("by_label") & (F.col("c") == F.col("most")), F.array("blk")).otherwise(every)))
    x = F.when(F.col("by_label"), F.col("o")).otherwise(F.least("blk", "o"))
    y = F.when(F.col("by_label"), F.col("o")).otherwise(F.greatest("blk", "o"))
    return rows.select("bucket", x.alias("x"), y.alias("y"), "blk", "node", "n", "sig", "c")


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, text) to (node, set): the distinct 64-bit hashes of the shingles."""
        for batch in batches:
            hashed: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for data, starts, rows in text_chunks(batch.column("text")):
                words, per_doc = word_hashes(data, starts)
                for i, part in zip(rows.tolist(), np.split(words, np.cumsum(per_doc)[:-1]), strict=True):
                    hashed[i].append(part)
            sets = []
            for parts in hashed:
                words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                sets.append(np.unique(shingle_hashes(words, np.array([len(words)]), size)[0]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of distinct numbers."""
    m = len(sets)
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    number = np.cumsum(counts > 1) - 1  # a shingle of one set only adds to no intersection
    some = counts[at] > 1
    column, owner = number[at[some]], owner[some]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((m, m), np.int64)
    for lo in range(0, int((counts > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        present = np.zeros((m, COLUMNS), np.float32)
        present[owner[a:b], column[a:b] - lo] = 1
        out += np.rint(present @ present.T).astype(np.int64)
    out[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return out


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups (node, set) of a cluster to links (a, b) that join all whose sets are similar enough."""
        for batch, starts in groups(batches):
            node = batch.column("node").to_numpy()
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(starts.tolist(), np.append(starts[1:], batch.num_rows).tolist(), strict=True):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in batch.column("set").slice(a, b - a).to_pylist()]
                n = np.array([len(s) for s in sets])
                shared = shared_counts(sets)
                root = roots((shared > 0) & (100 * shared >= percent * (n[:, None] + n[None] - shared)), node[a:b])
                some = root != node[a:b]
                found.append((root[some], node[a:b][some]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in range(2)], names=["a", "b"])

    return run


def _blocks() -> Column:
    """Blocks of a group of nodes with n shingles each, by number and bytes."""
    return F.ceil(F.greatest(F.count("*") / CLUSTER_BLOCK, F.sum("n") * 8 / CLUSTER_BYTES)).cast("int")


def _own_block(nb: str, seed: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(nb)).cast("int")


def _links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of ``rows`` (c, x, y, blk, node) that meet in a group (c, x, y), by their full ``sets``."""
    met = rows.join(sets, "node").select(F.col("c").alias("bucket"), "x", "y", "blk", "node", "set")
    return regrouped(met).mapInArrow(_confirm(percent), "a bigint, b bigint")


def _apart(rows: DataFrame) -> DataFrame:
    """(c, x, y, blk, node) for ``rows`` (c, node, n, label): all pairs meet that aren't both in a cluster's largest component.

    Blocks of the others meet each other and all blocks of the largest component, whose own blocks needn't meet.
    """
    each = rows.groupBy("c", "label").agg(F.count("*").alias("k"))
    most = each.groupBy("c").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    rows = rows.join(most, "c").withColumn("other", F.col("label") != F.col("most"))
    blocks = rows.groupBy("c", "other").agg(_blocks().alias("nb")).groupBy("c").agg(F.max(F.when(F.col("other"), F.col("nb"))).alias("qb"), F.max(F.when(~F.col("other"), F.col("nb"))).alias("mb"))
    rows = rows.join(blocks, "c").withColumn("nb", F.when(F.col("other"), F.col("qb")).otherwise(F.col("mb"))).withColumn("blk", _own_block("nb", 19))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    spot = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    zero, blk, qb, mb = F.lit(0), F.col("blk"), F.col("qb"), F.col("mb")
    largest = F.transform(span(zero, qb - 1), lambda i: spot(i, blk))
    # as x it meets every block of the largest and the later ones of the others, as y the earlier ones
    others = F.concat(F.transform(span(zero, mb - 1), lambda j: spot(blk, j)), F.transform(span(blk, qb - 1), lambda j: spot(blk, mb + j)), F.transform(span(zero, blk - 1), lambda i: spot(i, mb + blk)))
    rows = rows.withColumn("s", F.explode(F.when(F.col("other"), others).otherwise(largest)))
    return rows.select("c", "s.x", "s.y", "blk", "node")


def _confirmed(clusters: DataFrame, nodes: DataFrame, docs: DataFrame, tied: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, c): components of the links within the ``clusters`` (node, c), by the full texts of ``docs``, and of ``tied`` links."""
    sized = clusters.join(nodes.select("node", "n"), "node")
    rows = checkpointed(sized.join(sized.groupBy("c").agg(_blocks().alias("nb")), "c").withColumn("blk", _own_block("nb", 13)))
    texts = docs.join(rows, F.col("id") == F.col("node"), "left_semi").select(F.col("id").alias("node"), "text")
    sets = checkpointed(texts.mapInArrow(_sets(size), "node bigint, set binary").distinct())
    within = lambda dealt: dealt.select("c", F.col("blk").alias("x"), F.col("blk").alias("y"), "blk", "node")
    labels = components(_links(within(rows), sets, percent).unionByName(tied)).withColumnRenamed("component", "c")
    most = rows.agg(F.max("nb")).first()[0] or 0
    if most < 2:
        return labels
    large = rows.where("nb > 1").select("c", "node", "n")
    told = _labelled(large, labels, "label")  # later rounds go on from the representatives, whose labels are those of all
    for turn in range(ROUNDS):
        told = written(told.groupBy("c", "label").agg(F.min("node").alias("node"), F.min_by("n", "node").alias("n")))
        several = told.groupBy("c").agg(_blocks().alias("nb"), F.count("*").alias("k")).where("k > 1")
        told = written(told.join(several, "c").withColumn("blk", _own_block("nb", 23 + turn)))
        apart = told.count()
        if not apart:  # every cluster is one component
            return labels
        found = written(_links(within(told), sets, percent))
        links = found.count()
        if links:
            labels = merged(labels, found)
        if links * most < apart:  # a round compares each with one block, and spares those it joins a comparison with all
            break
        told = _labelled(told.select("c", "node", "n"), labels, "label")
    return merged(labels, _links(written(_apart(written(_labelled(large, labels, "label")))), sets, percent))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: its id, n_shingles, component_id, kept.

    Documents link when 100 * shared >= percent * joint of their distinct ``size``-word shingles. Null, empty and wordless
    texts have none and link with nothing, as do rows without an id (component null, kept). Rows that share an id are one
    document, which links where any of its texts does. kept marks the document with the smallest id of each component. Ids
    are cast to bigint.
    """
    small_batches(df.sparkSession)
    id_type = df.schema[doc_id].dataType
    docs = df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    signed = checkpointed(docs.mapInArrow(_signed(size), "id bigint, n bigint, fp binary, sig binary"))
    full = signed.where("fp is not null and id is not null")
    nodes = checkpointed(full.groupBy("fp").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    keys = nodes.select("node", "sig").mapInArrow(_keyed, "node bigint, bucket bigint")
    met = checkpointed(_met(keys, nodes.select("node", "n", "sig")))
    link = "a bigint, b bigint"
    near = regrouped(met.withColumn("c", F.col("node"))).mapInArrow(_near(percent), link)
    clusters = components(near).withColumnRenamed("component", "c")
    large = met.where("nb > 1")
    if not large.isEmpty():
        clusters = merged(clusters, regrouped(_met_again(large, clusters, nodes.select("node", "n", "sig"))).mapInArrow(_near(percent), link))
    tied = full.groupBy("id").agg(F.min("fp").alias("s"), F.max("fp").alias("t")).where("s <> t").select("id")
    tied = full.select("id", "fp").join(tied, "id").join(nodes.select("fp", "node"), "fp").select(F.col("id").alias("a"), F.col("node").alias("b"))
    final = _confirmed(checkpointed(clusters), nodes, docs, tied, size, percent)
    by_set = nodes.select("fp", "node").join(final, "node", "left").select("fp", F.coalesce("c", "node").alias("c"))
    out = signed.join(by_set, "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(F.col("id").cast(id_type).alias(doc_id), F.col("n").alias("n_shingles"), component.cast(id_type).alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, over two-word shingles at 0.8."""
    return near_duplicates(read(spark, sf_dir, "documents"), size=2, percent=80)
