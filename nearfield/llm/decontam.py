"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every overlapping passage of every training text is a query. An item is retrieved when its score reaches a share of what a
full copy of it would score; then shared five-word shingles of its question and answer are verified in the text around.

Before a passage goes to the index, an exact bound is tried: the terms of an item that are common or short can add only so
much to its score, so a passage whose other terms miss the rest for every item cannot reach the threshold.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm._common import HELD_BYTES, checkpointed, each_shared, gathered, plain_words, read, small_batches

#: Words in a passage, and from one to the next: a run of STRIDE words lies within some passage.
PASSAGE, STRIDE = 128, 64
#: Of a copy's BM25 score, what a passage must reach.
RETRIEVE = 0.6
#: Of an item's five-word shingles, and of its answer's words, what the text must hold.
OVERLAP, ANSWER = 0.8, 0.5
SHINGLE = 5
#: Bytes of the items of one broadcast index, about. More items are dealt to several, which a task holds one after the other;
#: statistics are those of all items, so that the number of indexes changes no result.
PART_BYTES = 8 << 20
K1, B = 1.2, 0.75


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    #: Words of the last sentence, or of the last quarter if there is only one.
    answer: list[bytes]


def parsed(item_id: int, text: str | None) -> Item:
    parts = [w for s in re.split(r"(?<=[.?!])\s+|\n+", text or "") if (w := plain_words(s))]
    words = [w for s in parts for w in s]
    return Item(item_id, words, parts[-1] if len(parts) > 1 else words[len(words) - len(words) // 4 - 1 :])


@dataclass
class Statistics:
    """Of all items: how many, their words, and items by word (those of an index's words are enough)."""

    items: int
    words: int
    df: dict[bytes, int]


@dataclass
class BlockMaxIndex:
    """Postings by term, in blocks with their largest impact. Impacts are shares of each item's own threshold, so 1 is enough."""

    items: list[Item]
    block: int = 32
    #: Of all items, if these are a part of them.
    of_all: Statistics | None = None
    postings: dict[bytes, tuple[list[int], list[float], list[int], list[float], float]] = field(default_factory=dict)
    #: Terms that an item can't reach its threshold without, with (item, impact); what they must add up to.
    needed: dict[bytes, list[tuple[int, float]]] = field(default_factory=dict)
    least: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        tf = [Counter(item.words) for item in self.items]
        of = self.of_all or Statistics(len(tf), sum(len(i.words) for i in self.items), Counter(w for counts in tf for w in counts))
        n, df, mean = of.items, of.df, of.words / max(1, of.items)
        lists: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for d, (item, counts) in enumerate(zip(self.items, tf, strict=True)):
            norm = K1 * (1 - B + B * len(item.words) / max(mean, 1e-9))
            own = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in counts.items()}
            spans = range(max(1, len(item.words) - STRIDE + 1))
            full = min(math.fsum(own[w] for w in set(item.words[s : s + STRIDE])) for s in spans)  # the same in any order
            threshold = RETRIEVE * full
            if threshold <= 0:
                self.least.append(2.0)
                continue
            own = {w: v / threshold for w, v in own.items()}
            spare = 0.0
            for w in sorted(own, key=lambda w: (-df[w], len(w), w)):  # common and short terms first
                if spare + own[w] <= 0.5:
                    spare += own[w]
                else:
                    self.needed.setdefault(w, []).append((d, own[w]))
            self.least.append(1.0 - spare - 1e-9)
            for w, v in own.items():
                lists[w].append((d, v))
        for w, entries in lists.items():
            docs, impacts = [d for d, _ in entries], [v for _, v in entries]
            ends = list(range(0, len(docs), self.block))
            self.postings[w] = (docs, impacts, [docs[min(e + self.block, len(docs)) - 1] for e in ends], [max(impacts[e : e + self.block]) for e in ends], max(impacts))

    def retrieve(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(position of the item, score as a share of its threshold) of all items at 1 or more, by block-max WAND."""
        cursors = [[p[0][0], 0, p] for w in sorted(set(words)) if (p := self.postings.get(w))]
        out: list[tuple[int, float]] = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2][4]
                if bound >= 1.0 - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            d = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == d:
                pivot += 1
            block_bound, upto = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.items)
            for c in cursors[: pivot + 1]:
                b = bisect_left(c[2][2], d)
                if b < len(c[2][2]):
                    block_bound += c[2][3][b]
                    upto = min(upto, c[2][2][b] + 1)
            if block_bound < 1.0 - 1e-9:
                target = max(d + 1, upto)
                move = cursors[: pivot + 1]
            elif cursors[0][0] == d:
                score = math.fsum(c[2][1][c[1]] for c in cursors[: pivot + 1])
                if score >= 1.0 - 1e-9:
                    out.append((d, score))
                target, move = d + 1, cursors[: pivot + 1]
            else:
                target, move = d, [c for c in cursors[:pivot] if c[0] < d]
            for c in move:
                c[1] = bisect_left(c[2][0], target, c[1])
                c[0] = c[2][0][c[1]] if c[1] < len(c[2][0]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def candidates(self, words: list[bytes]) -> set[int]:
        """Passages (numbers) that some item may reach its threshold in, by the bound over needed terms."""
        needed = self.needed
        sums: dict[tuple[int, int], float] = defaultdict(float)
        seen: set[tuple[int, bytes]] = set()
        last = max(0, -(-(len(words) - PASSAGE) // STRIDE))
        for i, w in enumerate(words):
            if w in needed:
                k = i // STRIDE
                for passage in (k - 1, k):
                    if 0 <= passage <= last and (passage, w) not in seen:
                        seen.add((passage, w))
                        for d, v in needed[w]:
                            sums[passage, d] += v
        return {passage for (passage, d), v in sums.items() if v >= self.least[d]}

    def search(self, text: str | None) -> list[tuple[Item, float, float, float]]:
        """(item, best BM25 share, shingle overlap, answer overlap) of each item that the text holds."""
        words = plain_words(text)
        best: dict[int, float] = {}
        where: dict[int, set[int]] = defaultdict(set)
        for passage in sorted(self.candidates(words)):
            for d, score in self.retrieve(words[passage * STRIDE : passage * STRIDE + PASSAGE]):
                best[d] = max(best.get(d, 0.0), score)
                where[d].add(passage)
        out = []
        for d, passages in where.items():
            item = self.items[d]
            reach = len(item.words) + PASSAGE
            overlap = answer = 0.0
            for passage in passages:
                near = words[max(0, passage * STRIDE - reach) : passage * STRIDE + PASSAGE + reach]
                o, a = overlaps(item, near)
                if (o, a) > (overlap, answer):
                    overlap, answer = o, a
            if overlap >= OVERLAP and answer >= ANSWER:
                out.append((item, best[d] * RETRIEVE, overlap, answer))
        return out


def overlaps(item: Item, words: list[bytes]) -> tuple[float, float]:
    """The share of the item's five-word shingles, and of its answer's words, that ``words`` hold."""
    size = min(SHINGLE, len(item.words))
    own = set(zip(*(item.words[k:] for k in range(size)), strict=False))
    there = set(zip(*(words[k:] for k in range(size)), strict=False))
    answer = set(item.answer)
    return len(own & there) / max(1, len(own)), len(answer.intersection(words)) / max(1, len(answer))


def _words_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, t) to (part, w, items, words): a row for each distinct word of an item, and one without word for the item itself."""
    for batch in batches:
        out: list[tuple[int, bytes | None, int, int]] = []
        for part, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if words := plain_words(t):
                out += [(part, w, 1, 0) for w in set(words)]
                out.append((part, None, 1, len(words)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.int64(), pa.int64()))], names=["part", "w", "items", "words"])


def indexes(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> Iterator[BlockMaxIndex]:
    """Indexes over all items, of about PART_BYTES each; at least one. Items without id, text or words are left out."""
    items = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // PART_BYTES))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int"))
    by_word = None
    if parts > 1:
        small_batches(items.sparkSession)
        seen = checkpointed(dealt.select("part", "t").mapInArrow(_words_of_items, "part int, w binary, items bigint, words bigint"))
        n, words = seen.where("w is null").agg(F.sum("items"), F.sum("words")).first()
        by_word = checkpointed(seen.where("w is not null").groupBy("w").agg(F.sum("items").alias("df")))
    for p in range(parts):
        of_all = None
        if by_word is not None:
            own = seen.where((F.col("part") == p) & F.col("w").isNotNull()).select("w").distinct().join(by_word, "w").toArrow()  # words of one part
            of_all = Statistics(n or 0, words or 0, dict(zip(map(bytes, own.column("w").to_pylist()), own.column("df").to_pylist(), strict=True)))
        part = dealt.where(F.col("part") == p).select("i", "t").toArrow()
        rows = sorted(zip(part.column("i").to_pylist(), part.column("t").to_pylist(), strict=True))
        yield BlockMaxIndex([x for i, t in rows if (x := parsed(i, t)).words], of_all=of_all)


def find_leaks(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, bm25, overlap, answer_overlap) of every text and every item that it holds, in one pass over the texts.

    Null and empty texts and items, and items without an id, match nothing; ids of items are cast to bigint. Equal rows of
    ``df`` give equal rows; repeated items (id and text) give one. The number of indexes changes no result.
    """
    spark = df.sparkSession
    small_batches(spark)
    schema = T.StructType([df.select(doc_id).schema[0], T.StructField("item_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("bm25", "overlap", "answer_overlap"))])
    shared = [spark.sparkContext.broadcast(index) for index in indexes(items, item_id, item_text)]  # about PART_BYTES of items each

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, HELD_BYTES if len(shared) > 1 else 0):
            texts = batch.column(1).to_pylist()
            for index in each_shared(shared):
                at: list[int] = []
                found: list[tuple[int, float, float, float]] = []
                for k, t in enumerate(texts):
                    for item, *numbers in index.search(t) if t else ():
                        at.append(k)
                        found.append((item.item_id, *numbers))
                columns = [pa.array([f[j] for f in found], pa.int64() if j == 0 else pa.float64()) for j in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=schema.names)

    return df.select(doc_id, F.col(text).cast("string")).mapInArrow(search, schema)


def without_leaks(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df``, with all its columns, whose text holds no item; null and empty texts stay."""
    spark = df.sparkSession
    small_batches(spark)
    shared = [spark.sparkContext.broadcast(index) for index in indexes(items, item_id, item_text)]
    place = df.columns.index(df.select(text).columns[0])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, HELD_BYTES if len(shared) > 1 else 0):
            texts = batch.column(place).cast(pa.string()).to_pylist()
            stays = [True] * len(texts)
            for index in each_shared(shared):
                stays = [s and not (t and index.search(t)) for s, t in zip(stays, texts, strict=True)]
            yield batch.filter(pa.array(stays))

    return df.mapInArrow(clean, df.schema)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, bm25, overlap, answer_overlap of every document and benchmark item that it holds.

    Null and empty texts and items match nothing; equal rows give equal rows; either table empty gives none.
    """
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
