"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.session import ship_package

#: Rows in one Arrow batch of texts at most. Spark bounds batches by rows only, so long texts need few rows.
BATCH_ROWS = 1000
#: Bytes of text that numpy works on at once; longer documents go through in pieces.
CHUNK_BYTES = 1 << 21
#: Bytes of texts that are searched with one part of a model after the other, where it has several.
HELD_BYTES = 64 << 20
WORD_BREAKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch for this session (a smaller bound that is set stays), and ship this package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def checkpoint_folder(spark: SparkSession) -> None:
    """Have checkpoints go to ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set; it must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder, and read it from there: lost executors cost no recomputation of what went before."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """checkpointed() as a table in the same folder, for what is joined round after round.

    A checkpoint keeps its plan's estimate of its size; those multiply in every join, and numbers whose digits double each
    round soon take the planner longer than the work.
    """
    checkpoint_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def held_out(id_col: str, modulus: int, value: int) -> Column:
    """True where the remainder is ``value``; false for a null id."""
    return F.coalesce(remainder(id_col, modulus) == value, F.lit(False))


def append_columns(
    df: DataFrame, keep: list[str], fn: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField], needs: list[str] = (), gather: int = 0
) -> DataFrame:
    """``keep`` columns of ``df`` and new ``fields``, computed by ``fn`` from each Arrow batch of ``keep`` and ``needs``.

    Columns of ``keep`` that bear the name of a new field give way to it. ``gather`` puts batches together until they have
    that many bytes, for an ``fn`` that costs much by the call.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in new]
    source = df.select(*dict.fromkeys([*keep, *needs]))
    schema = T.StructType([source.schema[c] for c in keep] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, gather) if gather else batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *fn(batch)], names=names)

    return source.mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= size and held:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def each_shared(shared: list) -> Iterator:
    """The values of broadcasts; where there are several, a task lets go of one before it loads the next."""
    for s in shared:
        yield s.value
        if len(shared) > 1:
            s.__dict__.pop("_value", None)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def letters_only(text: bytes) -> bytes:
    """ASCII letters in lower case and all bytes of other scripts; every other ASCII character becomes a space."""
    return text.translate(_PLAIN)


_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PLAIN_DIGITS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 or 48 <= c <= 57 else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Words of letters and digits in lower case, with punctuation as space."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN_DIGITS).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_STEP = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and those of its inverse."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_VALUE[list(WORD_BREAKS)] = 0
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(WORD_BREAKS)] = False


def word_hashes(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of documents that lie end to end in ``data`` (UTF-8), and the words in each.

    ``doc_starts`` has where each document begins. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; none
    reaches over the end of a document.
    """
    n = len(data)
    per_doc = np.zeros(len(doc_starts), np.int64)
    if not n:
        return np.zeros(0, np.uint64), per_doc
    data = _LOWER[data]
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = doc_starts[doc_starts < n]
    first[edges] |= inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), per_doc
    up, down = _power(n)
    sums = np.add.reduceat(_VALUE[data] * up, starts)
    upto = np.searchsorted(starts, doc_starts)
    per_doc = np.diff(np.append(upto, len(starts)))
    return mix(sums * down[starts]), per_doc


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as runs of at most about ``limit`` bytes: (bytes, where each piece starts, the row of each piece).

    A longer text is cut at white space; only a word that is longer than ``limit`` makes a run longer.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    values = texts.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    parts: list[np.ndarray] = []
    rows: list[int] = []
    held = 0
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while a < b:
            end = b
            if b - a > limit:
                end = a + limit
                while end < b and _IN_WORD[data[end]]:
                    end += 1
            if held and held + end - a > limit:
                yield _run(parts, rows)
                parts, rows, held = [], [], 0
            parts.append(data[a:end])
            rows.append(i)
            held += end - a
            a = end
    if parts:
        yield _run(parts, rows)


def _run(parts: list[np.ndarray], rows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts), np.cumsum(sizes) - sizes, np.asarray(rows, np.int64)
