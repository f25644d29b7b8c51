"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language come from all labelled training rows (summed in Spark); the log-probability matrix,
``languages x 2^15`` doubles, is broadcast, and each batch is scored in numpy as a sparse product: every n-gram gathers
its matrix entries and ``reduceat`` sums them by document. More than PART_LANGUAGES languages are dealt to several matrices by a
hash of their names; every text meets all of them, and the posterior is over all languages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm._common import HELD_BYTES, append_columns, each_shared, held_out, remainder, small_batches

BITS = 15
BUCKETS = 1 << BITS
#: Characters that numpy works on at once.
SLICE = 1 << 18
#: Languages of one matrix, about (262 kB each); a task holds one matrix at a time.
PART_LANGUAGES = 400
UNKNOWN = "und"
_SPACE = 32
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@lru_cache(1)
def _fold() -> np.ndarray:
    """Code points of letters in lower case; a space for all others."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            table[i] = ord(c.lower()[0])
    return table


def _slices(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(row of each piece, where it starts, codes): pieces of padded texts; the last two codes of a piece only complete n-grams."""
    rows: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def out():
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return rows, np.cumsum(sizes) - sizes, np.concatenate(parts)

    for i, text in enumerate(texts):
        if not text:
            continue
        codes = _fold()[np.frombuffer(f" {text}  ".encode("utf-32-le", "surrogatepass"), "<u4")]
        for a in range(0, len(codes) - 2, SLICE):
            piece = codes[a : a + SLICE + 2]
            if held and held + len(piece) > SLICE:
                yield out()
                rows, parts, held = [], [], 0
            rows.append(i)
            parts.append(piece)
            held += len(piece)
    if parts:
        yield out()


def _grams(starts: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams at each position; ``BUCKETS`` where none counts."""
    valid = np.ones(len(codes), bool)
    ends = np.append(starts[1:], len(codes))
    valid[ends - 1] = valid[ends - 2] = False
    c = codes.astype(np.uint64)
    letter = codes != _SPACE
    one = c * _K[0]
    two = one.copy()
    two[:-1] += (c[1:] + np.uint64(7)) * _K[1]
    three = two.copy()
    three[:-2] += (c[2:] + np.uint64(13)) * _K[2]
    either = letter.copy()
    either[:-1] |= letter[1:]
    out = []
    for h, ok in ((one, valid & letter), (two, valid & either), (three, valid & either)):
        h ^= h >> np.uint64(29)
        h *= _K[1]
        b = (h >> np.uint64(64 - BITS)).astype(np.int32)
        b[~ok] = BUCKETS
        out.append(b)
    return out


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    #: languages x (BUCKETS + 1); the last column is 0.
    log_probs: np.ndarray | None = None
    log_priors: np.ndarray | None = None

    def weigh(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: the most probable language's place, its log weight, the weights of all relative to it, and letters."""
        n, k = len(texts), len(self.languages)
        sums, letters = np.zeros((n, k)), np.zeros(n, np.int64)
        for rows, starts, codes in _slices(texts):
            grams = _grams(starts, codes)
            np.add.at(letters, rows, np.add.reduceat((grams[0] != BUCKETS).astype(np.int64), starts))
            for j in range(k):
                lp = self.log_probs[j]
                np.add.at(sums[:, j], rows, np.add.reduceat(sum(lp[g] for g in grams), starts))
        sums += self.log_priors
        best = sums.argmax(1)
        top = sums[np.arange(n), best]
        return best, top, np.exp(sums - top[:, None]).sum(1), letters

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The most probable language of each text and its posterior probability; (und, 0) without a letter."""
        return score_parts([self], texts)


def score_parts(parts: Iterable[LanguageModel], texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """LanguageModel.score() over the languages of all parts; equal weights go to the language that sorts first."""
    n = len(texts)
    pred, top, rest = [UNKNOWN] * n, np.full(n, -np.inf), np.zeros(n)
    for part in parts:
        if not part.languages:
            continue
        best, own, relative, letters = part.weigh(texts)
        for i in np.flatnonzero(letters):
            name = part.languages[best[i]]
            if own[i] > top[i] or (own[i] == top[i] and name < pred[i]):
                rest[i] = relative[i] + rest[i] * np.exp(top[i] - own[i])
                pred[i], top[i] = name, own[i]
            else:
                rest[i] += relative[i] * np.exp(own[i] - top[i])
    return pred, np.divide(1.0, rest, out=np.zeros(n), where=rest > 0)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.1) -> LanguageModel:
    """fit_parts() for languages that fit one matrix; a model that says und if there are none."""
    parts = list(fit_parts(df, text, lang, smoothing))
    if len(parts) > 1:
        raise ValueError(f"more than {PART_LANGUAGES} languages; ask fit_parts() for several models")
    return parts[0] if parts else LanguageModel()


def fit_parts(df: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.1) -> Iterator[LanguageModel]:
    """Learn from every row with text and language; one model for about PART_LANGUAGES languages, one after the other.

    Rows without a letter add nothing, and no rows give no model.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where("t is not null and l is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(label, []).append(t)
            for label, texts in by.items():
                sums = total.setdefault(label, np.zeros(BUCKETS + 2, np.int64))
                docs: set[int] = set()
                for which, starts, codes in _slices(texts):
                    grams = _grams(starts, codes)
                    for g in grams:
                        sums[: BUCKETS + 1] += np.bincount(g, minlength=BUCKETS + 1)
                    docs.update(np.asarray(which)[np.add.reduceat(grams[0] != BUCKETS, starts) > 0].tolist())
                sums[BUCKETS + 1] += len(docs)
        for label, sums in total.items():
            sums[BUCKETS] = 0
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["l", "b", "n"])

    counts = rows.mapInArrow(count, "l string, b int, n bigint").groupBy("l", "b").agg(F.sum("n").alias("n")).persist()
    number, documents = counts.where(F.col("b") == BUCKETS + 1).agg(F.count("*"), F.sum("n")).first()
    parts = 1 if number <= PART_LANGUAGES else -(-2 * number // PART_LANGUAGES)  # half of the bound each: a hash deals unevenly
    for p in range(parts if number else 0):
        own = counts if parts == 1 else counts.where(F.pmod(F.xxhash64("l"), F.lit(parts)) == p)
        table = own.toArrow()  # at most languages of the part x BUCKETS rows
        if table.num_rows:
            yield _model(table, documents, smoothing)
    counts.unpersist()


def _model(table: pa.Table, documents: int, smoothing: float) -> LanguageModel:
    """The model of the languages in a table of (language, bucket, count), of which BUCKETS + 1 counts documents."""
    names, b, n = table.column("l").to_pylist(), table.column("b").to_numpy(), table.column("n").to_numpy()
    learned = sorted({x for x, bucket in zip(names, b.tolist(), strict=True) if bucket == BUCKETS + 1})
    where = {label: i for i, label in enumerate(learned)}
    matrix = np.zeros((len(learned), BUCKETS + 2))
    known = np.array([where.get(x, -1) for x in names])
    matrix[known[known >= 0], b[known >= 0]] = n[known >= 0]
    grams = matrix[:, :BUCKETS] + smoothing
    log_probs = np.zeros((len(learned), BUCKETS + 1))
    log_probs[:, :BUCKETS] = np.log(grams / grams.sum(1, keepdims=True))
    return LanguageModel(learned, log_probs, np.log(matrix[:, BUCKETS + 1] / documents))


def identify(df: DataFrame, model: LanguageModel | Iterable[LanguageModel], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred and score (the posterior probability, 0 for und) of each whole text.

    ``model`` is one model, or what fit_parts() gives; parts are broadcast as they come, so the driver holds one at a time.
    """
    context = df.sparkSession.sparkContext
    shared = [context.broadcast(part) for part in ([model] if isinstance(model, LanguageModel) else model)]

    def score(batch: pa.RecordBatch) -> list[pa.Array]:
        pred, prob = score_parts(each_shared(shared), batch.column(text).cast(pa.string()).to_pylist())
        return [pa.array(pred, pa.string()), pa.array(prob, pa.float64())]

    gather = HELD_BYTES if len(shared) > 1 else 0
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return append_columns(df, keep, score, fields, [text], gather)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from rows whose crc32 remainder by 3 isn't 1.

    Null, empty and letterless texts: und, 0. A null doc_id is never learned from and isn't held out. Equal rows get
    equal results; an empty table gives none.
    """
    from nearfield.llm._common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_parts(docs.where(remainder("doc_id", 3) != 1))
    out = identify(docs.withColumn("held_out", held_out("doc_id", 3, 1)), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")
