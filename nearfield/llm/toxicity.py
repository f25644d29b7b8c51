"""Toxic passages as maximal scoring segments.

Each token scores its log-odds between toxic and clean training texts under Dirichlet priors, less a drift that makes the
expected score negative. A linear-time scan finds all maximal scoring segments of a text; extreme-value statistics
(lambda and K of the background score distribution) turn their scores into expected counts by chance, the significant
ones are kept, and their evidence is calibrated to a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm._common import append_columns, checkpointed, held_out, letters_only, read, remainder, small_batches
from nearfield.llm.quality import training_rows

#: Labelled rows that a model is fitted on at most (those whose ids hash lowest).
MAX_TRAIN_ROWS = 40_000
#: Segments that chance makes less often than this in a text of its length are significant.
E_VALUE = 0.05
SIGNIFICANT = -float(np.log(E_VALUE))


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters in lower case; every ASCII character that isn't a letter parts tokens."""
    return letters_only(text.encode("utf-8", "surrogatepass")).split() if text else []


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the last, score) of a sequence, in its order, in linear time.

    One pass over the positive scores, with the running total on either side of each candidate; a candidate joins the
    nearest earlier one that starts lower whenever it ends higher. Each candidate knows the nearest earlier one that starts
    lower than itself, so that the search skips those between, which start no lower.
    """
    total = np.cumsum(scores)
    hits = np.flatnonzero(scores > 0)
    highs = total[hits]
    found: list[tuple[int, int, float, float, int]] = []  # first, past the last, total before, total after, where one starts lower
    for i, low, high in zip(hits.tolist(), (highs - scores[hits]).tolist(), highs.tolist(), strict=True):
        first, k = i, len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= low:
                k = found[k][4]
            if k < 0 or found[k][3] >= high:
                found.append((first, i + 1, low, high, k))
                break
            first, _, low, _, before = found[k]
            del found[k:]
            k = before
    return [(a, b, high - low) for a, b, low, high, _ in found]


#: Bytes of a stem. Words of one stem share the prior of their odds.
STEM = 5


@dataclass
class ToxicityModel:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    #: Scores of words that aren't in the lexicon, by stem.
    stems: dict[bytes, float] = field(default_factory=dict)
    drift: float = 2.0
    #: Of the background: P(segment score >= s in n tokens) is about 1 - exp(-k * n * exp(-lam * s)).
    lam: float = 1.0
    k: float = 0.1
    #: Logistic calibration: intercept and weights of the features of evidence().
    calibration: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0, 0.0)

    def scored(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments: first token, past the last, score."""
        get, stem, drift = self.lexicon.get, self.stems.get, -self.drift
        scores = [s if (s := get(w)) is not None else stem(w[:STEM], drift) for w in words]
        return segments(np.asarray(scores)) if words and max(scores) > 0 else []

    def chance(self, score: float, n: int) -> float:
        """Minus the logarithm of how many segments of at least this score chance makes in ``n`` tokens."""
        return self.lam * score - float(np.log(self.k * max(1, n)))

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> list[float]:
        """Features of a text of ``n`` tokens: chance of its best segment; scores and number of the significant ones; tokens."""
        told = [self.chance(s, n) for _, _, s in found]
        sure = [e for e in told if e > SIGNIFICANT]
        top = max(told, default=self.chance(0.0, n))
        return [min(20.0, max(-5.0, top)), float(np.log1p(sum(sure))), float(np.log1p(len(sure))), float(np.log1p(n))]

    def probability(self, found: list[tuple[int, int, float]], n: int) -> float:
        z = self.calibration[0] + sum(w * x for w, x in zip(self.calibration[1:], self.evidence(found, n), strict=True))
        return float(1 / (1 + np.exp(-min(60.0, max(-60.0, z)))))


def extreme_values(values: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """lambda and K of a score distribution with negative mean: E[exp(lambda * s)] = 1, and K by its usual lower estimate."""
    p = counts / counts.sum()
    if (p * values).sum() >= 0 or values.max() <= 0:
        return 1.0, 0.1
    low, high = 1e-6, 1.0
    while (p * np.exp(high * values)).sum() < 1:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    lam = (low + high) / 2
    up = values > 0
    #: The chance that a run starts at a token, weighted by what its score adds: without longer runs this is K exactly.
    k = float((p[up] * np.exp(lam * values[up])).sum() * (1 - np.exp(-lam * values[up].min())))
    return lam, max(k, 1e-9)


def _sketch(words: list[bytes]) -> int:
    """The smallest hash of five-word shingles: near copies mostly share it."""
    if len(words) < 5:
        return xxhash.xxh64_intdigest(b" ".join(words)) >> 1
    return min(xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(len(words) - 4)) >> 1


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
    limit: int = MAX_TRAIN_ROWS, prior: float = 4.0, drift: float = 1.5, support: int = 3,
) -> ToxicityModel:
    """Fit on a sample of at most ``limit`` labelled ids, one text of each, less near copies.

    One part of the sample gives token odds, the other the calibration. The lexicon has all tokens of the sample that score.

    The Dirichlet prior of a token has ``prior`` pseudo-counts, dealt to the classes as the tokens of its stem are; that
    of a stem is dealt as all tokens are. A token needs ``support`` texts. Without both classes every text scores the
    share of class 1.
    """
    small_batches(docs.sparkSession)
    rows = training_rows(docs.select(doc_id, text), labels, label, doc_id, limit).select("_label", F.col(text).cast("string").alias("t"), F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(4)).alias("part"))

    def sketch(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([_sketch(tokens(t)) for t in batch.column("t").to_pylist()], pa.int64())]

    sketched = append_columns(rows.where("t is not null"), ["_label", "t", "part"], sketch, [T.StructField("sketch", T.LongType())])
    distinct = sketched.groupBy("sketch", "_label").agg(F.min_by(F.struct("t", "part"), F.xxhash64("t")).alias("r")).select("_label", "r.t", "r.part")
    distinct = checkpointed(distinct)  # counts and evidence both read it

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for y, t, part in zip(*(batch.column(c).to_pylist() for c in ("_label", "t", "part")), strict=True):
                if part:
                    by[y].update(set(tokens(t)))
        words = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([by[0][w] for w in words], pa.int64()), pa.array([by[1][w] for w in words], pa.int64())], names=["w", "n0", "n1"])

    counts = distinct.mapInArrow(count, "w binary, n0 bigint, n1 bigint").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.persist()
    t0, t1 = (int(x or 0) for x in counts.agg(F.sum("n0"), F.sum("n1")).first())
    if not t0 or not t1:
        counts.unpersist()
        both = rows.agg(F.count("*"), F.sum("_label")).first()
        rate = ((both[1] or 0) + 0.5) / (both[0] + 1)
        return ToxicityModel(calibration=(float(np.log(rate / (1 - rate))), 0.0, 0.0, 0.0, 0.0))
    base = float(np.log(t1 / t0))
    stems = counts.where(F.length("w") >= STEM).groupBy(F.substring("w", 1, STEM).alias("stem")).agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"))
    stems = stems.withColumn("share", (F.col("s1") + prior * t1 / (t0 + t1)) / (F.col("s0") + F.col("s1") + prior))
    share = F.coalesce("share", F.lit(t1 / (t0 + t1)))
    odds = F.log((F.col("n1") + prior * share) / (F.col("n0") + prior * (1 - share))) - base
    scored = counts.where(F.col("n0") + F.col("n1") >= support).join(stems, F.substring("w", 1, STEM) == F.col("stem"), "left")
    top = scored.select("w", "n0", (odds - drift).alias("s")).where("s > 0").toArrow()  # words of a bounded sample
    roots = stems.select("stem", (F.log(F.col("share") / (1 - F.col("share"))) - base - drift).alias("s")).where("s > 0").toArrow()
    counts.unpersist()
    lexicon = dict(zip(map(bytes, top.column("w").to_pylist()), top.column("s").to_pylist(), strict=True))
    order = np.lexsort((top.column("n0").to_numpy(), top.column("s").to_numpy()))  # sums don't depend on the order in which rows came
    values = np.append(top.column("s").to_numpy()[order], -drift)
    clean = np.append(top.column("n0").to_numpy()[order] + prior / 16, 0.0)
    clean[-1] = max(1.0, t0 - clean.sum())
    lam, k = extreme_values(values, clean)
    model = ToxicityModel(lexicon, dict(zip(map(bytes, roots.column("stem").to_pylist()), roots.column("s").to_pylist(), strict=True)), drift, lam, k)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for y, t, part in zip(*(batch.column(c).to_pylist() for c in ("_label", "t", "part")), strict=True):
                if not part:
                    words = tokens(t)
                    out.append((y, *shared.value.evidence(shared.value.scored(words), len(words))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.float64()) for i in range(5)], names=list("yabcd"))

    seen = distinct.mapInArrow(evidence, "y double, a double, b double, c double, d double").toArrow()  # at most ``limit`` rows of numbers
    x = np.column_stack([seen.column(c).to_numpy() for c in "abcd"])
    y = seen.column("y").to_numpy()
    order = np.lexsort([*x.T, y])
    if len(y) and y.min() < y.max():
        model.calibration = tuple(float(v) for v in _logistic(x[order], y[order]))
    return model


_PASSAGES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("past", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType()), T.StructField("text", T.StringType())]))


def detect(df: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text", spans: bool = True) -> DataFrame:
    """``keep`` columns with score, predicted and, if ``spans``, the significant passages (token offsets, scores, tokens)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        m, score, found = shared.value, [], []
        for t in batch.column(text).cast(pa.string()).to_pylist():
            words = tokens(t)
            every = m.scored(words)
            score.append(m.probability(every, len(words)))
            if spans:
                told = [(a, b, s, m.chance(s, len(words))) for a, b, s in every]
                found.append([{"first": a, "past": b, "score": s, "evidence": e, "text": b" ".join(words[a:b]).decode("utf-8", "replace")} for a, b, s, e in told if e > SIGNIFICANT])
        out = [pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())]
        if spans:
            out.append(pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("score", pa.float64()), ("evidence", pa.float64()), ("text", pa.string())]))))
        return out

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())] + [T.StructField("passages", _PASSAGES)] * spans
    return append_columns(df, keep, run, fields, [text])


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and passages of every document; labels of rows whose crc32 remainder by 5 isn't 0.

    Null and empty texts have no passage and get the lowest score; a null doc_id isn't held out; an empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    return detect(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model, ["doc_id", "held_out"])
