"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on a bounded sample of labelled rows, every path of theirs becomes a conjunctive rule, an
L1-penalised logistic regression keeps few of the rules, and those are compiled into one Spark column expression over the
statistics. The statistics come from one Arrow pass over the whole texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm._common import append_columns, held_out, read, remainder

#: Labelled rows that a model is fitted on at most (those whose ids hash lowest).
MAX_TRAIN_ROWS = 20_000
#: Rows that the regression takes at a time.
FIT_ROWS = 1024
STATISTICS = [
    "log_bytes", "words", "word_bytes", "upper", "digits", "marks", "bars", "shouts", "stops", "commas", "lines", "brackets",
    "distinct", "repeats", "top_word", "distinct_lines", "other_script", "short_words",
]


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of STATISTICS; zeros for null and empty texts."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(data)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = int(h[65:91].sum()), int(h[97:123].sum())
    counts = Counter(words)
    lines = data.split(b"\n")
    return [
        float(np.log1p(size)),
        float(n),
        sum(map(len, words)) / n,
        upper / max(1, upper + lower),
        int(h[48:58].sum()) / size,
        int(h[[35, 36, 37, 38, 42]].sum()) / n,
        int(h[124]) / n,
        int(h[33]) / n,
        int(h[46]) / n,
        int(h[44]) / n,
        len(lines) / n,
        int(h[[40, 41, 60, 62, 91, 93, 123, 125]].sum()) / n,
        len(counts) / n,
        sum(map(eq, words, words[1:])) / n,
        max(counts.values()) / n,
        len(set(lines)) / len(lines),
        int(h[128:].sum()) / size,
        sum(1 for w in words if len(w) < 4) / n,
    ]


#: A condition is (statistic, above?, threshold): value > threshold if above, else value <= threshold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self) -> Column:
        """Probability of label 1 as an expression over the columns named in STATISTICS."""
        z = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for j, above, at in rule:
                c = F.col(STATISTICS[j])
                holds = holds & (c > at if above else c <= at)
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, at in rule:
        out &= x[:, j] > at if above else x[:, j] <= at
    return out


def _simplified(path: list[tuple[int, bool, float]]) -> Rule:
    """The path with one condition for each statistic and direction."""
    tight: dict[tuple[int, bool], float] = {}
    for j, above, at in path:
        old = tight.get((j, above))
        tight[j, above] = at if old is None else max(old, at) if above else min(old, at)
    return tuple(sorted((j, above, at) for (j, above), at in tight.items()))


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, seed: int = 5) -> list[Rule]:
    """Paths of boosted trees (logistic loss, half of the rows for each tree, splits at quantiles)."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    f = np.zeros(len(y))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        grad, hess = y - p, p * (1 - p) + 1e-9
        part = np.flatnonzero(rng.random(len(y)) < 0.5)
        stack = [(part, np.arange(len(y)), [])]
        while stack:
            at, everywhere, path = stack.pop()
            if path:
                rules.setdefault(_simplified(path))
            best = (1e-6, -1, -1)
            if len(path) < depth and len(at) >= 20:
                g, h = grad[at].sum(), hess[at].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[at, j]
                    gl = np.cumsum(np.bincount(b, grad[at], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, hess[at], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] < 0:
                f[everywhere] += rate * grad[at].sum() / (hess[at].sum() + 1) if len(at) else 0.0
                continue
            _, j, k = best
            for above in (False, True):
                side = (binned[:, j] > k) == above
                stack.append((at[side[at]], everywhere[side[everywhere]], [*path, (j, above, float(cuts[j][k]))]))
    return list(rules)


def lasso_logistic(member: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression on the standardised columns of booleans, by accelerated proximal gradient.

    No column is constant. The driver holds the booleans, and has numbers of FIT_ROWS rows at a time. Weights are those of the
    booleans themselves.
    """
    n, m = member.shape
    mean = member.mean(0)
    scale = np.sqrt(mean * (1 - mean))
    blocks = lambda: ((slice(a, a + FIT_ROWS), member[a : a + FIT_ROWS].astype(np.float64)) for a in range(0, n, FIT_ROWS))
    gram = (sum(r.T @ r for _, r in blocks()) / n - np.outer(mean, mean)) / np.outer(scale, scale)
    step = 4.0 / (np.linalg.eigvalsh(gram)[-1] + 1.0)
    rate = y.mean().clip(1e-3, 1 - 1e-3)
    w, b = np.zeros(m), float(np.log(rate / (1 - rate)))
    vw, vb, t = w, b, 1.0
    for _ in range(steps):
        v, slope, total = vw / scale, np.zeros(m), 0.0
        for at, r in blocks():
            e = 1 / (1 + np.exp(-(r @ v + (vb - mean @ v)))) - y[at]
            slope += r.T @ e
            total += e.sum()
        w2 = vw - step * ((slope - mean * total) / scale) / n
        w2 = np.sign(w2) * np.maximum(0, np.abs(w2) - step * penalty)
        b2 = vb - step * float(total) / n
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    w = w / scale
    return float(b - (w * mean).sum()), w


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> RuleModel:
    """A rule ensemble; without rows 0.5 for all, with one class the share of that class, kept off 0 and 1."""
    if not len(y):
        return RuleModel()
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if y.min() == y.max():
        return RuleModel(float(np.log(rate / (1 - rate))))
    order = np.lexsort([*x.T, y])  # the model doesn't depend on the order in which rows came
    x, y = x[order], y[order].astype(float)
    rules = [r for r in grow_rules(x, y) if 0 < holds(r, x).mean() < 1]
    if not rules:
        return RuleModel(float(np.log(rate / (1 - rate))))
    b, w = lasso_logistic(np.stack([holds(r, x) for r in rules], 1), y, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(b, [rules[i] for i in keep], [float(w[i]) for i in keep])


def with_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    def stats(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [statistics(t) for t in batch.column(text).cast(pa.string()).to_pylist()]
        return [pa.array(c, pa.float64()) for c in np.asarray(rows).T]

    return append_columns(df, keep, stats, [T.StructField(s, T.DoubleType()) for s in STATISTICS], [text])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, limit: int) -> DataFrame:
    """id, label and columns of ``docs`` for at most ``limit`` labelled ids of ``docs``, those whose ids hash lowest; a row an id.

    An id with labels that differ takes the more frequent, 1 if they are even; of rows that share an id, the one whose
    columns hash lowest counts.
    """
    rest = [c for c in docs.columns if c != doc_id]
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(doc_id)
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_label"))
        .join(docs.select(doc_id).distinct(), doc_id, "left_semi")
        .orderBy(F.xxhash64(doc_id), doc_id)
        .limit(limit)
    )
    rows = docs.join(F.broadcast(chosen), doc_id)  # ``limit`` rows of two numbers at most
    one = F.min_by(F.struct(*rest), F.struct(F.xxhash64(*rest), *rest)).alias("_r")
    return rows.groupBy(doc_id, "_label").agg(one).select(doc_id, "_label", *(F.col(f"_r.{c}").alias(c) for c in rest))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", limit: int = MAX_TRAIN_ROWS) -> RuleModel:
    """Fit on a sample of at most ``limit`` labelled ids."""
    rows = with_statistics(training_rows(docs.select(doc_id, text), labels, label, doc_id, limit), ["_label"], text).toArrow()
    return fit_rules(np.stack([rows.column(s).to_numpy() for s in STATISTICS], 1), rows.column("_label").to_numpy())


def classify(df: DataFrame, model: RuleModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with score and predicted of each whole text; null texts count as empty."""
    keep = [c for c in keep if c.lower() not in ("score", "predicted")]
    names = {c.lower() for c in STATISTICS}
    aside = {c: f"_kept_{c}" for c in keep if c.lower() in names}
    source = df.select(*dict.fromkeys([*keep, text])).withColumnsRenamed(aside)
    out = with_statistics(source, [aside.get(c, c) for c in keep], text).withColumn("score", model.column())
    return out.select(*(F.col(aside.get(c, c)).alias(c) for c in keep), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of rows whose crc32 remainder by 3 isn't 1.

    Null and empty texts get the score of all-zero statistics; a null doc_id isn't held out; an empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(docs, labels.where(remainder("doc_id", 3) != 1))
    return classify(docs.withColumn("held_out", held_out("doc_id", 3, 1)), model, ["doc_id", "held_out"])
