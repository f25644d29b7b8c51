"""From raw documents to a mixed training corpus: five stages, each of which keeps or drops whole documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontam, langid, minhash, mixing, quality
from nearfield.llm._common import checkpointed, read

#: Documents whose language has a lower posterior probability are rejected.
LEAST_LANGUAGE_SCORE = 0.5
_ASIDE = "_aside_"


def _set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns of these names renamed, and what gives all columns of ``docs`` back."""
    columns = docs.columns
    moved = {c: _ASIDE + c for c in columns if c.lower() in names}
    return docs.withColumnsRenamed(moved), lambda out: out.select(*(F.col(moved.get(c, c)).alias(c) for c in columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: texts with letters, of which one language has at least LEAST_LANGUAGE_SCORE.

    The model learns from the lang column of ``docs``. Null, empty and letterless texts go.
    """
    renamed, back = _set_aside(docs, ("lang_pred", "score"))
    out = langid.identify(renamed, langid.fit_parts(docs), renamed.columns)
    return back(out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the rule ensemble, fitted on the labels of ``docs``, predicts to be of quality 1.

    Null and empty texts have all-zero statistics and go or stay by these; without labels all documents stay.
    """
    renamed, back = _set_aside(docs, ("score", "predicted"))
    model = quality.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return back(quality.classify(renamed, model, renamed.columns).where("predicted = 1"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word shingles at 0.8, and one row of it.

    Of rows that share an id, the one whose columns hash lowest stays. Rows without an id are in no group and stay, and null,
    empty and wordless texts too.
    """
    found = minhash.near_duplicates(docs, size=5, percent=80)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    rest = [c for c in docs.columns if c != "doc_id"]
    plain = [f.name for f in docs.select(*rest).schema if f.dataType.typeName() not in ("map", "variant")]
    order = F.struct(F.xxhash64(*plain), *plain)
    rows = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    rows = rows.select("doc_id", *(F.col(f"_row.`{c}`").alias(c) for c in rest))
    return rows.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item; null and empty texts hold none."""
    return decontam.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with block, slot and position of the mix of their sources; a null source is one of its own."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", language_stage),
    ("quality classifier", quality_stage),
    ("near-duplicates", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]

#: SQL can't express the classifiers; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that all stages keep, with block, slot and position."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
