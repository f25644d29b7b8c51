"""Scalar quantisation: each component as one of 256 levels between its dimension's bounds.

Codes are 0 to 255 in a ``array<smallint>`` column (Spark has no unsigned byte). Rounding is half to even.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators.knn import matrix
from nearfield.session import ship_package

LEVELS = 255
MARGIN = 0.10
#: Refitting is due when more than REFIT_RATE of at least REFIT_SAMPLES components were clipped.
REFIT_RATE, REFIT_SAMPLES = 0.02, 200


@dataclass(frozen=True)
class Quantizer:
    """Lower bound and step of each dimension."""

    low: tuple[float, ...]
    scale: tuple[float, ...]

    @property
    def dim(self) -> int:
        return len(self.low)

    def levels(self, v: Column) -> Column:
        """Rounded levels before clipping, as doubles."""
        bounds = F.arrays_zip(F.lit(list(self.low)).alias("lo"), F.lit(list(self.scale)).alias("sc"))
        return F.zip_with(v, bounds, lambda x, b: F.rint((x.cast("double") - b["lo"]) / b["sc"]))

    def encode(self, v: Column) -> Column:
        return F.transform(self.levels(v), lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(float(LEVELS))).cast("smallint"))

    def decode(self, codes: Column) -> Column:
        bounds = F.arrays_zip(F.lit(list(self.low)).alias("lo"), F.lit(list(self.scale)).alias("sc"))
        return F.zip_with(codes, bounds, lambda c, b: c.cast("double") * b["sc"] + b["lo"])

    def clipped(self, v: Column) -> Column:
        """Components whose level lies outside 0 to 255."""
        return F.size(F.filter(self.levels(v), lambda x: (x < 0) | (x > LEVELS)))

    def encode_matrix(self, v: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((v.astype(np.float64) - np.array(self.low)) / np.array(self.scale)), 0, LEVELS).astype(np.uint8)

    def decode_matrix(self, codes: np.ndarray) -> np.ndarray:
        return codes.astype(np.float64) * np.array(self.scale) + np.array(self.low)


def bounds(df: DataFrame, vector_col: str = "vector") -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of each dimension: one row from each task, then their extremes by dimension."""
    ship_package(df.sparkSession)

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0)).astype(np.float64)
                low = v.min(0) if low is None else np.minimum(low, v.min(0))
                high = v.max(0) if high is None else np.maximum(high, v.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int32()), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    ends = df.where(F.col(vector_col).isNotNull()).select(vector_col).mapInArrow(extremes, "d int, low double, high double")
    rows = ends.groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    return np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows])


def fit(df: DataFrame, vector_col: str = "vector", margin: float = MARGIN) -> Quantizer:
    """Bounds of a sample, widened on both sides by ``margin`` of its range."""
    low, high = bounds(df, vector_col)
    if not len(low):
        raise ValueError("no vectors to fit a quantizer on")
    pad = margin * (high - low)
    low, high = low - pad, high + pad
    return Quantizer(tuple(low.tolist()), tuple((np.maximum(high - low, 1e-8) / LEVELS).tolist()))


def clip_stats(df: DataFrame, quantizer: Quantizer, vector_col: str = "vector") -> DataFrame:
    """One row: clipped, total, rate (0 without components) and whether a refit is due."""
    v = F.col(vector_col)
    sums = df.agg(F.coalesce(F.sum(quantizer.clipped(v)), F.lit(0)).cast("bigint").alias("clipped"), F.coalesce(F.sum(F.size(v)), F.lit(0)).cast("bigint").alias("total"))
    rate = F.coalesce(F.try_divide(F.col("clipped").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    return sums.withColumn("rate", rate).withColumn("should_refit", (F.col("total") >= REFIT_SAMPLES) & (F.col("rate") > REFIT_RATE))


def memory_savings(n: int, dim: int) -> dict[str, float]:
    """Megabytes of float32 vectors and of their codes, and the factor between them."""
    full, coded = n * dim * 4 / 1e6, n * dim / 1e6
    return {"float32_mb": full, "int8_mb": coded, "factor": 4.0}
