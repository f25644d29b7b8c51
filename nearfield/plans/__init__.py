"""How a k-nearest-neighbour query runs, and a look at what Spark made of it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Bytes of a query block that is broadcast: larger query sets run block by block, each over all vectors.
QUERY_BLOCK_BYTES = 32 << 20


@dataclass(frozen=True)
class KnnPlan:
    """``sql``: higher-order functions, a broadcast of the queries and a window. ``arrow``: numpy kernels with local top-k."""

    kind: str = "arrow"
    query_rows: int = 4096

    def __post_init__(self) -> None:
        if self.kind not in ("arrow", "sql"):
            raise ValueError(f"unknown plan {self.kind!r}")


def choose(plan: str | KnnPlan, dim: int) -> KnnPlan:
    """A plan by name; ``auto`` is the Arrow plan, with as many queries in a block as its bytes allow."""
    if isinstance(plan, KnnPlan):
        return plan
    rows = max(1, QUERY_BLOCK_BYTES // max(8, 8 * dim))
    return KnnPlan("arrow" if plan == "auto" else plan, min(rows, 1 << 14))


def executed_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def pushed_filters(df: DataFrame) -> list[str]:
    """Filters that reach the scans."""
    return [f for found in re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", executed_plan(df)) for f in re.split(r", (?=[A-Z]\w*\()", found) if f]


def scanned_columns(df: DataFrame) -> list[str]:
    """Columns that the scans read."""
    return [c.split(":")[0] for found in re.findall(r"ReadSchema: struct<([^>]*(?:<[^>]*>[^>]*)*)>", executed_plan(df)) for c in re.split(r",(?![^<]*>)", found) if c]


def exchanges(df: DataFrame) -> int:
    """Shuffles in the plan."""
    return len(re.findall(r"\bExchange (?:hash|range|Single|RoundRobin|REBALANCE)", executed_plan(df)))
