"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Rows of a source form blocks. Block ``j`` (from 0) of a source with weight ``w`` is released in slot ``floor(j / w)`` and due
by slot ``ceil((j + 1) / w)``; each slot takes the released block that is due first. The weights are shares of a whole
number of slots, after which the schedule repeats, so one cycle (at most CYCLE slots for each source) is worked out ahead and
each row finds its slot from its rank. Up to every slot, a source has had its weight's share of blocks, give or take less
than one, for as long as no source has run out.

Within a source rows are in the order of a hash of their id. A rank is the number of rows in earlier hash ranges plus the
rank within a range of about RANGE_ROWS rows, so no source has to be sorted in one task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm._common import read

BLOCK_ROWS = 64
RANGE_ROWS = 2000
#: Slots of a cycle that the largest source has at most; distinct sources at most.
CYCLE, MAX_SOURCES = 100, 5000


def schedule(shares: list[int]) -> list[list[int]]:
    """For each source its slots within one cycle of ``sum(shares)`` slots, by earliest deadline first among the released."""
    total = sum(shares)
    slots: list[list[int]] = [[] for _ in shares]
    waiting = [(0, s) for s in range(len(shares))]  # release, source
    ready: list[tuple[int, int]] = []  # deadline, source
    heapq.heapify(waiting)
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // shares[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        if len(slots[s]) < shares[s]:
            heapq.heappush(waiting, (len(slots[s]) * total // shares[s], s))
    return slots


def root_shares(counts: Mapping[str | None, int]) -> dict[str | None, int]:
    """Target shares in proportion to the square root of each source's rows; the largest source has CYCLE."""
    most = max(counts.values(), default=1)
    return {s: max(1, math.floor(CYCLE * math.sqrt(n / most))) for s, n in counts.items()}


def _order(doc_id: str, rest: Column) -> Column:
    """32 bits of a hash of the id, which SQL elsewhere can compute as well; of ``rest`` for a null id."""
    own = F.conv(F.substring(F.md5(F.col(doc_id).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(own, F.pmod(rest, F.lit(1 << 32)))


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", keep: list[str] | None = None, shares: Mapping[str | None, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``keep`` columns (all by default) with block, slot and position of every row; reading by position gives the mix.

    ``shares`` are whole-number weights by source; by default root_shares(), and 1 for a source that they lack. Every row
    is kept once: a null source is a source of its own, rows with equal ids lie next to each other in the order of a hash of
    what is kept of them, and short last blocks and sources that have run out leave gaps between positions. Columns of
    ``df`` that bear the name of a new one give way to it. More than MAX_SOURCES sources are refused.
    """
    keep = [c for c in (keep or df.columns) if c.lower() not in ("block", "slot", "position")]
    counts = {r[0]: r[1] for r in df.groupBy(source).count().limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    given = root_shares(counts) if shares is None else shares
    each = [max(1, int(given.get(s, 1))) for s in names]
    slots = schedule(each)
    plan_rows = [
        F.struct(F.lit(i).alias("_i"), F.lit(s).cast("string").alias("_source"), F.lit(counts[s]).cast("bigint").alias("_n"), F.lit(",".join(map(str, own))).alias("_slots"))
        for i, (s, own) in enumerate(zip(names, slots, strict=True))
    ]
    spark = df.sparkSession
    if not plan_rows:
        zero = F.lit(0).cast("bigint")
        return df.limit(0).select(*keep, zero.alias("block"), zero.alias("slot"), zero.alias("position"))
    plan = spark.range(1).select(F.inline(F.array(*plan_rows))).withColumn("_slots", F.split("_slots", ",").cast("array<bigint>"))
    plain = [f.name for f in df.select(*keep).schema if f.dataType.typeName() not in ("map", "variant")]
    told = F.xxhash64(*plain) if plain else F.lit(0)
    rows = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(source).cast("string").alias("_s"), F.col(doc_id).alias("_id"), told.alias("_t"), _order(doc_id, told).alias("_h"))
    rows = rows.join(F.broadcast(plan), F.col("_s").eqNullSafe(F.col("_source")))  # MAX_SOURCES rows at most
    ranges = F.ceil(F.col("_n") / RANGE_ROWS)
    rows = rows.withColumn("_range", F.floor(F.col("_h") * ranges / F.lit(1 << 32)).cast("bigint"))
    ahead = rows.groupBy("_i", "_range").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_i").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.select("_i", "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    # the window and the join need the same partitioning, so rows are shuffled once
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_i", "_range").orderBy("_h", "_id", "_t"))).join(ahead, ["_i", "_range"])
    rank = (F.col("_before") + F.col("_rn") - 1).cast("bigint")
    block = F.floor(rank / block_rows).cast("bigint")
    share = F.size("_slots")
    slot = F.floor(F.col("_block") / share).cast("bigint") * sum(each) + F.element_at("_slots", (F.col("_block") % share + 1).cast("int"))
    rows = rows.withColumn("_rank", rank).withColumn("_block", block).withColumn("_slot", slot)
    position = F.col("_slot") * block_rows + F.col("_rank") % block_rows
    return rows.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.col("_block").alias("block"), F.col("_slot").alias("slot"), position.alias("position"))


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, block, slot, position of every document, with targets by the square root of the sources' sizes.

    A null source is one of its own, a null id has a place, equal rows have a place each, and an empty table gives no rows.
    """
    return mix(read(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def oracle_sql(table: str = "documents", columns: str = "doc_id, source") -> str:
    """DuckDB SQL for mix() with its default parameters over ``table``."""
    return f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM {table} GROUP BY source),
q AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS i, greatest(1, floor({CYCLE} * sqrt(n::DOUBLE / (SELECT max(n) FROM n))))::BIGINT AS q FROM n),
w AS (SELECT list(q ORDER BY i) AS q, sum(q)::BIGINT AS total, count(*)::BIGINT AS k FROM q),
s(t, pick, done) AS (
  SELECT 0::BIGINT, 0::BIGINT, list_transform(w.q, lambda x: 0::BIGINT) FROM w WHERE k > 0
  UNION ALL
  SELECT t + 1, p, list_transform(done, lambda x, j: CASE WHEN j = p THEN x + 1 ELSE x END) FROM (
    SELECT s.t, s.done, (list_min(list_transform(range(1, w.k + 1), lambda j:
      CASE WHEN done[j] < w.q[j] AND done[j] * w.total // w.q[j] <= s.t
           THEN (((done[j] + 1) * w.total + w.q[j] - 1) // w.q[j]) * 100000 + j END)) % 100000)::BIGINT AS p
    FROM s, w WHERE s.t < w.total
  )
),
slots AS (SELECT pick AS i, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM s WHERE pick > 0),
r AS (
  SELECT d.*, q.i AS _i, q.q AS _q, row_number() OVER (PARTITION BY d.source ORDER BY coalesce(('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT, 0), d.doc_id NULLS FIRST) - 1 AS _rank
  FROM {table} d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT {columns}, _rank // {BLOCK_ROWS} AS block, (_rank // {BLOCK_ROWS}) // _q * w.total + slots.slot AS slot,
  ((_rank // {BLOCK_ROWS}) // _q * w.total + slots.slot) * {BLOCK_ROWS} + _rank % {BLOCK_ROWS} AS position
FROM r JOIN slots ON slots.i = _i AND slots.j = (_rank // {BLOCK_ROWS}) % _q, w
"""


ORACLE_SQL = oracle_sql()
