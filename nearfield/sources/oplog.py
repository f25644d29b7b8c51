"""Operation logs: reading, replay, and the live set that a log leaves.

An id's first insert counts; later ones are skipped, also after a delete. A delete takes effect from its place in the log on
and is final; before the insert it does nothing. Compactions change nothing that replay sees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Of a log as a table.
COLUMNS = "seq bigint, ts double, op string, id bigint, vector array<float>, metadata string"
_JSON = "op string, ts double, id bigint, vector array<float>, metadata string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines (op, ts and, by op, id, vector, metadata) with seq by place in the file.

    Blank lines are skipped and malformed ones raise. Metadata stays JSON text; parse_json() makes it a VARIANT. Lines
    are numbered by file and by offset of their part of the file, so several files count in the order of their names.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.where(F.trim("value") != "")
    parsed = lines.select("_file", "_block", "_line", F.from_json("value", _JSON, {"mode": "FAILFAST"}).alias("r"))
    # blocks are counted first, so that no single task has to number a whole log
    sizes = parsed.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    starts = sizes.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_line"))
    numbered = parsed.withColumn("_place", place).join(starts, ["_file", "_block"])
    return numbered.select((F.col("_before") + F.col("_place") - 1).alias("seq"), "r.ts", "r.op", "r.id", "r.vector", "r.metadata")


def _by_id(log: DataFrame, payload: list[str]) -> DataFrame:
    """(id, first insert, last delete, row) of the ids of a log."""
    rows = log.where(F.col("op").isin("insert", "delete")).select(F.col("seq").cast("bigint").alias("seq"), "op", "id", F.struct(*payload).alias("_p"))
    inserted = F.col("op") == "insert"
    return rows.groupBy("id").agg(
        F.min(F.when(inserted, F.col("seq"))).alias("_in"),
        F.max(F.when(~inserted, F.col("seq"))).alias("_out"),
        F.min_by(F.when(inserted, F.col("_p")), F.when(inserted, F.col("seq"))).alias("_row"),
    )


def _added(log: DataFrame, snapshot: DataFrame | None, payload: list[str]) -> DataFrame:
    """(id, ``payload``, deleted) of the ids that the log inserts and the snapshot hasn't."""
    found = _by_id(log, payload).where(F.col("_in").isNotNull())
    if snapshot is not None:
        # the log's ids look themselves up in the snapshot, which stays where it is while the log is small
        new = log.where("op = 'insert'").select("id").distinct()
        found = found.join(snapshot.select("id").join(new, "id", "left_semi"), "id", "left_anti")
    deleted = F.coalesce(F.col("_out") > F.col("_in"), F.lit(False))
    return found.select("id", *(F.col(f"_row.`{c}`").alias(c) for c in payload), deleted.alias("deleted"))


def _deletes(log: DataFrame) -> DataFrame:
    return log.where("op = 'delete'").select("id").distinct()


def _payload(log: DataFrame, payload: list[str] | None) -> list[str]:
    return [c for c in log.columns if c not in ("seq", "ts", "op", "id")] if payload is None else payload


def replay(log: DataFrame, snapshot: DataFrame | None = None, payload: list[str] | None = None) -> DataFrame:
    """(id, ``payload``, deleted) of every id that the snapshot or the log inserts.

    ``log`` has seq, op (insert, delete, compact), id and the payload columns, ``snapshot`` id, payload and perhaps deleted;
    its ids count as inserted before the log. Only the log is grouped by id. The snapshot is joined with the ids that the log
    deletes, which Spark broadcasts as long as they are few, and filters and columns reach its files.
    """
    payload = _payload(log, payload)
    new = _added(log, snapshot, payload)
    if snapshot is None:
        return new
    gone = F.col("deleted") if "deleted" in snapshot.columns else F.lit(False)
    old = snapshot.select("id", *payload, gone.alias("_d")).join(_deletes(log).withColumn("_gone", F.lit(True)), "id", "left")
    return old.select("id", *payload, (F.col("_d") | F.coalesce("_gone", F.lit(False))).alias("deleted")).unionByName(new)


def live(log: DataFrame, snapshot: DataFrame | None = None, payload: list[str] | None = None) -> DataFrame:
    """The rows of replay() that aren't deleted."""
    payload = _payload(log, payload)
    new = _added(log, snapshot, payload).where(~F.col("deleted")).drop("deleted")
    if snapshot is None:
        return new
    old = snapshot.where(~F.col("deleted")) if "deleted" in snapshot.columns else snapshot
    return old.select("id", *payload).join(_deletes(log), "id", "left_anti").unionByName(new)
