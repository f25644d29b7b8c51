"""Operation logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.sources import oplog

_SCHEMA = "seq bigint, ts double, op string, id bigint, vector array<float>, metadata string"


def read_log(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Operations as JSON lines with seq, from files that keep arriving in ``folder``."""
    return spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def commit_log(log: DataFrame, target: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write each micro-batch of a log to its own folder of ``target``, named by the batch: a batch that is run again replaces itself."""

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    out = log.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime="10 seconds")).start()


def live_from(spark: SparkSession, target: str) -> DataFrame:
    """The live set of all committed batches."""
    log = spark.read.schema(_SCHEMA + ", batch int").parquet(target)
    return oplog.live(log.drop("batch"))


def operation_counts(log: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Operations by kind and window of time, with late ones accepted for a while."""
    timed = log.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", f"{minutes} minutes"), "op").agg(F.count("*").alias("n")).select("window.start", "window.end", "op", "n")
