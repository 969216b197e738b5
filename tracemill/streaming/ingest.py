"""Trajectory rows as a stream: deliveries of one line count once, late ones included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.operators.dedupe import keep_first

KEYS = ["task_id", "run_no", "line_no"]


def stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files of a folder, with their schema."""
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def ingest(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Adds each micro-batch to ``out`` under its batch id; a batch that is repeated overwrites itself."""

    def put(df: DataFrame, batch: int) -> None:
        keep_first(df, KEYS, ["ingested_at"]).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """One row per line over all batches, however late it came."""
    return keep_first(spark.read.option("basePath", out).parquet(out).drop("batch"), KEYS, ["ingested_at"])


def counts_by_hour(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """Lines per task and hour of execution, each line once; lines later than ``late`` are left out."""
    t = rows.withWatermark("executed_at", late).dropDuplicatesWithinWatermark(KEYS)
    return t.groupBy(F.window("executed_at", "1 hour").alias("w"), "task_id").count().select(F.col("w.start").alias("hour"), "task_id", F.col("count").alias("n"))
