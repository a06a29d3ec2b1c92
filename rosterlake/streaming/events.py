"""Streaming counterparts of the batch reports: windowed counts with a watermark, and incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event stream; event time becomes a timestamp, as watermarks need one."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_available(df: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what is there and stops; the checkpoint is the high-water mark of the next run."""
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def run_counts(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Like ``run_available`` for counts by window: each batch writes the windows it changed, so that open ones come too; of each window the
    latest count is returned. A batch that runs again replaces what it wrote."""
    keys = [c for c in df.columns if c != "n"]

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    held = df.sparkSession.read.schema(f"{kinds}, batch long").parquet(out)
    return held.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))
