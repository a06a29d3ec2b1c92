"""A cache of answers, addressed by what was asked.

A model is asked once for each distinct prompt: its hash (with the model's name) is the key. Answers are published as immutable batches, each written
whole under a name of its own; of a key that several writers have answered the batch that was published first holds for all readers, so writers need no lock and an
answer that was read once never changes. Only good answers are kept; a failed one is asked again by the next run.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "key string, response string, error string"


class Cache:
    """Answers in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str, model: str):
        self.spark, self.folder, self.model = spark, folder.rstrip("/"), model

    def key(self, prompt: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{self.model}\n"), F.coalesce(prompt, F.lit(""))), 256)

    def _batches(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        system = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(at) or not any(x.getPath().getName().startswith("batch=") for x in system.listStatus(at)):
            return None
        return self.spark.read.schema("key string, response string, batch string").parquet(self.folder)

    def held(self) -> DataFrame:
        """``key, response``: of each key the answer that was published first."""
        rows = self._batches()
        if rows is None:
            return self.spark.createDataFrame([], "key string, response string")
        return rows.groupBy("key").agg(F.min_by("response", "batch").alias("response"))

    def publish(self, found: DataFrame) -> None:
        """Adds ``found(key, response)`` as one batch; its folder's name begins with the time, so names order batches."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        hidden = f"{self.folder}/.{name}"
        found.select("key", "response").write.parquet(hidden)
        jvm = self.spark.sparkContext._jvm
        old = jvm.org.apache.hadoop.fs.Path(hidden)
        system = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.rename(old, jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={name}")):
            raise OSError(f"can't publish {name}")

    def answered(self, rows: DataFrame, prompt: str, ask: Callable[[str], str], tables) -> DataFrame:
        """``rows`` with ``response, error, asked`` (whether this run has asked). Equal prompts are asked once, known ones not at all."""
        keyed = tables.store(rows.withColumn("_key", self.key(F.col(prompt))), f"keyed-{uuid.uuid4().hex[:6]}")
        known = self.held()
        new = keyed.groupBy(F.col("_key").alias("key")).agg(F.min(prompt).alias("prompt")).join(known, "key", "left_anti")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for key, text in zip(batch.column("key").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                    try:
                        found.append((key, ask(text or ""), None))
                    except Exception as e:  # this prompt's own failure
                        found.append((key, None, str(e)))
                columns = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.record_batch([pa.array(c, pa.string()) for c in columns], ["key", "response", "error"])

        asked = tables.store(new.mapInArrow(run, ROWS), f"asked-{uuid.uuid4().hex[:6]}")
        good = asked.where("error IS NULL")
        if good.head(1):
            self.publish(good)
        told = self.held().select(F.col("key").alias("_key"), "response")
        now = asked.select(F.col("key").alias("_key"), "error", F.lit(True).alias("asked"))
        joined = keyed.join(told, "_key", "left").join(now, "_key", "left")
        return joined.select(*rows.columns, "response", "error", F.coalesce("asked", F.lit(False)).alias("asked"))
