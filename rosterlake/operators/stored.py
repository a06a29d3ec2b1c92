"""Written intermediate tables in the folder that the driver and all executors share.

A stored table cuts lineage: a lost executor costs at most the running stage. The folder is the session's
``spark.checkpoint.dir``; only where that is unset (single-machine tests) a temporary one is made and set.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="rosterlake-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


class Scratch:
    """Tables of one operator call. What a returned DataFrame still reads lives until the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/rosterlake/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def store(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Writes a table, into a folder for each value of the columns ``by``, and reads it."""
        df.write.option("compression", "zstd").partitionBy(*by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes the named tables (all without names) and lets Spark's cleaner remove finished shuffles."""
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            for name in names or ("",):
                at = jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            gc.collect()  # frees the driver's handles on the plans that read them


def wipe(spark: SparkSession, base: str, tables: list[str], keep: tuple[str, ...] = ("settings",)) -> list[str]:
    """Deletes the named tables of a base, all but those to keep, and what is cached of them; returns those that were there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = []
    for name in tables:
        at = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}")
        system = at.getFileSystem(conf)
        if name not in keep and system.exists(at):
            spark.catalog.refreshByPath(str(at.toString()))
            system.delete(at, True)
            gone.append(name)
    return gone


def publish(path: str, data: bytes) -> int:
    """Writes a file of the shared folder whole or not at all, from a task too; a task that runs again replaces what a lost one left."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    folder = at.rpartition("/")[0]
    system.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        out.write(data)
    system.move(hidden, at)
    return len(data)
