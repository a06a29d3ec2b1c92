"""Suppression of repeats in a stream, in the order of event time.

Events wait in their key's state until the watermark has passed them, so what counts as a repeat doesn't depend on the order in which they arrive within the
allowed lateness; then they are judged in order of second and id, and those that count are emitted. A state holds one key's events of that lateness, with the
time of the last one that counted, and is woken by the watermark itself. The checkpoint holds source positions and states together, so a run that failed goes on where its last whole
batch ended, and a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "ids array<long>, times array<long>, last long"


def judged(ids: list[int], times: list[int], last: int | None, until: int, gap: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int | None]:
    """Events (milliseconds) of whole seconds before ``until`` that count, those that still wait, and the second of the last that counted."""
    waiting = sorted(zip(times, ids, strict=True), key=lambda x: (x[0] // 1000, x[1]))
    kept = []
    k = 0
    while k < len(waiting) and waiting[k][0] // 1000 < until // 1000:
        second = waiting[k][0] // 1000
        if last is None or second - last > gap:
            kept.append(waiting[k])
            last = second
        k += 1
    return kept, waiting[k:], last


def once(events: DataFrame, key: str, at: str = "ts", id: str = "event_id", late: str = "1 day", gap: int = 60) -> DataFrame:
    """``key, id, at`` (milliseconds) of the stream's events but for repeats within ``gap`` seconds of the last one that counted."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, times, last = state.get if state.exists else ([], [], None)
        ids, times = list(ids), list(times)
        if not state.hasTimedOut:
            for rows in batches:
                ids += rows["id"].tolist()
                times += rows["ms"].tolist()
        watermark = state.getCurrentWatermarkMs()
        kept, waiting, last = judged(ids, times, last, watermark, gap)
        state.update(([i for _, i in waiting], [t for t, _ in waiting], last))
        if waiting:
            state.setTimeoutTimestamp(max((waiting[0][0] // 1000 + 1) * 1000, watermark + 1))
        yield pd.DataFrame({key: [name[0]] * len(kept), "id": [i for _, i in kept], "ms": [t for t, _ in kept]})

    rows = events.withWatermark(at, late).select(key, F.col(id).cast("long").alias("id"), F.unix_millis(at).alias("ms"), at)
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, id long, ms long", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_appended(df: DataFrame, out: str, checkpoint: str, put=None) -> DataFrame:
    """Processes what is there, each batch to its own folder, and reads what all batches have written."""

    def write(batch: DataFrame, number: int) -> None:
        if put:
            put(number)
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)
