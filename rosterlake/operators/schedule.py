"""Schedules: when they fire, what became of each fire, and the fires around any moment.

A fire waits until its worker is awake. Of the fires that wait then only the last counts, the earlier ones are coalesced into it; if it waited
longer than the grace it is missed, else it is a run. Fires and moments are put into one order and the next moment is carried back to the fires before it (an
as-of join without comparing pairs), however many a schedule has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranked import carried
from .stored import Scratch

#: Fixed value: seconds that a fire may wait.
GRACE = 6 * 3600


def expected(schedules: DataFrame) -> DataFrame:
    """``id, fire`` of ``schedules(id, first, last, days, hour, minute)``: days of the week from 1 (Monday), dates inclusive."""
    day = schedules.withColumn("day", F.explode(F.sequence("first", "last")))
    day = day.where(F.array_contains("days", F.weekday("day") + 1))
    return day.select("id", (F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("hour"), F.col("minute"))).alias("fire"))


def _beside(rows: DataFrame, others: DataFrame, at: str, other: str, out: str, later: bool) -> DataFrame:
    """Rows of ``rows(id, at, ..)`` with the nearest ``others(id, other)`` at the same time or later (earlier)."""
    keep = [c for c in rows.columns if c not in ("id", at)]
    line = rows.select("id", F.col(at).alias("_t"), F.struct(*keep).alias("_row") if keep else F.struct(F.lit(0)).alias("_row"), F.lit(None).cast("timestamp").alias("_o"))
    marks = others.select("id", F.col(other).alias("_t"), F.lit(None).cast(line.schema["_row"].dataType).alias("_row"), F.col(other).alias("_o"))
    time = F.unix_micros("_t") * (-1 if later else 1)
    both = line.unionByName(marks.where(F.col(other).isNotNull()).distinct()).withColumns({"_k": time, "_own": F.col("_o").isNull()})
    tables = Scratch(rows.sparkSession, "asof")
    # of one moment the others come first; equal rows may follow each other in any order, as they get the same
    near = carried(both, tables, "line", ["id"], [F.col("_k"), F.col("_own"), F.xxhash64("_row")], {out: "_o"}).where("_own")
    return near.select("id", F.col("_t").alias(at), *(F.col(f"_row.{c}").alias(c) for c in keep), out)


def outcomes(fires: DataFrame, awake: DataFrame, grace: int = GRACE) -> DataFrame:
    """``id, fire, status, started_at``: what became of each of ``fires(id, fire)`` by ``awake(id, at)``, the moments when the worker was there; fires that still wait
    are ``waiting``."""
    met = _beside(fires.select("id", "fire").distinct(), awake, "fire", "at", "started_at", True)
    last = met.where("started_at IS NOT NULL").groupBy("id", "started_at").agg(F.max("fire").alias("_last"))
    same = F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.started_at") == F.col("y.started_at"))
    rows = met.alias("x").join(last.alias("y"), same, "left").select("x.*", "y._last")
    late = F.unix_timestamp("started_at") - F.unix_timestamp("fire")
    status = F.when(F.col("started_at").isNull(), "waiting").when(F.col("fire") < F.col("_last"), "coalesced").when(late > grace, "missed").otherwise("run")
    return rows.select("id", "fire", status.alias("status"), F.when(status == "run", F.col("started_at")).alias("started_at"))


def around(moments: DataFrame, fires: DataFrame, at: str = "at") -> DataFrame:
    """``moments(id, at, ..)`` with ``previous`` (the last fire not after it) and ``next`` (the first after it)."""
    before = _beside(moments, fires, at, "fire", "previous", False)
    after = before.withColumn("_after", F.col(at) + F.expr("INTERVAL 1 MICROSECOND"))
    return _beside(after, fires, "_after", "fire", "next", True).drop("_after").select(*moments.columns, "previous", "next")


def is_absent(previous: Column, started: Column, leeway: int = 60) -> Column:
    """Whether a run for the last fire hasn't begun: the last start lies more than ``leeway`` seconds before it."""
    return previous.isNotNull() & (started.isNull() | (F.unix_timestamp(started) < F.unix_timestamp(previous) - leeway))
