"""Ranks, running sums and neighbours in two passes.

A window over a group is one task, however large the group. Here rows are dealt by ranges of (group, order), so that a hot group
lies in several parts; each part counts and sums its own rows, and what precedes a part in its group comes from the parts' totals, of which
there are as many as parts. Equal rows of an order lie in one part, so an order should end with a unique id. Nulls are a group of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import Scratch, unused


def dealt(df: DataFrame, tables: Scratch, name: str, by: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, str]:
    """The rows, written in parts by ranges of group and order, and the column with the number of the part."""
    part = unused(df, "_part")
    ranged = df.repartitionByRange(*(F.col(c) for c in by), *order) if by or order else df
    return tables.store(ranged.withColumn(part, F.spark_partition_id()), name), part


def ranked(df: DataFrame, tables: Scratch, name: str, by: Sequence[str], order: Sequence[Column], place: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """Adds ``place``, a row's number in its group from 1, and for each of ``sums`` (new column: a column) the sum of it over the group's earlier rows."""
    wanted = {k: F.col(v) for k, v in (sums or {}).items()} | ({place: F.lit(1)} if place else {})
    rows, part = dealt(df, tables, name, by, order)
    inside = Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda x: F.coalesce(x, F.lit(0))
    totals = rows.groupBy(part, *by).agg(*(F.sum(x).alias(f"_of_{k}") for k, x in wanted.items()))
    held = {c: unused(rows, f"_{c}_of") for c in (part, *by)}
    totals = totals.select(*(F.col(c).alias(a) for c, a in held.items()), *(zero(F.sum(f"_of_{k}").over(before)).alias(f"_of_{k}") for k in wanted))
    here = rows.withColumns({k: zero(F.sum(x).over(inside)) for k, x in wanted.items()})
    same = [F.col(c).eqNullSafe(F.col(a)) for c, a in held.items()]
    both = here.join(totals, same).select(*df.columns, *((F.col(k) + F.col(f"_of_{k}") + (1 if k == place else 0)).alias(k) for k in wanted))
    return both


def neighbours(df: DataFrame, tables: Scratch, name: str, by: Sequence[str], order: Sequence[Column], columns: Sequence[str], before: str = "_before", after: str = "_after") -> DataFrame:
    """Adds the structs ``before`` and ``after``: the given columns of the row before and after in its group, null at its ends.

    Each part borrows its group's last row of the parts before it, and the first of those after it."""
    rows, part = dealt(df, tables, name, by, order)
    inside = Window.partitionBy(part, *by).orderBy(*order)
    own = F.struct(*columns)
    ends = rows.select(part, *by, own.alias("_own"), F.row_number().over(inside).alias("_k"), F.lead(F.lit(1)).over(inside).alias("_more"))
    ends = ends.groupBy(part, *by).agg(F.max(F.when(F.col("_k") == 1, F.col("_own"))).alias("_first"), F.max(F.when(F.col("_more").isNull(), F.col("_own"))).alias("_last"))
    parts = Window.partitionBy(*(by or [F.lit(0)])).orderBy(part)
    held = {c: unused(rows, f"_{c}_of") for c in (part, *by)}
    ends = ends.select(*(F.col(c).alias(a) for c, a in held.items()), F.lag("_last").over(parts).alias("_left"), F.lead("_first").over(parts).alias("_right"))
    here = rows.withColumns({before: F.lag(own).over(inside), after: F.lead(own).over(inside)})
    both = here.join(ends, [F.col(c).eqNullSafe(F.col(a)) for c, a in held.items()])
    return both.select(*df.columns, F.coalesce(before, "_left").alias(before), F.coalesce(after, "_right").alias(after))


def carried(df: DataFrame, tables: Scratch, name: str, by: Sequence[str], order: Sequence[Column], columns: dict[str, str]) -> DataFrame:
    """Adds for each new column the last value that isn't null of an old one, in the group's order up to the row itself."""
    rows, part = dealt(df, tables, name, by, order)
    inside = Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = Window.partitionBy(*(by or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    is_last = F.lead(F.lit(1)).over(Window.partitionBy(part, *by).orderBy(*order)).isNull()
    here = rows.withColumns({k: F.last(c, True).over(inside) for k, c in columns.items()} | {"_is_last": is_last})
    held = {c: unused(rows, f"_{c}_of") for c in (part, *by)}
    ends = here.where("_is_last").select(*(F.col(c).alias(a) for c, a in held.items()), part, *by, *columns)
    ends = ends.select(*held.values(), *(F.last(k, True).over(parts).alias(f"_end_{k}") for k in columns))
    both = here.join(ends, [F.col(c).eqNullSafe(F.col(a)) for c, a in held.items()])
    return both.select(*df.columns, *(F.coalesce(k, f"_end_{k}").alias(k) for k in columns))
