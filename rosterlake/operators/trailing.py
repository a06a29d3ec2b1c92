"""Counts over a trailing span of time, without a window over a whole key.

Time is cut into buckets as long as the span. What a row's span holds lies in its own bucket and the one before, so each bucket gets a copy of
the rows of its predecessor (the halo) and is a group of its own: it holds what happens in two spans, however long a key goes on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, key: Sequence[str], at: str, id: str, span: int) -> DataFrame:
    """Adds ``n`` and ``first``: how many of a key's rows lie within ``span`` seconds up to the row's own second ``at``, and the earliest of them.

    Rows of one second are counted before they are copied, so many of them make no large group."""
    seconds = rows.groupBy(*key, at).agg(F.count(F.lit(1)).alias("_n"))
    home = F.floor(F.col(at) / span)
    copies = seconds.select(*key, at, "_n", F.explode(F.array(F.struct(home.alias("bucket"), F.lit(True).alias("own")), F.struct((home + 1).alias("bucket"), F.lit(False).alias("own")))).alias("_c"))
    copies = copies.select(*key, at, "_n", F.col("_c.bucket").alias("_bucket"), F.col("_c.own").alias("_own"))
    back = Window.partitionBy(*key, "_bucket").orderBy(at).rangeBetween(-span, 0)
    told = copies.withColumns({"n": F.sum("_n").over(back), "first": F.min(at).over(back)}).where("_own").select(*key, at, "n", "first")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*key, at)]
    return rows.alias("x").join(told.alias("y"), same).select("x.*", "y.n", "y.first")
