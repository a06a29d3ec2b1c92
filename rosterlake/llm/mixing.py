"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order (null last) weigh ``WEIGHTS``, repeating. Together they are to give ``SHARE`` of
all words; no target exceeds ``CAP`` times its source, what is above goes to the others by weight. A source's
documents all expect ``target / source size`` copies; the whole part is taken, the fraction is rounded: in falling size each document is
paired with the pool of all smaller ones, and mass (in words) moves between the two, the way drawn so that both
keep their expectations, until the document is integral (or the pool is). The pool's documents give and take by their shares, so each keeps its own expectation, and
large documents are settled while there are small ones to make up for them. The source's words thus stay on target exactly. A leaf is a bucket of
about ``LEAF`` documents of one source and leaves one fraction at most, as a rule its smallest document's; those meet in a tree of fan-in ``FAN_IN``,
and a source's last fraction goes to the nearer whole, so the source comes as near to its target as that document lets it. All draws come from row hashes, so reruns agree however rows are dealt.

Rows that are equal in all columns are one item that expects so many times the copies; what it gets is dealt to them in turn,
counted within the parts in which they were read, so that no task meets all of them.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source; an empty table
gives an empty one; sources without words have target 0; ties of sizes are ordered by hash; a very long text is one item whose
words its source may miss or exceed its target by if its others can't make up for it; further columns count in the comparison of rows, whatever their names, and ``repeated``
returns them as they came.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, unused

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
LEAF, FAN_IN = 4096, 64
_ROUNDED = "source string, bucket long, key long, check long, size long, p double, extra int"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, n_docs, target`` of ``sizes(source, size)``: one row for each source."""
    every = Window.partitionBy(F.lit(0))
    by_source = every.orderBy(F.col("source").asc_nulls_last())
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # lowest caps first: the level at which all sources still below their cap get level * weight
    order = every.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    sources = (
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))).cast("int") + 1))
        .withColumn("most", cap * F.col("source_size"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("level", (share * F.sum("source_size").over(every) - F.sum("most").over(order) + F.col("most")) / (F.sum("weight").over(every) - F.sum("weight").over(order) + F.col("weight")))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))).over(every)["level"])
    )
    return sources.select(
        "source", "source_size", "n_docs", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))).alias("target")
    )


def _uniform(key: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * level + 1)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def pivot(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounded fractions, and the row that keeps one (-1: none). Sum of size * fraction stays as it is. Rows come in falling size.

    What the pool of later rows has given and taken so far is one linear map of its fractions, so a row costs the same however many follow."""
    p, open_ = p.copy(), -1
    live = (p > 1e-12) & (p < 1 - 1e-12) & (size > 0)
    p[~live] = np.round(p[~live])
    rows = np.flatnonzero(live)
    words, mass = size[rows].astype(float), size[rows] * p[rows]
    later_words, later_mass = (np.append(np.cumsum(x[::-1])[::-1], 0.0)[1:] for x in (words, mass))
    slope, base = 1.0, 0.0
    for k, a, most, held in zip(rows.tolist(), words.tolist(), later_words.tolist(), later_mass.tolist(), strict=True):
        x = slope * p[k] + base
        if x < 1e-9 or x > 1 - 1e-9 or open_ >= 0:
            p[k] = round(x)
            continue
        pool = min(max(slope * held + base * most, 0.0), most)
        up, down = min((1 - x) * a, pool), min(x * a, most - pool)
        if up + down > 0 and u[k] * (up + down) < down:  # words move to the row
            x += up / a
            slope, base = (slope * (1 - up / pool), base * (1 - up / pool)) if pool > 0 else (0.0, 0.0)
        elif down > 0:
            x -= down / a
            share = down / (most - pool)
            slope, base = slope * (1 - share), base * (1 - share) + share
        if 1e-9 < x < 1 - 1e-9:
            p[k], open_ = x, k
        else:
            p[k] = round(x)
    return p, open_


def _round(level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "key", "check"], ascending=[False, True, True], kind="stable", ignore_index=True)
        p, open_ = pivot(rows["size"].to_numpy(), rows["p"].to_numpy(), _uniform(rows["key"].to_numpy(), level))
        extra = pd.array(np.round(p), dtype="Int32")
        if open_ >= 0:
            extra[open_] = pd.NA
        return rows.assign(p=p, extra=extra)[["source", "bucket", "key", "check", "size", "p", "extra"]]

    return run


def _keys(docs: DataFrame) -> list[Column]:
    """Two independent hashes of all columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def items(docs: DataFrame, tables: Scratch, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs(doc_id, text, source, ..)`` as ``doc_id, key, check, size, part``, and their distinct ones:
    ``key, check, size, n_equal, source_size, target, copies``; ``key, check``: hashes of all columns, ``part``: where a row was read."""
    key, check = _keys(docs)
    source = F.col("source").cast("string").alias("source")
    rows = docs.select("doc_id", source, n_words().alias("size"), key.alias("key"), check.alias("check"), F.spark_partition_id().alias("part"))
    rows = tables.store(rows, "sizes")
    goals = tables.store(targets(rows, weights, share, cap), "targets")
    expected = F.when(F.col("source_size") > 0, F.col("n_equal") * F.col("target") / F.col("source_size")).otherwise(0.0)
    found = rows.groupBy("source", "key", "check", "size").agg(F.count("*").alias("n_equal"))
    found = found.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    found = found.withColumn("expected", expected).withColumn("whole", F.floor(F.col("expected") + 1e-12).cast("long"))
    found = tables.store(found, "items")
    fraction = F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0))
    bucket = F.pmod(F.xxhash64("key", F.lit(5)), F.ceil(F.col("n_docs") / LEAF))
    open_ = found.where("size > 0").select("source", bucket.alias("bucket"), "key", "check", "size", fraction.alias("p"))
    most = goals.agg(F.max("n_docs")).first()[0] or 0
    n, level, rounded = -(-most // LEAF), 0, []
    while True:
        done = tables.store(open_.groupBy("source", "bucket").applyInPandas(_round(level), _ROUNDED), f"rounded{level}")
        rounded.append(done.where("extra IS NOT NULL").select("key", "check", "extra"))
        open_ = done.where("extra IS NULL").select("source", F.floor(F.col("bucket") / FAN_IN).cast("long").alias("bucket"), "key", "check", "size", "p")
        if n <= 1:
            break
        n, level = -(-n // FAN_IN), level + 1
    extras = open_.select("key", "check", (F.col("p") >= 0.5).cast("int").alias("extra"))
    for more in rounded:
        extras = extras.unionByName(more)
    found = found.join(extras, ["key", "check"], "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    return rows, found.select("key", "check", "size", "n_equal", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for each row of ``docs(doc_id, text, source, ..)``."""
    tables = Scratch(docs.sparkSession, "mixing")
    rows, found = items(docs, tables, weights, share, cap)
    found = tables.store(found, "found")
    # equal rows: numbered within their part, and after those of the parts before
    several = found.where("n_equal > 1").select("key", "check")
    parts = rows.join(several, ["key", "check"]).groupBy("key", "check", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key", "check").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = tables.store(parts.select("key", "check", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "parts")
    turn = F.row_number().over(Window.partitionBy("key", "check", "part").orderBy("doc_id"))
    rows = rows.withColumn("turn", turn).join(parts, ["key", "check", "part"], "left").join(found.drop("size"), ["key", "check"])
    place = F.col("turn") + F.coalesce("before", F.lit(0))
    copies = F.floor(F.col("copies") / F.col("n_equal")) + (place <= F.col("copies") % F.col("n_equal")).cast("int")
    return rows.withColumn("copies", copies.cast("long")).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it (equal rows together)."""
    tables = Scratch(docs.sparkSession, "mixing")
    taken = items(docs, tables, **options)[1].where("copies > 0")
    key, check, copies, turn = (unused(docs, f"mix_{x}") for x in ("key", "check", "copies", "turn"))
    taken = tables.store(taken.select(F.col("key").alias(key), F.col("check").alias(check), F.col("copies").cast("int").alias(copies)), "taken")
    once = docs.withColumns(dict(zip((key, check), _keys(docs), strict=True))).dropDuplicates([key, check])
    chosen = once.join(taken.hint("merge"), [key, check]).withColumn(turn, F.explode(F.sequence(F.lit(1), copies)))
    return chosen.select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
