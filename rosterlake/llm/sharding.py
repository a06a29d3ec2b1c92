"""Sharding by balanced label propagation.

Documents with equal texts are linked. Each starts in the shard of its hash; in every round a linked document
looks at where its neighbours are (a join with the counts of its group by shard) and asks to move to
the shard that holds most of them and has room; each shard lets in as many as it has room for, in hash order.
Documents without links then fill the shards up to their quotas. The law is ``rows``: counts differ by one at most.
A group larger than a shard's quota fills one shard and goes on in others. ``ROUNDS`` and ``SETTLED`` end the search: they bound how few
links are cut (``cut_edges`` counts them), not what is right; every row has a shard and a slot at any time.

Ranks (who is let in, the slots) are counted per hash bin first and numbered within bins of about ``BIN`` rows,
so neither a hot group nor a shard meets in one task.

Edge cases: a null text is empty (size 1, crc 0); null doc_ids are rows like others; equal rows get slots of their
own; shards that hold equally many neighbours tie for the lower one, equal hashes are ordered by doc_id and size; a very long text counts by
its size alone; with fewer rows than shards the first shards hold one each; an empty table gives an empty one; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SHARDS, ROUNDS, BIN = 16, 12, 8192
#: Rounds end when fewer than this share of the linked documents moved.
SETTLED = 0.002


def numbered(df: DataFrame, by: str | None, hashed: str, counts: dict[int | None, int], out: str) -> DataFrame:
    """Adds the place, from 0, in the order of the column ``hashed`` (a uniform long) within ``by``, a shard; counts: rows of each shard."""
    bits = {s: (n // BIN).bit_length() for s, n in counts.items()}
    width = F.lit(bits.get(None, 0)) if by is None else F.element_at(F.array(*(F.lit(bits.get(s, 0)) for s in range(max(bits, default=0) + 1))), F.col(by) + 1)
    binned = df.withColumn("_bin", F.when(width == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col(hashed), 64 - width)))
    keys = [*([by] if by else []), "_bin"]
    sizes = binned.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by or F.lit(0)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(hashed, "doc_id", "size")) - 1
    return binned.join(sizes, keys).withColumn(out, F.col("_before") + inside).drop("_bin", "_before")


def _counts(df: DataFrame, by: str) -> dict[int, int]:
    """Rows of each shard: as many numbers as there are shards."""
    return {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).collect()}


def cut_edges(sharded: DataFrame, group: list[str], shard: str = "shard") -> tuple[int, int]:
    """Links (couples of rows of one group) between shards, and all links, from counts alone."""
    place = sharded.groupBy(*group, shard).agg(F.count("*").alias("n"))
    couples = lambda n: F.expr(f"{n} * ({n} - 1) div 2")
    groups = place.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(couples("n")).alias("inside"))
    inside, every = groups.agg(F.sum("inside"), F.sum(couples("n"))).first()
    return (every or 0) - (inside or 0), every or 0


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    tables = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    nodes = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    nodes = nodes.withColumn("place", F.xxhash64("doc_id", "text_crc32", F.lit(3)))
    nodes = tables.store(nodes, "nodes")
    group = ["text_hash", "text_crc32", "size"]
    total = nodes.count()
    quota = {s: total // shards + (s < total % shards) for s in range(shards)}
    limit = F.element_at(F.array(*(F.lit(quota[s]) for s in range(shards))), F.col("shard") + 1)
    members = nodes.groupBy(*group).agg(F.count("*").alias("members"))
    nodes = tables.store(nodes.join(members, group).withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")), "grouped")
    linked, free = nodes.where("members > 1"), nodes.where("members = 1")
    n_linked = linked.count()
    moved_last = n_linked
    for k in range(rounds):
        if moved_last <= SETTLED * n_linked:
            break
        held = _counts(linked, "shard")
        room = {s: max(0, quota[s] - held.get(s, 0)) for s in range(shards)}
        place = linked.groupBy(*group, "shard").agg(F.count("*").alias("near"))
        # a document stays where it has most neighbours; of equal shards the lower draws
        open_ = F.element_at(F.array(*(F.lit(room[s] > 0) for s in range(shards))), F.col("shard") + 1)
        best = place.where(open_).groupBy(*group).agg(F.max(F.struct("near", (-F.col("shard")).alias("s"))).alias("best"))
        asked = linked.join(place, [*group, "shard"]).join(best, group, "left")
        better = F.struct("near", -F.col("shard")) < F.col("best")
        asked = asked.withColumn("wish", F.when(better, -F.col("best.s")).otherwise(F.col("shard")).cast("int")).select(*linked.columns, "wish")
        stay, asking = asked.where("wish = shard").drop("wish"), asked.where("wish <> shard")
        move = numbered(asking, "wish", "place", _counts(asking, "wish"), "turn")
        let_in = F.col("turn") < F.element_at(F.array(*(F.lit(room[s]) for s in range(shards))), F.col("wish") + 1)
        moved = move.withColumn("moved", let_in).withColumn("shard", F.when(let_in, F.col("wish")).otherwise(F.col("shard"))).drop("wish", "turn")
        columns = [c for c in stay.columns if c != "moved"]
        linked = tables.store(stay.withColumn("moved", F.lit(False)).unionByName(moved), f"round{k}")
        moved_last = linked.where("moved").count()
        linked = linked.select(*columns)
    settled = numbered(linked, "shard", "place", _counts(linked, "shard"), "slot")
    fit = tables.store(settled, "settled")
    kept = fit.where(F.col("slot") < limit)
    over = fit.where(F.col("slot") >= limit).drop("slot")
    held = _counts(kept, "shard")
    rest = numbered(free.unionByName(over), None, "place", {None: total}, "turn")
    # the shards' free slots as ranges of the turn
    to, slot, begin = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        end = begin + quota[s] - held.get(s, 0)
        inside = (F.col("turn") >= begin) & (F.col("turn") < end)
        to = F.when(inside, F.lit(s)).otherwise(to)
        slot = F.when(inside, F.col("turn") - begin + held.get(s, 0)).otherwise(slot)
        begin = end
    rest = rest.withColumn("shard", to).withColumn("slot", slot.cast("long")).drop("turn")
    return kept.unionByName(rest).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
