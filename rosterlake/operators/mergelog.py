"""A log of merges, edits and undone merges, replayed.

What a merge gives a record depends on what earlier merges and edits left, and an undone merge takes back only what still is as the absorbed record
gave it. So the log is the truth and the base is its result: events are folded in their order, and a merge in the middle of a chain can be undone after later
ones. Records that no event of the log connects don't touch each other, so each connected part of the merge forest is folded alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resolve
from .stored import Scratch

#: Events: ``merge`` of ``old`` into ``main`` (fields in ``take`` come from ``old`` anyway), ``unmerge`` of the same, ``edit`` of a field of ``main``.
LOG = "seq long, kind string, main long, old long, take array<string>, field string, value string"


class Fold:
    """The records of one part, and the merges in force with what each main record was before."""

    def __init__(self, scalars: list[str], lists: list[str]):
        self.scalars, self.lists = scalars, lists
        self.records: dict[int, dict] = {}
        self.home: dict[int, int | None] = {}
        self.merges: dict[tuple[int, int], dict] = {}
        self.state: dict[tuple[int, int], str] = {}

    def merge(self, main: int, old: int, take: list[str]) -> None:
        if main == old or self.home.get(main, 0) is not None or self.home.get(old, 0) is not None:
            return  # both must be active
        a, b = self.records[main], self.records[old]
        before = {c: a[c] for c in self.scalars} | {c: list(a[c]) for c in self.lists}
        for c in self.scalars:
            if b[c] is not None and (a[c] is None or c in take):
                a[c] = b[c]
        for c in self.lists:
            a[c] = list(dict.fromkeys([*a[c], *b[c]]))
        moved = [k for k, of in self.home.items() if of == old]
        for k in [*moved, old]:
            self.home[k] = main
        self.merges[main, old], self.state[main, old] = before | {"": moved}, "merged"

    def unmerge(self, main: int, old: int) -> None:
        before = self.merges.pop((main, old), None)
        if before is None:
            return
        a, b = self.records[main], self.records[old]
        for c in self.scalars:
            if a[c] != before[c] and a[c] == b[c]:
                a[c] = before[c]
        for c in self.lists:
            brought = set(b[c]) - set(before[c])
            a[c] = [x for x in a[c] if x not in brought]
        for k in before[""]:
            if self.home[k] == main:
                self.home[k] = old
        self.home[old], self.state[main, old] = None, "open"

    def edit(self, main: int, field: str, value: str | None) -> None:
        if main in self.records and field in self.scalars:
            self.records[main][field] = value


def parts(log: DataFrame, tables: Scratch) -> DataFrame:
    """``id, part`` of all records that the log names."""
    pairs = tables.store(log.where("old IS NOT NULL").select(F.col("main").alias("a"), F.col("old").alias("b")).distinct(), "pairs")
    joined = resolve.components(pairs)
    alone = log.select(F.col("main").alias("id")).distinct().join(joined, "id", "left_anti")
    return tables.store(joined.select("id", F.col("component").alias("part")).unionByName(alone.select("id", F.col("id").alias("part"))), "parts")


def replayed(records: DataFrame, log: DataFrame, scalars: list[str], lists: list[str]) -> tuple[DataFrame, DataFrame]:
    """``records(id, scalars.., lists..)`` (strings and arrays of strings) after the log (``LOG``, unique ``seq``), with ``duplicate_of``; and the pairs
    ``main, old, status`` that the log has merged, ``open`` again where that was undone. Events that don't apply (a record absorbed already, unknown, a merge
    that isn't in force) change nothing; records that the log doesn't name stay as they are."""
    tables = Scratch(records.sparkSession, "replay")
    log = tables.store(log.select(*(x.split()[0] for x in LOG.split(", "))), "log")
    of = parts(log, tables)
    fields = [*scalars, *lists]
    none = lambda kind: F.lit(None).cast(kind)
    things = records.select("id", *fields).join(of, "id").select(
        "part", F.lit(-1).cast("long").alias("seq"), F.lit("record").alias("kind"), F.col("id").alias("main"), none("long").alias("old"), none("array<string>").alias("take"),
        none("string").alias("field"), none("string").alias("value"), *fields,
    )
    events = log.join(of, log["main"] == of["id"]).select("part", *log.columns, *(none("string").alias(c) for c in scalars), *(none("array<string>").alias(c) for c in lists))
    rows = things.unionByName(events)

    def fold(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Fold(scalars, lists)
        waiting = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["seq"], r["main"]))
        for r in waiting:
            if r["kind"] == "record":
                held.records[r["main"]] = {c: r[c] for c in scalars} | {c: list(r[c] or []) for c in lists}
                held.home[r["main"]] = None
            elif r["kind"] == "edit":
                held.edit(r["main"], r["field"], r["value"])
            elif r["kind"] == "merge":
                held.merge(r["main"], r["old"], r["take"] or [])
            elif r["kind"] == "unmerge":
                held.unmerge(r["main"], r["old"])
        out = [{"main": k, "old": None, "status": None, "duplicate_of": held.home[k], **x} for k, x in held.records.items()]
        out += [{"main": a, "old": b, "status": s, "duplicate_of": None} | dict.fromkeys(fields) for (a, b), s in held.state.items()]
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("main", pa.int64()), ("old", pa.int64()), ("status", pa.string()), ("duplicate_of", pa.int64()), *((c, pa.string()) for c in scalars), *((c, pa.list_(pa.string())) for c in lists)])
    kinds = "main long, old long, status string, duplicate_of long" + "".join(f", {c} string" for c in scalars) + "".join(f", {c} array<string>" for c in lists)
    # the rows of one part are few: records that people, or equal contacts, have put together
    done = tables.store(rows.groupBy("part").applyInArrow(fold, kinds), "done")
    changed = done.where("status IS NULL").select(F.col("main").alias("id"), *fields, "duplicate_of")
    same = records.select("id", *fields).join(changed.select("id"), "id", "left_anti").withColumn("duplicate_of", none("long"))
    return same.unionByName(changed), done.where("status IS NOT NULL").select("main", "old", "status")
