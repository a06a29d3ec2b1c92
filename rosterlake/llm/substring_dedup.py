"""Substring dedup by recompression.

A text is a sequence of words. Rounds rename it, each the same everywhere: in a *pair* round a left-class symbol and the
right-class symbol after it become one, in a *run* round equal neighbours do. A symbol's class is a bit of its
name and a new name is made of the parts' names, so all executors name alike and no dictionary travels between rounds. Each
symbol knows its context: the words that decide how it came about (a pair that of its parts; what stays alone
or is a run, that of its neighbours too). A symbol occurs wherever its context does. Rounds go on until no context fits into a
window of 50 words; symbols then stand for tens of words (``recompress`` gives those of all rounds).

A window is represented by one of the symbols whose context it holds: the longest, where all of ``ENOUGH`` words or more
count alike; of these the one with the greatest name, then the first. Equal windows have equal representatives at equal
places. Neighbouring windows mostly share theirs and form a block.

1. Symbols meet by name; what occurs in one document only is dropped (min and max of doc_id per name, combined map-side).
2. A block of which an equal one (the words of all its windows, 122 bits) starts in a smaller document is a repeat as a whole.
3. Of the other blocks with a shared symbol, the first of its kind is verified window by window, by 122 bits of all 50 words.

No step gathers a group: groups only give minima, and joins back are equi-joins that AQE can split.

Edge cases: a null text has no words; texts of fewer than 50 words have no window and are only normalised;
rows without a doc_id neither lose words nor cause losses; rows that share a doc_id are one document
(they don't remove each other's words); a tie goes to the smaller doc_id; a very long text is read whole and recompressed in
overlapping segments, with the same result; an empty table gives an empty table; further columns are ignored, whatever their
names, and ``without_repeats`` returns them as they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, unused
from .textops import U64, Runs, Words, fingerprints, mix, slices, words

WINDOW = 50
#: Kinds of rounds, repeated; most of them at once, as each run round widens all contexts.
ROUNDS, MOST_ROUNDS = ("pair", "pair", "pair", "run"), 64
#: Symbols of so many words or more represent windows alike; what is longer changes more often from window to window.
ENOUGH = 8
_PLACE = U64(0xFFFFFF)
_SEGMENT = 1 << 22
_FAR = 1 << 30


def recompress(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Names, first words, lengths and contexts (begin, end) of the symbols of more than a word that all rounds
    make, as far as a window holds their context; ``first``: where texts begin, never crossed."""
    n = len(names)
    name, at, size = names.copy(), np.arange(n, dtype=np.int32), np.ones(n, np.int32)
    low, high = at.copy(), at + np.int32(1)
    head = np.zeros(n + 1, bool)
    head[first] = True
    head = head[:-1]
    made = []
    for k in range(MOST_ROUNDS):
        if len(name) < 2 or not (high - low <= WINDOW).any():
            break
        tail = np.append(head[1:], True)
        # contexts of the neighbours; beyond a text's end everything is open
        before_low, before_high = np.where(head, -_FAR, np.roll(low, 1)), np.where(head, -_FAR, np.roll(high, 1))
        after_low, after_high = np.where(tail, _FAR, np.roll(low, -1)), np.where(tail, _FAR, np.roll(high, -1))
        if ROUNDS[k % len(ROUNDS)] == "pair":
            right = (mix(name + U64(k + 1)) & U64(1)).astype(bool)
            joined = ~right & ~tail
            joined[:-1] &= right[1:]
            taken = np.append(False, joined[:-1])
            # a left symbol looks at the one after it, a right one at the one before
            low, high = (
                np.minimum(low, np.where(right, before_low, after_low)).astype(np.int32),
                np.maximum(high, np.where(right, before_high, after_high)).astype(np.int32),
            )
            to = np.flatnonzero(joined)
            name[to] = mix(mix(name[to] + U64(0x9FB21C651E98DF25)) + name[to + 1] * U64(0xA24BAED4963EE407))
            size[to] += size[to + 1]
        else:
            begin = np.append(True, name[1:] != name[:-1])[: len(name)] | head
            start = np.flatnonzero(begin)
            count = np.diff(np.append(start, len(name)))
            low = np.minimum.reduceat(np.minimum(low, before_low), start).astype(np.int32)
            high = np.maximum.reduceat(np.maximum(high, after_high), start).astype(np.int32)
            joined, taken = np.zeros(len(name), bool), ~begin
            joined[start] = count > 1
            many = start[count > 1]
            name[many] = mix(mix(name[many] + U64(0x632BE59BD9B4E019)) + count[count > 1].astype(np.uint64))
            size[start] = np.add.reduceat(size, start)
            low, high = np.repeat(low, count), np.repeat(high, count)
        keep = ~taken
        name, at, size, low, high, head, joined = (x[keep] for x in (name, at, size, low, high, head, joined))
        fits = joined & (high - low <= WINDOW)
        made.append((name[fits], at[fits], size[fits], low[fits], high[fits]))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True)) if made else (names[:0], at[:0], size[:0], low[:0], high[:0])


def _code(name: np.ndarray, at: np.ndarray) -> np.ndarray:
    """34 bits of a name and 24 of a place; earlier places have greater values."""
    return (name >> U64(30)) << U64(24) | _PLACE - at.astype(np.uint64)


def _represented(best: np.ndarray, symbols: tuple[np.ndarray, ...]) -> None:
    """Raises ``best``, a value for each window, to the greatest of the symbols whose context the window holds."""
    name, at, size, low, high = symbols
    value = np.minimum(size, ENOUGH).astype(np.uint64) << U64(58) | _code(name, at)
    begin, end = np.maximum(high - WINDOW, 0), np.minimum(low, len(best) - 1)
    some = begin <= end
    value, begin, end = value[some], begin[some].astype(np.int64), end[some].astype(np.int64)
    level = np.frexp((end - begin + 1).astype(np.float64))[1] - 1
    # a range is two overlapping ones whose length is a power of two; those are halved until they are single windows
    held = np.zeros(len(best), np.uint64)
    for k in range(int(level.max(initial=0)), -1, -1):
        here = level == k
        np.maximum.at(held, begin[here], value[here])
        np.maximum.at(held, end[here] - (1 << k) + 1, value[here])
        if k:
            half = 1 << (k - 1)
            shifted = held[:-half] if half < len(held) else held[:0]
            held = held.copy()
            np.maximum(held[half:], shifted, out=held[half:])
    np.maximum(best, held, out=best)


def blocks(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First windows and numbers of windows of all blocks, and their symbols' first words and names; places in the slice."""
    n = len(w.name)
    if n > _SEGMENT + 4 * WINDOW:
        return _by_segments(w)
    start = np.arange(max(0, n - WINDOW + 1))
    start = start[start + WINDOW <= np.repeat(w.first[1:], np.diff(w.first))[: len(start)]]
    if not len(start):
        return start, start, start, w.name[:0]
    symbols = recompress(w.name, w.first)
    best = np.zeros(n - WINDOW + 1, np.uint64)
    _represented(best, symbols)
    name, at = symbols[:2]
    if not best[start].all():  # without a symbol, words represent
        place = np.arange(n, dtype=np.int32)
        single = (w.name, place, np.ones(n, np.int32), place, place + np.int32(1))
        _represented(best, single)
        name, at = np.append(name, w.name), np.append(at, place)
    which = best[start] & U64((1 << 58) - 1)
    new = np.ones(len(start), bool)
    new[1:] = (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)
    k = np.flatnonzero(new)
    which = which[k]
    symbol_at = (_PLACE - (which & _PLACE)).astype(np.int64)
    wanted = np.zeros(n, bool)
    wanted[symbol_at] = True
    some = np.flatnonzero(wanted[at])
    code = _code(name[some], at[some])
    order = np.argsort(code)
    found = name[some[order[np.searchsorted(code[order], which)]]]
    return start[k], np.diff(np.append(k, len(start))), symbol_at, found


def _by_segments(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``blocks`` of a very long slice: parts overlap by more than a window, so each sees the same symbols."""
    found = []
    for low in range(0, len(w.name), _SEGMENT):
        a, b = max(0, low - WINDOW), min(len(w.name), low + _SEGMENT + 2 * WINDOW)
        part = Words(w.data, w.offsets, w.start[a:b], w.end[a:b], w.name[a:b], np.clip(w.first, a, b) - a)
        start, n, at, name = blocks(part)
        start, at = start + a, at + a
        begin = np.maximum(start, low)
        n = np.minimum(start + n, low + _SEGMENT) - begin
        found.append((begin[n > 0], n[n > 0], at[n > 0], name[n > 0]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            w = words(part.column("text"))
            start, n, at, name = blocks(w)
            if not len(start):
                continue
            of = np.searchsorted(w.first, start, "right") - 1
            yield pa.record_batch(
                [
                    _signed(name),
                    *(_signed(Runs(x, kind)(start, start + n + WINDOW - 1, at - start)) for kind, x in _both(w)),
                    part.column("doc_id").take(pa.array(of)),
                    part.column("version").take(pa.array(of)),
                    pa.array((start - w.first[of]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                ],
                ["symbol", "block_a", "block_b", "doc_id", "version", "start", "n"],
            )


def _both(w: Words) -> Iterator[tuple[str, np.ndarray]]:
    """Two independent names of each word, by kind."""
    yield "a", w.name
    yield "b", fingerprints(w.data, w.start, w.end, "b")


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of each list item, and the items; nulls are empty."""
    n = np.asarray(column.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(column)), n), column.flatten()


def _lists(of: np.ndarray, rows: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole repeats as (start, n) couples in ``cut``; fingerprints of the windows still open."""
    for batch in batches:
        for part in slices(batch):
            w = words(part.column("text"))
            of, spans = _flat(part.column("spans"))
            start, n = (np.asarray(spans.field(x)).astype(np.int64) for x in ("start", "n"))
            decided = np.asarray(spans.field("repeat").cast(pa.int8())).astype(bool)
            cut = np.stack((start[decided], n[decided]), 1).ravel()
            of_open = np.repeat(of[~decided], n[~decided])
            n = n[~decided]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[~decided], n)
            where = w.first[of_open] + at
            columns = [part.column(x) for x in ("doc_id", "version", "text")]
            columns.append(_lists(np.repeat(of[decided], 2), len(part), cut, pa.int32()))
            for kind, x in _both(w) if len(where) else (("a", w.name), ("b", w.name)):
                columns.append(_lists(of_open, len(part), Runs(x, kind)(where, where + WINDOW).view(np.int64), pa.int64()))
            columns.append(_lists(of_open, len(part), at, pa.int32()))
            yield pa.record_batch(columns, ["doc_id", "version", "text", "cut", "key_a", "key_b", "at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            texts = part.column("text").cast(pa.large_binary()).to_pylist()
            split = [t.split() if t else [] for t in texts]
            n_words = np.fromiter(map(len, split), np.int64, len(split))
            first = np.concatenate(([0], np.cumsum(n_words)))
            cover = np.zeros(first[-1] + 1, np.int64)
            of, cut = _flat(part.column("cut"))
            cut, of = np.asarray(cut).astype(np.int64).reshape(-1, 2), of[::2]
            np.add.at(cover, first[of] + cut[:, 0], 1)
            np.add.at(cover, first[of] + cut[:, 0] + cut[:, 1] + WINDOW - 1, -1)
            of, at = _flat(part.column("repeats"))
            at = np.asarray(at).astype(np.int64)
            np.add.at(cover, first[of] + at, 1)
            np.add.at(cover, first[of] + at + WINDOW, -1)
            kept = np.cumsum(cover[:-1]) == 0
            n_kept = np.diff(np.concatenate(([0], np.cumsum(kept)))[first])
            out = [
                b" ".join(x if k == n else compress(x, kept[a : a + n].tolist()))
                for x, a, n, k in zip(split, first.tolist(), n_words.tolist(), n_kept.tolist(), strict=False)
            ]
            yield pa.record_batch(
                [*(part.column(x) for x in ("doc_id", "version")), pa.array(n_words), pa.array(n_words - n_kept), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "version", "n_words", "n_removed", "text"],
            )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that ``remove_repeats`` leaves; texts from which nothing is taken stay as they are."""
    version, kept = unused(docs, "version"), unused(docs, "kept")
    found = remove_repeats(docs).where("n_removed > 0").select("doc_id", F.col("version").alias(version), F.col("text").alias(kept)).distinct()
    keyed = docs.withColumn(version, F.xxhash64("text")).join(found.hint("merge"), ["doc_id", version], "left")
    return keyed.select(*(F.coalesce(kept, "text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, version, n_words, n_removed, text`` of each row of ``docs(doc_id, text)``; ``version``: a hash of the text.

    ``text`` keeps, joined by one space, the words that no window covers whose 50 words also start in a
    document with a smaller doc_id. Windows are judged on the input.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "substring")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    anchors = docs.where("doc_id IS NOT NULL").mapInArrow(
        _anchors, f"symbol long, block_a long, block_b long, doc_id {kind}, version long, start int, n int"
    )
    anchors = tables.store(anchors, "anchors")
    several = (F.min("block_a") < F.max("block_a")) | (F.min("block_b") < F.max("block_b"))
    symbols = anchors.groupBy("symbol").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), several.alias("several"))
    # what is joined is stored first: AQE splits hot keys only where both sides are plain exchanges
    symbols = tables.store(symbols.where("low < high").select("symbol", "several"), "symbols")
    shared = tables.store(anchors.join(symbols, "symbol"), "shared")
    tables.drop("anchors", "symbols")
    block = ["symbol", "block_a", "block_b"]
    starts = tables.store(shared.groupBy(*block).agg(F.min("doc_id").alias("home")), "starts")
    spans = (
        shared.join(starts, block)
        .where("home < doc_id OR several")
        .groupBy("doc_id", "version")
        .agg(F.collect_list(F.struct("start", "n", (F.col("home") < F.col("doc_id")).alias("repeat"))).alias("spans"))
    )
    spans = tables.store(spans, "spans")
    tables.drop("shared", "starts")
    opened = docs.join(spans.hint("merge"), ["doc_id", "version"], "left").select("doc_id", "version", "text", "spans")
    opened = opened.mapInArrow(
        _windows, f"doc_id {kind}, version long, text string, cut array<int>, key_a array<long>, key_b array<long>, at array<int>"
    )
    opened = tables.store(opened, "opened")
    tables.drop("spans")
    window = opened.select("doc_id", "version", F.explode(F.arrays_zip("key_a", "key_b", "at")).alias("w")).select("doc_id", "version", "w.*")
    homes = window.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("last")).where("home < last")
    homes = tables.store(homes.select("key_a", "key_b", "home"), "homes")
    repeats = (
        window.join(homes, ["key_a", "key_b"]).where("home < doc_id").groupBy("doc_id", "version").agg(F.collect_list("at").alias("repeats"))
    )
    repeats = tables.store(repeats, "repeats")
    tables.drop("homes")
    columns = ("doc_id", "version", "text", "cut", "repeats")
    decided = opened.where("size(at) = 0").withColumn("repeats", F.lit(None).cast("array<int>")).select(*columns)
    rest = opened.where("size(at) > 0").join(repeats.hint("merge"), ["doc_id", "version"], "left").select(*columns)
    out = f"doc_id {kind}, version long, n_words long, n_removed long, text string"
    return decided.mapInArrow(_cut, out).unionByName(rest.mapInArrow(_cut, out))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS key FROM p),
f AS (SELECT key, min(doc_id) AS home FROM k GROUP BY key),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS pos FROM k JOIN f USING (key) WHERE home < doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
