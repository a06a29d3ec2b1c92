"""Phrase collocations from depth-limited count tries.

Each task reads slices of one language (shards): pieces, words, and the shard's own dictionary. Depth one is merged first, from dictionaries cut
by ranges of their words' names: a phrase with a word that occurs less than ``LEAST`` times can't reach that count itself, so each shard gets back, for its
own dictionary alone, which of its words do, with their numbers. Over runs of such words it builds its trie of two to ``DEPTH`` words as
sorted paths with counts. Tries are serialised sorted, a path as what it doesn't share with the one before, and cut by prefix ranges: a path's
place on the language's line is found as in arithmetic coding (each word takes its share of its predecessor's interval), so
ranges hold similar shares of all occurrences, however common a first word is. Each range is merged from all shards' cuts, and counts of its
nodes are sums over paths. Only nodes on the path of a range's first or last row may go on in another range; their counts are added up afterwards.

Left parts of a phrase are met on the walk from the root to it, in order of paths; right parts are found by suffix links (a join with
the nodes that spell the rest). Counts and scores are exact: products are decimals of 38 digits.

Edge cases: a null or empty text has no words; a null lang is ``und``, with any lang of that name; doc_ids don't matter; repeated rows count again; texts are
read whole, a very long one as a shard of its own; equal scores and counts are ordered by phrase; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from .scratch import Scratch
from .textops import fingerprints, slices, utf8

DEPTH, LEAST, TOP = 5, 100, 2000
SLICE = 12_000_000
#: Occurrences in a prefix range, and rows that are merged at a time.
RANGE, MERGE = 1 << 21, 1 << 19
LINE = float(1 << 50)
SALTS = 64
_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Entries of dictionaries in a range of words.
WORDS = 1 << 20
SHARDS = "shard long, lang string, n_words long, n_distinct long, words array<string>, counts array<int>, stream binary, ranks binary"
SEGMENTS = "lang string, n long, range int, shared binary, depth binary, ids binary, counts binary"
ENTRIES = "lang string, range int, shard long, start int, words binary, counts binary"
FOUND = "lang string, range int, shard long, words array<string>, counts array<long>, places binary, numbers binary, count binary, before binary"
NODES = "lang string, n long, path array<int>, f long"


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in little space: their first bytes, their second bytes and so on, compressed."""
    size = values.dtype.itemsize
    return ZstdCompressor(level=1).compress(bytes([size]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = ZstdDecompressor().decompress(data)
    size = raw[0]
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(size, -1).T).view(f"<i{size}").reshape(-1)


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places, the number of each item's name, and counts of distinct couples of names."""
    _, first, inverse, counts = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
    if not np.array_equal(b[first][inverse], b):
        _, first, inverse, counts = np.unique(np.stack((a, b), 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse.reshape(-1), counts


def shard(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words in order of their names, their counts, the words in order by rank (the most frequent is 0; those that begin a piece as their
    complement ``~k``), and the rank of each distinct word."""
    data, offsets = utf8(texts)
    data = _LOWER[data]
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kind == 0
    edge = np.diff(inside)
    begins, ends = edge[:-1] == 1, edge[1:] == -1
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    whole = kind == 0
    begins[cut], ends[cut - 1] = whole[cut], whole[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return pa.array([], pa.string()), *(np.zeros(0, np.int32) for _ in range(3))
    first, number, counts = distinct(fingerprints(data, start, end, "a"), fingerprints(data, start, end, "b"))
    piece = np.searchsorted(np.flatnonzero(kind == _BREAK), start) + np.searchsorted(offsets[1:], start, "right")
    new = np.concatenate(([True], piece[1:] != piece[:-1]))
    ranks = np.empty(len(counts), np.int32)
    ranks[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    number = ranks[number]
    stream = np.where(new, ~number, number)
    size = (end - start)[first]
    stop = np.cumsum(size)
    raw = data[np.repeat(start[first] - (stop - size), size) + np.arange(stop[-1])]
    words = pa.LargeBinaryArray.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.concatenate(([0], stop)).astype(np.int64)), pa.py_buffer(raw)])
    return words.cast(pa.string()), counts.astype(np.int32), stream, ranks


def shards(docs: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in SHARDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in gathered(batches):
            for rows in slices(batch, limit=SLICE):
                for lang in pc.unique(rows.column("lang")).to_pylist():
                    words, counts, stream, ranks = shard(rows.filter(pc.equal(rows.column("lang"), lang)).column("text"))
                    if len(stream):
                        columns = [[(part << 32) + k], [lang], [len(stream)], [len(words)], pa.ListArray.from_arrays([0, len(words)], words), pa.ListArray.from_arrays([0, len(counts)], pa.array(counts)), [packed(stream)], [packed(ranks)]]
                        yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)
                        k += 1

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, SHARDS)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches together, until they have a slice of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if sum(b.num_rows for b in batches) else batches[0]


def groups(batches: Iterator[pa.RecordBatch], names: list[str], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns, the rest of each row by it."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if row[:n_keys] != key:
                if held:
                    yield key, held
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield key, held


def entries(read: DataFrame, ranges: int) -> DataFrame:
    """The shards' dictionaries, cut by ranges of the words' names."""
    names = [x.split()[0] for x in ENTRIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard_, lang = batch.column("shard")[k].as_py(), batch.column("lang")[k].as_py()
                words, counts = batch.column("words")[k].values, batch.column("counts")[k].values.to_numpy()
                data, offsets = utf8(words)
                of = ((fingerprints(data, offsets[:-1], offsets[1:], "a") >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)])).tolist()
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    body = pc.binary_join(pa.ListArray.from_arrays([0, b - a], words.slice(a, b - a)), " ")[0].as_py()
                    rows.append((lang, int(of[a]), shard_, a, ZstdCompressor(level=1).compress(body.encode()), packed(counts[a:b])))
                for j in range(0, len(rows), 64):
                    columns = [pa.array(x, pa.int32() if c in ("range", "start") else None) for c, x in zip(names, zip(*rows[j : j + 64], strict=True), strict=True)]
                    yield pa.record_batch(columns, names)

    return read.select("shard", "lang", "words", "counts").mapInArrow(run, ENTRIES)


def frequent(dictionaries: DataFrame, least: int) -> DataFrame:
    """For each range its words that occur ``least`` times with their counts, in order, and for each shard where its dictionary has them (``places``),
    which of the range's words they are (``numbers``), their counts, and the counts of the range's words before them."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 4]
    read = [x.split()[0] for x in ENTRIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, k), rows in groups(batches, read, 2):
            parts = [pc.split_pattern(pa.array([ZstdDecompressor().decompress(words)]).cast(pa.string()), " ").flatten() for _, _, words, _ in rows]
            encoded = pa.concat_arrays(parts).dictionary_encode()
            code, size = encoded.indices.to_numpy(), np.array([len(p) for p in parts])
            total = np.bincount(code, np.concatenate([unpacked(counts) for *_, counts in rows]).astype(np.float64), len(encoded.dictionary)).astype(np.int64)
            kept = np.flatnonzero(total >= least)
            if not len(kept):
                continue
            words = encoded.dictionary.take(pa.array(kept))
            order = pc.sort_indices(words).to_numpy()
            kept, words = kept[order], words.take(pa.array(order))
            number = np.full(len(total), -1, np.int32)
            number[kept] = np.arange(len(kept))
            count = total[kept]
            before = np.cumsum(count) - count
            out = [(lang, k, None, words.to_pylist(), count.tolist(), None, None, None, None)]
            ends = np.cumsum(size)
            for (shard_, start, *_), a, b in zip(rows, (ends - size).tolist(), ends.tolist(), strict=True):
                here = number[code[a:b]]
                at = np.flatnonzero(here >= 0)
                if len(at):
                    out.append((lang, k, shard_, None, None, packed((at + start).astype(np.int32)), packed(here[at]), packed(count[here[at]]), packed(before[here[at]])))
            for j in range(0, len(out), 256):
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out[j : j + 256], strict=True), kinds, strict=True)], names)

    return dictionaries.repartition("lang", "range").sortWithinPartitions("lang", "range", "shard").mapInArrow(run, FOUND)


def paths(stream: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The runs of up to ``DEPTH`` frequent words (two at least) that begin at each word; -1 fills them up."""
    new, word = stream < 0, number[np.where(stream < 0, ~stream, stream)]
    n = len(word)
    out = np.full((n, DEPTH), -1, np.int32)
    out[:, 0] = word
    for d in range(1, min(DEPTH, n)):
        out[: n - d, d] = np.where(~new[d:] & (out[: n - d, d - 1] >= 0), word[d:], -1)
    return out[out[:, 1] >= 0]


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct paths and the sums of their counts."""
    if not len(rows):
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(1))))
    return rows[first], np.add.reduceat(counts, first)


def places(rows: np.ndarray, before: np.ndarray, share: np.ndarray, total: float) -> np.ndarray:
    """Where each path lies on a line of length ``LINE``: in whole numbers, so intervals of children lie one after the other within their parent's."""
    low, width = np.zeros(len(rows)), np.full(len(rows), LINE)
    for d in range(rows.shape[1]):
        here = rows[:, d] >= 0
        word = np.where(here, rows[:, d], 0)
        left, right = np.floor(width * (before[word] / total)), np.floor(width * ((before[word] + share[word]) / total))
        low, width = low + np.where(here, left, 0), np.where(here, right - left, 0)
    return low


def serialised(rows: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Sorted paths as how many words they share with the one before, how many they have, the other words, and counts."""
    depth = (rows >= 0).sum(1)
    same = np.zeros(len(rows), np.int64)
    same[1:] = np.minimum(np.cumprod(rows[1:] == rows[:-1], 1).sum(1), depth[1:])
    at = np.arange(rows.shape[1])
    fresh = (at >= same[:, None]) & (at < depth[:, None])
    return packed(same.astype(np.int8)), packed(depth.astype(np.int8)), packed(rows[fresh].astype("<i4")), packed(counts.astype("<i8"))


def restored(shared: bytes, depth: bytes, ids: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    same, deep = unpacked(shared), unpacked(depth)
    at = np.arange(DEPTH)
    fresh, held = (at >= same[:, None]) & (at < deep[:, None]), at < deep[:, None]
    rows = np.full((len(same), DEPTH), -1, np.int32)
    rows[fresh] = unpacked(ids)
    for d in range(DEPTH):  # a shared word is that of the last path that brought one
        source = np.maximum.accumulate(np.where(same <= d, np.arange(len(same)), 0))
        rows[:, d] = np.where(held[:, d], rows[source, d], -1)
    return rows, unpacked(counts)


def tries(known: DataFrame, size: int = RANGE) -> DataFrame:
    """The shards' tries by prefix ranges of about ``size`` occurrences; known: shards with ``known``, their frequent words, and the language's totals."""
    names = [x.split()[0] for x in SEGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lang, n, n_frequent, n_distinct = (batch.column(c)[k].as_py() for c in ("lang", "n", "n_frequent", "n_distinct"))
                stream, ranks = (unpacked(batch.column(c)[k].as_py()) for c in ("stream", "ranks"))
                known = batch.column("known")[k].as_py()
                parts = [[unpacked(x[c]) for c in ("places", "numbers", "count", "before")] for x in known]
                at, number, count, before = (np.concatenate([p[j] for p in parts]).astype(np.int64) for j in range(4))
                number += np.repeat([x["first"] for x in known], [len(p[0]) for p in parts])
                before += np.repeat([x["base"] for x in known], [len(p[0]) for p in parts])
                order = np.argsort(number)  # the language's order of words, as numbers of this shard's own
                here = np.full(n_distinct, -1, np.int32)
                here[ranks[at[order]]] = np.arange(len(order))
                rows = paths(stream, here)
                rows, counts = summed(rows, np.ones(len(rows), np.int64))
                if not len(rows):
                    continue
                before, count, number = before[order].astype(float), count[order].astype(float), number[order].astype(np.int32)
                ranges = max(1, -(-n_frequent // size))
                of = np.minimum(places(rows, before, count, float(n_frequent)) * ranges // LINE, ranges - 1).astype(np.int32)
                rows = np.where(rows >= 0, number[rows], -1)
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(rows)])).tolist()
                segments = [(lang, n, int(of[a]), *serialised(rows[a:b], counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                for j in range(0, len(segments), 64):
                    yield pa.record_batch([pa.array(x, pa.int32() if c == "range" else None) for c, x in zip(names, zip(*segments[j : j + 64], strict=True), strict=True)], names)

    return known.mapInArrow(run, SEGMENTS)


def nodes(rows: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Paths of each depth with their counts: those that reach ``least``, and those that may go on in another range."""
    for d in range(2, DEPTH + 1):
        here = np.flatnonzero(rows[:, d - 1] >= 0)
        if not len(here):
            continue
        part = rows[here, :d]
        first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]).any(1))))
        f, part = np.add.reduceat(counts[here], first), part[first]
        edge = (part == rows[0, :d]).all(1) | (part == rows[-1, :d]).all(1)
        kept = (f >= least) | edge
        yield part[kept], f[kept]


def merged(segments: DataFrame, least: int) -> DataFrame:
    """Counts of the tries' nodes from all shards' segments; a node that two ranges share comes from each of them."""
    names = [x.split()[0] for x in NODES.split(", ")]

    def told(lang: str, n: int, rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part, f in nodes(rows, counts, least):
            for k in range(0, len(f), 65536):
                some, size = part[k : k + 65536], len(f[k : k + 65536])
                path = pa.ListArray.from_arrays(np.arange(0, some.size + 1, some.shape[1]), pa.array(some.reshape(-1)))
                yield pa.record_batch([pa.array([lang] * size), pa.array(np.full(size, n)), path, pa.array(f[k : k + 65536])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, whole, held, waiting = None, None, [], 0

        def merge():
            rows, counts = (np.concatenate(x) for x in zip(*([whole] if whole else []), *held, strict=True))
            return summed(rows, counts)

        for batch in batches:
            for lang, n, k, *blobs in zip(*(batch.column(c).to_pylist() for c in SEGMENT_COLUMNS), strict=True):
                if at is not None and at[::2] != (lang, k):
                    yield from told(at[0], at[1], *merge())
                    whole, held, waiting = None, [], 0
                at = (lang, n, k)
                held.append(restored(*blobs))
                waiting += len(held[-1][0])
                if waiting >= max(MERGE, len(whole[0]) if whole else 0):
                    whole = merge()
                    held, waiting = [], 0
        if at is not None:
            yield from told(at[0], at[1], *merge())

    return segments.repartition("lang", "range").sortWithinPartitions("lang", "range").mapInArrow(run, NODES)


SEGMENT_COLUMNS = [x.split()[0] for x in SEGMENTS.split(", ")]


def walked(phrases: DataFrame) -> DataFrame:
    """Adds ``left``, the counts of a path's prefixes from one word on, met on the way down to it."""
    schema = "lang string, n long, path array<int>, f long, left array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, stack = None, []
        for batch in batches:
            left = []
            for name, path, f in zip(*(batch.column(c).to_pylist() for c in ("lang", "path", "f")), strict=True):
                if name != lang:
                    lang, stack = name, []
                del stack[len(path) - 1 :]
                left.append(list(stack))
                stack.append(f)
            yield pa.record_batch([*batch.columns, pa.array(left, pa.list_(pa.int64()))], [*batch.schema.names, "left"])

    # all prefixes of a path begin with its first word and come before it
    return phrases.repartition("lang", F.col("path")[0]).sortWithinPartitions("lang", "path").mapInArrow(run, schema)


def numbered(docs: DataFrame, tables: Scratch, least: int) -> tuple[DataFrame, ...]:
    """The shards, what each has of the frequent words, where each range's words begin, the words ``lang, number, word, count``, and the languages' totals."""
    read = tables.store(shards(docs), "shards")
    ranges = max(1, -(-(read.agg(F.sum("n_distinct")).first()[0] or 0) // WORDS))
    found = tables.store(frequent(entries(read, ranges), least), "frequent")
    held = found.where("shard IS NULL")
    sizes = held.select("lang", "range", F.size("words").cast("long").alias("own"), F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum"))
    earlier = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    zero = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0).cast("long"))
    firsts = tables.store(sizes.select("lang", "range", zero("own").alias("first"), zero("sum").alias("base")), "firsts")
    words = held.join(firsts.select("lang", "range", "first"), ["lang", "range"]).select("lang", "first", F.posexplode(F.arrays_zip("words", "counts")).alias("k", "w"))
    words = words.select("lang", (F.col("first") + F.col("k")).cast("int").alias("number"), F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    totals = read.groupBy("lang").agg(F.sum("n_words").alias("n")).join(sizes.groupBy("lang").agg(F.sum("sum").alias("n_frequent")), "lang")
    return read, found, firsts, words, totals


def counted(docs: DataFrame, tables: Scratch, least: int, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Frequent words ``lang, word, number``, and frequent phrases ``lang, n, path, f`` of one to ``DEPTH`` words."""
    read, found, firsts, words, totals = numbered(docs, tables, least)
    told = found.where("shard IS NOT NULL").join(firsts, ["lang", "range"])
    own = told.groupBy("shard").agg(F.collect_list(F.struct("places", "numbers", "count", "before", "first", "base")).alias("known"))
    language = read.select("shard", "lang").join(totals, "lang").select("shard", "n", "n_frequent")
    known = read.select("shard", "lang", "stream", "ranks", "n_distinct").join(own, "shard").join(language, "shard")
    paths_ = merged(tries(known.select("lang", "n", "n_frequent", "n_distinct", "stream", "ranks", "known"), size), least)
    paths_ = paths_.groupBy("lang", "path").agg(F.max("n").alias("n"), F.sum("f").alias("f")).where(F.col("f") >= least).select("lang", "n", "path", "f")
    single = words.join(totals, "lang").select("lang", "n", F.array("number").alias("path"), F.col("count").alias("f"))
    return words.select("lang", "word", "number"), tables.store(paths_.unionByName(single), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, size: int = RANGE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of ``docs(lang, text)``."""
    tables = Scratch(docs.sparkSession, "collocations")
    words, phrases = counted(docs, tables, least, size)
    linked = phrases.select("lang", F.col("path").alias("rest"), F.col("f").alias("r"))
    cuts = walked(phrases).where(F.size("path") > 1).select("*", F.posexplode("left").alias("k", "l"))
    cuts = cuts.withColumn("rest", F.slice("path", F.col("k") + 2, DEPTH)).join(linked, ["lang", "rest"])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (whole("f") * whole("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"), whole("l") * whole("r"))
    best = cuts.groupBy("lang", "path").agg(F.max("n").alias("n"), F.max("f").alias("f"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # a longer phrase with the same count covers all in between, so those with one word more decide
    longer = phrases.where(F.size("path") > 2).select("lang", "f", F.explode(F.array(F.expr("slice(path, 1, size(path) - 1)"), F.slice("path", 2, DEPTH))).alias("path"))
    longer = longer.groupBy("lang", "path").agg(F.max("f").alias("most"))
    kept = best.join(longer, ["lang", "path"], "left").where("most IS NULL OR most < f").select("lang", "path", "n", "f", "cut")
    spelled = kept.select("*", F.posexplode("path").alias("at", "number")).join(words, ["lang", "number"])
    spelled = spelled.groupBy("lang", "path").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"), *(F.first(c).alias(c) for c in ("n", "f", "cut")))
    rows = spelled.select("lang", F.array_join("words.word", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
totals AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
grams AS (SELECT lang, w[i:i + d - 1] AS p, d FROM starts, (SELECT unnest(range(1, 6)) AS d) WHERE i + d - 1 <= len(w)),
counts AS (SELECT lang, p, d, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.p, c.d, c.f AS a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM counts c, (SELECT unnest(range(1, 5)) AS k), counts l, counts r, totals t
  WHERE c.d > 1 AND k < c.d AND l.lang = c.lang AND l.p = c.p[1:k] AND r.lang = c.lang AND r.p = c.p[k + 1:c.d] AND t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (
  SELECT DISTINCT o.lang, o.p[i:i + m - 1] AS p, o.f
  FROM counts o, (SELECT unnest(range(2, 5)) AS m), (SELECT unnest(range(1, 5)) AS i) WHERE m < o.d AND i + m - 1 <= o.d),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (FROM inner_parts x WHERE x.lang = b.lang AND x.p = b.p AND 100 * x.f >= 100 * b.a)),
spelled AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM spelled QUALIFY rank <= 2000
"""
