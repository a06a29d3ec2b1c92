"""Quality rules: an isolation forest on rule statistics.

One scan gives each text's counts. Their ratios (``FEATURES``) feed isolation forests: each tree splits a
small sample by random features at random values until rows stand alone; a row that few splits isolate is an
outlier, with score ``2 ** (-mean path length / expected length)``. One forest sees all features and one each
sees a single feature, as what is rare isn't equally bad in each of them. The samples are the trees' own parameter
(``TREES * SAMPLE`` rows with the least keyed hashes of doc_id and text); all rows are scored. Each forest's
threshold comes from the labelled rows that pass the base rule, but for one document of ``HELD_OUT``, chosen by hash, whose
labels are left to measure by: their scores are counted in ``BINS`` bins by label, and the threshold is the bin edge that rejects the most low-quality rows while at most
``SPARED`` of the good ones go. Forests and bin counts are of fixed size, whatever the input.

Edge cases: a null text has no words; texts without words have ratios 0 and fail the base rule; nothing to
fit on (an empty table) or no good labels leaves the base rule alone; several labels of one doc_id count each;
labels that are null are left out; repeated rows get equal verdicts, and so do rows that tie in their ratios; rows without
doc_id are scored; a very long text is counted whole, with memory in proportion to its length; further columns are
ignored, whatever their names (``keep`` returns them as they came).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import U64, fingerprints, grams, mix, slices, words

#: The characters counted by ``n_symbols``.
SYMBOLS = "#*$%&|<>"
TREES, SAMPLE, BINS, SPARED = 64, 256, 512, 0.0002
#: Bytes of text that are counted at a time, and one of how many labelled documents takes no part in the calibration.
SLICE, HELD_OUT = 1 << 19, 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols a word", "characters a word", "repeated lines a word", "share of repeated words")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def _repeated(of: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items (in order of ``of``): whether an equal one exists, and whether an earlier one does, in the same text."""
    key = mix(names ^ mix(of.astype(np.uint64) + U64(1)))
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][equal]] = True
    any_[order[1:][equal]] = True
    any_[order[:-1][equal]] = True
    return any_, later


def counts_of(part: pa.RecordBatch) -> list[np.ndarray]:
    """The counts of each row of a slice."""
    w = words(part.column("text"))
    n_words = np.diff(w.first)
    of = w.of
    edges = np.zeros(len(w.data) + 1, np.int32)
    edges[w.start] += 1
    edges[w.end] -= 1
    in_word = np.cumsum(edges[:-1]) > 0
    chars = _per_text(in_word & ((w.data & 0xC0) != 0x80), w.offsets)
    symbols = _per_text(_IS_SYMBOL[w.data], w.offsets)
    # lines: from each text's start or line feed to the next, where words are in between
    feeds = np.flatnonzero(w.data == 10)
    begin = np.union1d(w.offsets[:-1][np.diff(w.offsets) > 0], feeds + 1)
    begin = begin[begin < len(w.data)]
    end = np.append(begin[1:], len(w.data)) if len(begin) else begin
    end = end - (w.data[end - 1] == 10)
    with_word = np.searchsorted(w.start, begin) < np.searchsorted(w.start, end)
    begin, end = begin[with_word], end[with_word]
    line_of = np.searchsorted(w.offsets, begin, "right") - 1
    _, later = _repeated(line_of, fingerprints(w.data, begin, end))
    dup_lines = np.bincount(line_of[later], minlength=len(part))
    # three-word windows
    at = np.flatnonzero(np.arange(len(of)) + 3 <= w.first[1:][of]) if len(of) else np.zeros(0, np.int64)
    any_, _ = _repeated(of[at], grams(w.name, 3)[at])
    cover = np.zeros(len(of) + 1, np.int64)
    np.add.at(cover, at[any_], 1)
    np.add.at(cover, at[any_] + 3, -1)
    repeats = _per_text(np.cumsum(cover[:-1]) > 0, w.first)
    return [np.asarray(x, np.int64) for x in (n_words, chars, symbols, dup_lines, repeats)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            yield pa.record_batch([part.column("doc_id"), part.column("key"), *map(pa.array, counts_of(part))], ["doc_id", "key", *COUNTS])


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id, key`` (a hash of both columns) and the counts of each row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    return keyed.mapInArrow(_counts, f"doc_id {kind}, key long, " + ", ".join(f"{x} long" for x in COUNTS))


def features(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) -> np.ndarray:
    n = np.maximum(np.asarray(n_words, float), 1)
    return np.stack([np.asarray(x, float) / n for x in (n_symbols, word_chars, n_dup_lines, n_repeat_words)], 1)


def _path(n: np.ndarray | int) -> np.ndarray:
    """Expected path length among n rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n > 1.5, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: split feature (-1: leaf), split value, children; a leaf's value is its path length."""

    feature: list[np.ndarray]
    value: list[np.ndarray]
    child: list[np.ndarray]
    expected: float

    @classmethod
    def fit(cls, samples: list[np.ndarray], seed: int = 7) -> Forest:
        out = cls([], [], [], float(_path(max([len(x) for x in samples], default=1))))
        rng = np.random.Generator(np.random.PCG64(seed))
        deepest = int(np.ceil(np.log2(max(2, SAMPLE))))
        for rows in samples:
            feature, value, child = [], [], []
            todo = [(rows, 0, -1, 0)]
            while todo:
                x, depth, parent, side = todo.pop()
                if parent >= 0:
                    child[parent][side] = len(feature)
                low, high = x.min(0), x.max(0)
                free = np.flatnonzero(high > low)
                if depth >= deepest or not len(free):
                    feature.append(-1)
                    value.append(depth + float(_path(len(x))))
                    child.append([0, 0])
                    continue
                f = int(rng.choice(free))
                at = float(rng.uniform(low[f], high[f]))
                feature.append(f)
                value.append(at)
                child.append([0, 0])
                todo += [(x[x[:, f] <= at], depth + 1, len(feature) - 1, 0), (x[x[:, f] > at], depth + 1, len(feature) - 1, 1)]
            out.feature.append(np.array(feature))
            out.value.append(np.array(value))
            out.child.append(np.array(child))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, value, child in zip(self.feature, self.value, self.child, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                open_ = np.flatnonzero(feature[node] >= 0)
                if not len(open_):
                    break
                k = node[open_]
                node[open_] = child[k, (x[open_, feature[k]] > value[k]).astype(np.int64)]
            total += value[node]
        return 2.0 ** (-total / max(1, len(self.feature)) / max(self.expected, 1e-9))


def fit(rows: DataFrame) -> list[Forest]:
    """A forest of all features and one of each, on ``TREES * SAMPLE`` rows of ``counts`` at most, the ones with the least keyed hashes."""
    # hashes far above the wanted ones are left out first, so what tasks send doesn't grow with their number
    near = min(1.0, 1.5 * TREES * SAMPLE / max(1, rows.count()))
    few = rows.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30)) <= int(near * (1 << 30))).select("key", *COUNTS)
    few = few.orderBy(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30)), "key", *COUNTS).limit(TREES * SAMPLE).toPandas()
    if not len(few):
        return []
    x = features(*(few[c] for c in COUNTS))
    n = max(1, min(TREES, len(x) // 32))
    samples = [x[k::n][:SAMPLE] for k in range(n)]
    single = [[np.where(np.arange(x.shape[1]) == f, s, 0.0) for s in samples] for f in range(x.shape[1])]
    return [Forest.fit(s) for s in (samples, *single)]


def score(rows: DataFrame, forests: list[Forest]) -> DataFrame:
    """Adds ``scores``, one of each forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*(batch.column(c).to_numpy() for c in COUNTS))
            found = np.stack([f.score(x) for f in forests], 1)
            ends = pa.array(np.arange(0, found.size + 1, len(forests), dtype=np.int32))
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], [*batch.schema.names, "scores"])

    return rows.mapInArrow(run, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema) + ", scores array<double>")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's labels are left to measure verdicts by."""
    return F.pmod(F.xxhash64(doc_id, F.lit(21)), F.lit(HELD_OUT)) == 0


def calibrate(scored: DataFrame, labels: DataFrame, forests: int) -> list[float]:
    """For each forest, the score from which on a row goes."""
    known = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & ~held_out())
    labelled = scored.where("NOT base_failed").select("doc_id", "scores").join(known, "doc_id")
    each = labelled.select("quality", F.posexplode("scores").alias("forest", "score"))
    bins = each.groupBy("forest", F.floor(F.col("score") * BINS).alias("bin")).agg(
        F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad")
    )
    good, bad = np.zeros((forests, BINS + 2)), np.zeros((forests, BINS + 2))
    for row in bins.collect():  # BINS + 1 rows for each forest at most
        good[row["forest"], row["bin"]], bad[row["forest"], row["bin"]] = row["good"], row["bad"]
    limits = []
    for g, b in zip(good, bad, strict=True):
        above_good, above_bad = g[::-1].cumsum()[::-1], b[::-1].cumsum()[::-1]
        edges = [k for k in range(BINS + 2) if above_good[k] <= SPARED * g.sum()] if g.sum() else [BINS + 1]
        alike = [k for k in edges if above_bad[k] == max(above_bad[j] for j in edges)]
        limits.append((alike[0] + alike[-1]) // 2 / BINS)  # in the middle of the gap between good and bad rows
    return limits


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, key``, the counts, ``scores, base_failed, kept`` of each row of ``docs(doc_id, text)``."""
    tables = Scratch(docs.sparkSession, "quality")
    rows = tables.store(counts(docs), "counts")
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    forests = fit(rows)
    if not forests:
        return rows.withColumns({"scores": F.array(F.lit(0.0)), "base_failed": base, "kept": ~base})
    scored = tables.store(score(rows, forests).withColumn("base_failed", base), "scored")
    tables.drop("counts")
    limits = F.array(*map(F.lit, calibrate(scored, labels, len(forests))))
    odd = F.exists(F.zip_with("scores", limits, lambda x, limit: F.floor(x * BINS) >= limit * BINS), lambda x: x)
    return scored.withColumn("kept", ~F.col("base_failed") & ~odd)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text, ..)`` that ``judge`` keeps, judged again in one scan: no text is shuffled."""
    tables = Scratch(docs.sparkSession, "quality")
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    rows = tables.store(counts(docs), "counts")
    forests = fit(rows)
    limits = calibrate(score(rows, forests).withColumn("base_failed", base), labels, len(forests)) if forests else []
    tables.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                found = counts_of(part)
                kept = (found[0] >= 50) & (100 * found[4] <= 50 * found[0])
                x = features(*found)
                for forest, limit in zip(forests, limits, strict=True):
                    kept &= np.floor(forest.score(x) * BINS) < limit * BINS
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    return judge(docs, labels).select("doc_id", *COUNTS, "base_failed", "kept", "scores")
