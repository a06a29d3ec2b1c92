"""Audit of how filters interact: what each filter removes at each place of each order.

Words go through a relational pipeline: a text's words are exploded, counted by (document, word), and these counts by document,
which gives the totals and the distinct words. A text never spans slices, so both aggregations run as Arrow group-bys inside the task
that has read it, and words are never shuffled; what leaves a task is one narrow row a document. Flags that need other rows
(the first document with the same text, the labels) are outer-joined, and each part's documents are counted by which of the
five filters they fail: 32 conditional counts, of all, of good and of toxic documents. All orders follow from these counts alone.

Filters, as failure conditions: A under 200 words; B ``100 * distinct < 50 * words``; C ``100 * [A-Z] > 3 * code points``; D any of
``#$%&*|``; E the text of a smaller doc_id once more.

Edge cases: a null text is empty; a null lang is the part ``''``, with the empty lang; a null doc_id is judged by A to D alone and makes no copies; rows
that repeat a doc_id with its text aren't copies of each other; labels that repeat a doc_id count as good (toxic) if any of them says so;
null labels say nothing; a very long text is read whole; an empty table has no parts and no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import slices, utf8

FILTERS, SUBSETS = "ABCDE", 32
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
SLICE = 4_000_000
_UPPER, _SYMBOL = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[list(b"#$%&*|")] = _SYMBOL
STATISTICS = "doc_id long, part string, n_words long, n_distinct long, n_upper long, n_chars long, n_symbols long, digest binary"


def word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each text: exploded, grouped by (text, word), then by text."""
    split = pc.ascii_split_whitespace(texts)
    words, of = split.flatten(), pc.list_parent_indices(split)
    exploded = pa.table([of, words.dictionary_encode().indices, pc.not_equal(pc.binary_length(words), 0)], ["text", "word", "real"])
    if pc.any(pc.invert(exploded["real"])).as_py():  # white space at an end leaves an empty word
        exploded = exploded.filter(exploded["real"])
    by_word = pa.TableGroupBy(exploded, ["text", "word"], use_threads=False).aggregate([([], "count_all")])
    by_text = pa.TableGroupBy(by_word, ["text"], use_threads=False).aggregate([("count_all", "sum"), ([], "count_all")])
    total, distinct = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    at = by_text["text"].to_numpy()
    total[at], distinct[at] = by_text["count_all_sum"].to_numpy(), by_text["count_all"].to_numpy()
    return total, distinct


def statistics(docs: DataFrame) -> DataFrame:
    """What the filters look at, a row a document (``STATISTICS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                texts = part.column("text").cast(pa.large_string()).fill_null("")
                data, offsets = utf8(texts)
                kind = _KIND[data]
                upper, symbols = (np.diff(np.searchsorted(np.flatnonzero(kind == k), offsets)) for k in (_UPPER, _SYMBOL))
                raw = memoryview(data)
                digest = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                n_words, n_distinct = word_counts(texts)
                columns = [part.column("doc_id"), part.column("part"), n_words, n_distinct, upper, pc.utf8_length(texts), symbols, digest]
                yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [x.split()[0] for x in STATISTICS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text").mapInArrow(run, STATISTICS)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, part, failed, good, toxic`` of each document; ``failed`` has a bit for each filter, A's the lowest."""
    told = Scratch(docs.sparkSession, "audit").store(statistics(docs), "statistics")
    first = told.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"))
    says = lambda column: F.max(F.coalesce(F.col(column) == 1, F.lit(False))).alias(f"is_{column}")
    labelled = labels.groupBy("doc_id").agg(says("quality"), says("toxic"))
    fails = (
        F.col("n_words") < LEAST_WORDS, 100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"), 100 * F.col("n_upper") > UPPER_PERCENT * F.col("n_chars"),
        F.col("n_symbols") > 0, F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)),
    )
    failed = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0)).alias("failed")
    joined = told.join(first, "digest", "left").join(labelled, "doc_id", "left")
    return joined.select("doc_id", "part", failed, F.coalesce("is_quality", F.lit(False)).alias("good"), F.coalesce("is_toxic", F.lit(False)).alias("toxic"))


def audit(judged: DataFrame) -> DataFrame:
    """Kept, removed and lost documents at each step of all orders, by part, from ``failures``."""

    def counted(name: str, also: Column) -> list[Column]:
        return [F.count_if((F.col("failed") == k) & also).alias(f"{name}{k}") for k in range(SUBSETS)]

    wanted = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = judged.groupBy("part").agg(*(x for name, also in wanted.items() for x in counted(name, also)))
    counts = counts.select("part", *(F.array(*(f"{name}{k}" for k in range(SUBSETS))).alias(name) for name in wanted))
    orders = F.array(*(F.lit("".join(x)) for x in permutations(FILTERS)))
    steps = counts.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord("A"))
    earlier = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("at")), F.lit(0), lambda x, letter: x.bitwiseOR(bit(letter)))
    steps = steps.withColumns({"own": bit(F.col("letter")), "earlier": earlier})
    own, before = F.col("own"), F.col("earlier")

    def total(which, name: str = "n", times=lambda k: F.lit(1)) -> Column:
        of = F.filter(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), which)
        return F.aggregate(of, F.lit(0).cast("long"), lambda x, k: x + F.get(F.col(name), k) * times(k))

    fails = lambda k: k.bitwiseAND(own) != 0
    gone = lambda k: k.bitwiseAND(before) != 0
    removed = lambda k: fails(k) & ~gone(k)
    n_orders = len(list(permutations(FILTERS)))
    return steps.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"),
        total(lambda k: ~fails(k) & ~gone(k)).alias("kept"), total(removed).alias("removed"), total(lambda k: fails(k) & gone(k)).alias("redundant"),
        total(lambda k: k == own).alias("unique_fails"), total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"),
        # of a document's failed filters each comes first in equally many orders
        total(fails, times=lambda k: F.floor(F.lit(n_orders) / F.bit_count(k)).cast("long")).alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(failures(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP12_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
says AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS first FROM words GROUP BY text),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(first < doc_id, false)::INT AS failed
  FROM words JOIN firsts USING (text) LEFT JOIN says USING (doc_id)),
letters AS (SELECT chr(65 + k::INT) AS l, 1 << k::INT AS own FROM range(5) r(k)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.own, b.own, c.own, d.own, e.own] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.own + b.own + c.own + d.own + e.own = 31),
steps AS (SELECT filter_order, s::INT AS step, bits[s] AS own, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS earlier FROM orders, range(1, 6) r(s)),
tallies AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY ALL)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (failed & (own | earlier) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (failed & own <> 0 AND failed & earlier = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (failed & own <> 0 AND failed & earlier <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (failed & own <> 0 AND failed & earlier = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (failed & own <> 0 AND failed & earlier = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(failed), 1))) FILTER (failed & own <> 0), 0)::BIGINT AS shapley
FROM tallies, steps GROUP BY part, filter_order, step
"""
