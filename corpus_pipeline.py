"""The corpus pipeline: five operators in a row, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` and the checks write it as Parquet and read it again as
the next one's ``docs``. All but the last return the columns of ``documents``.

Edge cases, alike in all stages: an empty table gives an empty one; further columns come through as they are, whatever their names; nulls in any
column but ``text`` don't matter; very long texts are read whole; results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import byte_bpe, mixing, ngram_join, quality_rules, substring_dedup
from rosterlake.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; thresholds come from the table ``labels``.

    A null or empty text has no words and goes; repeated rows, and rows that tie, are judged alike; without labels the base rule decides alone."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least doc_id.

    Texts without words and rows without doc_id stay; rows that repeat a doc_id with its text stay together."""
    return ngram_join.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a document with a smaller doc_id has; texts of which nothing is left go.

    So do null and empty texts; rows without doc_id neither lose words nor cause losses; equal doc_ids are one document."""
    columns = [F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return substring_dedup.without_repeats(docs).where("length(text) > 0").select(*columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in the wanted shares; documents occur as often as the mix takes them.

    A null source is a source; texts without words aren't taken; equal rows share their copies; ties are drawn by hash, so reruns agree."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text they decode to; a null text has no ids, repeated rows come as often as they are there."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=False)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mixed),
    ("byte-level BPE", tokens),
]

#: SQL can express neither the isolation forest's verdicts nor the rounding's draws nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        docs = tables.store(done, f"stage{k}")
        if k:
            tables.drop(f"stage{k - 1}")
    return docs
