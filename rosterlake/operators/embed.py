"""Embeddings: pluggable encoders, kept by model, made again only where something changed.

An encoder is a callable from a list of texts to rows of numbers; queries and passages have their prefixes. The default one hashes words into
signed buckets, so that vectors are the same everywhere.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is put before texts, and the size of the default vectors.
QUERY, PASSAGE, SIZE = "query: ", "passage: ", 64
Encoder = Callable[[list[str]], list[list[float]]]


def hashing_encoder(texts: list[str]) -> list[list[float]]:
    """Counts of words' stems by hash, half of them negative, as unit vectors."""
    out = []
    for value in texts:
        row = [0.0] * SIZE
        for word in re.findall(r"\w{2,}", value.lower()):
            h = zlib.crc32(word[:5].encode())
            row[h % SIZE] += 1.0 if h >> 31 else -1.0
        out.append(row)
    return out


def unit(row: list[float]) -> list[float]:
    norm = math.sqrt(sum(x * x for x in row))
    return [x / norm for x in row] if norm else list(row)


def embed(passages: DataFrame, model: str = "hashing", encoder: Encoder = hashing_encoder, batch: int = 64) -> DataFrame:
    """``doc_id, model, hash, embedding`` (of length 1) of ``passages(doc_id, passage)``; ``hash``: of the passage."""

    def run(batches):
        for rows in batches:
            texts, found = [PASSAGE + (x or "") for x in rows["passage"]], []
            for k in range(0, len(texts), batch):
                found += [unit(list(map(float, x))) for x in encoder(texts[k : k + batch])]
            yield rows.assign(embedding=found)

    kind = passages.schema["doc_id"].dataType.simpleString()
    rows = passages.select("doc_id", F.lit(model).alias("model"), F.sha1(F.coalesce("passage", F.lit(""))).alias("hash"), "passage")
    found = rows.mapInPandas(run, f"doc_id {kind}, model string, hash string, passage string, embedding array<float>")
    return found.select("doc_id", "model", "hash", "embedding")


def query_vector(query: str, encoder: Encoder = hashing_encoder) -> list[float]:
    return unit(list(map(float, encoder([QUERY + query])[0])))


def missing(passages: DataFrame, held: DataFrame, model: str) -> DataFrame:
    """``passages`` that have no vector of this model, or one of an older text."""
    known = held.where(F.col("model") == model).select("doc_id", "hash")
    hashed = passages.withColumn("hash", F.sha1(F.coalesce("passage", F.lit(""))))
    return hashed.join(known, ["doc_id", "hash"], "left_anti").drop("hash")


def refreshed(passages: DataFrame, held: DataFrame, model: str = "hashing", encoder: Encoder = hashing_encoder) -> DataFrame:
    """The table of vectors with those of ``missing`` made anew; vectors of other models and of up-to-date texts stay as they are."""
    new = embed(missing(passages, held, model), model, encoder)
    return held.join(new.select("doc_id", "model"), ["doc_id", "model"], "left_anti").unionByName(new)


def forgotten(held: DataFrame, parsed_again: DataFrame) -> DataFrame:
    """The table of vectors without those of records that were parsed again."""
    return held.join(parsed_again.select("doc_id"), "doc_id", "left_anti")
