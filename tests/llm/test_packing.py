import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from rosterlake.llm import packing as op

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return op.Tokenizer(PATH)


def library(tokenizer, text):
    return [*tokenizer.library.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_the_library_s(tokenizer):
    rng = random.Random(8)
    parts = [" ", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\x85", "\x1c", " ", "a", "The", "ing", "é", "漢", "字", "'s", "'ll", "23", "²", "½", "ª", "...", "<|endoftext|>", "<|end", "\x00", "😀", "ا", "ǆ", "ɐ", "​", "́", "_"]
    texts = ["", " ", "  ", "\n", " a", "a ", "a\n ", "a \n b", None, "a" * 5000 + " b"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    ids, n = tokenizer.encode(pa.array(texts), 1)
    assert ids.tolist() == [x for t in texts for x in library(tokenizer, t)] and n.tolist() == [len(library(tokenizer, t)) for t in texts]


def checked(pieces, docs, window):
    """Every id lies in one piece, offsets are gapless; returns the share of padding."""
    seen, ends = Counter(), {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and 0 < r.length <= window
        ends[r.sequence_id] = r.offset + r.length
    assert all(x <= window for x in ends.values()) and sorted(ends) == list(range(len(ends)))
    for r in pieces:
        seen[r.doc_id, r.start, bytes(r.ids)] += 1
    for (doc_id, start, ids), n in seen.items():
        got = np.frombuffer(ids, "<u4").tolist()
        assert sum(x[start : start + len(got)] == got for x in docs[doc_id]) >= 1 and n <= len(docs[doc_id])
    assert sum(r.length for r in pieces) == sum(len(x) for xs in docs.values() for x in xs)
    return 1 - sum(ends.values()) / (window * len(ends)) if ends else 0


@pytest.mark.parametrize("window", [64, 2048])
def test_pack(spark, odd, odd_rows, tokenizer, window):
    docs = {}
    for i, text, *_ in odd_rows:
        docs.setdefault(i, []).append(library(tokenizer, text))
    pieces = op.pack(odd.withColumnsRenamed({"lang": "length", "source": "part", "n_chars": "ids"}), PATH, 1, window).collect()
    padding = checked(pieces, docs, window)
    assert padding < (0.15 if window == 64 else 0.03)
    for i, own in docs.items():
        got = sorted((r.start, r.length) for r in pieces if r.doc_id == i)
        assert sum(n for _, n in got) == sum(map(len, own)) and {r.doc_tokens for r in pieces if r.doc_id == i} == set(map(len, own))


def test_empty(spark, odd):
    assert op.pack(odd.limit(0), PATH, 1).count() == 0
    assert [(r.length, r.sequence_id, r.offset) for r in op.pack(spark.createDataFrame([(None, None)], "doc_id long, text string"), PATH, 1).collect()] == [(1, 0, 0)]


def placed(counts, window):
    plan = op.plan(counts, window)
    length = np.repeat(np.arange(window + 1), counts)
    rank = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
    sequence, offset, here = plan.place(length, rank)
    spans = sorted([*zip(sequence.tolist(), offset.tolist(), here.tolist(), strict=True), *((s + 1, 0, n - h) for s, n, h in zip(sequence.tolist(), length.tolist(), here.tolist(), strict=True) if h < n)])
    ends = {}
    for s, o, n in spans:
        assert o == ends.get(s, 0)
        ends[s] = o + n
    assert sorted(ends) == list(range(len(ends))) and max(ends.values(), default=0) <= window
    assert sum(ends.values()) == (counts * np.arange(window + 1)).sum()
    return plan, ends


def test_plans():
    rng = np.random.default_rng(6)
    for k in range(60):
        window = int(rng.choice([8, 60, 256]))
        counts = np.zeros(window + 1, np.int64)
        some = rng.integers(1, window + 1, rng.integers(0, 40))
        counts[some] = rng.integers(0, [2, 50, 1000][k % 3], len(some))
        _, ends = placed(counts, window)
        last = max(ends, default=0)
        short = [window - x for s, x in ends.items() if s < last]
        assert all(x <= op.SLACK for x in short)


def test_least_squares_finds_what_is_there():
    """A histogram made of combinations is explained whole, without cuts."""
    rng, window = np.random.default_rng(7), 128
    counts = np.zeros(window + 1, np.int64)
    for _ in range(25):
        a, b = np.sort(rng.integers(1, window, 2))
        if a < b:
            for x in (a, b - a, window - b):
                counts[x] += 1000
    ways = op.combinations(counts > 0, window)
    assert (ways.sum(1) == window).all() and len({tuple(x) for x in ways.tolist()}) == len(ways)
    used, repeats = op.solve(ways, counts.astype(float))
    assert (repeats > 0).all()
    fit = np.zeros(window + 1)
    for k in range(3):
        np.add.at(fit, ways[used, k], repeats)
    fit[0] = 0
    assert np.abs(fit - counts).sum() <= op.SETTLED * counts.sum() * 1.01
    plan, ends = placed(counts, window)
    assert plan.packed.sum() >= 0.99 * counts.sum()


def test_the_query_s_checksums(spark, sf, tokenizer):
    rows = op.op13_packing(spark, sf).collect()
    texts = {r.doc_id: np.array(library(tokenizer, r.text), "<u4") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert all(r.ids_crc32 == zlib.crc32(texts[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
    assert {r.doc_id for r in rows} == set(texts)
