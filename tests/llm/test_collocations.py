import re
from collections import Counter

import numpy as np
import pytest

from rosterlake.llm import collocations as op


def brute(rows, least, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for i in range(len(w)):
                for d in range(1, min(5, len(w) - i) + 1):
                    counts[lang, tuple(w[i : i + d])] += 1
    found = {k: f for k, f in counts.items() if f >= least}
    out = {}
    for (lang, p), a in found.items():
        if len(p) > 1:
            n = totals[lang]
            score, k = min((1000 * a * n // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p)))
            inside = any(o == lang and len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), f in found.items())
            if not inside:
                out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), found[lang, p[:k]], found[lang, p[k:]], n))
    return sorted((lang, r, p.decode(), -a, left, right, n, -s) for lang, x in out.items() for r, (s, a, p, left, right, n) in enumerate(sorted(x)[:top], 1))


def rows_of(rng, n):
    words = ["of", "the", "The", "sea", "é", "a\x01", "a", "b", "漢字", "x'y", "1,5"]
    weights = 1 / np.arange(1, len(words) + 1)
    out = []
    for k in range(n):
        text = "".join(w + rng.choice([" ", "\t", "  ", ". ", ",", "\n", " "]) for w in rng.choice(words, rng.integers(0, 60), p=weights / weights.sum()))
        out.append((["en", "de", None, "und", ""][k % 5], text))
    return [*out, ("en", None), ("xx", ""), (None, " ,, \n"), ("en", "of the sea " * 500), ("en", "of the sea " * 500)]


@pytest.mark.parametrize("least,top,size", [(3, 2000, 1 << 21), (4, 7, 40)])
def test_against_brute_force(spark, least, top, size):
    rows = rows_of(np.random.default_rng(least), 300)
    docs = spark.createDataFrame([(k, *r, "extra") for k, r in enumerate(rows)], "doc_id long, lang string, text string, path string").repartition(5)
    found = sorted(map(tuple, op.collocations(docs, least, top, size).collect()))
    assert found == brute(rows, least, top)
    assert len({r[0] for r in found}) >= 4


def test_empty(spark):
    assert op.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert op.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


def test_segments_come_back():
    rng = np.random.default_rng(1)
    for n in (1, 2, 500):
        rows = rng.integers(0, 4, (n, op.DEPTH)).astype(np.int32)
        for row in rows:
            row[rng.integers(2, op.DEPTH + 1) :] = -1
        rows, counts = op.summed(rows, np.ones(n, np.int64))
        again = op.restored(*op.serialised(rows, counts))
        assert np.array_equal(again[0], rows) and np.array_equal(again[1], counts)


def test_places_follow_the_order_of_paths():
    rng = np.random.default_rng(2)
    share = rng.integers(1, 1000, 50).astype(float)
    before = np.cumsum(share) - share
    rows = rng.integers(0, 50, (5000, op.DEPTH)).astype(np.int32)
    rows, _ = op.summed(rows, np.ones(5000, np.int64))
    at = op.places(rows, before, share, share.sum())
    assert (np.diff(at) >= 0).all() and at.min() >= 0 and at.max() < op.LINE


def test_equal_names_of_one_kind_are_told_apart_by_the_other():
    first, number, counts = op.distinct(np.array([1, 1, 2, 1], np.uint64), np.array([5, 6, 7, 5], np.uint64))
    assert counts.tolist() == [2, 1, 1] and number.tolist() == [0, 1, 2, 0] and len(first) == 3
