import re
from collections import Counter

import numpy as np
import pyarrow as pa

from rosterlake.llm import substring_dedup as op
from rosterlake.llm.textops import words


def brute(rows):
    seen, split = {}, [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            if i is not None:
                seen[key] = min(seen.get(key, i), i)
    out = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if i is not None and seen[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        out[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    return out


def result(docs):
    return Counter(tuple(r) for r in op.remove_repeats(docs).drop("version").collect())


def test_same_as_brute_force(spark, odd, odd_rows):
    found = result(odd)
    assert found == brute([(r[0], r[1]) for r in odd_rows])


def test_many_overlapping_repeats(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):  # few different words: periodic texts, runs, and repeats of all lengths
        parts = [" ".join(rng.choice(["a", "b", "c"], rng.integers(1, 60), p=[0.7, 0.2, 0.1])) for _ in range(rng.integers(1, 6))]
        rows.append((k, " ".join(parts + [rows[rng.integers(len(rows))][1][: rng.integers(1, 300)]] if rows else parts)))
    found = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == brute(rows)


def test_symbols_of_equal_substrings_agree():
    rng = np.random.default_rng(1)
    longest = 0
    for words_ in (4, 1000):
        for _ in range(30):
            middle = rng.integers(0, words_, 120).astype(str).tolist()
            found = []
            for n in (17, 40):
                text = " ".join([*rng.integers(0, words_, n).astype(str), *middle, *rng.integers(0, words_, 30).astype(str)])
                w = words(pa.array([text]))
                name, at, size, low, high = op.recompress(w.name, w.first)
                assert (low <= at).all() and (at + size <= high).all() and (high - low <= op.WINDOW).all()
                inside = (low >= n) & (high <= n + 120)
                longest = max(longest, size[inside].max())
                found.append(sorted(zip((at[inside] - n).tolist(), size[inside].tolist(), name[inside].tolist())))
            assert found[0] == found[1] and found[0]
    assert longest >= 16  # symbols of tens of words


def thue_morse(k, x="a", y="b"):
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


def test_words_that_collide_in_rings_of_two_powers(spark):
    x, y = thue_morse(10)
    rows = [(1, f"{x} " + " ".join(f"w{k}" for k in range(60))), (2, f"{y} " + " ".join(f"w{k}" for k in range(48)) + " other"), (3, x), (4, " ".join(x)), (5, " ".join(y))]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_clashing_columns(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, passage, "v1", "k1"), (2, passage + " end", "v2", "k2")]
    found = op.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, version string, kept string")).collect()
    assert sorted(map(tuple, found)) == [(1, passage, "v1", "k1"), (2, "end", "v2", "k2")]


def test_long_slices_go_by_segments(monkeypatch):
    rng = np.random.default_rng(2)
    w = words(pa.array([" ".join(rng.integers(0, 9, n).astype(str)) for n in (700, 30, 400)]))
    whole = op.blocks(w)
    monkeypatch.setattr(op, "_SEGMENT", 256)
    parts = op.blocks(w)
    spread = lambda b: sorted((s + k, a, m) for s, n, a, m in zip(*b) for k in range(n))
    assert spread(whole) == spread(parts)


def test_empty_table(spark):
    assert op.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
