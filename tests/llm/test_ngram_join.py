import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from rosterlake.llm import ngram_join as op
from rosterlake.llm.textops import words


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and rows[a][0] is not None and rows[b][0] is not None and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i) if i is not None else None
    return Counter((i, least[find(k)], links[k]) for k, (i, _) in enumerate(rows))


def result(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in op.join(df).collect())


def test_same_as_brute_force(odd, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    assert result(odd) == brute(rows)


def family(rng, n, words_, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words_)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], [f"x{rng.randrange(9999)}"], [w[at], "more"]])
        out.append(" ".join(w))
    return out


def test_families_and_blocks(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(op, "UNIT", 16)
    texts = family(rng, 90, 150, 4) + [t for _ in range(30) for t in family(rng, rng.randint(1, 5), rng.randint(3, 120), 5)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df) == brute(rows)


def test_borders_of_tasks():
    rng = np.random.default_rng(1)
    sketch = np.repeat(rng.integers(0, 256, (4, 96), np.uint8), 10, 0)
    batch = pa.record_batch([pa.array([1] * 5 + [2] * 30 + [3] * 5), pa.array([bytes([k]) for k in range(40)], pa.binary()), pa.array([s.tobytes() for s in sketch], pa.binary())], ["key", "node", "sketch"])
    found = [r for b in op._sorted_buckets(iter([batch.slice(0, 12), batch.slice(12)]), True) for r in b.to_pylist()]
    assert {r["key"] for r in found if r["b"] is None} == {1, 3}
    linked = {(r["a"][0], r["b"][0]) for r in found if r["b"]}
    assert {(5, 6), (10, 11), (20, 21), (35, 36)} <= linked and all(a // 10 == b // 10 for a, b in linked)


def test_sorted_keys_are_tries():
    rng = np.random.default_rng(4)
    low = rng.integers(0, 3, (50, op.TREES * op.DEPTH)).astype(np.uint32)
    keys = op.trie_keys(low)
    values = low.reshape(50, op.TREES, op.DEPTH)
    for t in range(op.TREES):
        assert np.argsort(keys[:, t], kind="stable").tolist() == sorted(range(50), key=lambda k: values[k, t].tolist())
    for a, b in ((0, 1), (2, 3), (4, 5)):
        same = (values[a] == values[b]).cumprod(1).sum(0)
        assert op.matched_trees(keys[[a]], keys[[b]])[0].tolist() == same.tolist()


def test_variants_are_at_the_threshold():
    rng = np.random.default_rng(5)
    names = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    first = np.array([0, 30, 400, 900])
    changed, has = op.variants(names, first)
    assert has.tolist() == [False, True, True]
    for k in (1, 2):
        one, other = (set(op.shingles(x, first)[0][op.shingles(x, first)[1][k] : op.shingles(x, first)[1][k + 1]].tolist()) for x in (names, changed))
        assert 0.8 <= len(one & other) / len(one | other) < 0.83


def test_prefix_is_shortened_until_the_recall(spark):
    def depth(*shares):
        rows = [([round(op.TREES * x) for x in shares],)] * 3 + [(None,)]
        return op.settled_depth(spark.createDataFrame(rows, "met array<int>"))

    assert depth(0.9, 0.8, 0.7, 0.6, 0.5, 0.4) == 6
    assert depth(0.8, 0.64, 0.51, 0.42, 0.33, 0.25) == 5
    assert depth(0.8, 0.4, 0.1, 0, 0, 0) == 2
    assert depth(0, 0, 0, 0, 0, 0) == 1


def test_recall_on_planted_pairs(spark):
    """Pairs whose similarity is 0.80 to 0.85 by brute force: at least 0.9 of them must be found; all are expected to be."""
    rng = random.Random(12)
    rows, near = [], []
    while len(near) < 400:
        w = [f"w{rng.randrange(20000)}" for _ in range(rng.randint(60, 200))]
        other = list(w)
        for _ in range(rng.randint(1, 5)):
            other[rng.randrange(len(other))] = f"x{rng.randrange(20000)}"
        a, b = grams(" ".join(w)), grams(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            near.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(other))]
    found = {r.doc_id: r.n_links for r in op.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = sum(found[b] > 0 for _, b in near) / len(near)
    print("recall on planted pairs", recall)
    assert recall >= 0.99


def test_texts_that_collide_in_rings_of_two_powers(spark):
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    rows = [(1, " ".join(x)), (2, " ".join(y)), (3, x), (4, y), (5, f"{x} one two three four"), (6, f"{y} one two three four")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_few_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "UNIT_BYTES", 1000)
    rng = random.Random(9)
    rows = list(enumerate(t for _ in range(6) for t in family(rng, 4, 300, 6)))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_minhash_estimates():
    rng = np.random.default_rng(3)
    shared, own = rng.integers(0, 1 << 63, 800, np.uint64), rng.integers(0, 1 << 63, (2, 100), np.uint64)
    values = op.mix(np.concatenate((shared, own[0], shared, own[1])))
    low = op.minhashes(values, np.array([0, 900, 1800]), 2000)
    assert abs((low[0] == low[1]).mean() - 0.8) < 0.04
    assert words(pa.array(["a"])).name.shape == (1,)


def test_representatives(odd, odd_rows):
    kept = op.representatives(odd)
    assert kept.columns == odd.columns
    classes = {(i, c) for i, c, _ in brute([(r[0], r[1]) for r in odd_rows])}
    assert {r.doc_id for r in kept.collect()} == {i for i, c in classes if i == c}


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", "v1", 1, "n1"), (2, "a b c d e f", "v2", 2, "n2"), (3, "other", "v3", 3, "n3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, version string, class_id int, node string")
    assert sorted(map(tuple, op.representatives(df).collect())) == [rows[0], rows[2]]


def test_empty(odd):
    assert op.join(odd.limit(0)).count() == 0
