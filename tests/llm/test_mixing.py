from collections import Counter

import numpy as np
import pytest

from rosterlake.llm import mixing as op


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: op.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, open_, out = op.SHARE * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = 2.0 * sizes[s]
            open_.discard(s)
        left = op.SHARE * sum(sizes.values()) - sum(out.values())


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 900, None: 40}, {"b": 10, "a": 10}, {"x": 7}, {"a": 0, "b": 3, "é": 50, "z": 1000}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r.source: r.target for r in op.targets(df).collect()}
    want = brute_targets(sizes)
    assert found.keys() == want.keys() and all(found[s] == pytest.approx(want[s]) for s in want)


def test_pivot_keeps_the_sum():
    rng = np.random.default_rng(4)
    for _ in range(200):
        size, p = rng.integers(0, 500, 40), np.full(40, rng.random())
        x, open_ = op.pivot(size, p, rng.random(40))
        assert (size * x).sum() == pytest.approx((size[size > 0] * p[size > 0]).sum())
        assert sum(0 < v < 1 for v in x) == (open_ >= 0)


def test_expectations():
    rng, size = np.random.default_rng(5), np.array([5, 17, 40, 3, 90, 12])
    mean = np.mean([op.pivot(size, np.full(6, 0.3), rng.random(6))[0] for _ in range(20000)], 0)
    assert np.abs(mean - 0.3).max() < 0.02


def test_mix(spark, odd, monkeypatch):
    monkeypatch.setattr(op, "LEAF", 8)
    monkeypatch.setattr(op, "FAN_IN", 2)
    first = op.mix(odd).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, op.mix(odd.repartition(7)).collect()))
    assert len(first) == odd.count()
    taken, target = Counter(), {}
    for r in first:
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert target and all(abs(taken[s] - target[s]) <= max(r.size for r in first if r.source_size == s) for s in target)
    assert Counter(r.doc_id for r in op.repeated(odd).collect()) == Counter({i: n for i, n in sum((Counter({r.doc_id: r.copies}) for r in first), Counter()).items() if n})


def test_equal_rows(spark):
    rows = [(1, "a b c", "s")] * 50 + [(2, "d e", "s"), (3, "f", None)] + [(3, "f", None)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    found = op.mix(df).collect()
    assert len(found) == len(rows)
    copies = [r.copies for r in found if r.doc_id == 1]
    assert max(copies) - min(copies) <= 1 and max(copies) <= 2
    assert Counter(r.doc_id for r in op.repeated(df).collect()) == Counter({i: sum(r.copies for r in found if r.doc_id == i) for i in (1, 2, 3)})


def test_clashing_columns(spark):
    names = ("key", "own", "copies", "n_equal", "turn", "mix_key", "size", "part", "target")
    rows = [(k, f"w{k} x", "s", *range(len(names))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names))
    assert op.mix(df).count() == 30
    found = op.repeated(df)
    assert found.columns == df.columns and set(map(tuple, found.collect())) <= set(rows) and found.count() > 30


def test_empty(spark, odd):
    assert op.mix(odd.limit(0)).count() == 0


def test_large_documents_are_made_up_for():
    """One document has a third of all words: the rest takes the rounding's difference, and the last open row is a small one."""
    rng = np.random.default_rng(8)
    for _ in range(100):
        size = np.sort(np.concatenate(([5000], rng.integers(1, 400, 50))))[::-1]
        p = np.full(51, rng.uniform(0.2, 0.8))
        x, open_ = op.pivot(size, p, rng.random(51))
        rest = size[1:].sum()
        if (1 - p[0]) * 5000 <= p[0] * rest and p[0] * 5000 <= (1 - p[0]) * rest:  # the others have the words, and the room, that it may need
            assert open_ != 0
        assert abs((size * np.round(x)).sum() - (size * p).sum()) <= (size[open_] if open_ >= 0 else 0.5)


def test_sources_are_near_their_targets(spark):
    """Shares of a real table: no source misses its target by more than its largest document, nor by 2 % where documents are many."""
    found = op.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")).groupBy("source_size", "target").agg({"taken": "sum", "size": "max"}).collect()
    miss = sorted(abs(r["sum(taken)"] - r.target) / r.target for r in found)
    assert miss[-1] < 0.05 and miss[len(miss) // 2] < 0.003, miss
