import re
from collections import Counter

import numpy as np
import pytest

from rosterlake.llm import quality_rules as op


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    many = Counter(three)
    hit = {k + j for k, x in enumerate(three) if many[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in op.SYMBOLS), len(lines) - len(set(lines)), len(hit)


def test_counts(odd, odd_rows):
    extra = odd.sparkSession.createDataFrame([(900, "a\n\na\n a\nb \na"), (901, "\n"), (902, "x\n"), (903, "é ü\té ü é ü")], "doc_id long, text string")
    rows = odd.select("doc_id", "text").unionByName(extra)
    found = Counter((r.doc_id, *(r[c] for c in op.COUNTS)) for r in op.counts(rows).collect())
    assert found == Counter((i, *brute(t)) for i, t in rows.collect())


def test_labelled_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = op.op3_quality_rules(spark, d).join(labels, "doc_id").withColumn("held_out", op.held_out()).toPandas()
    for part in (True, False):  # labels that took no part in the calibration, and those that did
        passed = found[~found.base_failed & (found.held_out == part)]
        print("held out" if part else "fitted", passed.groupby("quality").kept.agg(["mean", "size"]).to_dict())
        assert passed[passed.quality == 1].kept.mean() > 0.99
        assert passed[passed.quality == 0].kept.mean() < 0.05
    assert not found[found.base_failed].kept.any()


def test_lines_that_collide_in_rings_of_two_powers(spark):
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    rows = [(1, f"{x}\n{y}\n{x}"), (2, f"{x}\n{y}")]
    found = op.counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, *(r[c] for c in op.COUNTS)) for r in found} == {(i, *brute(t)) for i, t in rows}


def test_without_labels_or_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.judge(odd, none).where("kept = base_failed").count() == 0
    assert op.judge(odd.limit(0), none).count() == 0


def test_outliers_have_short_paths():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (2000, 4)), [[9, 9, 9, 9]]])
    forest = op.Forest.fit([x[k::8][:256] for k in range(8)] * 8)
    score = forest.score(x)
    assert score[-1] > np.quantile(score, 0.999)
    assert op._path(256) == pytest.approx(10.244, abs=0.01)
