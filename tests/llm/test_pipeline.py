from collections import Counter

import corpus_pipeline as op
from rosterlake.llm import mixing, quality_rules

from .test_ngram_join import brute as classes
from .test_substring_dedup import brute as repeats


def test_stages_by_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 0 OR n_chars < 3000")
    columns, before = docs.columns, [tuple(r) for r in docs.collect()]
    done = {}
    for k, (name, stage) in enumerate(op.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        done[name] = [tuple(r) for r in docs.collect()]
    quality, near, cut, mix, tokens = done.values()
    assert set(quality) <= set(before) and len(quality) > 0.7 * len(before)
    least = {i for i, c, _ in classes([(r[0], r[1]) for r in quality]) if i == c}
    assert set(near) == {r for r in quality if r[0] in least}
    want = {i: (n, text) for i, _, n, text in repeats([(r[0], r[1]) for r in near])}
    assert {r[0]: r[1] for r in cut} == {r[0]: want[r[0]][1] if want[r[0]][0] else r[1] for r in near if not want[r[0]][0] or want[r[0]][1]}
    assert all(r[4] == len(r[1]) for r in cut)
    assert set(mix) <= set(cut) and max(Counter(mix).values()) <= 2
    assert Counter(r[0] for r in tokens) == Counter(r[0] for r in mix)
    assert quality_rules.SPARED < 0.01 and mixing.CAP == 2


def test_odd_rows(spark, odd, sf):
    for name, stage in op.STAGES:
        out = stage(spark, odd, sf)
        assert out.count() >= 0, name
        assert stage(spark, odd.limit(0), sf).count() == 0, name
