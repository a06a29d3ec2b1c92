from collections import Counter

import pytest

from rosterlake.llm import sharding as op


def check(rows, shards=op.SHARDS):
    n = Counter(r.shard for r in rows)
    counts = [n[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))


def test_odd_rows(odd, odd_rows):
    import zlib

    rows = op.shard(odd).collect()
    check(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)


@pytest.mark.parametrize("n, hot", [(2000, 700), (5, 0), (640, 640), (1000, 30)])
def test_groups_stay_together(spark, monkeypatch, n, hot):
    monkeypatch.setattr(op, "BIN", 64)
    rows = [(k, "hot" if k < hot else f"pair {k // 2}" if k % 5 == 0 else f"own {k}") for k in range(n)]
    found = op.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    check(found)
    assert len(found) == n
    if hot:
        of = Counter(r.shard for r in found if r.doc_id < hot)
        assert len(of) <= 2 + hot // (n // op.SHARDS), of


def test_fewer_links_are_cut_than_by_hash(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = op.shard(docs).join(docs, "doc_id").withColumn("hashed", op.F.pmod(op.F.xxhash64("doc_id"), op.F.lit(op.SHARDS)).cast("int"))
    cut, links = op.cut_edges(found, ["text"])
    by_hash, _ = op.cut_edges(found, ["text"], "hashed")
    print("links", links, "cut", cut, "cut by hash", by_hash)
    assert links > 20 and cut <= 0.05 * links < 0.8 * links < by_hash


def test_empty(odd):
    assert op.shard(odd.limit(0)).count() == 0
