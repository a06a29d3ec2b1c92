import hashlib
import random

import duckdb
import pytest

from rosterlake.llm import warc as op
from rosterlake.llm.scratch import Scratch


@pytest.fixture(scope="module")
def rows():
    rng, hot = random.Random(3), "<html>" + "é hot " * 40
    rows = [(k, f"http://h/{k}?x=ü y\r\n", hot if k % 3 == 0 else f"<p>{rng.random()}</p>" * rng.randint(1, 30)) for k in range(5, 300)]
    return [*rows, (400, None, None), (401, "", ""), (402, "u", "small"), (403, "u", "small"), (None, "u", hot), (5, "u", rows[0][2]), (404, "u", "long" * 100000), (405, "u", "WARC/1.1\r\n\r\n" * 50)]


def brute(rows):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    out = []
    for i, _, t in rows:
        data = (t or "").encode()
        revisit = len(data) >= 100 and i is not None and first[t] < i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[t] if revisit else None))
    return out


def test_round_trip(spark, rows):
    found = op.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute(rows)))


def test_files_roll_over(spark, rows, monkeypatch):
    monkeypatch.setattr(op, "BUNDLE", 2000)
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, path int").repartition(3)
    tables = Scratch(spark, "test")
    index = op.archive(pages, tables.path("a"), tables)
    assert index.select("path").distinct().count() > 3
    assert sorted(map(str, map(tuple, op.read(index).collect()))) == sorted(map(str, brute(rows)))


def test_index(spark, rows, monkeypatch):
    tables = Scratch(spark, "test")
    index = op.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), tables.path("a"), tables).collect()
    assert len(index) == len(rows)
    for r in index[::17]:
        data = open(r.path.removeprefix("file://"), "rb").read()
        head, _ = op.fetch(memoryview(data), r.frame_start, r.frame_bytes, r.place, r.length)
        assert head["WARC-Record-ID"] == f"<{r.record_id}>"


def test_frames_stand_alone():
    bundle = op.Bundle()
    for k in range(50):
        bundle.add(str(k), op.record(k, None, b"x" * 20000, "0" * 64, None))
    data = b"".join(bundle.parts())
    table = op.seek_table(memoryview(data))
    assert len(table) > 2
    assert op.frame(memoryview(data), table[-1]).startswith(b"WARC/1.1")
    broken = bytearray(data)
    broken[-9 - 1] ^= 1
    with pytest.raises(ValueError):
        op.frame(memoryview(bytes(broken)), op.seek_table(memoryview(bytes(broken)))[-1])


def test_same_as_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet'")
    assert {tuple(r) for r in op.op8_warc(spark, sf).collect()} == set(db.sql(op.OP8_SQL).fetchall())


def test_empty(spark):
    assert op.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
