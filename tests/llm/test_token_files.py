import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlake.llm import token_files as op

PATH = P.path("word_bpe_49k.json")
TOKENIZER = op.Tokenizer(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 1 << 16), st.integers(0, (1 << 64) - 1), st.just(op.ESCAPE)), max_size=400))
def test_pack_round_trip(values):
    values = np.array(values, np.uint64)
    words, escapes = op.pack(values)
    assert (op.unpack(words, len(values), escapes) == values).all()


def test_long_runs_are_short():
    words, _ = op.pack(np.zeros(2400, np.uint64))
    assert len(words) == 10
    words, _ = op.pack(np.arange(4096, dtype=np.uint64) % np.uint64(1 << 12))
    assert len(words) <= 4096 // 5 + 1


def test_file_round_trip(monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 64)
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 300, 40)
    ids = rng.integers(0, 49408, counts.sum())
    data = memoryview(b"".join(op.encode_file(pa.array(range(40)), counts, ids)))
    found = [(d, x) for docs, part in op.decode_file(data) for d, x in [(docs["doc_id"].to_pylist(), part)]]
    assert sum((d for d, _ in found), []) == list(range(40))
    assert (np.concatenate([x for _, x in found]) == ids).all()
    with pytest.raises(ValueError):
        op.directory(memoryview(bytes(data)[:-1] + b"x"))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t aeintr'sTHé漢\x1c\x85\u0301Σσ<|>"), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_words_alone_encode_as_in_texts(text):
    library = TOKENIZER.library
    apart = TOKENIZER.encode(pa.array([text, None, text]), 1)
    assert apart[1].tolist() == [len(apart[0]) // 2, 1, len(apart[0]) // 2]
    apart = apart[0][: apart[1][0] - 1].tolist()
    assert apart == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aeintrsTHé漢.,!'<|>\u0301Σ\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=9)))
def test_new_words_together(parts):
    library = TOKENIZER.library
    texts = [list(set(" ".join(parts).encode().split())), [b"<|endoftext|>", b"a<|startoftext|>b", b"<|ENDOFTEXT|>", "été.".encode(), "क़,".encode(), "İ.".encode(), b"a1.", b".", b"it's,"]]
    texts = sum(texts, [])
    for word, ids in zip(texts, TOKENIZER.learn(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(word.decode(), add_special_tokens=False).ids


def test_query(odd, odd_rows):
    library = TOKENIZER.library
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in op.round_trip(odd, PATH, 1).collect())
    want, start = [], 0
    for i, text, *_ in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i is not None, i or 0, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((a, b, d, e) for a, b, _, d, e in found) == sorted(want)
    at = 0
    for row in found:
        assert row[2] == at
        at += row[3]
    assert at == start


def test_files_roll_over(spark, odd, monkeypatch):
    whole = sorted(map(str, op.round_trip(odd, PATH, 1).collect()))
    monkeypatch.setattr(op, "FILE_BYTES", 3000)
    tables = op.Scratch(spark, "test")
    files = tables.store(op.write(odd, tables.path("files"), PATH, 1), "written")
    assert files.where("file > 0").count() > 0
    assert sorted(map(str, op.read(spark, tables.path("files"), files).collect())) == whole


def test_empty(odd):
    assert op.round_trip(odd.limit(0), PATH, 1).count() == 0
