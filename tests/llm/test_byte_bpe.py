import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlake.llm import byte_bpe as op

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = op.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER, DECODER = op.Encoder(RANKS, P.PATTERN), op.Decoder(RANKS)


def ids(text):
    return np.frombuffer(ENCODER.encode(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t aeintr'sTHé漢\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=60), st.integers(1, 9))
def test_as_the_library(text, step):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert "".join(DECODER.stream(ENCODER.encode(text), step)) == text


@pytest.mark.parametrize("text", ["", " ", "  a", "a  ", "don't can'T we'll", "a" * 3000, " " * 300 + "x", "\n\n \t x", "😀 👩‍👩‍👧", "\x00 \x7f"])
def test_odd_texts(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_beyond_the_bounds(monkeypatch):
    monkeypatch.setattr(op, "_STATES", 50)
    monkeypatch.setattr(op, "_MEMO", 20)
    monkeypatch.setattr(op, "_PAIRS", 20)
    encoder, rng = op.Encoder(RANKS, P.PATTERN), random.Random(2)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abcdehinrst") for _ in range(rng.randint(1, 12))) for _ in range(20))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_machine(data, step):
    machine = op.Utf8()
    found = "".join(machine.feed(data[k : k + step]) for k in range(0, len(data), step)) + machine.finish()
    assert found == data.decode("utf-8", "replace")


def test_query(spark, odd, odd_rows):
    found = {}
    for r in op.digests(odd, PATH, P.PATTERN).collect():
        found.setdefault(r.doc_id, r)
    import hashlib

    for i, text, *_ in odd_rows:
        want = np.array(LIBRARY.encode_ordinary(text or ""), "<u4").tobytes()
        r = found[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
