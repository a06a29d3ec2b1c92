"""Byte-level BPE by a lazily determinised transducer, and decoding by an incremental UTF-8 machine.

The merges compile into the vocabulary, its proper prefixes and a memo of which tokens may stand side
by side: ``b`` may follow ``a`` if the merges of their joined bytes give just these two. The encoding of a
prefix then ends with the one token that fits its predecessor, which a nondeterministic machine finds by
carrying every place from which a token may still be open. Determinised, a state is the list of such places: the
open bytes, the token that ends there, and what isn't emitted yet. States and their transitions are made
when first met, up to a bound; where one is missing then, the nondeterministic machine goes on from the state. A token is emitted once all places of a state agree on it, after a lookahead of at most
the longest token; the end of a piece emits the rest.

Texts are cut into pieces by the vocabulary's pattern; what the machine emits for a piece is remembered in a
bounded memo, and so are its states. What a slice of texts no longer needs goes back to the system after each slice.

Edge cases: a null or empty text has no ids; ids that aren't in the vocabulary raise ``IndexError`` in decoding; bytes
that aren't UTF-8 decode to U+FFFD; rows are independent, so repeated rows and null doc_ids pass through;
a piece of any length is encoded in one pass, with memory in proportion to the longest token; a very long text is encoded whole;
an empty table gives an empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gc
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import slices

#: Bytes of text, or of ids, that are turned at a time.
SLICE = 1 << 19
_ONE = [bytes((x,)) for x in range(256)]
#: Bounds of what a worker remembers: pieces (up to twice as many), moves, pairs, characters of a piece.
_MEMO, _STATES, _PAIRS, _LONGEST_KEY = 3 << 17, 3 << 16, 1 << 18, 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes pieces; states come with what is read; beyond their bound it goes on without keeping more."""

    def __init__(self, ranks: dict[bytes, int], most_moves: int):
        self.ranks, self.most_moves = ranks, most_moves
        self.token = {rank: token for token, rank in ranks.items()}
        self.prefixes = {prefix: prefix for token in ranks for prefix in [token[:k] for k in range(1, len(token))]}
        self.fits: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        # a place: (open bytes, last token or -1, ids that aren't emitted yet)
        start = ((b"", -1, ()),)
        self.known, self.places, self.shared = {start: 0}, [start], {}
        #: state << 8 | byte -> next state, or (next state, ids to emit)
        self.moves: dict[int, int | tuple[int, tuple[int, ...]]] = {}

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge gives this one; the token itself if it is a single byte."""
        held = self.halves.get(token)
        if held is None:
            data, rank = self.token[token], self.ranks.get
            parts = [data[k : k + 1] for k in range(len(data))]
            while len(parts) > 2:
                k = min(range(len(parts) - 1), key=lambda k: rank(parts[k] + parts[k + 1], 1 << 60))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            held = self.halves[token] = (rank(parts[0]), rank(parts[-1])) if len(parts) == 2 else (token, token)
        return held

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of a and b. Merges are undone from the last one back: the two
        tokens at the border may not have merged before the one that is undone took one of them (of equal
        merges the left one comes first)."""
        token, rank, before = self.token, self.ranks.get, 1 << 60
        while True:
            left, right = token[a], token[b]
            merge = rank(left + right)
            if merge is not None and merge < before:
                return False
            if len(left) > 1 and (a > b or len(right) == 1):
                a, before = self._halves(a)[1], a
            elif len(right) > 1:
                b, before = self._halves(b)[0], b + 1
            else:
                return True

    def _step(self, places, byte: int) -> list[tuple[bytes, int, tuple[int, ...]]]:
        """The places after one more byte; the last of them is where the encoding of all bytes so far ends."""
        c, after, here = _ONE[byte], [], None
        ranks, prefixes, fits = self.ranks, self.prefixes, self.fits
        for open_, last, rest in places:
            grown = open_ + c
            if here is None and (token := ranks.get(grown)) is not None:
                pair = last << 20 | token
                held = last < 0 or fits.get(pair)
                if held is None:
                    if len(fits) >= _PAIRS:
                        fits.clear()
                    held = fits[pair] = self._may_follow(last, token)
                if held:
                    here = (b"", token, (*rest, token))
            if (grown := prefixes.get(grown)) is not None:
                after.append((grown, last, rest))
        after.append(here)
        return after

    def _move(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        """Makes the transition: tokens on which all places agree are emitted and leave the state."""
        places, emitted = self._step(self.places[state], byte), ()
        final = min([rest for _, _, rest in places], key=len)
        if final:
            k = 0
            while k < len(final) and all([rest[k] == final[k] for _, _, rest in places]):
                k += 1
            if k:
                emitted = final[:k]
                places = [(open_, last, rest[k:]) for open_, last, rest in places]
        shared = self.shared  # equal places are one object
        key = tuple([shared.setdefault(x, x) for x in places])
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.places)
            self.places.append(key)
        self.moves[state << 8 | byte] = move = (to, emitted) if emitted else to
        return move

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        state, out, moves = 0, [], self.moves.get
        for k, byte in enumerate(piece):
            move = moves(state << 8 | byte)
            if move is None:
                if len(self.moves) >= self.most_moves:
                    return self._undetermined(state, piece, k, out)
                move = self._move(state, byte)
            if move.__class__ is tuple:
                out += move[1]
                state = move[0]
            else:
                state = move
        out += self.places[state][-1][2]
        return out

    def _undetermined(self, state: int, piece: bytes, k: int, out: list[int]) -> list[int]:
        """The rest of a piece when no more states are kept."""
        places = self.places[state]
        for byte in piece[k:]:
            places = self._step(places, byte)
            if len(places) == 1 or len(places[0][2]) > 64:  # long pieces emit as they go
                final = min([rest for _, _, rest in places], key=len)
                n = next((j for j in range(len(final)) if any([rest[j] != final[j] for _, _, rest in places])), len(final))
                out += final[:n]
                places = [(open_, last, rest[n:]) for open_, last, rest in places]
        out += places[-1][2]
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Memo(dict):
    """A dict that computes what it misses and holds between ``most`` and twice as many recent keys."""

    def __init__(self, find, most: int):
        super().__init__()
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, key: str):
        older = self.older
        value = older[key] if key in older else self.find(key)
        if len(key) <= _LONGEST_KEY:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of texts as little-endian uint32 bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: int = 1):
        """share: by how much less than the bounds to remember."""
        machine = Transducer(ranks, _STATES // share)
        # white space is the Unicode property, which isn't what \\s means everywhere
        self.pieces = regex.compile(pattern.replace("+|", "++|").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.piece = Memo(lambda piece: _packed(machine.encode(piece.encode())), _MEMO // share)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pieces(text))) if text else b""


class Utf8:
    """Incremental decoding: bytes go in as they come, whole characters come out."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _open(tail: bytes) -> bool:
        """Whether the bytes begin a character that more bytes can complete."""
        lead = tail[0]
        need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        if len(tail) >= need:
            return False
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
        return all((low if k == 0 else 0x80) <= x <= (high if k == 0 else 0xBF) for k, x in enumerate(tail[1:]))

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = next((k for k in range(max(0, len(data) - 3), len(data)) if self._open(data[k:])), len(data))
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def stream(self, ids: bytes, step: int = 1 << 16) -> Iterable[str]:
        """Parts of the text, each from at most ``step`` more ids."""
        machine, ids = Utf8(), np.frombuffer(ids, "<u4")
        for k in range(0, len(ids), step):
            yield machine.feed(b"".join(map(self.token.__getitem__, ids[k : k + step].tolist())))
        yield machine.finish()


@lru_cache(2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


@lru_cache(2)
def _decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, keep: bool = True) -> DataFrame:
    """``doc_id, ids`` (little-endian uint32) of the texts of ``docs(doc_id, text)``.

    keep: workers remember pieces and states from task to task; else a task remembers less and frees it, for steps that come after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern) if keep else Encoder(read_ranks(path), pattern, 3)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                gc.disable()  # states hold no cycles, and walking them costs more than making them
                try:
                    ids = [encoder.encode(x) for x in part.column("text").to_pylist()]
                finally:
                    gc.enable()
                found = pa.array(ids, pa.binary())
                del ids
                yield pa.record_batch([part.column("doc_id"), found], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text`` of ``encoded(doc_id, ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for batch in batches:
            for part in slices(batch.set_column(1, "ids", batch.column("ids").cast(pa.binary())), "ids", SLICE):
                texts = ["".join(decoder.stream(x or b"")) for x in part.column("ids").to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, text string"
    )


def digests(docs: DataFrame, path: str, pattern: str, keep: bool = True) -> DataFrame:
    found = decode(encode(docs, path, pattern, keep), path)
    return found.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
