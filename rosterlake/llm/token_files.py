"""Token-id files in Simple-8b.

A 64-bit word has a 4-bit selector and 60 bits of payload: 240 or 120 zeros, or as many equal fields as fit
(``FIELDS``); selector 15 holds one value of 60 bits. Packing is greedy, the most values first. A value of
``2**60 - 1`` or more is an escape: its field holds ``2**60 - 1`` and the value goes to the block's escape list.

File: ``MAGIC``, blocks, directory, 8 bytes with the directory's length, ``MAGIC``. Blocks are of ``BLOCK`` ids
and decode alone, a selector at a time in whole arrays. The directory (Arrow IPC) has for each block its offset,
words, ids and escapes, and for each document its id and number of ids; documents follow each other in
ascending order, within a file and over the files, without padding.

The tokenizer runs once for each distinct word of a batch that a bounded memo doesn't hold: the vocabulary's
normaliser and splitter act alike on a word alone and in its text, as white space always separates.

Tasks begin a new file at ``FILE_BYTES``, so files can be read whole and a task holds one packed file and a block of ids at most.

Edge cases: a null or empty text has the end id alone; null doc_ids come first; equal doc_ids keep all their rows, in the order in
which they are read, and equal rows are rows like others; a very long text is encoded whole and stays in one file; an empty table gives an
empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import place, publish
from .scratch import Scratch
from .textops import U64, slices, utf8

MAGIC, BLOCK, FILE_BYTES = b"S8BTOK01", 1 << 16, 1 << 26
#: Simple-8b's selectors, in order: values in a word, bits of each.
FIELDS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = (1 << 60) - 1
#: Distinct words that a worker remembers, and bytes of text that are encoded at a time.
_MEMO, SLICE = 1 << 19, 5_000_000
_MARKS = b".,!?;:"
_SINGLE = [bytes((x,)) for x in _MARKS]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the values (uint64), and the escaped values."""
    escaped = values >= U64(ESCAPE)
    escapes = values[escaped]
    n = len(values)
    if not n:
        return np.zeros(0, U64), escapes
    padded = np.concatenate((np.where(escaped, U64(ESCAPE), values), np.zeros(240, U64)))
    # bits that each value needs; what needs more than 30 has a word of its own
    width = np.frexp(np.minimum(padded, U64(1 << 31)).astype(np.float64))[1].astype(np.uint8)
    choice = np.full(n, 15, np.int64)
    for selector in range(14, -1, -1):
        count, bits = FIELDS[selector]
        fits, have = width <= bits, 1
        while have < count and fits[:n].any():  # whether so many values from here on fit
            step = min(have, count - have)
            fits = fits[:-step] & fits[step:]
            have += step
        choice[np.flatnonzero(fits[:n])] = selector
    step = np.array([count for count, _ in FIELDS], np.uint8)[choice].tobytes()
    at, k = [], 0
    while k < n:
        at.append(k)
        k += step[k]
    at = np.array(at)
    selectors = choice[at]
    out = selectors.astype(np.uint64) << U64(60)
    for selector in np.unique(selectors).tolist():
        count, bits = FIELDS[selector]
        if bits:
            rows = np.flatnonzero(selectors == selector)
            fields = padded[at[rows][:, None] + np.arange(count)]
            out[rows] |= np.bitwise_or.reduce(fields << (np.arange(count).astype(np.uint64) * U64(bits)), 1)
    return out, escapes


def unpack(words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    selectors = (words >> U64(60)).astype(np.int64)
    counts = np.array([count for count, _ in FIELDS])[selectors]
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), U64)
    for selector in np.unique(selectors).tolist():
        count, bits = FIELDS[selector]
        if bits:
            rows = np.flatnonzero(selectors == selector)
            fields = words[rows][:, None] >> (np.arange(count).astype(np.uint64) * U64(bits)) & U64((1 << bits) - 1)
            out[begin[rows][:, None] + np.arange(count)] = fields
    out = out[:n]
    if len(escapes):
        out[out == U64(ESCAPE)] = escapes
    return out


class File:
    """A file in the making: blocks are packed as soon as they are full."""

    def __init__(self):
        self.data, self.blocks, self.size = [MAGIC], [], len(MAGIC)
        self.doc_ids, self.counts, self.held, self.n_ids = [], [], [], 0

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.counts.append(counts)
        self.held.append(ids)
        self.n_ids += len(ids)
        self._pack(BLOCK)

    @property
    def about(self) -> int:
        """Bytes so far, with two for each id that isn't packed yet."""
        return self.size + 2 * sum(map(len, self.held))

    def _pack(self, least: int) -> None:
        """Packs what is held, but for less than ``least`` ids."""
        if sum(map(len, self.held)) < least:
            return
        ids = np.concatenate(self.held)
        whole = len(ids) if least == 1 else len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            block = ids[k : min(k + BLOCK, whole)]
            words, escapes = pack(block.astype(np.uint64))
            self.data += [words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()]
            self.blocks.append((self.size, len(words), len(block), len(escapes)))
            self.size += 8 * (len(words) + len(escapes))
        self.held = [ids[whole:].copy()]

    def parts(self) -> list[bytes]:
        """The whole file, in order."""
        self._pack(1)
        columns = list(zip(*self.blocks, strict=True)) or [[], [], [], []]
        sink = pa.BufferOutputStream()
        for table in (
            pa.table([pa.array(c, pa.int64()) for c in columns], ["offset", "words", "ids", "escapes"]),
            pa.table([pa.concat_arrays(self.doc_ids), pa.array(np.concatenate(self.counts), pa.int64())], ["doc_id", "n"]),
        ):
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
        directory = sink.getvalue().to_pybytes()
        return [*self.data, directory, len(directory).to_bytes(8, "little"), MAGIC]


def encode_file(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """A file's parts in order."""
    file = File()
    file.add(pa.array(doc_ids), np.asarray(counts), np.asarray(ids))
    return file.parts()


def directory(data: memoryview) -> tuple[pa.Table, pa.Table]:
    """Blocks and documents of a file."""
    if bytes(data[: len(MAGIC)]) != MAGIC or bytes(data[-len(MAGIC) :]) != MAGIC:
        raise ValueError("not a token file")
    end = len(data) - len(MAGIC) - 8
    size = int.from_bytes(data[end : end + 8], "little")
    source = pa.BufferReader(pa.py_buffer(data[end - size : end]))
    return tuple(pa.ipc.open_stream(source).read_all() for _ in range(2))


def decode_file(data: memoryview) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The documents of a file and all their ids, a few blocks' worth at a time."""
    blocks, docs = directory(data)
    counts = docs["n"].to_numpy()
    ends = np.cumsum(counts)
    held, k, before = [], 0, 0
    for offset, n_words, n_ids, n_escapes in zip(*(blocks[c].to_pylist() for c in blocks.column_names), strict=True):
        words = np.frombuffer(data, "<u8", n_words, offset)
        held.append(unpack(words, n_ids, np.frombuffer(data, "<u8", n_escapes, offset + 8 * n_words)))
        have = before + sum(map(len, held))
        end = int(np.searchsorted(ends, have, "right"))
        if end > k:
            ids = np.concatenate(held)
            size = int(ends[end - 1]) - before
            yield docs.slice(k, end - k), ids[:size]
            held, before, k = [ids[size:]], before + size, end


class Tokenizer(dict):
    """Ids of words without ASCII white space by a tokenizers file, as little-endian uint32 bytes; as a dict, the memo.

    New words go to the library together: runs of letters with spaces between them, others with a special token,
    at which it splits before all else."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        super().__init__()
        self.library = Library.from_file(path)
        special = ((i, t) for i, t in self.library.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word))
        self.border, token = next(special, (None, None))
        self.between = token.content if token else ""
        self.mark = b"<|"
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix and self.between:
            vocabulary = self.library.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        probe = "AbcXYZ"
        marked = all(t.content.startswith("<|") for t in self.library.get_added_tokens_decoder().values())
        self.folds = marked and self._ids(probe).tobytes() == self._ids(probe.lower()).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    @staticmethod
    def stem(word: bytes) -> bytes | None:
        """The word without its last mark, if that follows an ASCII letter: the splitter always cuts there."""
        return word[:-1] if word[-1] in _MARKS and word[-2:-1].isalpha() else None

    def __missing__(self, word: bytes) -> bytes:
        """A stem and its mark, which isn't kept; only asked for what ``learn`` has seen."""
        return self[word[:-1]] + self[word[-1:]]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id, and how many each has."""
        data, offsets = utf8(texts)
        data = data.tobytes()
        if self.folds and b"<|" not in data:  # ASCII letters in lower case, as the vocabulary has no other: fewer words to remember
            data = data.lower()
        texts = pa.LargeBinaryArray.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)])
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().cast(pa.large_binary()).dictionary_encode()
        found = self.learn(words.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, place = np.frombuffer(b"".join(found), "<u4"), words.indices.to_numpy()
        n = size[place]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat((np.cumsum(size) - size)[place] - ends[:-1], n) + np.arange(ends[-1])]
        cut = ends[np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(split)))))]
        return np.insert(ids, cut[1:], end_id), np.diff(cut) + 1

    def learn(self, distinct: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self) > _MEMO:  # the older half goes
            kept = dict(islice(self.items(), len(self) // 2, None))
            self.clear()
            self.update(kept)
        new = set()
        for word in filterfalse(self.__contains__, chain(distinct, _SINGLE)):
            stem = self.stem(word) if word else b""
            if stem is None:
                new.add(word)
            elif stem not in self:
                new.add(stem)
        letters, others, alone = [], [], []
        for word in new:
            text = word.decode()
            if self.ends is not None and text.isalpha() and (text.isascii() or max(text) < "\u0100"):
                letters.append(text)
            else:
                (alone if not self.between or self.between in text else others).append(text)
        for text in alone:
            self[text.encode()] = self._ids(text).tobytes()
        parts = [letters[k : k + 512] for k in range(0, len(letters), 512)]
        found = self.library.encode_batch_fast([" ".join(part) for part in parts], add_special_tokens=False)
        for part, ids in zip(parts, (np.array(x.ids, "<u4") for x in found), strict=True):
            # the splitter takes a run of letters whole, and its last token ends a word
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) != len(part):
                others += part
            else:
                self._learned(part, ids, [0, *end.tolist()], end.tolist())
        for k in range(0, len(others), 4096):
            part = others[k : k + 4096]
            ids = self._ids(self.between.join([*part, ""]))
            end = np.flatnonzero(ids == self.border)
            self._learned(part, ids, [0, *(end + 1).tolist()], end.tolist())
        return list(map(self.__getitem__, distinct))

    def _learned(self, part: list[str], ids: np.ndarray, begin: list[int], end: list[int]) -> None:
        raw = ids.tobytes()
        for text, low, high in zip(part, begin, end, strict=False):
            self[text.encode()] = raw[4 * low : 4 * high]


@lru_cache(1)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def write(docs: DataFrame, folder: str, path: str, end_id: int) -> DataFrame:
    """Writes the files, each until it has ``FILE_BYTES``; a row each: ``part, file, path, n_docs, n_ids, n_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = _tokenizer(path)
        file, k = File(), 0

        def published() -> pa.RecordBatch:
            number, at = place(folder, f"-{k:06d}.s8b")
            n = publish(at, file.parts())
            row = (number, k, at, sum(map(len, file.counts)), file.n_ids, n)
            return pa.record_batch([pa.array([x]) for x in row], ["part", "file", "path", "n_docs", "n_ids", "n_bytes"])

        for batch in batches:
            for part in slices(batch, limit=min(SLICE, FILE_BYTES)):
                ids, n = tokenizer.encode(part.column("text"), end_id)
                file.add(part.column("doc_id"), n, ids.astype(np.uint32))
                if file.about >= FILE_BYTES:
                    yield published()
                    file, k = File(), k + 1
        if file.counts:
            yield published()

    # rows of one doc_id keep the order in which they are read, and may lie in several parts
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("turn", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange("doc_id", "turn").sortWithinPartitions("doc_id", "turn").select("doc_id", "text")
    return ordered.mapInArrow(run, "part long, file long, path string, n_docs long, n_ids long, n_bytes long")


def read(spark, folder: str, files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files."""
    # sums of parts first, then within each part: no window holds all files
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    starts = files.select("part", "file", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("more")).join(parts, "part")
    starts = starts.select("part", "file", (F.col("first") + F.col("more")).alias("before"))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.s8b").load(folder)
    number = lambda k: F.regexp_extract("path", r"part-(\d+)-(\d+)\.s8b$", k).cast("long")
    content = content.select(number(1).alias("part"), number(2).alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, start in zip(batch.column("content"), batch.column("before").to_pylist(), strict=True):
                for docs, ids in decode_file(memoryview(data.as_buffer())):
                    counts, raw = docs["n"].to_numpy(), memoryview(ids.astype("<u4").tobytes())
                    ends = np.cumsum(counts)
                    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                    columns = [docs["doc_id"].combine_chunks(), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                    yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])

    joined = content.join(starts, ["part", "file"]).select("content", "before")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    tables = Scratch(docs.sparkSession, "tokens")
    folder = tables.path("files")
    files = tables.store(write(docs, folder, path, end_id), "written")
    if not files.head(1):
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(docs.sparkSession, folder, files)


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 1)
