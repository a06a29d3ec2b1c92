"""Packing of token sequences into windows by non-negative least squares.

Each document's ids (with the end id) are cut into whole windows and a tail. Whole windows are sequences of their own. For the tails'
histogram all combinations of two or three lengths that fill a window are enumerated, and how often each is repeated is the
non-negative least squares solution of ``combinations * repeats = histogram``, found by an active set that takes in
blocks of combinations with positive gradient (``solve``). Repeats are rounded down and never use a length more often than it is there. What is
left is packed greedily, by histogram too: the longest piece, then ever the longest that fits; a sequence of this kind may
lack ``SLACK`` tokens. Pieces that don't come together so are laid end to end and cut at the windows' borders, so only the very last sequence has more padding.

All this works on a histogram of at most ``window`` counts, whatever the table's size. As lengths are exact, a piece's sequence and offset
follow from its length and its rank among the pieces of that length: ranks are counted in the task that tokenises, and
counts by (task, length) are summed before. So nothing is sorted or gathered by length, by sequence or by document, and ids travel once.

Ids are those of the tokenizers library. Texts are split at spaces where that never changes how the vocabulary's
pattern splits (no white space on both sides), and each distinct word of a slice is encoded once; words of characters below U+0250 by
tiktoken's faster code with the same merges, others and whole texts that can't be split so, or hold a special token, by the library itself.

Edge cases: a null or empty text is the end id alone; null doc_ids are rows like others; repeated rows are packed each for itself; equal lengths are
ranked in the order in which tasks read them, which is stored once; a very long text is encoded whole and has many windows; an empty table gives no pieces; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import slices, utf8

WINDOW, SLACK = 2048, 8
SLICE = 8_000_000
#: The active set grows by so many combinations at a time, until so small a share of the pieces is unexplained, or two rounds have explained
#: too little more: a length that most pieces have can't be filled up whole.
BLOCK, SETTLED, ROUNDS, STALLED = 128, 0.05, 120, 0.002
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_ODD = rf"{_WHITE} (?:{_WHITE}|\z)"


class Tokenizer:
    """Ids of whole texts by a byte-level BPE tokenizers file whose pattern splits before a space."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Library.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte = self._bytes(ByteLevel)
        special = set(self.special)
        ranks = {bytes(byte[c] for c in token): k for token, k in self.library.get_vocab().items() if token not in special}
        import public_tokenizers

        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(self.library.get_vocab_size(), bool)
        self.begins[[k for token, k in ranks.items() if token[:1] == b" "]] = True

    @staticmethod
    def _bytes(level) -> dict[str, int]:
        """The byte of each character by which a byte-level vocabulary writes it: printable Latin-1 bytes are themselves, the others follow from U+0100."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(shown)]
        found = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}
        assert found.keys() == set(level.alphabet())
        return found

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _together(self, words: pa.Array, fast: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words that each follow a space, and how many each has."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        text = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), " ")[0].as_py()
        ids = np.array(self.fast.encode_ordinary(text), np.uint32) if fast else self._whole(text)
        first = np.flatnonzero(self.begins[ids])
        return (ids, np.diff(np.append(first, len(ids)))) if len(first) == len(words) else None

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of `` word`` for each of the words one after the other, and how many each has."""
        edged = pc.match_substring_regex(words, rf"\A{_WHITE}|{_WHITE}\z|\A\z")
        wide = pc.match_substring_regex(words, r"[^\x00-\x{24f}]")
        kind = np.where(edged.to_numpy(zero_copy_only=False), 2, wide.to_numpy(zero_copy_only=False))
        parts, sizes, order = [], [], []
        for k in range(3):
            at = np.flatnonzero(kind == k)
            found = self._together(words.take(pa.array(at)), k == 0) if k < 2 else None
            if found is None:
                each = [self._whole(f" {w}") for w in words.take(pa.array(at)).to_pylist()]
                found = np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)
            parts.append(found[0])
            sizes.append(found[1])
            order.append(at)
        return _reordered(np.concatenate(parts), np.concatenate(sizes), np.concatenate(order))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id, and how many each has."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, _ODD)
        for token in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        count, words = np.asarray(pc.list_value_length(split)), split.flatten().dictionary_encode()
        ids, size = self._words(words.dictionary)
        n = len(size)
        # a text's first word follows no space; a text that isn't split is its own first word
        heads = pc.if_else(whole, texts, pc.list_element(split, 0))
        wide = pc.match_substring_regex(heads, r"[^\x00-\x{24f}]")
        slow = pc.or_(whole, wide).to_pylist()
        first = [self._whole(x) if library else np.array(self.fast.encode_ordinary(x), np.uint32) for x, library in zip(heads.to_pylist(), slow, strict=True)]
        ids = np.concatenate([ids, *first, np.array([end_id], np.uint32)])
        size = np.concatenate((size, np.fromiter(map(len, first), np.int64, len(first)), [1]))
        place, last = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(count)
        place[last - count] = n + np.arange(len(count))
        place = np.insert(place, last, n + len(count))
        got = size[place]
        ends = np.cumsum(got)
        flat = ids[np.repeat((np.cumsum(size) - size)[place] - (ends - got), got) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.diff(np.concatenate(([0], ends[np.cumsum(count + 1) - 1])))


def _reordered(ids: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids, the k-th of which belongs to place ``at[k]``, in the order of places."""
    back = np.argsort(at)
    begin, size = (np.cumsum(size) - size)[back], size[back]
    ends = np.cumsum(size)
    return ids[np.repeat(begin - (ends - size), size) + np.arange(len(ids))], size


@lru_cache(1)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def _pieces(doc_ids: pa.Array, ids: np.ndarray, n: np.ndarray, window: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Windows and tails of documents with n ids each."""
    parts = -(-n // window)
    of = np.repeat(np.arange(len(n)), parts)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
    length = np.minimum(n[of] - start, window)
    return doc_ids.take(pa.array(of)), start, length, n[of], _binary(ids, length)


def _binary(ids: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(length))) * ids.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def tokenized(docs: DataFrame, path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Windows and tails with ``part``, the task that made them, and ``turn``, their rank among its pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen, part = _tokenizer(path), np.zeros(window + 1, np.int64), TaskContext.get().partitionId()
        stored = "<u2" if max(len(tokenizer.begins), end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for rows in slices(batch, limit=SLICE):
                ids, n = tokenizer.encode(rows.column("text"), end_id)
                doc_id, start, length, of, raw = _pieces(rows.column("doc_id"), ids.astype(stored), n, window)
                order, found = np.argsort(length, kind="stable"), np.bincount(length, minlength=window + 1)
                turn = np.empty(len(length), np.int64)
                turn[order] = np.arange(len(length)) - np.repeat(np.cumsum(found) - found, found) + np.repeat(seen, found)
                seen += found
                columns = [doc_id, start, length, of, raw, np.full(len(length), part), turn]
                for k in range(0, len(length), 4096):
                    yield pa.record_batch([x.slice(k, 4096) if isinstance(x, pa.Array) else pa.array(x[k : k + 4096]) for x in columns], names)

    schema = f"{PIECES}, part long, turn long"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """All couples and triples of present lengths that fill a window, a row each; couples have a 0 as third."""
    lengths = np.flatnonzero(present)
    lengths = lengths[(lengths > 0) & (lengths < window)]
    here = np.zeros(window + 1, bool)
    here[lengths] = True
    couples = lengths[(2 * lengths <= window) & here[window - lengths]]
    found = [np.stack((couples, window - couples, np.zeros_like(couples)), 1)]
    for a in lengths[3 * lengths <= window].tolist():
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        b = b[here[window - a - b]]
        found.append(np.stack((np.full_like(b, a), b, window - a - b), 1))
    return np.concatenate(found)


def solve(ways: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``ways`` in use, and how often each is repeated: the least squares fit to the counts without negative repeats.

    Each round takes in the combinations with the steepest gradients that share no length, solves for all in use, and gives up those
    that would be negative, stepping only as far as the first of them allows; a block that comes to nothing is retried with its best alone."""
    scale = float(counts.max(initial=0)) or 1.0
    want = counts / scale
    want[0] = 0
    used, x, rest, block = np.zeros(0, np.int64), np.zeros(0), want.copy(), BLOCK

    def matrix(rows: np.ndarray) -> np.ndarray:
        a = np.zeros((len(counts), len(rows)))
        for k in range(3):
            a[ways[rows, k], np.arange(len(rows))] += 1
        a[0] = 0
        return a

    a, gram, idle_rounds = matrix(used), np.zeros((0, 0)), 0
    for _ in range(ROUNDS):
        if not len(ways) or np.abs(rest).sum() <= SETTLED * want.sum():
            break
        slope = rest[ways].sum(1)
        slope[used] = -1
        best = np.argpartition(-slope, min(len(slope) - 1, 16 * block))[: 16 * block]
        best = best[np.argsort(-slope[best], kind="stable")]
        taken, new = set(), []
        for k in best[slope[best] > 1e-9].tolist():
            lengths = set(ways[k].tolist()) - {0}
            if not lengths & taken:
                taken |= lengths
                new.append(k)
                if len(new) == block:
                    break
        if not new:
            break
        before, more = used, matrix(np.array(new))
        used, x = np.concatenate((used, new)), np.concatenate((x, np.zeros(len(new))))
        across = a.T @ more
        gram, a = np.block([[gram, across], [across.T, more.T @ more]]), np.concatenate((a, more), 1)
        while len(used):
            z = np.linalg.solve(gram + 1e-10 * np.eye(len(used)), a.T @ want)
            low = z <= 1e-12
            if not low.any():
                x = z
                break
            idle = low & (x <= 1e-12)
            if not idle.any():  # as far as the first of them allows, which leaves in any case
                z = np.where(low, np.minimum(z, 0), z)
                allowed = np.where(low, x / np.where(low, x - z, 1), np.inf)
                first = int(allowed.argmin())
                x = x + allowed[first] * (z - x)
                idle = low & (x <= 1e-12)
                idle[first] = True
            used, x, a, gram = used[~idle], np.maximum(x[~idle], 0), a[:, ~idle], gram[~idle][:, ~idle]
        unexplained, rest = np.abs(rest).sum(), want - a @ x
        idle_rounds = idle_rounds + 1 if unexplained - np.abs(rest).sum() < STALLED * want.sum() else 0
        if idle_rounds == 2:
            break
        if np.array_equal(np.sort(used), np.sort(before)):
            if block == 1:
                break
            block = 1
        else:
            block = BLOCK
    return used, x * scale


@dataclass
class Plan:
    """Where the piece with a length and a rank lies: ``key`` (length << 48 | rank) to sequence and offset, and where what is cut begins."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    packed: np.ndarray
    laid: np.ndarray
    first_cut: int
    window: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset and how many ids lie there; the rest begins the next sequence."""
        key = (length << 48) | rank
        slot = np.maximum(np.searchsorted(self.key, key, "right") - 1, 0)
        whole = rank < self.packed[length]
        at = self.laid[length] + (rank - self.packed[length]) * length
        if len(self.key):
            sequence, offset = self.sequence[slot] + key - self.key[slot], self.offset[slot]
        else:
            sequence = offset = np.zeros_like(at)
        sequence = np.where(whole, sequence, self.first_cut + at // self.window)
        offset = np.where(whole, offset, at % self.window)
        return sequence, offset, np.minimum(length, self.window - offset)


def plan(counts: np.ndarray, window: int = WINDOW) -> Plan:
    """The plan for pieces of which ``counts[k]`` have length k."""
    left = counts.astype(np.int64).copy()
    slots: list[tuple[int, int, int, int]] = []
    n_sequences, packed = 0, np.zeros(window + 1, np.int64)

    def take(lengths: list[int], times: int) -> None:
        nonlocal n_sequences
        offset = 0
        for k in lengths:
            slots.append((k, int(packed[k]), n_sequences, offset))
            packed[k] += times
            left[k] -= times
            offset += k
        n_sequences += times

    if left[window]:
        take([window], int(left[window]))
    ways = combinations(left > 0, window)
    used, repeats = solve(ways, left.astype(float))
    for k in np.argsort(-repeats, kind="stable").tolist():
        lengths = [x for x in ways[used[k]].tolist() if x]
        times = min([int(repeats[k] + 1e-6), *(int(left[x]) // lengths.count(x) for x in lengths)])
        if times > 0:
            take(lengths[::-1], times)
    rest = left.copy()
    while rest.any():  # each turn uses a length up, or leaves fewer of it than a sequence takes
        longest = int(np.flatnonzero(rest)[-1])
        lengths, gap, free = [longest], window - longest, rest.copy()
        free[longest] -= 1
        while gap > 0 and (fits := np.flatnonzero(free[: gap + 1])).size:
            k = int(fits[-1])
            times = min(gap // k, int(free[k]))
            lengths += [k] * times
            free[k] -= times
            gap -= k * times
        if gap > SLACK:
            rest[longest] = 0  # what could fill it only becomes less
            continue
        each = np.bincount(lengths, minlength=window + 1)
        times = int((rest[each > 0] // each[each > 0]).min())
        take(lengths, times)
        rest -= each * times
    sizes = left[::-1] * np.arange(window, -1, -1)
    laid = (np.cumsum(sizes) - sizes)[::-1].copy()
    slots.sort()
    columns = [np.array(x, np.int64) for x in zip(*slots, strict=True)] if slots else [np.zeros(0, np.int64)] * 4
    return Plan((columns[0] << 48) | columns[1], columns[2], columns[3], packed, laid, n_sequences, window)


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids, sequence_id, offset`` of each piece; ids are little-endian unsigned 32-bit integers
    (stored in two bytes each until then if the vocabulary has up to 65536 tokens)."""
    tables = Scratch(docs.sparkSession, "packing")
    pieces = tables.store(tokenized(docs, path, end_id, window), "pieces")
    counts = tables.store(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length at most
        histogram[r.length] = r.n
    where = plan(histogram, window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            sequence, offset, here = where.place(length, batch.column("rank").to_numpy())
            parts = 1 + (here < length)
            of, again = np.repeat(np.arange(len(length)), parts), np.zeros(int(parts.sum()), bool)
            again[np.cumsum(parts)[parts == 2] - 1] = True
            raw = utf8(batch.column("ids"))[0].tobytes()
            raw = np.frombuffer(raw, "<u4" if len(raw) == 4 * length.sum() else "<u2").astype("<u4")
            size = np.where(again, (length - here)[of], here[of])
            start = batch.column("start").to_numpy()[of] + np.where(again, here[of], 0)
            rows = pa.array(of)
            columns = [
                batch.column("doc_id").take(rows), pa.array(start), pa.array(size), batch.column("doc_tokens").take(rows), _binary(raw, size),
                pa.array(sequence[of] + again), pa.array(np.where(again, 0, offset[of])),
            ]
            yield pa.record_batch(columns, names)

    schema = f"{PIECES}, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]
    ranked = pieces.join(first, ["part", "length"]).select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("before") + F.col("turn")).alias("rank"))
    return ranked.mapInArrow(run, schema)


def op13_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
