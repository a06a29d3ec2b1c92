"""N-gram Jaccard join by a MinHash LSH forest.

Two documents are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.

1. One scan names each text by 125 bits of its word sequence and takes ``TREES * DEPTH`` MinHash values. Copies (equal word
   sequences) become one node with a count.
2. The forest: a tree's key holds ``BITS`` bits of each of its ``DEPTH`` values, the tree's number before them, so that sorted keys are
   the tries of all trees, and nodes under one inner node of a trie are neighbours: those whose prefix of that length matches. The matched
   prefix is shortened from full depth, a value at a time, until enough pairs at the threshold share one in one tree at least.
   That recall is measured: one text of ``PLANTED``, chosen by hash, is compared with a variant of itself in which
   so many words are changed that their similarity is just 0.8. The share of trees in which they match is measured for each
   prefix length; the length taken is the largest at which that share, in all trees together, gives ``RECALL`` (``settled_depth``).
3. Nodes alone under their prefix leave; the others are sorted by key and dealt by range, so a hot prefix is spread over
   several tasks. Under a prefix all MinHash values estimate the similarity. A node is compared with leaders; it is
   covered, and leads no more, where it is nearly a leader's copy, so prefixes of near copies don't compare all pairs.
   Estimates far below the threshold (``NEAR``; a pair at 0.8 falls below with a probability under 1e-9) are no candidates; that
   keeps clusters apart that only share passages. Leaders under prefixes at the borders of tasks meet once more, in couples of blocks.
4. Candidate pairs form clusters (connected components). Each cluster's texts meet once and all its pairs are verified exactly,
   clusters of more than ``UNIT`` texts or ``UNIT_BYTES`` in couples of blocks, by products of shingle incidence matrices. Only sums
   of links and one edge for each linked node leave a task; no pairs are emitted.
5. Verified edges give classes, again as connected components.

Edge cases: texts of one to four words are one shingle; texts without words, and rows without doc_id, are in a class of their own
without links; equal rows are copies of each other, and so are rows of one doc_id with equal texts; of a class the least doc_id
stands for it; a very long text is read whole; an empty table gives an empty one; no bucket has a cap; further columns are ignored, whatever their
names, and ``representatives`` returns them as they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import resolve
from .scratch import Scratch, unused
from .textops import U64, Runs, fingerprints, grams, mix, slices, words

SHINGLE, FIVE_J, FOUR = 5, 5, 4  # similarity 4/5: 5 * shared >= 4 * united
TREES, DEPTH, BITS, PLANTED, RECALL = 24, 6, 9, 16, 0.9998
NEAR, COVERED, UNIT, UNIT_BYTES, MEETING = 0.55, 0.95, 1024, 1 << 23, 512


def shingles(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles, and where each text's begin (n + 1 values); a short text is one shingle."""
    n = np.diff(first)
    each = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    begin = np.concatenate(([0], np.cumsum(each)))
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], each) + np.repeat(first[:-1], each)
    out = np.empty(len(at), np.uint64)
    short = np.repeat(n < SHINGLE, each)
    out[~short] = grams(names, SHINGLE)[at[~short]]
    out[short] = Runs(names)(at[short], np.repeat(first[1:], each)[short])
    return out, begin


def minhashes(values: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of each set (uint32); sets must not be empty."""
    x = (values >> U64(32)).astype(np.uint32)
    rng = np.random.Generator(np.random.PCG64(11))
    out = np.empty((len(begin) - 1, n), np.uint32)
    for k in range(n):
        a, b = rng.integers(1, 1 << 31) * 2 + 1, rng.integers(0, 1 << 32)
        out[:, k] = np.minimum.reduceat((x * np.uint32(a)) ^ np.uint32(b), begin[:-1])
    return out


def trie_keys(low: np.ndarray) -> np.ndarray:
    """The keys of each row of MinHash values, one a tree: sorted, they are the trees' tries."""
    values = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, TREES, DEPTH)
    key = np.broadcast_to(np.arange(TREES, dtype=np.uint64), values.shape[:2]).copy()
    for j in range(DEPTH):
        key = key << U64(BITS) | values[:, :, j]
    return key


def matched_trees(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many trees two rows of keys have a common prefix, for each length from one value on."""
    return np.stack([((a ^ b) >> U64(BITS * (DEPTH - d)) == 0).sum(1) for d in range(1, DEPTH + 1)], 1)


def variants(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a few words changed, as evenly as it goes, and which have any: their shingles are 0.8 alike or slightly more."""
    n = np.diff(first)
    changes = np.where(n >= SHINGLE, (n - SHINGLE + 1) // (9 * SHINGLE), 0)
    k = np.arange(changes.sum()) - np.repeat(np.cumsum(changes) - changes, changes)
    step = np.repeat(n / np.maximum(changes, 1), changes)
    at = np.repeat(first[:-1], changes) + ((k + 0.5) * step).astype(np.int64)
    out = names.copy()
    out[at] = mix(out[at] + at.astype(np.uint64) + U64(1))
    return out, changes > 0


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            w = words(part.column("text"))
            n = np.diff(w.first)
            some = np.flatnonzero(n > 0)
            first = np.append(w.first[:-1][some], w.first[-1])
            names = [
                Runs(x, kind)(first[:-1], first[1:])
                for kind, x in (("a", w.name), ("b", fingerprints(w.data, w.start, w.end, "b")))
            ]
            node = np.stack([x.byteswap() for x in names], 1).tobytes()
            low = minhashes(*shingles(w.name, first), TREES * DEPTH) if len(some) else np.zeros((0, TREES * DEPTH), np.uint32)
            keys = trie_keys(low)
            # the sample: its variants, and how far they match
            tried = np.flatnonzero(mix(names[0]) % U64(PLANTED) == 0)
            met = [None] * len(some)
            if len(tried):
                size = n[some[tried]]
                begin = np.concatenate(([0], np.cumsum(size)))
                at = np.arange(begin[-1]) - np.repeat(begin[:-1], size) + np.repeat(first[tried], size)
                changed, has = variants(w.name[at], begin)
                other = trie_keys(minhashes(*shingles(changed, begin), TREES * DEPTH))
                for j, counts in zip(tried[has].tolist(), matched_trees(keys[tried], other)[has].tolist(), strict=True):
                    met[j] = counts
            ends = np.arange(0, keys.size + 1, TREES, dtype=np.int32)
            take = pa.array(some)
            yield pa.record_batch(
                [
                    part.column("doc_id").take(take),
                    part.column("version").take(take),
                    pa.array([node[16 * j : 16 * j + 16] for j in range(len(some))], pa.binary()),
                    pa.array(np.diff(w.offsets)[some]),
                    pa.array(met, pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))),
                    pa.array([x.tobytes() for x in (low & np.uint32(0xFF)).astype(np.uint8)], pa.binary()),
                ],
                ["doc_id", "version", "node", "n_bytes", "met", "keys", "sketch"],
            )


def settled_depth(scanned: DataFrame) -> int:
    """The longest prefix with the wanted recall of the planted pairs; one value if none has it."""
    sums = [F.avg(F.element_at("met", d) / float(TREES)).alias(f"d{d}") for d in range(1, DEPTH + 1)]
    shares = scanned.where("met IS NOT NULL").agg(*sums).first()
    depth = DEPTH
    while depth > 1 and 1 - (1 - (shares[f"d{depth}"] or 0)) ** TREES < RECALL:
        depth -= 1
    return depth


def _estimates(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    same = (sketches == one).mean(1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _bucket(nodes: np.ndarray, sketches: np.ndarray) -> tuple[list[tuple[bytes, bytes]], np.ndarray]:
    """A spanning forest of the candidate pairs of one bucket with its leaders (an edge a node at most), and the leaders' rows."""
    leaders, left, tree = [], np.arange(len(nodes)), np.arange(len(nodes))
    while len(left):
        lead, left = left[0], left[1:]
        leaders.append(lead)
        if len(left):
            e = _estimates(sketches[left], sketches[lead])
            near = left[e >= NEAR]
            if len(near):
                trees = np.unique(np.append(tree[near], tree[lead]))
                tree[np.isin(tree, trees)] = trees[0]
            left = left[e < COVERED]
    return [(nodes[r], nodes[j]) for j, r in enumerate(tree.tolist()) if r != j], np.array(leaders, np.int64)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["key", "a", "b", "sketch"])


_PAIRS = "key long, a binary, b binary, sketch binary"


def _sorted_buckets(batches: Iterator[pa.RecordBatch], borders: bool, shift: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> candidate pairs (a, b) of keys that are equal without their last ``shift`` bits. With ``borders``, leaders
    of the first and last key come as rows with ``sketch`` and without ``b``, as these keys may go on in other tasks."""
    held, first = None, None
    for batch in batches:
        key = batch.column("key").to_numpy() >> shift
        node = batch.column("node").to_pylist()
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(key), -1)
        if held is not None:
            key, node, sketch = np.concatenate((held[0], key)), held[1] + node, np.concatenate((held[2], sketch))
        if not len(key):
            continue
        first = int(key[0]) if first is None else first
        cut = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        last = int(cut[-2]) if len(cut) > 1 else 0
        rows = _matched(key[:last], node[:last], sketch[:last], first if borders else None)
        if rows:
            yield _rows(rows)
        held = key[last:], node[last:], sketch[last:]
    if held is not None:
        rows = _matched(*held, int(held[0][0]) if borders else None)
        if rows:
            yield _rows(rows)


def _matched(key: np.ndarray, node: list[bytes], sketch: np.ndarray, border: int | None) -> list[tuple]:
    if not len(key):
        return []
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    end = np.append(begin[1:], len(key))
    rows = []
    two = (end - begin == 2) & (key[begin] != border if border is not None else True)
    a = begin[two]
    same = (sketch[a] == sketch[a + 1]).mean(1)
    rows += [(None, node[j], node[j + 1], None) for j in a[(same - 1 / 256) / (1 - 1 / 256) >= NEAR].tolist()]
    of = np.array(node, object)
    for b, e in zip(begin[~two].tolist(), end[~two].tolist(), strict=True):
        pairs, leaders = _bucket(of[b:e], sketch[b:e])
        rows += [(None, x, y, None) for x, y in pairs]
        if border is not None and int(key[b]) == border:
            rows += [(border, node[b + j], None, sketch[b + j].tobytes()) for j in leaders.tolist()]
    return rows


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of the nodes of ``edges(a, b)``: equal labels in a connected component."""
    return resolve.components(edges).toDF("node", "label")


def links_within(names: np.ndarray, first: np.ndarray, side: np.ndarray, copies: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Exact links among texts: for each the number of documents it is linked to, and the first text of its component.

    across: only pairs of different sides count."""
    values, begin = shingles(names, first)
    of = np.repeat(np.arange(len(first) - 1), np.diff(begin))
    order = np.lexsort((of, values))
    values, of = values[order], of[order]
    keep = np.append(True, (values[1:] != values[:-1]) | (of[1:] != of[:-1])) if len(values) else np.zeros(0, bool)
    values, of = values[keep], of[keep]
    m = len(first) - 1
    size = np.bincount(of, minlength=m)
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(values)))
    column = np.repeat(np.arange(len(start)), count)
    shared = np.repeat(count > 1, count)
    of, column = of[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((m, m), np.float32)
    step = 1 << 12
    for low in range(0, int(column.max(initial=-1)) + 1, step):
        inside = slice(*np.searchsorted(column, (low, low + step)))
        dense = np.zeros((m, step), np.float32)
        dense[of[inside], column[inside] - low] = 1
        both += dense @ dense.T
    united = size[:, None] + size[None, :] - both
    linked = (FIVE_J * both >= FOUR * united) & (size[:, None] > 0)
    np.fill_diagonal(linked, False)
    if across:
        linked &= side[:, None] != side[None, :]
    root = np.arange(m)
    while True:  # least label around
        least = np.where(linked, root[None, :], m).min(1, initial=m)
        after = np.minimum(root, least)
        after = after[after]
        if (after == root).all():
            break
        root = after
    return linked @ copies, root


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit -> ``node, root, links`` of each linked node."""

    def checked(unit: pa.Table):
        node, side, copies = unit["node"].to_pylist(), unit["side"].to_numpy(), unit["copies"].to_numpy()
        w = words(unit["text"].combine_chunks())
        links, root = links_within(w.name, w.first, side, copies, unit["low"][0].as_py() < unit["high"][0].as_py())
        return [(node[j], node[root[j]], int(links[j])) for j in np.flatnonzero(links).tolist()]

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        unit = np.stack([table[c].to_numpy() for c in ("cluster", "low", "high")], 1)
        cut = [0, *(np.flatnonzero((unit[1:] != unit[:-1]).any(1)) + 1).tolist()]
        rows = [x for a, b in zip(cut, cut[1:], strict=False) for x in checked(table.slice(a, b - a))]
        held = table.slice(cut[-1])
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["node", "root", "links"])
    if held is not None and len(held) and (rows := checked(held)):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["node", "root", "links"])


def _couples(rows: DataFrame, hashed: Column) -> DataFrame:
    """Each row once for each block it meets: adds its block ``side`` and the couples ``low, high``; ``blocks``: how many there are."""
    sided = rows.withColumn("side", F.pmod(hashed, F.col("blocks")).cast("int"))
    sided = sided.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return sided.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, version, class_id, n_links`` of each row of ``docs(doc_id, text)``; ``version`` is a hash of the text.

    ``class_id`` is the least doc_id of the linked documents, ``n_links`` the number of other documents linked directly."""
    spark = docs.sparkSession
    tables = Scratch(spark, "ngrams")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = docs.where("doc_id IS NOT NULL").mapInArrow(_scan, f"doc_id {kind}, version long, node binary, n_bytes long, met array<int>, keys array<long>, sketch binary")
    scanned = tables.store(scanned, "scanned")
    of = scanned.select("doc_id", "version", "node")
    shift = BITS * (DEPTH - settled_depth(scanned))
    nodes = scanned.groupBy("node").agg(F.min(F.struct("doc_id", "version", "n_bytes", "keys", "sketch")).alias("x"), F.count("*").alias("copies"))
    nodes = tables.store(nodes.select("node", "copies", "x.*"), "nodes")
    # the forest
    place = nodes.select("node", F.explode("keys").alias("key")).withColumn("prefix", F.shiftright("key", shift))
    full = tables.store(place.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix"), "full")
    met = place.join(full, "prefix").join(nodes.select("node", "sketch"), "node").select("key", "node", "sketch")
    met = tables.store(met, "met")
    pairs = met.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(lambda b: _sorted_buckets(b, True, shift), _PAIRS)
    pairs = tables.store(pairs, "pairs")
    tables.drop("full", "met")
    border = pairs.where("b IS NULL").select("key", F.col("a").alias("node"), "sketch")
    many = tables.store(border.groupBy("key").agg(F.ceil(F.count("*") / MEETING).cast("int").alias("blocks")), "borders")
    more = _couples(border.join(many, "key"), F.xxhash64("node", F.lit(2))).select(F.xxhash64("key", "low", "high").alias("key"), "node", "sketch")
    more = more.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda b: _sorted_buckets(b, False), _PAIRS)
    candidates = pairs.where("b IS NOT NULL").select("a", "b").unionByName(more.where("b IS NOT NULL").select("a", "b"))
    clusters = components(candidates)
    tables.drop("pairs")
    # verification
    sizes = clusters.join(nodes.select("node", "n_bytes"), "node").groupBy("label").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    blocks = F.least("n", F.greatest(F.ceil(F.col("n") / UNIT), F.ceil(F.col("bytes") / UNIT_BYTES))).cast("int")
    sizes = tables.store(sizes.where("n > 1").select("label", blocks.alias("blocks")), "sizes")
    members = clusters.join(sizes, "label").join(nodes.select("node", "doc_id", "version", "copies"), "node")
    members = members.select("doc_id", "version", "node", "copies", F.xxhash64("label").alias("cluster"), "blocks")
    # a node with the same doc_id and text is found once, whatever the number of its rows
    texts = docs.join(members.hint("merge"), ["doc_id", "version"]).dropDuplicates(["node"])
    units = _couples(texts, F.xxhash64("node", F.lit(1))).select("cluster", "low", "high", "side", "node", "copies", "text")
    units = units.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    verified = tables.store(units.mapInArrow(_verify, "node binary, root binary, links long"), "verified")
    labels = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = tables.store(nodes.select("node", "doc_id", "copies").join(links, "node", "left").join(labels, "node", "left"), "known")
    known = known.withColumn("label", F.coalesce("label", "node"))
    least = known.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    classes = tables.store(known.join(least, "label").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    found = tables.store(of.join(classes, "node").select("doc_id", "version", "class_id", "n_links").distinct(), "found")
    tables.drop("scanned", "nodes", "sizes", "verified", "known", "classes")
    return docs.select("doc_id", "version").join(found, ["doc_id", "version"], "left").select(
        "doc_id", "version", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: the one with the least doc_id."""
    version = unused(docs, "version")
    chosen = join(docs).where("class_id = doc_id").select("doc_id", F.col("version").alias(version)).distinct()
    keyed = docs.withColumn(version, F.xxhash64("text"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return keyed.join(chosen.hint("merge"), ["doc_id", version]).select(*columns).unionByName(docs.where("doc_id IS NULL"))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * k >= 4 * (na.n + nb.n - k)),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
r AS (SELECT a AS doc_id, a AS reach FROM links UNION SELECT r.doc_id, links.b FROM r JOIN links ON r.reach = links.a),
c AS (SELECT doc_id, min(reach) AS class_id FROM r GROUP BY doc_id),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""
