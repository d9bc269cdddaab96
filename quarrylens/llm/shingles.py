"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The join is exact.  All shingles have one global order, the common ones last; all texts tell how common a shingle is, in a
table of counts by hash.  Sets with similarity 0.8 share a shingle among the first fifth of each (prefix filter), and from where the first shared one stands the rest must still be long enough
(position filter).  Rows of one shingle stand next to each other in a sorted stream and carry the counts of their sets in
``BUCKETS`` buckets, which bound what two sets share; only pairs that pass all three leave the task.  They are
compared shingle by shingle, on their texts.

Equal sets are one node.  Groups of near copies are first compared in stars: in a round every node meets one centre per
shingle, and nodes that are linked already meet no more.  After ``STARS`` rounds the nodes of a shingle that are in different
sets meet, so the connected sets are those of all pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import add_column, discard, slices, stash

#: Words of a shingle, seed of the hash of a word.
WIDTH, SEED = 5, 42
#: Bits of the slot in which a shingle is counted, slots of a block.  This decides the order, not the result.
SLOT_BITS, BLOCK = 22, 1 << 16
#: Rounds of stars before the pairs left are compared.
STARS = 3
#: Buckets in which the shingles of a set are counted (in a byte each, 255 is any number from there on).
BUCKETS = 64
#: Up to so many rows of a shingle meet by shifted arrays; pairs bounded at once.
SMALL, AT_ONCE = 16, 1 << 15
#: The texts of one PARTth as many pairs as there are sets are compared at once.
PART = 6
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    own = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    if not len(own):
        return own
    n = max(1, len(own) - WIDTH + 1)
    out = own[:n].copy()
    for k in range(1, min(WIDTH, len(own))):
        out ^= out >> np.uint64(29)
        out *= _FACTOR
        out += own[k:k + n]
    out ^= out >> np.uint64(32)
    out *= _FACTOR
    return np.unique(out ^ out >> np.uint64(29))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 4/5 or more, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def _slots(own: np.ndarray) -> np.ndarray:
    """The slot of each shingle, from its leading bits."""
    return (own >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slot_counts(stream):
    """How many texts of a task hold a shingle of each slot, in packed blocks."""
    counts, seen = np.zeros(1 << SLOT_BITS, np.uint32), False
    for batch in stream:
        for part in slices(batch, 0, 1):
            found = [_slots(shingles(text)) for text in part.column(0).to_pylist()]
            np.add.at(counts, np.concatenate(found), np.uint32(1))
            seen = True
    if seen:
        packer = zstandard.ZstdCompressor(level=1)
        for at in range(0, len(counts), BLOCK):
            part = counts[at:at + BLOCK]
            if part.any():  # all low bytes come first, the next ones are mostly zero
                body = packer.compress(np.ascontiguousarray(part.view(np.uint8).reshape(-1, 4).T).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([body], pa.binary())],
                                                 names=["block", "body"])


def _levels(stream):
    """From the sorted counts of all tasks, a byte for each slot of a block that grows with the logarithm of their sum."""
    at, total = None, None

    def done():
        level = np.minimum(np.rint(8 * np.log2(total + 1.0)), 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([level.tobytes()], pa.binary())],
                                          names=["block", "body"])

    for batch in stream:
        for block, body in zip(*(batch.column(i).to_pylist() for i in range(2))):
            counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(4, -1)
            if block != at:
                if at is not None:
                    yield done()
                at, total = block, np.zeros(BLOCK, np.int64)
            total += np.ascontiguousarray(counts.T).view("<u4").ravel()
    if at is not None:
        yield done()


def _commonness(docs: DataFrame, text) -> np.ndarray:
    """For each slot, a byte that tells in how many of all texts its shingles are."""
    counted = docs.select(text.alias("text")).mapInArrow(_slot_counts, "block int, body binary")
    found = counted.repartition("block").sortWithinPartitions("block").mapInArrow(_levels, "block int, body binary")
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    for block, body in found.toLocalIterator():
        out[block * BLOCK:(block + 1) * BLOCK] = np.frombuffer(bytes(body), np.uint8)
    return out


def with_prefix(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``struct<node, n, keys>``: name and size of the set of shingles, and the first fifth of it."""
    text = F.col(text_col).cast("binary")
    sent = docs.sparkSession.sparkContext.broadcast(_commonness(docs, text))

    def make():
        common = sent.value

        def one(part):
            own = shingles(part)
            n = len(own)
            first = own[np.argsort(common.take(_slots(own)), kind="stable")[:n - (4 * n + 4) // 5 + 1]]
            node = np.array([xxhash.xxh64_intdigest(own.tobytes())], np.uint64).view(np.int64)[0]
            sizes = np.minimum(np.bincount((own % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)
            return {"node": int(node), "n": n, "keys": first.tobytes(), "sizes": sizes.tobytes()}

        return lambda texts: list(map(one, texts))

    return add_column(docs, {"text": text}, name, "struct<node: bigint, n: int, keys: binary, sizes: binary>", make)


def _postings(stream):
    """One row per shingle of a prefix."""
    for whole in stream:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            keys = [np.frombuffer(k, np.int64) for k in batch.column(2).to_pylist()]
            sizes = np.fromiter(map(len, keys), np.int64, len(keys))
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            nodes, ns = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes) for i in range(2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(nodes), pa.array(ns.astype(np.int32)),
                 pa.array((np.arange(len(first)) - first).astype(np.int32))], names=["key", "node", "n", "pos"])


def _shared(stream):
    """The rows of a sorted stream whose key another row has; the last row waits for the next batch."""
    waiting, known = None, False
    for batch in stream:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if waiting is None else [waiting, batch]).combine_chunks().to_batches()[0]
        keys = rows.column(0).to_numpy(zero_copy_only=False)
        mark = np.zeros(len(keys), bool)
        mark[0] = known
        mark[1:] |= keys[1:] == keys[:-1]
        mark[:-1] |= keys[1:] == keys[:-1]
        yield rows.slice(0, len(keys) - 1).filter(pa.array(mark[:-1]))
        waiting, known = rows.slice(len(keys) - 1), bool(mark[-1])
    if known:
        yield waiting


class _Rows:
    """Rows of whole keys of a sorted stream as arrays, and which of their pairs may be similar."""

    def __init__(self, parts: list[pa.RecordBatch]):
        whole = [np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(5)]
        self.key, self.node, self.n, self.pos, self.root = whole
        self.sizes = np.concatenate([np.frombuffer(b"".join(p.column(5).to_pylist()), np.uint8).reshape(-1, BUCKETS) for p in parts])
        edge = np.flatnonzero(np.diff(self.key)) + 1
        self.start = np.concatenate([[0], edge]).astype(np.int64)
        self.size = np.diff(np.concatenate([self.start, [len(self.key)]]))

    def pairs(self, i: np.ndarray, j: np.ndarray):
        """Pairs of nodes of the rows ``i`` and ``j`` that pass the filters."""
        for at in range(0, len(i), AT_ONCE):
            a, b = i[at:at + AT_ONCE], j[at:at + AT_ONCE]
            n, m = self.n[a].astype(np.int64), self.n[b].astype(np.int64)
            rest = np.minimum(n - self.pos[a], m - self.pos[b])
            near = (self.root[a] != self.root[b]) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * rest >= 4 * (n + m))
            a, b, both = a[near], b[near], (n + m)[near]
            x, y = self.sizes[a], self.sizes[b]
            low = np.minimum(x, y)
            near = (9 * low.sum(1, dtype=np.int64) >= 4 * both) | (low == 255).any(1)
            a, b = self.node[a[near]], self.node[b[near]]
            if len(a):
                yield np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)

    def with_centre(self, turn: int):
        """Every row with one row of its key."""
        order = (self.node.view(np.uint64) ^ np.uint64(turn)) * _FACTOR
        order ^= order >> np.uint64(31)
        least = np.repeat(np.minimum.reduceat(order, self.start), self.size)
        centre = np.flatnonzero(order == least)
        first = centre[np.searchsorted(centre, self.start)]
        yield from self.pairs(np.arange(len(self.key)), np.repeat(first, self.size))

    def all_left(self):
        """All rows of each key with each other; few by shifted arrays, many by blocks of rows."""
        few = np.repeat(self.size <= SMALL, self.size)
        ends = np.repeat(self.start + self.size, self.size)
        at = np.flatnonzero(few)
        for step in range(1, SMALL):
            at = at[at + step < ends[at]]
            if not len(at):
                break
            yield from self.pairs(at, at + step)
        for k in np.flatnonzero(self.size > SMALL):
            start, size = int(self.start[k]), int(self.size[k])
            if (self.root[start:start + size] == self.root[start]).all():
                continue
            height = max(1, AT_ONCE // size)
            for top in range(0, size, height):
                rows = np.arange(top, min(size, top + height))
                i, j = np.repeat(rows, size), np.tile(np.arange(size), len(rows))
                yield from self.pairs(start + i[i < j], start + j[i < j])


def _candidates(turn: int):
    """Task: pairs of the rows of each key in a sorted stream; the rows of the last key wait for the next batch."""
    def made(parts):
        rows = _Rows(parts)
        for found in rows.with_centre(turn) if turn < STARS else rows.all_left():
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(stream):
        waiting: list[pa.RecordBatch] = []
        for batch in stream:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (waiting and waiting[-1].column(0)[0].as_py() != keys[0]):
                parts = [*waiting, batch.slice(0, cut)] if cut else waiting
                yield from made(parts)
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield from made(waiting)

    return run


def _compared(stream):
    """The pairs whose texts are similar."""
    for whole in stream:
        for at in range(0, whole.num_rows, 500):
            batch, sets, out = whole.slice(at, 500), {}, []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for node, text in ((a, x), (b, y)):
                    if node not in sets:
                        sets[node] = shingles(text)
                if similar(sets[a], sets[b]):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in range(2)], names=["a", "b"])


def similar_pairs(pairs: DataFrame, sets: int, texts) -> list[DataFrame]:
    """The pairs ``a, b`` of nodes whose texts are similar, in parts.

    A pair moves two texts; so many pairs are compared at once that no more than a part of the texts of all ``sets`` is on the move.
    """
    said = stash(texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), "texts")
    n = -(-pairs.count() * PART // max(1, sets)) or 1
    similar = []
    for part in range(n):
        some = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(n)) == part)
        similar.append(stash(some.join(said.toDF("b", "text_b"), "b").join(said.toDF("a", "text_a"), "a").select(
            "a", "b", "text_a", "text_b").mapInArrow(_compared, "a bigint, b bigint"), "similar"))
    discard(said)
    return similar


def shingle_links(prefixes: DataFrame, texts, components, linked: list[DataFrame]) -> DataFrame | None:
    """``node, root`` of all nodes with a similar other one; null where there are none.

    ``prefixes``: one row ``node, n, keys, sizes`` per set; ``texts(nodes)`` gives ``node, text`` of some nodes; ``components``
    turns links ``a, b`` into ``node, root``; ``linked``: stashed links between similar sets that are known already.
    """
    def connected(roots: DataFrame | None, links: list[DataFrame]) -> DataFrame | None:
        """The sets that the new links make of those so far, which count as one link from each node to its root."""
        if all(some.isEmpty() for some in links):
            return roots
        stars = [] if roots is None else [roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))]
        return components(reduce(DataFrame.union, [*stars, *links]))

    roots = connected(None, linked)
    discard(*linked)
    posted = prefixes.select("node", "n", "keys").mapInArrow(_postings, "key bigint, node bigint, n int, pos int")
    shared = stash(posted.repartition("key").sortWithinPartitions("key").mapInArrow(
        _shared, "key bigint, node bigint, n int, pos int"), "shared")
    if shared.isEmpty():
        discard(shared)
        return roots
    sets = prefixes.count()
    sizes = stash(prefixes.select("node", "sizes").join(shared.select("node").distinct(), "node", "left_semi"), "sizes")
    for turn in range(STARS + 1):
        known = sizes.withColumn("root", F.col("node"))
        if roots is not None:
            old = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
            known = sizes.join(old, sizes["node"] == old["_node"], "left").select("node", "sizes", F.coalesce("_root", "node").alias("root"))
        rows = shared.join(known, "node").select("key", "node", "n", "pos", "root", "sizes")
        pairs = stash(rows.repartition("key").sortWithinPartitions("key").mapInArrow(
            _candidates(turn), "a bigint, b bigint").distinct(), "pairs")
        similar = similar_pairs(pairs, sets, texts)
        roots = connected(roots, similar)
        discard(pairs, *similar)
    discard(shared, sizes)
    return roots
