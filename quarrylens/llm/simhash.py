"""Near duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments.  Two fingerprints within 4 bits have at most 2 errors in at least two
of the three (two segments with 3 errors each would be 6).  Each segment is decoded in the binary Golay code (23, 12, 7): a
word at distance up to 2 from its codeword gets the index of that codeword, a word at distance 3 the indices of all six
codewords at distance 3 or 4.  Words that differ in at most 2 bits always share an index.  So a key is a pair of segments
with an index of each, and every pair of linked fingerprints meets under at least one key.

Equal fingerprints are one row.  The rows of a key are sorted next to each other and verified there; a key passes on a
star of links per connected set, not its pairs.  Labels then spread over the links, with pointer jumping, until none changes.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm import shingles
from quarrylens.llm.common import add_column, discard, fresh_name, stash

#: Words of a shingle, seed of its hash, bits that two linked fingerprints may differ in.
SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Low bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Up to so many rows under a key are compared by shifted arrays; more are searched from one row to the next.
SMALL = 8
#: Rounds in which a node is compared with one of the nodes near it, before the pairs that are left.
TURNS = 2


def fingerprints(texts: list[bytes | None]) -> list[int]:
    """SimHash of each text as a signed 64-bit number."""
    hashes, counts = [], []
    for text in texts:
        words = (text or b"").lower().split()
        if len(words) >= SHINGLE:
            joined = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)]))
        else:
            joined = iter([b" ".join(words)] if words else [])
        own = list(map(xxhash.xxh64_intdigest, joined, repeat(SEED)))
        hashes.append(np.array(own, np.uint64))
        counts.append(len(own))
    counts = np.array(counts)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        over = ones * 2 > counts[full][:, None]
        out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64).tolist()


@lru_cache(maxsize=1)
def golay_table() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome (11 bits): up to six error patterns that lead to a codeword, and how many there are."""
    unit = []
    for bit in range(23):
        left = 1 << bit
        for high in range(22, 10, -1):
            if left >> high & 1:
                left ^= GENERATOR << (high - 11)
        unit.append(left)
    patterns, found = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    lightest = np.full(2048, 9)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome, pattern = 0, 0
            for b in bits:
                syndrome ^= unit[b]
                pattern |= 1 << b
            lightest[syndrome] = min(lightest[syndrome], weight)
            if weight < 4 or lightest[syndrome] == 3:
                patterns[syndrome, found[syndrome]] = pattern
                found[syndrome] += 1
    return patterns, found


@lru_cache(maxsize=1)
def _syndromes() -> np.ndarray:
    """Syndrome of every word of 12 high bits, added to the low 11 bits by xor."""
    out = np.zeros(4096, np.int64)
    for bit in range(12):
        left = 1 << (bit + 11)
        for high in range(22, 10, -1):
            if left >> high & 1:
                left ^= GENERATOR << (high - 11)
        out[np.arange(4096) >> bit & 1 == 1] ^= left
    return out


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six columns of codeword indices (12 bits) of 23-bit words, and how many of them count."""
    patterns, found = golay_table()
    syndrome = _syndromes()[words >> 11] ^ (words & 2047)
    return (words[:, None] ^ patterns[syndrome]) >> 11, found[syndrome]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all keys of all fingerprints; two rows within ``DISTANCE`` bits share at least one."""
    bits = prints.view(np.uint64)
    own = [codeword_indices((bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    rows, keys = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (left, n_left), (right, n_right) = own[a], own[b]
        for i in range(6):
            for j in range(6):
                at = np.flatnonzero((i < n_left) & (j < n_right))
                rows.append(at)
                keys.append(left[at, i] << 12 | right[at, j] | pair << 24)
    return np.concatenate(rows), np.concatenate(keys)


def _keys(stream):
    for batch in stream:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 4096):
            rows, keys = fuzzy_keys(prints[at:at + 4096])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int32)), pa.array(prints[at:at + 4096][rows])],
                names=["key", "fp"])


def connected(prints: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Links (two columns) that join each fingerprint to the smallest of its connected set."""
    bits, links = np.sort(prints), []
    while len(bits):
        root, ends, rest = bits[0], [bits[0]], bits[1:]
        while ends and len(rest):
            near = np.bitwise_count((rest ^ ends.pop()).view(np.uint64)) <= distance
            if near.any():
                links.append(rest[near])
                ends.extend(rest[near])
                rest = rest[~near]
        bits = rest
        if links and not isinstance(links[-1], tuple):
            mine = []
            while links and not isinstance(links[-1], tuple):
                mine.append(links.pop())
            members = np.concatenate(mine)
            links.append((np.full(len(members), root), members))
    if not links:
        return np.zeros((0, 2), np.int64)
    return np.stack([np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links])], 1)


def _links_of(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Verified links among rows sorted by key."""
    edge = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
    size = ends - starts
    out = []
    few = (size > 1) & (size <= SMALL)
    if few.any():
        first, last = np.repeat(starts[few], size[few]), np.repeat(ends[few], size[few])
        at = first + np.arange(len(first)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
        for step in range(1, SMALL):
            at, last = at[at + step < last], last[at + step < last]
            a, b = prints[at], prints[at + step]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE
            out.append(np.stack([np.minimum(a, b)[near], np.maximum(a, b)[near]], 1))
    for k in np.flatnonzero(size > SMALL):
        out.append(connected(prints[starts[k]:ends[k]]))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _links(stream):
    """Links under each key of a sorted stream; the rows of the last key wait for the next batch."""
    kept_keys, kept = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def batch_of(links):
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    waiting = [(kept_keys, kept)]
    for batch in stream:
        keys, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(keys):
            continue
        if waiting[-1][0].size and keys[-1] == waiting[-1][0][-1] and keys[0] == keys[-1]:
            waiting.append((keys, prints))
            continue
        all_keys = np.concatenate([*[w[0] for w in waiting], keys])
        all_prints = np.concatenate([*[w[1] for w in waiting], prints])
        cut = np.searchsorted(all_keys, all_keys[-1])
        if cut:
            yield batch_of(_links_of(all_keys[:cut], all_prints[:cut]))
        waiting = [(all_keys[cut:], all_prints[cut:])]
    all_keys, all_prints = (np.concatenate([w[i] for w in waiting]) for i in range(2))
    if len(all_keys):
        yield batch_of(_links_of(all_keys, all_prints))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``links`` (columns ``a, b``): the smallest node that it reaches."""
    both = stash(links.union(links.select("b", "a")).distinct().toDF("a", "b"), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("root"))
    lower = None
    while True:
        labels = stash(labels, "labels")
        if lower is not None:
            discard(lower)
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        lower = stash(lower, "lower")
        discard(labels)
        if lower.where("root < old").isEmpty():
            discard(both)
            return lower.select("node", "root")
        ahead = lower.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        labels = lower.join(ahead, lower["root"] == ahead["_n"]).select("node", F.least("root", "_r").alias("root"))


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", keep=None) -> DataFrame:
    """``docs`` with the SimHash of the text (``bigint``) as column ``name``."""
    return add_column(docs, {"text": F.col(text_col).cast("binary")}, name, "bigint", lambda: fingerprints, keep)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links ``a < b`` whose connected sets are those of all pairs within ``DISTANCE`` bits; ``prints``: distinct ``fp``."""
    keyed = prints.select("fp").mapInArrow(_keys, "key int, fp bigint")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    The component is named by its smallest doc_id (null ids are ignored unless all are null).  A null text has no words and
    the fingerprint zero, as has an empty one; all of these are linked like any others.  Repeated rows get a row each, an
    empty table none.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    printed = stash(with_fingerprint(rows, "fp", keep=["doc_id"]), "fingerprints")
    prints = stash(printed.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "prints")
    roots = components(fingerprint_links(prints))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return printed.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _verified_links(prints: DataFrame, texts) -> list[DataFrame]:
    """Stashed links between the nodes of ``prints`` (``node, fp``) with near fingerprints whose texts are similar.

    One node stands for its fingerprint; the others with the same one are compared with it.  For ``TURNS`` rounds each node
    is compared with one near it, and pairs that are connected by then are not compared; all pairs left are.
    """
    named = stash(prints.groupBy("fp").agg(F.min("node").alias("node")), "named")
    side = lambda end: named.select(F.col("fp").alias(end), F.col("node").alias(f"node_{end}"))
    near = fingerprint_links(named).join(side("a"), "a").join(side("b"), "b").select("node_a", "node_b")
    same = prints.join(named.withColumnRenamed("node", "first"), "fp").where("node <> first").select("first", "node")
    pairs = stash(near.union(same).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")), "near")
    discard(named)
    sets, similar = prints.count(), []
    for turn in range(TURNS):
        one = stash(pairs.groupBy("b").agg(F.min_by("a", F.xxhash64(F.lit(turn), "a", "b")).alias("a")).select("a", "b"), "near")
        similar += shingles.similar_pairs(one, sets, texts)
        rest = pairs.join(one, ["a", "b"], "left_anti")
        if not all(some.isEmpty() for some in similar):
            roots = components(reduce(DataFrame.union, similar))
            root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
            rest = rest.join(root("a"), "a", "left").join(root("b"), "b", "left").where(
                F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        rest = stash(rest, "near")
        discard(pairs, one)
        pairs = rest
    similar += shingles.similar_pairs(pairs, sets, texts)
    discard(pairs)
    return similar


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each connected set of near copies, with the columns of ``docs``.

    Near copies have a Jaccard similarity of 0.8 or more of their five-word shingles, compared exactly.  The links of near
    fingerprints, as in ``near_duplicates``, come first; each is checked on its texts.  Similar texts whose fingerprints are
    further apart than its bits meet by their shingles then.  The row with the smallest id stays (null last), then the smallest
    hash of the text, then one of equal rows.  Sets with equal or null ids stay apart.

    The attribute ``stashes`` of the result lists the tables that it reads and that can go when it is written.
    """
    made, number, fp = (fresh_name(docs.columns, name) for name in ("_shingles", "_number", "_print"))
    printed = with_fingerprint(shingles.with_prefix(docs, made, text_col), fp, text_col)
    marked = stash(printed.withColumn(number, F.monotonically_increasing_id()), "marked")
    rank = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"),
                    F.col(number).alias("number"))
    firsts = stash(marked.groupBy(F.col(f"{made}.node").alias("node")).agg(
        F.min(rank).alias("first"), F.min_by(F.col(fp), rank).alias("fp")), "firsts")
    single = firsts.select(F.col("first.number").alias(number))
    prefixes = marked.select(number, f"{made}.*").join(single, number, "left_semi")

    def texts(nodes):
        asked = firsts.join(nodes, "node", "left_semi").select("node", F.col("first.number").alias(number))
        return marked.select(number, F.col(text_col).cast("binary").alias("text")).join(asked, number).select("node", "text")

    roots = shingles.shingle_links(prefixes, texts, components, _verified_links(firsts.select("node", "fp"), texts))
    kept = firsts.select("first")
    if roots is not None:
        old = roots.select(F.col("node").alias("_node"), "root")
        kept = firsts.join(old, firsts["node"] == old["_node"], "left").groupBy(F.coalesce("root", "node")).agg(
            F.min("first").alias("first"))
    out = marked.join(kept.select(F.col("first.number").alias(number)), number, "left_semi").select(*docs.columns)
    out.stashes = [marked, firsts]
    return out
