"""Language-model scores by logistic context mixing.

A text is its lower-cased words, joined by blanks and closed by a line feed.  Its bytes are written in a Huffman code of the
training bytes, so a byte costs four to five binary decisions instead of eight.  Every decision is predicted by several
hashed contexts (the bytes before it, the word so far).  A context's slot holds how often a 0 and a 1 followed; the log odds
enter a logistic mixer whose weights are gated: which of the long contexts have been seen, and how deep the decision is.  A
last table, indexed by decision and predicted probability, refines the outcome.  The bits of all decisions, after
those of the class of the text, add up to the log probability of the text; it is a proper code, so the sum over all texts is
at most one.

Training is distributed and takes every training document: each task counts its documents into its own tables, tables are
summed slot by slot in blocks, and only two bytes per slot, the coded counts of 0 and 1, are sent back; their size is fixed by
``TABLES``.  A second pass over all training documents sums the slopes and curvatures of the weights and fills the last table;
a decision there is predicted by counts that leave out the word in its own document.  The weights take one Newton step on
these sums.  Where the step starts is found online on a few documents (``SAMPLE``).  Scoring changes nothing, so a score depends
on no order, partitioning or retry.

The plain score next to it is a smoothed word frequency.  Each chunk of documents asks for the frequencies of its distinct
words, buckets of words answer all chunks, so neither the vocabulary nor the corpus is ever in one place.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarrylens.llm.common import discard, held, held_out, slices, stash

#: Bits of the slot number of each context: two bytes before and the class of the text, three bytes and the class, four
#: bytes, the word so far and the class of the text, the word so far and the class of the word before.
TABLES = (18, 20, 20, 22, 22)
#: Classes of texts and of words before: the most frequent training words, 0 for any other, the last for none.
CLASSES = 16
#: Slots that are summed together; the tables of ``2**FAN_BITS`` tasks meet in one sum.
BLOCK, FAN_BITS = 1 << 15, 6
#: About so many training rows give the weights from which the step on all rows starts.
SAMPLE = 600
#: Bytes of a chunk of documents; bytes that go through the model at once.
CHUNK, PIECE = 16_000_000, 40_000
#: Log odds are kept in steps of 1/16.
SCALE = 16.0
#: Decisions of a learning step, passes over the sample, learning rate of the weights, and what a first entry of the last
#: table counts for.
STEP, PASSES, RATE, PRIOR = 4096, 4, 0.05, 100.0
_END, _PAD = 10, 4
#: How often a word stands in its document, rounded up, is what its counts are lowered by.
LEVELS = np.array([1, 2, *[1 + (1 << k) for k in range(1, 17)], 1 << 20, 1 << 40])
#: Counts below ``EXACT`` are their own code, larger ones are coded in steps of a tenth.
EXACT, _OCTAVE = 64, 191 / 26
_LOG10_2 = math.log10(2.0)


def normalised(text: bytes | None) -> bytes:
    """Lower-cased words joined by blanks."""
    return b" ".join((text or b"").lower().split())


class Code:
    """A Huffman code of bytes: for each byte its nodes and bits from the root."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, i, None) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        inner = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], 256 + inner, (a, b)))
            inner += 1
        paths: list = [None] * 256
        walk = [(heap[0], [])]
        while walk:
            (_, number, children), path = walk.pop()
            if children is None:
                paths[number] = path
            else:
                for bit in (0, 1):
                    walk.append((children[bit], [*path, (number - 256, bit)]))
        self.length = np.array([len(p) for p in paths], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.node = np.array([n for p in paths for n, _ in p], np.uint32)
        self.bit = np.array([b for p in paths for _, b in p], np.uint8)
        self.depth = np.concatenate([np.minimum(np.arange(len(p)), 3) for p in paths]).astype(np.uint8)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, f, np.uint64)]))
                 for f in (_FACTOR, _INVERSE))


class Decisions:
    """All binary decisions of some words: slots per context, bits, depths and where each word begins.

    A word is its bytes and a blank, the end of a text a line feed.  ``group`` and ``before`` are the classes of the text
    and of the word before, below 256.
    """

    def __init__(self, code: Code, words: list[bytes], group: np.ndarray, before: np.ndarray):
        raw = np.frombuffer(b"".join([b"   " + w + b" " if w != b"\n" else b"   \n" for w in words]), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        sizes[[i for i, w in enumerate(words) if w == b"\n"]] = 1
        start = np.cumsum(sizes + 3) - sizes  # where each word begins, after three blanks of context
        owner = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(owner)) + 3 * (owner + 1)
        symbol = raw[at]
        many = code.length[symbol]
        begin = np.cumsum(many) - many
        place = np.repeat(np.arange(len(at)), many)
        path = (code.start[symbol] - begin).take(place) + np.arange(len(place))
        self.node, self.bit, self.depth = code.node.take(path), code.bit.take(path), code.depth.take(path)
        self.word_start = begin[np.cumsum(sizes) - sizes]
        self._place, self._contexts = place, self._hashes(raw, at, start[owner], group[owner], before[owner])

    @staticmethod
    def _hashes(raw, at, start, group, before) -> list[np.ndarray]:
        """A 32-bit hash of each context of every coded byte."""
        x = raw.astype(np.uint32)
        back = [x.take(at - k) for k in (1, 2, 3)]
        four = np.where(at - start >= 1, x.take(np.maximum(at - 4, 0)), np.uint32(32))
        group = group.astype(np.uint32)
        two = back[0] | back[1] << np.uint32(8) | group << np.uint32(16)
        three = back[0] | back[1] << np.uint32(8) | back[2] << np.uint32(16)
        power, inverse = _powers(1 << max(17, len(raw).bit_length()))
        total = np.concatenate([[np.uint64(0)], np.cumsum(raw * power[:len(raw)], dtype=np.uint64)])
        word = (total.take(at) - total.take(start)) * inverse.take(start) + (at - start).astype(np.uint64)
        word = (word ^ (word >> np.uint64(29))) * _FACTOR
        word = (word >> np.uint64(32)).astype(np.uint32)
        return [two * np.uint32(0x9E3779B1), (three | group << np.uint32(24)) * np.uint32(0x85EBCA6B),
                (three | four << np.uint32(24)) * np.uint32(0xC2B2AE35), word ^ group * np.uint32(0x27D4EB2F),
                word * np.uint32(0x165667B1) ^ before.astype(np.uint32) * np.uint32(0x2C1B3C6D)]

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of the words for all their decisions."""
        return np.repeat(values, np.diff(np.append(self.word_start, len(self.bit))))

    def slots(self):
        """The slot numbers of one context after the other."""
        key = self.node * np.uint32(0x9E3779B1)
        for bits, hashed in zip(TABLES, self._contexts):
            slot = hashed.take(self._place)
            slot ^= key
            slot *= np.uint32(0x2C1B3C6D)
            slot >>= np.uint32(32 - bits)
            yield slot.astype(np.int64)


def pieces(words: list[bytes], most: int = PIECE):
    """(first, last) of runs of words of about ``most`` bytes."""
    size = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    cuts = np.flatnonzero(np.diff(size // most)) + 1 if len(words) else []
    edges = [0, *[int(c) for c in cuts], len(words)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def count_tables(code: Code, entries: Entries, times: np.ndarray, tables: list[np.ndarray]) -> None:
    """Add the decisions of the entries, ``times`` over; entry ``2 * slot + bit`` of a table."""
    used = np.flatnonzero(times)
    words = [entries.words[i] for i in entries.word[used]]
    group, before, times = entries.group[used], entries.before[used], times[used]
    for a, b in pieces(words):
        found = Decisions(code, words[a:b], group[a:b], before[a:b])
        each = found.spread(times[a:b]).astype(np.uint32)
        for table, slot in zip(tables, found.slots()):
            slot <<= 1
            slot |= found.bit
            np.add.at(table, slot, each)


class Entries:
    """The distinct (text class, class of the word before, word) of some texts, and which of them each text holds."""

    def __init__(self, words: dict[bytes, int], common: dict[bytes, int], ids: list[np.ndarray]):
        self.words = list(words)
        kind = np.zeros(len(self.words) + 1, np.uint8)
        for w, c in common.items():
            if w in words:
                kind[words[w]] = c
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.first = np.cumsum(sizes) - sizes
        own = kind[flat]
        before = np.concatenate([np.zeros(1, np.uint8), own[:-1]])[:len(own)]
        before[self.first] = CLASSES - 1
        shown = np.repeat(np.arange(len(ids), dtype=np.int32) * CLASSES, sizes)
        shown += own
        shown = np.bincount(shown, minlength=len(ids) * CLASSES).reshape(-1, CLASSES)
        shown[:, 0] = 0
        key = flat.astype(np.int64) * CLASSES
        self.text_class = shown.argmax(1)
        key += np.repeat(self.text_class, sizes)
        key *= CLASSES
        key += before
        place, key = pd.factorize(key)
        self.place = place.astype(np.int32)
        self.word, self.group, self.before = key // CLASSES ** 2, key // CLASSES % CLASSES, key % CLASSES

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of values of entries over the words of each text; every text has its end."""
        return np.add.reduceat(values[self.place], self.first) if len(self.first) else np.zeros(0)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """One signed byte per slot; 0 where nothing was seen."""
    pairs = counts.reshape(-1, 2) + 0.4
    return np.rint(np.clip(SCALE * np.log(pairs[:, 1] / pairs[:, 0]), -127, 127)).astype(np.int8)


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte each."""
    more = EXACT + np.rint(np.log2(np.maximum(counts, EXACT) / EXACT) * _OCTAVE)
    return np.where(counts < EXACT, counts, np.minimum(more, 255)).astype(np.uint8)


def _pairs() -> np.ndarray:
    """The counts of 0 and 1 that each pair of codes (the second in the high byte) stands for."""
    code = np.arange(256)
    value = np.where(code < EXACT, code, np.rint(EXACT * 2.0 ** ((code - EXACT) / _OCTAVE)))
    return np.stack([np.tile(value, 256), np.repeat(value, 256)], 1)


@lru_cache(maxsize=1)
def coded_odds() -> np.ndarray:
    """Log odds of each pair of codes."""
    return log_odds(_pairs())


@lru_cache(maxsize=1)
def left_out_odds() -> np.ndarray:
    """Log odds of each pair of codes without a document, by level of the repeats in it and by the bit that followed."""
    out = []
    for many in LEVELS:
        for bit in (0, 1):
            pairs = _pairs()
            pairs[:, bit] = np.maximum(pairs[:, bit] - many, 0)
            out.append(log_odds(pairs))
    return np.concatenate(out)


def own_levels(ids: list[np.ndarray]) -> np.ndarray:
    """For each word of the texts, the level of its repeats in its text."""
    flat = np.concatenate(ids).astype(np.int64)
    owner = np.repeat(np.arange(len(ids)), np.fromiter(map(len, ids), np.int64, len(ids)))
    place, _ = pd.factorize(flat * len(ids) + owner)
    return np.searchsorted(LEVELS, np.bincount(place))[place]


_BUCKETS = 33


def _chance(mixed: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(mixed, -15, 15)))


class Sums:
    """What all training documents say about a model: slopes and curvatures of its weights, and its last table."""

    def __init__(self, inputs: int):
        self.slope, self.curve = np.zeros((32, inputs)), np.zeros((32, inputs, inputs))
        self.seen, self.ones = np.zeros(256 * _BUCKETS), np.zeros(256 * _BUCKETS)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.slope, self.curve, self.seen, self.ones)])

    def fill(self, values: np.ndarray) -> None:
        at = 0
        for x in (self.slope, self.curve, self.seen, self.ones):
            x.ravel()[:] = values[at:at + x.size]
            at += x.size


class Model:
    """Log odds per context, gated weights, and the last table; ``codes``: the coded counts behind the log odds."""

    def __init__(self, code: Code, odds: list[np.ndarray], codes: list[np.ndarray] | None = None):
        self.code, self.odds, self.codes = code, odds, codes
        self.weights = np.full((32, len(TABLES) + 1), 0.3, np.float32)
        self.weights[:, -1] = 0.0
        self.refined = np.repeat(1 / (1 + np.exp(-np.linspace(-8, 8, _BUCKETS, dtype=np.float32)))[None], 256, 0)

    def _inputs(self, found: Decisions, level: np.ndarray | None = None):
        """Log odds and gate of each decision; with a ``level`` they leave out the document that the decision is of."""
        if level is None:
            odds = [table.take(slot) for table, slot in zip(self.odds, found.slots())]
        else:
            known, at = left_out_odds(), level.astype(np.int32) << 17 | found.bit.astype(np.int32) << 16
            odds = [known.take(codes.take(slot) | at) for codes, slot in zip(self.codes, found.slots())]
        gate = (odds[2] != 0).view(np.uint8) | (odds[3] != 0).view(np.uint8) << 1 | (odds[4] != 0).view(np.uint8) << 2
        gate |= found.depth << 3
        return [o.astype(np.float32) for o in odds], gate.astype(np.int64)

    def _mixed(self, odds, gate) -> np.ndarray:
        out = self.weights[:, -1].take(gate)
        for k, o in enumerate(odds):
            w = (self.weights[:, k] * np.float32(1 / SCALE)).take(gate)
            w *= o
            out += w
        return out

    def _last(self, found: Decisions, mixed: np.ndarray) -> np.ndarray:
        """Probability of a 1 after the last table: half of it, half of the mixer."""
        place = np.clip(mixed, -7.99, 7.99)
        place *= np.float32(2)
        place += np.float32(16)
        low = place.astype(np.int64)
        place -= low
        low += found.node * np.int64(_BUCKETS)
        flat = self.refined.ravel()
        one, two = flat.take(low), flat[1:].take(low)
        two -= one
        two *= place
        one += two
        one += _chance(mixed)
        one *= np.float32(0.5)
        return one

    def start(self, entries: Entries, levels: np.ndarray) -> None:
        """Weights from some texts, online, in steps of blocks in a fixed random order.

        Steps shrink with the squares of the gradients so far, and the weights are averaged over all steps.
        """
        words = [entries.words[i] for i in entries.word[entries.place]]
        if not words:
            return
        group, before = entries.group[entries.place], entries.before[entries.place]
        steps = []
        for a, b in pieces(words, 20_000):
            found = Decisions(self.code, words[a:b], group[a:b], before[a:b])
            odds, gate = self._inputs(found, found.spread(levels[a:b]))
            kept = np.stack(odds).astype(np.int8)
            for at in range(0, len(gate), STEP):
                part = slice(at, at + STEP)
                steps.append((kept[:, part], gate[part].astype(np.uint8), found.bit[part]))
        order = np.random.default_rng(0)
        squares, mean, n = np.full(self.weights.shape, 1e-3), np.zeros(self.weights.shape), 0
        for turn in range(PASSES):
            for i in order.permutation(len(steps)):
                odds, gate, bit = steps[i]
                inputs = np.concatenate([odds / np.float32(SCALE), np.ones((1, len(gate)), np.float32)])
                error = bit - _chance((self.weights[gate].T * inputs).sum(0))
                many = np.maximum(1, np.bincount(gate, minlength=32))
                slope = np.stack([np.bincount(gate, error * x, 32) for x in inputs], 1) / many[:, None]
                squares += slope ** 2
                self.weights += (RATE * slope / np.sqrt(squares)).astype(np.float32)
                if turn:
                    mean += self.weights
                    n += 1
        if n:
            self.weights = (mean / n).astype(np.float32)

    def add(self, sums: Sums, entries: Entries, levels: np.ndarray) -> None:
        """Add what the words of some training texts say; equal words of equal context and level count as one, so many times."""
        place, key = pd.factorize(entries.place.astype(np.int64) * len(LEVELS) + levels)
        times, entry, level = np.bincount(place, minlength=len(key)), key // len(LEVELS), key % len(LEVELS)
        words = [entries.words[i] for i in entries.word[entry]]
        group, before = entries.group[entry], entries.before[entry]
        for a, b in pieces(words):
            found = Decisions(self.code, words[a:b], group[a:b], before[a:b])
            odds, gate = self._inputs(found, found.spread(level[a:b]))
            many = found.spread(times[a:b]).astype(np.float64)
            mixed = self._mixed(odds, gate)
            cell = found.node * np.int64(_BUCKETS) + np.rint(np.clip(mixed, -8, 8) * 2 + 16).astype(np.int64)
            sums.seen += np.bincount(cell, many, len(sums.seen))
            sums.ones += np.bincount(cell, many * found.bit, len(sums.ones))
            order = np.argsort(gate.astype(np.uint8), kind="stable")
            chance, many = _chance(mixed.take(order)).astype(np.float64), many.take(order)
            error, curve = (found.bit.take(order) - chance) * many, chance * (1 - chance) * many
            inputs = np.stack([o.take(order) / SCALE for o in odds] + [np.ones(len(order))])
            ends = np.searchsorted(gate.take(order), np.arange(33))
            for g in np.flatnonzero(np.diff(ends)):
                part = slice(ends[g], ends[g + 1])
                x = inputs[:, part]
                sums.slope[g] += x @ error[part]
                sums.curve[g] += (x * curve[part]) @ x.T

    def step(self, sums: Sums) -> None:
        """One Newton step of the weights, and the last table, from the sums over all training texts."""
        curve = sums.curve + PRIOR * np.eye(sums.curve.shape[-1])
        self.weights = (self.weights + np.linalg.solve(curve, sums.slope[..., None])[..., 0]).astype(np.float32)
        self.refined = ((PRIOR * self.refined.ravel() + sums.ones) / (PRIOR + sums.seen)).astype(np.float32).reshape(256, _BUCKETS)

    def bits(self, entries: Entries) -> np.ndarray:
        """Bits of each entry."""
        words = [entries.words[i] for i in entries.word]
        out = np.zeros(len(words))
        for a, b in pieces(words):
            found = Decisions(self.code, words[a:b], entries.group[a:b], entries.before[a:b])
            odds, gate = self._inputs(found)
            one = self._last(found, self._mixed(odds, gate))
            chance = np.abs(one - (1 - found.bit).astype(np.float32))
            np.maximum(chance, np.float32(2.0 ** -14), out=chance)
            out[a:b] = -np.add.reduceat(np.log2(chance), found.word_start, dtype=np.float64)
        return out


#: Distinct words that a task counts before it passes them on.
_HELD_WORDS = 200_000


def _symbol_counts(stream):
    """Words and how often they occur; bytes, as the texts are coded, without a word."""
    seen, total = Counter(), np.zeros(256, np.int64)

    def batch_of(words, symbols, n):
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(symbols, pa.int32()), pa.array(n, pa.int64())],
                                          names=["word", "byte", "n"])

    def done():
        words, n = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
        each = np.repeat(n, np.fromiter(map(len, words), np.int64, len(words)))
        if words:
            total[:] += np.bincount(np.frombuffer(b"".join(words), np.uint8), each, 256).astype(np.int64)
        total[32] += n.sum()
        seen.clear()
        return batch_of(words, [None] * len(words), n)

    for batch in stream:
        for part in slices(batch, 0, 1):
            for text in part.column(0).to_pylist():
                seen.update(normalised(text).split())
            total[_END] += part.num_rows
            if len(seen) > _HELD_WORDS:
                yield done()
    yield done()
    yield batch_of([None] * 256, list(range(256)), total)


def _words(text: bytes) -> list[bytes]:
    return [*text.split(b" "), b"\n"] if text else [b"\n"]


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def of(self, text: bytes) -> np.ndarray:
        words = _words(text)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def class_bits(counts: np.ndarray) -> np.ndarray:
    """Bits that name the class of a text, from smoothed training frequencies."""
    return -np.log2((counts + 1) / (counts.sum() + CLASSES))


def text_bits(model: Model, entries: Entries, kinds: np.ndarray) -> np.ndarray:
    """Bits of each text: its class, then its words."""
    return kinds[entries.text_class] + entries.per_text(model.bits(entries))


def _by_bucket(words, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words by bucket and value, the order, and the first of each bucket."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    return hashes[order], order, np.searchsorted(bucket[order], np.arange(buckets + 1))


_ROW = "kind int, chunk bigint, bucket int, doc_ids array<{}>, held_out array<boolean>, body binary, more binary"
_NAMES = ["kind", "chunk", "bucket", "doc_ids", "held_out", "body", "more"]


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(counts: np.ndarray) -> bytes:
    """Compressed counts: first all low bytes, then the next ones, which are mostly zero."""
    return _pack(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpack(data), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _rows(id_type: pa.DataType, kind: int, chunk: int, bucket, body, more, ids=None, held=None) -> pa.RecordBatch:
    n = len(body)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, chunk, np.int64)),
        pa.array(np.asarray(bucket, np.int32)), pa.array(ids or [None] * n, pa.list_(id_type)),
        pa.array(held or [None] * n, pa.list_(pa.bool_())), pa.array(body, pa.binary()), pa.array(more, pa.binary())],
        names=_NAMES)


def _gather(code: Code, common: dict, buckets: int, id_type: pa.DataType):
    """Per task: its documents in chunks (kind 0), what each chunk asks (1), the task's tables (2) and its texts by class (3).

    Documents travel as compressed pieces of about 4 MB of text: ids, flags, joined texts and their sizes.
    """
    def close(chunk, ids, learns, numbers, tables, classes):
        """The asks of a chunk; its training documents are added to the tables and to the classes of texts."""
        learns = np.array(learns)
        entries = Entries(numbers, common, ids)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        known = entries.place[np.repeat(learns, sizes)]
        count_tables(code, entries, np.bincount(known, minlength=len(entries.word)), tables)
        classes += np.bincount(entries.text_class[learns], minlength=CLASSES)
        learnt = np.bincount(entries.word[known], minlength=len(numbers))
        hashes, order, first = _by_bucket(numbers, buckets)
        learnt = learnt[order]
        full = np.flatnonzero(np.diff(first))
        cuts = [(first[b], first[b + 1]) for b in full]
        return _rows(id_type, 1, chunk, full, [hashes[x:y].tobytes() for x, y in cuts], [_planes(learnt[x:y]) for x, y in cuts])

    def run(stream):
        tables = [np.zeros(2 << bits, np.uint32) for bits in TABLES]
        classes = np.zeros(CLASSES, np.int64)
        chunk, size, state, any_row = TaskContext.get().partitionId() << 24, 0, ([], [], Numbers()), False
        for batch in (part for whole in stream for part in slices(whole, 2, 1)):
            docs, held = (batch.column(i).to_pylist() for i in (0, 1))
            made = [normalised(t) for t in batch.column(2).to_pylist()]
            ids, learns, numbers = state
            ids += [numbers.of(t) for t in made]
            learns += [not h for h in held]
            lengths = np.array([len(t) for t in made], np.int64)
            yield _rows(id_type, 0, chunk, [0], [_pack(b"".join(made))], [_planes(lengths)], [docs], [held])
            any_row, size = True, size + int(lengths.sum()) + 8 * len(made)
            if size > CHUNK:
                yield close(chunk, *state, tables, classes)
                chunk, size, state = chunk + 1, 0, ([], [], Numbers())
        if size:
            yield close(chunk, *state, tables, classes)
        if any_row:
            yield _rows(id_type, 3, chunk, [0], [classes.tobytes()], [None])
            number, blobs = 0, []
            for table in tables:
                for at in range(0, len(table), 2 * BLOCK):
                    part = table[at:at + 2 * BLOCK]
                    if part.any():
                        blobs.append((number, _planes(part)))
                    number += 1
            yield _rows(id_type, 2, TaskContext.get().partitionId(), [b for b, _ in blobs], [b for _, b in blobs], [None] * len(blobs))

    return run


def _summed(last: bool):
    """Sums of counts per (block of slots, group of tasks), at the last level coded; one sum is held at a time."""
    def run(stream):
        current, total = None, None

        def done():
            body = coded(total).tobytes() if last else _planes(total)
            return pa.RecordBatch.from_arrays([pa.array([current[1]], pa.int64()), pa.array([current[0]], pa.int32()),
                                               pa.array([body], pa.binary())], names=["chunk", "bucket", "body"])

        for batch in stream:
            for chunk, bucket, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts = _from_planes(body)
                if (bucket, chunk) != current:
                    if current is not None:
                        yield done()
                    current, total = (bucket, chunk), np.zeros(len(counts), np.int64)
                total += counts
        if current is not None:
            yield done()

    return run


def _table_sums(tables: DataFrame) -> DataFrame:
    """Coded counts per block of slots from the tables of all tasks, summed by ``2**FAN_BITS`` tasks at a time, level by level."""
    last = tables.agg(F.max("chunk")).first()[0] or 0
    while True:
        tables = tables.withColumn("chunk", F.shiftright("chunk", FAN_BITS))
        final = last >> FAN_BITS == 0
        ordered = tables.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk")
        tables = ordered.mapInArrow(_summed(final), "chunk bigint, bucket int, body binary")
        if final:
            return tables
        tables, last = stash(tables, "sums"), last >> FAN_BITS


def _answers(table: pa.Table) -> pa.Table:
    """Frequencies of the words of a bucket, for each chunk that asked."""
    hashes = [np.frombuffer(b, np.uint64) for b in table["body"].to_pylist()]
    learnt = [_from_planes(b) for b in table["more"].to_pylist()]
    words, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, place, np.concatenate(learnt))
    ends = np.cumsum([len(h) for h in hashes])
    n = table.num_rows
    first = np.arange(n) == 0
    return pa.table({
        "chunk": table["chunk"], "bucket": table["bucket"],
        "body": pa.array([_planes(total[place[e - len(h):e]]) for e, h in zip(ends, hashes)], pa.binary()),
        "tokens": pa.array(np.where(first, total.sum(), 0)), "kinds": pa.array(np.where(first, (total > 0).sum(), 0))})


def _score(sent, common: dict, classes: np.ndarray, buckets: int, tokens: int, kinds: int):
    """Scores of the documents of one chunk, given the answers to it."""
    norm = math.log10(tokens + 0.5 * (kinds + 1))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts, numbers = [t for part in _texts(docs["body"].to_pylist(), docs["more"].to_pylist()) for t in part], Numbers()
        ids = [numbers.of(t) for t in texts]
        counts = np.zeros(len(numbers), np.int64)
        if len(counts):
            bodies = sorted(zip(answers["bucket"].to_pylist(), answers["body"].to_pylist()))
            counts[_by_bucket(numbers, buckets)[1]] = np.concatenate([_from_planes(b) for _, b in bodies])
        entries = Entries(numbers, common, ids)
        bits = text_bits(_model(sent), entries, classes)
        plain = entries.per_text((np.log10(counts + 0.5) - norm)[entries.word])
        known = entries.per_text((counts > 0)[entries.word].astype(np.int64))
        n = len(texts)
        return pa.table({
            "doc_id": docs["doc_ids"].combine_chunks().flatten(), "held_out": docs["held_out"].combine_chunks().flatten(),
            "n_tokens": pa.array(np.fromiter(map(len, ids), np.int64, n)), "n_known": pa.array(known.astype(np.int64)),
            "train_tokens": pa.array(np.full(n, tokens, np.int64)), "base_score": pa.array(plain),
            "score": pa.array(-bits * _LOG10_2), "bits_per_byte": pa.array(bits / np.array([len(t) + 1 for t in texts]))})

    return run


def _texts(bodies, sizes):
    """The texts of some rows of kind 0, row by row."""
    for body, size in zip(bodies, sizes):
        joined, ends = _unpack(body), np.cumsum(_from_planes(size)).tolist()
        yield [joined[x:y] for x, y in zip([0, *ends], ends)]


def _whole_sums(sent, common: dict):
    """Task: the sums of its training documents, one row per number."""
    def run(stream):
        model, sums = _model(sent), Sums(len(TABLES) + 1)
        ids, numbers, size = [], Numbers(), 0

        def close():
            model.add(sums, Entries(numbers, common, ids), own_levels(ids))

        for batch in stream:
            held, bodies, sizes = (batch.column(i).to_pylist() for i in range(3))
            for out, texts in zip(held, _texts(bodies, sizes)):
                learnt = [t for h, t in zip(out, texts) if not h]
                ids += [numbers.of(t) for t in learnt]
                size += sum(map(len, learnt))
                if size > CHUNK:
                    close()
                    ids, numbers, size = [], Numbers(), 0
        if ids:
            close()
        flat = sums.flat()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    return run


def _model(sent) -> Model:
    """The broadcast model, unpacked once per Python worker."""
    name, counts, tables, weights, refined = sent.value

    def make() -> Model:
        if refined is None:  # coded counts, to learn
            model = Model(Code(counts), [], [np.frombuffer(t, "<u2") for t in tables])
            model.weights = weights
            return model
        model = Model(Code(counts), [np.frombuffer(t, np.int8) for t in tables])
        model.weights, model.refined = weights, refined
        return model

    return held(("model", name), make)


def text_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5,
                sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    Both scores are log10 probabilities of the words of the text and an end; a null or empty text is the end alone.  Rows
    whose id leaves 1 modulo ``folds`` are scored only, all others are learnt from too.  Repeated rows get a row each and
    count each time; a null id is learnt from; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    share = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) * F.lit(2.0 ** -53)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.withColumn("held_out", held_out("doc_id", folds))
    learnt = rows.where(~F.col("held_out"))
    symbols = stash(learnt.select("text").mapInArrow(_symbol_counts, "word binary, byte int, n bigint").groupBy("word", "byte").agg(
        F.sum("n").alias("n")), "symbols")
    counts = np.zeros(256, np.int64)
    for byte, n in symbols.where("word is null").select("byte", "n").collect():
        counts[byte] = n
    top = symbols.where("word is not null").orderBy(F.desc("n"), "word").limit(CLASSES - 2).collect()
    common, code = {bytes(r["word"]): i + 1 for i, r in enumerate(top)}, Code(counts)
    discard(symbols)
    drawn = sample / max(1, counts[_END])
    chosen = rows.where(~F.col("held_out") & (share < F.lit(float(drawn)))).select(share.alias("h"), "text").distinct().orderBy("h").collect()
    chosen = [normalised(bytes(t) if t is not None else None) for _, t in chosen]
    width = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_kind = rows.schema["doc_id"].dataType
    id_type = id_kind.simpleString()
    gathered = stash(rows.select("doc_id", "held_out", "text").mapInArrow(
        _gather(code, common, width, to_arrow_type(id_kind)), _ROW.format(id_type)), "gathered", "kind")
    classes = np.zeros(CLASSES, np.int64)
    for (body,) in gathered.where("kind = 3").select("body").collect():
        classes += np.frombuffer(bytes(body), np.int64)
    codes = [np.zeros(1 << bits, np.uint16) for bits in TABLES]
    first = np.cumsum([0, *[max(1, (1 << bits) // BLOCK) for bits in TABLES]])
    for _, bucket, body in _table_sums(gathered.where("kind = 2").select("chunk", "bucket", "body")).collect():
        table = int(np.searchsorted(first, bucket, "right")) - 1
        at = (bucket - first[table]) * BLOCK
        codes[table][at:at + BLOCK] = np.frombuffer(bytes(body), "<u2")
    model, numbers = Model(code, [], codes), Numbers()
    ids = [numbers.of(t) for t in chosen]
    if ids:
        model.start(Entries(numbers, common, ids), own_levels(ids))
    texts = gathered.where("kind = 0")
    # workers keep a model by its name; an address may be used again
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, counts, [t.tobytes() for t in codes], model.weights, None))
    sums = Sums(len(TABLES) + 1)
    whole = texts.select("held_out", "body", "more").mapInArrow(_whole_sums(sent, common), "i bigint, v double")
    found = whole.groupBy("i").agg(F.sum("v").alias("v")).collect()
    sent.destroy()
    values = np.zeros(len(sums.flat()))
    for i, v in found:
        values[i] = v
    sums.fill(values)
    model.step(sums)
    answers = stash(gathered.where("kind = 1").select("chunk", "bucket", "body", "more").groupBy("bucket").applyInArrow(
        _answers, "chunk bigint, bucket int, body binary, tokens bigint, kinds bigint"), "answers")
    tokens, kinds = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    odds = [coded_odds().take(t).tobytes() for t in codes]
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, counts, odds, model.weights, model.refined))
    return texts.select("chunk", "doc_ids", "held_out", "body", "more").groupBy("chunk").cogroup(answers.select("chunk", "bucket", "body").groupBy("chunk")).applyInArrow(
        _score(sent, common, class_bits(classes), width, tokens, kinds),
        f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
        "score double, bits_per_byte double")
