"""Long passages that repeat across documents, found by seed and extend.

Seeds are winnowed anchors: in every window of 50 words the smallest hash of 16 words (the rightmost of equal ones).  So each
window has one seed, two equal windows have equal seeds at the same place, and the windows of a seed are a run of at most 35.
Documents are joined on seeds; a seed that stands in one document only is given up.

A seed is extended for all its occurrences at once, never pair by pair.  Occurrences whose whole run of windows is the same
text are one: all but those of the smallest id are repeats to their full extent.  Of the runs that differ, each is
extended to the left and to the right as far as 50 words reach, once for every way to share them between the two sides; equal
extensions of a seed are a match, and the one with the smallest id is no repeat.  Extensions that follow each other
make up the maximal repeats.  Every join key holds the hash of the seed and one of the extension, 128 bits together.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import add_column, discard, slices, stash

#: Words of a window, of a seed, and the seed of the hash of a word.
WINDOW, ANCHOR, SEED = 50, 16, 42
#: Windows that can hold one seed.
REACH = WINDOW - ANCHOR + 1
#: A null id is the largest one.
LAST_ID = (1 << 63) - 1
_FACTOR, _TWIST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_RUN = "array<struct<at: int, n: int, run: bigint, anchor: bigint>>"


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes in their order."""
    out = left * _FACTOR
    out ^= out >> np.uint64(31)
    out += right
    out *= _TWIST
    return out ^ out >> np.uint64(29)


def gram_hashes(own: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on, put together from runs of 1, 2, 4, ... words."""
    power, size, done, out = own, 1, 0, None
    while True:
        if width & size:
            out = power if out is None else _pair(out[:max(0, len(own) - done - size + 1)], power[done:])
            done += size
        if done == width:
            return out
        power = _pair(power[:max(0, len(power) - size)], power[size:])
        size *= 2


def seeds(grams: np.ndarray) -> np.ndarray:
    """Place of the smallest of ``REACH`` hashes from each place on, the rightmost of equal ones."""
    def lower(a, b):
        return np.where(grams[b] <= grams[a], b, a)

    best, size = np.arange(len(grams)), 1
    while size * 2 <= REACH:
        best = lower(best[:max(0, len(best) - size)], best[size:])
        size *= 2
    rest = REACH - size
    return lower(best[:max(0, len(best) - rest)], best[rest:]) if rest else best


def _runs(stream):
    """One row per run of windows that have the same seed."""
    for batch in stream:
        for part in slices(batch, 2, 1, 2_000_000):
            texts = [(t or b"").split() for t in part.column(2).to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            own = word_hashes([w for t in texts for w in t])
            if len(own) < WINDOW:
                continue
            owner = np.repeat(np.arange(len(texts)), sizes)
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            grams = gram_hashes(own, ANCHOR)
            place = seeds(grams)
            inside = np.flatnonzero(owner[:len(place)] == owner[WINDOW - 1:])
            if not len(inside):
                continue
            edge = np.flatnonzero(np.diff(place[inside])) + 1
            start = inside[np.concatenate([[0], edge])]
            n = np.diff(np.concatenate([[0], edge, [len(inside)]]))
            body = memoryview(own.view(np.uint8))
            runs = np.fromiter((xxhash.xxh64_intdigest(body[8 * a:8 * b]) for a, b in zip(
                start.tolist(), (start + n + WINDOW - 1).tolist())), np.uint64, len(start))
            ids, keys = (part.column(i).to_numpy(zero_copy_only=False)[owner[start]] for i in range(2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[place[start]].view(np.int64)), pa.array(runs.view(np.int64)), pa.array(ids), pa.array(keys),
                 pa.array((start - first[start]).astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["anchor", "run", "id", "key", "at", "n"])


def _extended(stream):
    """One row per window of the runs asked for: the hash of its words."""
    for batch in stream:
        for part in slices(batch, 1, 1, 2_000_000):
            cells = [[] for _ in range(5)]
            for doc, text, asked in zip(*(part.column(i).to_pylist() for i in range(3))):
                grams = gram_hashes(word_hashes(text.split()), WINDOW)
                for ask in asked:
                    n = ask["n"]
                    cells[0].append(np.full(n, ask["anchor"], np.int64))
                    cells[1].append(np.full(n, ask["run"], np.int64))
                    cells[2].append(np.arange(n, dtype=np.int32))
                    cells[3].append(grams[ask["at"]:ask["at"] + n].view(np.int64))
                    cells[4].append(np.full(n, doc, np.int64))
            if cells[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in cells], names=["anchor", "run", "off", "words", "id"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, key, text``: rows with equal ids and texts share a key, and get the same answer."""
    number = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID))
    return docs.select(number.alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"),
                       F.col(text_col).cast("binary").alias("text"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, marks``: of each document with repeats, runs of windows and a bit for each window that is one.

    ``id`` and ``key`` are those of ``_keyed``; a window is a repeat if its words also stand in a row with a smaller id.
    """
    keyed = _keyed(docs, id_col, text_col)
    runs = stash(keyed.mapInArrow(_runs, "anchor bigint, run bigint, id bigint, key bigint, at int, n int"), "runs")
    # What is grouped is written before it is joined on the same key, so that Spark can split a hot key in the join.
    shared = stash(runs.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(
        "anchor"), "shared")
    seeded = stash(runs.join(shared, "anchor"), "seeded")
    discard(runs, shared)
    place = F.struct("id", "key", "at", "n")
    first = stash(seeded.groupBy("anchor", "run").agg(F.min(place).alias("first")), "first")
    several = stash(first.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "several")
    asked = first.join(several, "anchor").groupBy(F.col("first.id").alias("id"), F.col("first.key").alias("key")).agg(
        F.collect_list(F.struct("first.at", "first.n", "run", "anchor")).cast(_RUN).alias("asked"))
    windows = stash(keyed.join(asked, ["id", "key"]).select("id", "text", "asked").mapInArrow(
        _extended, "anchor bigint, run bigint, off int, words bigint, id bigint"), "windows")
    lows = stash(windows.groupBy("anchor", "words").agg(F.min("id").alias("low"), F.max("id").alias("high")).where(
        "low < high").select("anchor", "words", "low"), "lows")
    masks = windows.join(lows, ["anchor", "words"]).where("id > low").groupBy("anchor", "run").agg(
        F.expr("bit_or(shiftleft(1L, off))").alias("mask"))
    told = stash(first.select("anchor", "run", F.col("first.id").alias("low")).join(masks, ["anchor", "run"], "left"), "told")
    discard(windows, first, several, lows)
    whole = F.expr("shiftleft(1L, n) - 1")
    mask = F.when(F.col("id") > F.col("low"), whole).otherwise(F.coalesce("mask", F.lit(0).cast("bigint")))
    marked = seeded.join(told, ["anchor", "run"]).select("id", "key", "at", mask.alias("mask")).where("mask != 0")
    marks = stash(marked.groupBy("id", "key").agg(F.collect_set(F.struct("at", "mask")).alias("marks")), "marks")
    discard(seeded, told)
    return marks


def _spans(marks, n: int) -> list[tuple[int, int]]:
    """Maximal repeats as [start, end) in words, from the marks of a document of ``n`` words."""
    level = np.zeros(n + 1, np.int64)
    for mark in marks or ():
        bits, at = mark["mask"], mark["at"]
        own = np.flatnonzero([bits >> i & 1 for i in range(bits.bit_length())]) + at
        np.add.at(level, own, 1)
        np.add.at(level, own + WINDOW, -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(level[:n]) > 0, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _with_marks(docs: DataFrame, id_col: str, text_col: str):
    """Documents next to their marks."""
    marks = repeated_windows(docs, id_col, text_col).withColumnsRenamed({"id": "_mark_id", "key": "_mark_key"})
    number = F.coalesce(F.col(f"_doc.`{id_col}`").cast("bigint"), F.lit(LAST_ID))
    key = F.xxhash64(F.col(f"_doc.`{id_col}`"), F.col(f"_doc.`{text_col}`"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return rows.join(marks, (number == F.col("_mark_id")) & (key == F.col("_mark_key")), "left").select(
        F.col(f"_doc.`{id_col}`").alias("doc_id"), F.col(f"_doc.`{text_col}`").alias("text"), "_doc", "marks")


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256, repeats`` (spans of words, start and end).

    A word goes if a window of 50 words over it also starts in a document with a smaller id; windows are those of the input.
    A null text has no words; texts below 50 words have no windows and stay whole.  A null id counts as larger than any
    other; rows with the same id (or null ids) are one document for this purpose, so none removes words of the other.
    Repeated rows get a row each, an empty table none; other columns are ignored.
    """
    def make():
        def work(texts, marks):
            out = []
            for text, own in zip(texts, marks):
                words = (text or b"").split()
                spans = _spans(own, len(words))
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append({"n_words": len(words), "n_removed": len(words) - len(kept),
                            "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(),
                            "repeats": [{"start": a, "end": b} for a, b in spans]})
            return out
        return work

    said = "struct<n_words: bigint, n_removed: bigint, kept_sha256: string, repeats: array<struct<start: int, end: int>>>"
    rows = _with_marks(docs, id_col, text_col)
    found = add_column(rows, {"text": F.col("text").cast("binary"), "marks": F.col("marks")}, "_found", said, make,
                       keep=["doc_id"])
    return found.select("doc_id", "_found.*")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of the text; texts without one are left as they are, to the last space.

    The words kept of a text with repeats are joined by one space.  Edge cases as in ``repeat_report``; no row is dropped.
    """
    def make():
        def work(texts, marks):
            out = []
            for text, own in zip(texts, marks):
                if own:
                    words, at, kept = text.split(), 0, []
                    for a, b in _spans(own, len(words)):
                        kept += words[at:a]
                        at = b
                    text = b" ".join(kept + words[at:])
                out.append(text)
            return out
        return work

    rows = _with_marks(docs, id_col, text_col)
    cut = add_column(rows, {"text": F.col("text").cast("binary"), "marks": F.col("marks")}, "_cut", "binary", make, keep=["_doc"])
    return cut.select(*[F.col("_cut").cast("string").alias(c) if c == text_col else F.col(f"_doc.`{c}`") for c in docs.columns])
