"""Benchmark decontamination: windows of test words are looked up in the words of training documents.

The benchmark's windows become one sorted array of 64-bit hashes per window length, made once and sent to all tasks.  Documents
are scanned once, without a shuffle: words become numbers of the benchmark's vocabulary, a window holding any other word
cannot match, the remaining windows are hashed and looked up, and every hit is verified word by word.

What is sent is bounded: benchmarks above ``BLOCK_BYTES`` of text are sent in blocks, one scan of the documents each.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import add_column, fresh_name, stash

#: Words of an item or document that form a window.
WINDOW = 10
#: Bytes of benchmark text sent to the tasks at once.
BLOCK_BYTES = 32_000_000
#: Kind of the column that :func:`overlaps` adds; spans are word numbers, end exclusive.
KIND = "struct<n_words: bigint, items: array<string>, spans: array<struct<start: bigint, end: bigint>>>"

#: ASCII letters and digits and all other characters above 7F form words; A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Windows:
    """All windows of some items, by length: sorted hashes, where their words stand and the items they come from.

    Everything but the vocabulary is an array over the words of the items, about 24 bytes a word.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        parts, owners, starts = [], [], {}
        names: dict[str | None, int] = {}
        at = 0
        for name, text in items:
            words = normal_words(text)
            if words:
                parts.append(np.fromiter((number(w, len(self.vocabulary) + 1) for w in words), np.uint32, len(words)))
                owners.append(np.full(len(words), names.setdefault(name, len(names)), np.int32))
                n = min(width, len(words))
                starts.setdefault(n, []).append(np.arange(at, at + len(words) - n + 1, dtype=np.int64))
                at += len(words)
        self.names = list(names)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        self.lengths = {n: self._table(n, np.concatenate(found), owner) for n, found in starts.items()}

    def _table(self, n: int, starts: np.ndarray, owner: np.ndarray):
        """Factor of the hash, distinct hashes, a place of each, and the items of each as (first, numbers)."""
        factor = np.uint64(0x9E3779B97F4A7C15)
        while True:
            keys = self._hash((self.words[starts + j] for j in range(n)), factor)
            order = np.argsort(keys, kind="stable")
            keys, place = keys[order], starts[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = keys[1:] != keys[:-1]
            again = np.flatnonzero(~fresh)
            if all((self.words[place[again] + j] == self.words[place[again - 1] + j]).all() for j in range(n)):
                break
            factor += np.uint64(2)  # two windows with one hash: take another one
        pairs = np.unique((np.cumsum(fresh) - 1) << 32 | owner[place])
        first = np.searchsorted(pairs >> 32, np.arange(int(fresh.sum()) + 1))
        return factor, keys[fresh], place[fresh], first, (pairs & 0xFFFFFFFF).astype(np.int32)

    @staticmethod
    def _hash(columns, factor: np.uint64) -> np.ndarray:
        """Polynomial of word numbers modulo 2**64; ``columns`` yields the first words, then the second, and so on."""
        total = np.uint64(0)
        for words in columns:
            total = total * factor + words
        return total

    def hits(self, ids: np.ndarray):
        """(length, starts, positions in the window table) of all verified windows in ``ids``; 0 is no known word."""
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, (factor, keys, place, _, _) in self.lengths.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(unknown[n:] == unknown[:-n])
            hashed = self._hash((ids[starts + j] for j in range(n)), factor)
            at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            same = keys[at] == hashed
            starts, at = starts[same], at[same]
            same = np.ones(len(starts), bool)
            for j in range(n):
                same &= ids[starts + j] == self.words[place[at] + j]
            yield n, starts[same], at[same]

    def items(self, n: int, at: int) -> list[str | None]:
        """The items with the window number ``at`` of length ``n``."""
        _, _, _, first, members = self.lengths[n]
        return [self.names[k] for k in members[first[at]:first[at + 1]]]


def _scanner(windows: Windows):
    known = windows.vocabulary.get

    def scan(texts: list[bytes | None]) -> list[dict]:
        first, parts = [0], []
        for text in texts:
            words = normal_words(text)
            ids = np.zeros(len(words) + 1, np.uint64)  # a gap, so that no window crosses two documents
            ids[:-1] = np.fromiter(map(known, words, repeat(0)), np.uint64, len(words))
            parts.append(ids)
            first.append(first[-1] + len(ids))
        edges = np.array(first)
        out = [{"n_words": int(n) - 1, "items": set(), "spans": []} for n in np.diff(edges)]
        change = np.zeros(edges[-1] + 1, np.int64)
        for n, starts, at in windows.hits(np.concatenate(parts)):
            np.add.at(change, starts, 1)
            np.add.at(change, starts + n, -1)
            owner = np.searchsorted(edges, starts, "right") - 1
            for doc, k in np.unique(np.stack([owner, at]), axis=1).T.tolist():
                out[doc]["items"].update(windows.items(n, k))
        hit = np.cumsum(change) > 0
        turn = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)):
            doc = np.searchsorted(edges, a, "right") - 1
            out[doc]["spans"].append({"start": int(a - edges[doc]), "end": int(b - edges[doc])})
        for row in out:
            row["items"] = sorted(x for x in row["items"] if x is not None)
        return out

    return scan


def _blocks(items: DataFrame, item_col: str, text_col: str, most: int):
    """The items in lists of about ``most`` bytes of text at most; the driver holds one at a time."""
    size = items.agg(F.sum(F.octet_length(F.coalesce(text_col, F.lit(""))))).first()[0] or 0
    n = max(1, -(-2 * size // most) if size > most else 1)
    block = F.pmod(F.xxhash64(item_col, text_col), F.lit(n))
    for i in range(n):
        rows = items.where(block == i).select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).collect()
        yield n, [(name, bytes(text) if text is not None else None) for name, text in rows]


def overlaps(docs: DataFrame, items: DataFrame, name: str, text_col: str = "text", item_col: str = "item_id",
             item_text: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES,
             keep=None) -> DataFrame:
    """``docs`` with the column ``name``: number of words, ids of the items found, hit word spans.

    A null or empty text has no words and no hits.  An item of fewer than ``width`` words is one window, one without
    words none.  An item with a null id marks hits but is not listed; rows sharing an item id are one item.  Neither
    table needs rows; all columns of ``docs`` stay.
    """
    spark, out, before = docs.sparkSession, docs, None
    for n, block in _blocks(items, item_col, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(Windows(block, width))

        def make(sent=sent):
            return _scanner(sent.value)

        if n == 1:
            return add_column(docs, {"text": F.col(text_col).cast("binary")}, name, KIND, make, keep)
        here = fresh_name(out.columns, name)
        out = stash(add_column(out, {"text": F.col(text_col).cast("binary")}, here, KIND, make), "overlaps")
        if before is not None:
            both = F.struct(
                F.col(f"{here}.n_words").alias("n_words"),
                F.array_sort(F.array_union(f"{before}.items", f"{here}.items")).alias("items"),
                _joined(F.array_sort(F.concat(f"{before}.spans", f"{here}.spans"))).alias("spans"))
            out = out.withColumn(here, both).drop(before)
        before = here
    return out.withColumnRenamed(before, name).select(*(docs.columns if keep is None else keep), name)


def _joined(spans):
    """Sorted spans with touching and overlapping ones made one."""
    def add(done, span):
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(
                          F.concat(done, F.array(span)))

    return F.aggregate(spans, F.array().cast("array<struct<start: bigint, end: bigint>>"), add)


def overlap_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = overlaps(rows, items, "found", "text", keep=["doc_id"], **kw)
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "found.n_words", n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        "found.spans")


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The documents without any hit, with the columns of ``docs``.

    Null and empty texts have no hit and stay; texts of any length are scanned whole; repeated rows and ties stay or go alike;
    without items all documents stay, an empty table stays empty.  No column of ``docs`` clashes with the ones made here.
    """
    name = fresh_name(docs.columns, "_found")
    found = overlaps(docs, items, name, text_col, **kw)
    return found.where(F.size(f"{name}.spans") == 0).drop(name)


def cut_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """All documents, with hit words (and what stands between them) cut out of the text.

    Null and empty texts and those without hits stay as they are, to the last space; repeated rows are cut alike; without items
    nothing is cut, an empty table stays empty.  All columns of ``docs`` stay.
    """
    name = fresh_name(docs.columns, "_found")
    found = overlaps(docs, items, name, text_col, **kw)
    spans = F.transform(f"{name}.spans", lambda s: F.array(s["start"], s["end"]))
    new = fresh_name(found.columns, "_text")

    def make():
        def cut(texts, all_spans):
            return [t if not s else _without(t, s) for t, s in zip(texts, all_spans)]
        return cut

    rest = add_column(found, {"text": F.col(text_col), "spans": spans}, new, "string", make)
    return rest.withColumn(text_col, F.col(new)).select(*docs.columns)


def _without(text: str, spans: list[list[int]]) -> str:
    words = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:words[a][0]])
        at = words[b - 1][1]
    return "".join([*kept, text[at:]])


def items_digest(items: list[str]) -> str:
    """The digest of :func:`overlap_report` for a list of item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
