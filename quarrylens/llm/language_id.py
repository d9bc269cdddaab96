"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text.  A document is parsed with every automaton: from the root it
follows the text as far as the automaton goes, which is the longest match; then a phrase ends and the next one begins.
Text of the automaton's own language needs few, long phrases.  The number of phrases times the log of the reference
length, per symbol, estimates the cross entropy, and the language with the least wins.

The references are bounded samples (``REFERENCE`` bytes per label), so the labelled pieces are all that is sent to the
tasks.  Whole texts are parsed, in blocks of ``BLOCK`` symbols which all move through the tables at once; a phrase ends
at the end of a block, the same for all languages.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import add_column, fresh_name, held, held_out

#: Bytes of labelled text per language, and the largest number of documents they are drawn from.
REFERENCE, PIECES = 65_536, 256
#: Symbols parsed from one start.
BLOCK = 1024
#: Documents whose best language needs more bits per symbol than this fit no language; see :func:`fits_a_language`.
#: Text of a learned language needs 2 to 3, random letters above 5, another script 16.
MOST_BITS = 5.0
KIND = "struct<lang: string, score: double, bits: double>"

#: Bytes that are no part of a word (ASCII other than letters) become one symbol.
_TABLE = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def symbols(text: str) -> np.ndarray:
    """Lower-cased UTF-8 with every run of other characters as one blank."""
    raw = _TABLE[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    blank = raw == 32
    return raw[~(blank & np.concatenate([[False], blank[:-1]]))] if len(raw) else raw


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of ``text``; state 0 is the root."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p, last = last, new
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p == -1:
            continue
        q = step[p][c]
        if length[q] == length[p] + 1:
            link[new] = q
            continue
        twin = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = link[new] = twin
        while p != -1 and step[p].get(c) == q:
            step[p][c] = twin
            p = link[p]
    return step


class Parser:
    """Suffix automata of several languages in one table."""

    def __init__(self, references: dict[str, bytes]):
        self.names = sorted(references)
        letters = sorted(set().union(*references.values())) if references else []
        self.code = np.zeros(256, np.int32)
        self.code[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        tables, self.roots, base = [], [], 0
        for name in self.names:
            steps = suffix_automaton(references[name])
            table = np.full((len(steps), self.width), -1, np.int32)
            for state, out in enumerate(steps):
                for c, to in out.items():
                    table[state, self.code[c]] = base + to
            # where a match ends, the table holds the complement of the state that begins the next phrase
            begin = np.where(table[0] >= 0, table[0], base)
            tables.append(np.where(table >= 0, table, ~begin))
            self.roots.append(base)
            base += len(steps)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.log = np.array([math.log2(max(2, len(references[n]))) for n in self.names])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Ended phrases per text and language."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not len(self.names) or not sizes.sum():
            return out
        flat = self.code[np.concatenate(texts)]
        n_blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, n_blocks) + number * BLOCK
        length = np.minimum(BLOCK, np.repeat(sizes, n_blocks) - number * BLOCK)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(owner), 1)
        count = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-length, -np.arange(BLOCK), "left")  # blocks longer than each step
        width = np.int32(self.width)
        for t in range(int(length[0])):
            n = active[t]
            at = state[:, :n]
            to = self.table[at * width + flat[start[:n] + t]]
            ended = to >> 31
            count[:, :n] -= ended
            state[:, :n] = to ^ ended
        np.add.at(out, owner, count.T)
        return out

    def identify(self, texts: list[str | None]) -> list[dict]:
        parts = [symbols(t or "") for t in texts]
        found = self.phrases(parts)
        out = []
        for text, part, phrases in zip(texts, parts, found):
            if not len(self.names) or not text or not any(map(str.isalpha, text)):
                out.append({"lang": "und", "score": 0.0, "bits": None})
                continue
            bits = phrases * self.log
            best = int(np.argmin(bits))
            chance = 1.0 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()
            out.append({"lang": self.names[best], "score": float(chance), "bits": float(bits[best] / len(part))})
        return out


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = REFERENCE,
               pieces: int = PIECES) -> dict[str, bytes]:
    """Labelled text per language, at most ``size`` bytes each: pieces of the rows with the smallest hashes.

    A row is drawn by a threshold on its hash, set from the number of rows of its language; repeated rows count once.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row per label
    if not counts:
        return {}
    n = F.element_at(F.create_map(*[F.lit(x) for row in counts for x in row]), F.col("lang"))
    share = F.shiftrightunsigned("h", 11) * F.lit(2.0 ** -53)
    piece = F.greatest(F.lit(256), (F.lit(size) / F.least(n, F.lit(pieces))).cast("int"))
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - piece)).cast("int") + 1
    drawn = rows.where(share * n <= 4 * pieces).select(
        "lang", "h", F.substring(F.col("text"), start, piece).alias("piece"))
    drawn = drawn.groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    ranked = drawn.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "piece"))), 1, pieces).alias("all"))
    out = {}
    for lang, found in ranked.collect():
        joined = b" ".join(symbols(p).tobytes() for _, p in found)[:size]
        if joined.strip():
            out[lang] = joined
    return out


def _parser(learned: tuple) -> Parser:
    """Built once per Python worker, which runs many tasks."""
    return held(("parser", learned), lambda: Parser(dict(learned)))


def with_language(docs: DataFrame, learned: dict[str, bytes], name: str, text_col: str = "text",
                  keep=None) -> DataFrame:
    """``docs`` with the column ``name``: language, probability among the learned ones, bits per symbol."""
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def make():
        return _parser(tuple(sorted(sent.value.items()))).identify

    return add_column(docs, {"text": F.col(text_col)}, name, KIND, make, keep)


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    folds: int = 3) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, bits``.

    Learns from labelled rows that are not held out.  ``und`` (score 0) stands for a null text, one without a letter, or
    a table without any label to learn from.  Ties go to the first name.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("held_out", held_out("doc_id", folds))
    learned = references(rows.where(~F.col("held_out")))
    found = with_language(rows, learned, "found", keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.bits")


def fits_a_language(docs: DataFrame, learned: dict[str, bytes], most_bits: float = MOST_BITS,
                    text_col: str = "text") -> DataFrame:
    """The documents that read as one of the languages, with the columns of ``docs``."""
    name = fresh_name(docs.columns, "_found")
    found = with_language(docs, learned, name, text_col)
    return found.where((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.bits") <= most_bits)).drop(name)
