"""Phrase collocations against brute force; counting quotient filters against plain counters."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarrylens.llm import phrases


def slow(rows, least=10, top=2000):
    """Rows of the result from (lang, text)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            own = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(own)
            for k in (1, 2, 3):
                for i in range(len(own) - k + 1):
                    counts[lang][tuple(own[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = defaultdict(int)
        for p, a in found.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longest[q] = max(longest[q], a)
        ranked = []
        for p, a in found.items():
            if 100 * longest[p] >= 50 * a:
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for place, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, place, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts(seed, n):
    rng = np.random.default_rng(seed)
    stock = ["new", "York", "city", "the", "THE", "of", "ünï", "文字", "a b", "x\x1cy", "don't", "a.b", "e,", "end.", "no!\n", "\r", "t\tt"]
    return [" ".join(rng.choice(stock, rng.integers(1, 60), p=np.array([8] * 6 + [3] * 11) / 81)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    langs = ["en", "en", "de", None, "und", ""]
    own = [(langs[i % 6], t) for i, t in enumerate(texts(1, 240))]
    return own + [("en", None), ("en", ""), ("en", " \t\n.,"), (None, None), ("fr", "seul mot"), ("en", "alpha beta " * 3000),
                  ("en", own[0][1]), ("en", own[0][1])]


SCHEMA = "lang string, text string, id int, word string, f int, n string, score string"


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", 2, "n", "s") for r in rows], SCHEMA).repartition(5).cache()


def told(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def test_collocations(docs, rows):
    found = told(phrases.collocations(docs))
    assert found == slow(rows) and len(found) > 50


def test_few_rows_and_ties(docs, rows):
    assert told(phrases.collocations(docs, least=2, top=7)) == slow(rows, 2, 7)


@pytest.mark.parametrize("fan_bits, shard, entries", [(1, 500, 64), (2, 2000, 16), (10, 100, 1 << 20)])
def test_rounds(docs, rows, monkeypatch, fan_bits, shard, entries):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrases, "RANGE_ENTRIES", entries)
    assert told(phrases.collocations(docs, fan_bits=fan_bits)) == slow(rows)


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert told(phrases.collocations(none)) == []
    assert told(phrases.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string"))) == []


@pytest.mark.parametrize("bits", [2, 3, 7, 16, 21, 22, 25, 31, 32])
def test_keys_are_invertible(bits):
    rng = np.random.default_rng(bits)
    words = rng.integers(0, 1 << bits, (3, 5000)).astype(np.uint64)
    words[2, ::3] = 0
    left, right = phrases.permuted(words, bits)
    half = phrases.half_bits(bits)
    assert int(left.max()) < 1 << half and int(right.max()) < 1 << half
    assert (phrases.restored(left, right, bits) == words).all()
    again = phrases.parted(*phrases.joined(left, right, half), half)
    assert (again[0] == left).all() and (again[1] == right).all()


@pytest.mark.parametrize("bits", [2, 5, 16, 22, 27, 32])
def test_filters_keep_everything(bits):
    rng = np.random.default_rng(bits)
    words = rng.integers(0, min(1 << bits, 40), (3, 4000)).astype(np.uint64)
    half = phrases.half_bits(bits)
    total = 2 * half
    uses = rng.choice([1, 2, 254, 255, 256, 10 ** 12], 4000)
    want = Counter()
    for key, n in zip(zip(*words.tolist()), uses.tolist()):
        want[key] += n
    merged = phrases._merged(*phrases.joined(*phrases.permuted(words, bits), half), uses)
    for after in (0, 1, min(10, total)):
        got = Counter()
        for batch in phrases._filters_by_range(*merged, 3, 0, after, total):
            for group, number, data in zip(*(c.to_pylist() for c in batch.columns)):
                high, low, n = phrases.read_filter(data, total - after, number)
                assert group == 3 and (phrases._merged(high, low, n)[1] == low).all()
                for key, v in zip(zip(*phrases.restored(*phrases.parted(high, low, half), bits).tolist()), n.tolist()):
                    got[key] += v
        assert got == want


def test_filter_is_small():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 1 << 16, (3, 100_000)).astype(np.uint64)
    keys = phrases._merged(*phrases.joined(*phrases.permuted(words, 16), 24), np.ones(100_000, np.int64))
    size = sum(len(f) for b in phrases._filters_by_range(*keys, 0, 0, 4, 48) for f in b.column(2).to_pylist())
    assert size < 7 * 100_000
