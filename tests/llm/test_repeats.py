"""Repeated passages and whitened embeddings against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import repeats, whitening


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 10 ** 6, n)]


def slow(rows):
    """Per row of (id, text): words, removed words and digest of what is left."""
    low = {}
    for number, text in rows:
        number = repeats.LAST_ID if number is None else number
        own = (text or "").encode().split()
        for i in range(len(own) - 49):
            key = tuple(own[i:i + 50])
            low[key] = min(low.get(key, number), number)
    out = []
    for number, text in rows:
        real = repeats.LAST_ID if number is None else number
        own = (text or "").encode().split()
        gone = set()
        for i in range(len(own) - 49):
            if low[tuple(own[i:i + 50])] < real:
                gone |= set(range(i, i + 50))
        kept = b" ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((number, len(own), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    shared, other, small = words(1, 120), words(2, 60), words(3, 49)
    loop = ["na"] * 130

    def text(*parts, gap=" "):
        return gap.join(w for p in parts for w in p)

    return [
        (1, text(words(10, 80), shared, words(11, 40))), (2, text(shared)), (3, text(words(12, 5), shared[10:70], other)),
        (4, text(other, gap="\n\t ")), (5, text(small)), (6, text(small)), (7, None), (8, ""), (9, " \n"),
        (10, text(loop)), (11, text(words(13, 30), loop[:60], words(14, 3))), (12, text(shared[:50])),
        (13, text(shared[:49], words(15, 60))), (2, text(shared)), (2, text(shared, other)), (None, text(other)),
        (None, text(words(16, 70))), (None, text(words(16, 70))), (14, text(words(10, 80), words(17, 20), shared, shared)),
        (15, text(words(18, 3000), other, words(19, 3000))), (-3, text(words(18, 2000))), (16, text(words(20, 16), words(21, 100))),
        (17, text(words(20, 16), words(22, 100))), (18, text(words(20, 16), words(22, 100)) + " ünï 文字")]


SCHEMA = "doc_id bigint, text string, id int, key string, marks string, _doc string, n int"


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "m", "d", 2) for r in rows], SCHEMA).repartition(4).cache()


def test_repeats(docs, rows):
    found = repeats.repeat_report(docs)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"]
    found = found.collect()
    assert Counter(tuple(r)[:4] for r in found) == Counter(slow(rows))
    for r in found:
        assert r.n_removed == sum(s.end - s.start for s in r.repeats) and all(s.end - s.start >= 50 for s in r.repeats)
        assert all(a.end < b.start for a, b in zip(r.repeats, r.repeats[1:]))


def test_cut_texts(docs, rows):
    found = repeats.without_repeats(docs)
    assert found.columns == docs.columns
    gone = {(n, w, g, h) for n, w, g, h in slow(rows)}
    told = Counter((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in found.collect())
    assert told == Counter((n, h) for n, w, g, h in slow(rows)) and gone
    assert {r.text for r in found.where("doc_id in (7, 8, 9)").collect()} == {None, "", " \n"}


def test_random_texts(spark):
    rng = np.random.default_rng(5)
    stock = [words(s, 200) for s in range(6)]
    rows = []
    for n in range(60):
        parts = []
        for _ in range(rng.integers(1, 5)):
            own = stock[rng.integers(6)]
            a = rng.integers(0, 150)
            parts += own[a:a + rng.integers(20, 120)]
        rows.append((int(n % 50), " ".join(parts)))
    found = repeats.repeat_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert Counter(tuple(r)[:4] for r in found.collect()) == Counter(slow(rows))


def test_few_words_repeat_often(spark):
    rng = np.random.default_rng(6)
    rows = [(n, " ".join(rng.choice(["a", "b"], 300, p=[0.97, 0.03]))) for n in range(12)]
    found = repeats.repeat_report(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(tuple(r)[:4] for r in found.collect()) == Counter(slow(rows))


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repeats.repeat_report(none).collect() == [] and repeats.without_repeats(none).collect() == []


def test_seeds_are_in_every_window():
    rng = np.random.default_rng(2)
    own = rng.integers(0, 5, 400).astype(np.uint64)
    place = repeats.seeds(own)
    for i, p in enumerate(place):
        part = own[i:i + repeats.REACH]
        assert p == i + max(np.flatnonzero(part == part.min()))
    assert len(place) == 400 - repeats.REACH + 1
    wide = repeats.gram_hashes(own, 50)
    same = defaultdict(set)
    for i in range(351):
        same[tuple(own[i:i + 50])].add(int(wide[i]))
    assert len(wide) == 351 and all(len(s) == 1 for s in same.values()) and len(set(wide.tolist())) == len(same)


# whitening --------------------------------------------------------------------------------------------------------

def slow_whiten(vectors, most=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    centred = x - total / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total)) for row in x]
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    return deviation, centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(cov)


def test_whiten(spark):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((200, 6)) @ rng.standard_normal((6, 6)) * [1, 2, 3, 5, 8, 13]).astype(np.float32)
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(good)] + [(0, [float(v) for v in good[0]], "again")]
    bad = [(900, None, "x"), (901, [], "x"), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (903, [float("nan")] * 6, "x"),
           (904, [float("inf")] + [0.0] * 5, "x"), (905, [1.0, 2.0], "x"), (None, [float(v) for v in good[5]], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, component string").repartition(3)
    found = whitening.whiten(df, components=4).collect()
    fit = [r[1] for r in rows] + [bad[-1][1]]
    deviation, white, share = slow_whiten(fit, 4)
    assert len(found) == 4 * len(fit) and {r.n for r in found} == {len(fit)}
    want = defaultdict(list)
    for (number, _, _), d, w in zip(rows + bad[-1:], deviation, white):
        want[number].append((d, w))
    for r in found:
        d, w = want[r.vec_id][0]
        assert int(r.deviation) == d
        assert abs(abs(r.whitened) - abs(w[r.component - 1])) < 1e-9
        assert abs(r.explained - share[r.component - 1]) < 1e-12 and r.identity_error < 1e-9
    signs = {r.component: np.sign(r.whitened * want[r.vec_id][0][1][r.component - 1]) for r in found}
    assert all(np.sign(r.whitened * want[r.vec_id][0][1][r.component - 1]) == signs[r.component] for r in found)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None]])
def test_whiten_nothing(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    found = whitening.whiten(df)
    assert found.collect() == [] and found.columns[0] == "vec_id"


def test_whiten_dependent_dimensions(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-50, 50, (80, 2))
    df = spark.createDataFrame([(i, [float(a), float(b), float(a + b), 7.0]) for i, (a, b) in enumerate(base)],
                               "vec_id bigint, embedding array<double>")
    found = whitening.whiten(df)
    assert found.agg(F.max("component")).first()[0] == 2 and found.first().identity_error < 1e-9


def test_whiten_huge_entries(spark):
    df = spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 4.0])], "vec_id bigint, embedding array<double>")
    assert whitening.whiten(df).select("vec_id").distinct().count() == 3


def test_components_equal_library():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        a = rng.standard_normal((3 * n, n)) * np.exp(rng.uniform(-4, 4, n))
        a = a.T @ a
        values, axes = whitening.spectral_components(a)
        right, other = np.linalg.eigh(a)
        assert np.allclose(values, right[::-1], rtol=1e-9, atol=1e-13 * right[-1])
        assert np.allclose(np.abs((axes * other[:, ::-1]).sum(0)), 1, atol=1e-7)
    for a in (np.eye(5), np.zeros((3, 3)), np.diag([1.0, 1, 2, 2, 0]), np.ones((6, 6))):
        values, axes = whitening.spectral_components(a)
        assert np.allclose(axes @ np.diag(values) @ axes.T, a) and np.allclose(axes.T @ axes, np.eye(len(a)))
