"""Operators on documents against brute force, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylens.llm import (
    context_mixing, decontaminate, exact_dedup, language_id, licenses, mixing, pii, shingles, simhash, token_shards)

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, _found string, kept int, fp string, "
          "size int, bucket string")
WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but".split()


def long_text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + f" end{seed}"


@pytest.fixture(scope="module")
def rows():
    base = long_text(1, 300)
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(" ", "\n", 5), "en", "b"),
        (4, base + " tail", "en", "b"), (5, None, None, None), (6, "", "en", None), (7, " \t\n", None, ""),
        (8, long_text(2, 5000), "en", "a"), (9, "der die und nicht ist ein", "de", "c"), (10, "12345 !!", "de", "c"),
        (1, base, "en", "a"), (1, base, "en", "a"), (None, "one two three", "en", "a"), (11, "Ünïcode é 文字 text", "fr", "c"),
        (12, "le la les des une est dans pour", "fr", "c"), (13, long_text(3, 40), "en", "d")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3, "z") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


# exact duplicates -----------------------------------------------------------------------------------------------

def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[normal(text)].append(i)
    got = exact_dedup.exact_groups(docs, rounds=1).collect()
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        want = groups[normal(text)]
        own = [r for r in got if r.doc_id == i and r.text_sha256 == hashlib.sha256(normal(text).encode()).hexdigest()]
        assert own and all(r.group_size == len(want) for r in own)
        assert all(r.keep_id == min((x for x in want if x is not None), default=None) for r in own)
    assert sum(r.kept for r in got) == len(groups)


def test_exact_empty(none):
    assert exact_dedup.exact_groups(none).count() == 0


# near duplicates ------------------------------------------------------------------------------------------------

def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(docs, rows):
    prints = [slow_fingerprint(r[1]) for r in rows]
    roots = slow_components(prints)
    smallest = {}
    for r, c in zip(rows, roots):
        if r[0] is not None:
            smallest[c] = min(smallest.get(c, r[0]), r[0])
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    want = sorted(((r[0], f"{p:016x}", smallest.get(c)) for r, p, c in zip(rows, prints, roots)), key=str)
    assert got == want


def test_near_duplicates_keeps_columns(docs, none):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def slow_sets(texts):
    """Root of each text by exact five-word Jaccard similarity of all pairs."""
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 9 * both >= 4 * (len(a) + len(sets[j])):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def test_one_of_each_finds_all_similar_texts(spark):
    """Every pair of five-word Jaccard similarity 0.8 counts, however far apart the fingerprints are, and no other pair."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    for k in range(60):  # a group of near copies, of which not all are similar to each other
        own = list(base)
        for at in rng.choice(200, k % 7, replace=False):
            own[at] = f"new{k}x{at}"
        rows.append((100_000 + k, " ".join(own)))
    roots = slow_sets([t for _, t in rows])
    want = {rows[r][0] for r in roots}
    got = [r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_one_of_each_keeps_sets_with_equal_ids_apart(spark):
    """Rows are chosen by set, not by id: different texts with null or equal ids all stay."""
    rows = [(None, long_text(11, 50)), (None, long_text(12, 50)), (7, long_text(13, 50)), (7, long_text(14, 50)), (None, None),
            (7, long_text(13, 50)), (3, long_text(12, 50)), (None, "")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted([(r.doc_id, (r.text or "")[-5:]) for r in got], key=str) == [
        (3, "end12"), (7, "end13"), (7, "end14"), (None, ""), (None, "end11")]


def test_one_of_each_takes_its_links_from_fingerprints_first(spark, monkeypatch):
    """Near fingerprints give links that are checked on the texts; the shingle join gets them and finds the others."""
    words = [f"w{i}" for i in range(400)]
    other = list(words)
    other[200] = "new"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, long_text(15, 60)), (4, "one two three"), (5, "one  two three")]
    given, join = [], shingles.shingle_links

    def spied(prefixes, texts, components, linked):
        given.extend(tuple(r) for part in linked for r in part.collect())
        return join(prefixes, texts, components, linked)

    monkeypatch.setattr(shingles, "shingle_links", spied)
    monkeypatch.setattr(simhash, "fingerprint_links", lambda prints: spark.createDataFrame(  # all pairs, near or not
        [(a, b) for a in sorted(r.fp for r in prints.collect()) for b in sorted(r.fp for r in prints.collect()) if a < b], "a bigint, b bigint"))
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 4] and len(given) == 1


def test_one_of_each_spreads_labels_over_one_link_per_node(spark, monkeypatch):
    """A group of near copies has many links; those found count as one per node in the next round, and few are looked for."""
    words, rows, spread, compared = [f"w{i}" for i in range(400)], [], [], []
    for k in range(60):
        own = list(words)
        own[5 * k] = f"new{k}"
        rows.append((k, " ".join(own)))
    spread_labels, compare = simhash.components, shingles.similar_pairs

    def spied(links):
        spread.append(links.count())
        return spread_labels(links)

    def counted(pairs, sets, texts):
        compared.append(pairs.count())
        return compare(pairs, sets, texts)

    monkeypatch.setattr(simhash, "components", spied)
    monkeypatch.setattr(shingles, "similar_pairs", counted)
    monkeypatch.setattr(simhash, "fingerprint_links", lambda prints: spark.createDataFrame(  # all pairs are near
        [(a, b) for a in sorted(r.fp for r in prints.collect()) for b in sorted(r.fp for r in prints.collect()) if a < b], "a bigint, b bigint"))
    assert [r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()] == [0]
    assert max(spread) <= 3 * 59 and sum(compared) <= 3 * 59


def test_all_texts_tell_how_common_a_shingle_is(spark):
    rows = [(f"a{i} b c d e",) for i in range(3000)] + [("one common line here now",)] * 7
    table = shingles._commonness(spark.createDataFrame(rows, "text string").repartition(3), F.col("text").cast("binary"))
    own = shingles.shingles(b"one common line here now")
    assert table[shingles._slots(own)[0]] == round(8 * np.log2(8)) and (table > 0).sum() > 2990


def test_golay_indices_meet_within_two_bits():
    rng = np.random.default_rng(0)
    flips = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
    for word in rng.integers(0, 1 << 23, 200):
        at, n = simhash.codeword_indices(np.array([word ^ f for f in flips]))
        own = set(at[0, :n[0]])
        assert all(own & set(a[:k]) for a, k in zip(at, n))


def test_links_in_dense_sets(spark):
    """Large sets under one key: same components as all pairs."""
    rng = np.random.default_rng(5)
    centre, prints = 0x0123456789ABCDEF, set()
    for _ in range(300):
        value = centre
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            value ^= 1 << int(b)
        prints.add(value - (1 << 64) if value >> 63 else value)
    prints |= {int(x) for x in rng.integers(-2**63, 2**63 - 1, 300)}
    prints = sorted(prints)
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp bigint"))
    found = {r.node: r.root for r in simhash.components(links).collect()}
    roots = slow_components([p & (1 << 64) - 1 for p in prints])
    assert [found.get(p, p) for p in prints] == [prints[c] for c in roots]


# language -------------------------------------------------------------------------------------------------------

def test_phrases_are_longest_matches():
    reference = b"abracadabra alakazam"
    parser = language_id.Parser({"x": reference})
    for text in (b"abra kadabra", b"zam zam", b"xyz", b"a" * 3000, b""):
        count = 0
        for at in range(0, len(text), language_id.BLOCK):
            block, phrase = text[at:at + language_id.BLOCK], b""
            for c in block:
                grown = phrase + bytes([c])
                if grown in reference:
                    phrase = grown
                else:
                    count += 1
                    phrase = bytes([c]) if bytes([c]) in reference else b""
        assert parser.phrases([np.frombuffer(text, np.uint8)])[0, 0] == count


def test_language(docs, none, rows):
    got = by_id(language_id.language_report(docs))
    assert sum(map(len, got.values())) == len(rows)
    for i in (5, 6, 7, 10):
        assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got[i])
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, rs in got.items() if i is not None for r in rs)
    assert language_id.language_report(none).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert all(r.lang_pred == "und" for r in language_id.language_report(unlabelled).collect())
    kept = language_id.fits_a_language(docs, language_id.references(docs))
    assert kept.columns == docs.columns


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.language_report(docs).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.98


# decontamination ------------------------------------------------------------------------------------------------

def slow_overlaps(text, items):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = split(text), set(), set()
    for name, item in items:
        own = split(item)
        n = min(10, len(own))
        windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                if name is not None:
                    found.add(str(name))
    return len(words), len(hit), found


def test_overlaps(spark, docs, rows):
    base = rows[0][1].split()
    items = [(1, " ".join(base[40:70])), (2, "One, two THREE"), (10, " ".join(base[60:72])), (3, None), (4, "..."),
             (2, "nicht ist"), (None, "die und"), (1, " ".join(base[40:70]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (decontaminate.BLOCK_BYTES, 100):
        got = decontaminate.overlap_report(docs, bench, block_bytes=size)
        want = []
        for i, text, *_ in rows:
            n, hit, found = slow_overlaps(text, items)
            want.append((i, n, hit, len(found), decontaminate.items_digest(list(found)), hit > 0))
        have = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()]
        assert sorted(have, key=str) == sorted(want, key=str)
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)
    cut = decontaminate.cut_spans(docs, bench)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert not any(slow_overlaps(r.text, items[:1])[1] for r in cut.collect())


def test_windows_share_hashes_and_items():
    """Windows of several lengths and items; the items of a window, and no item without words."""
    items = [("a", b"one two three"), ("b", b"one two three"), (None, b"one two three four"), ("c", b" ."), ("d", None), ("a", b"four five")]
    windows = decontaminate.Windows(items, 3)
    assert set(windows.lengths) == {2, 3} and len(windows.lengths[3][1]) == 2
    ids = np.array([windows.vocabulary.get(w, 0) for w in b"zero one two three four five".split()], np.uint32)
    found = {(n, int(s)): set(windows.items(n, k)) for n, starts, at in windows.hits(ids) for s, k in zip(starts, at)}
    assert found == {(3, 1): {"a", "b", None}, (3, 2): {None}, (2, 4): {"a"}}
    assert decontaminate.Windows([], 3).lengths == {} and list(decontaminate.Windows([], 3).hits(ids)) == []


def test_overlaps_empty(spark, docs, none):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.overlap_report(docs, bench).where("contaminated").count() == 0
    assert decontaminate.overlap_report(none, bench).count() == 0


# personal data --------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                    "card": lambda: 14 <= len(digits) <= 19 and pii.luhn(digits),
                    "phone": lambda: 10 <= len(digits) <= 15}[kind]():
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans_equal_regular_expressions():
    rng = np.random.default_rng(3)
    for alphabet in ("1234567890.", "a@b.-+%1 ", "+1 ().-9", "@@a..b-", "0123456789 -", "25.5@a+é€1 "):
        for n in rng.integers(0, 40, 1500):
            text = "".join(rng.choice(list(alphabet), n))
            assert [s for s in pii.spans(text) if s[0] in pii.BASE] == slow_spans(text), text


def test_extra_spans():
    text = "see http://bob:pw1@host.example/x iban DE89 3704 0044 0532 0130 00, token = \"abcdef0123456789ff\" hi @someone"
    assert [(k, text[a:b]) for k, a, b in pii.spans(text) if k not in pii.BASE] == [
        ("url", "bob:pw1@host.example"), ("account", "DE89 3704 0044 0532 0130 00"), ("secret", "abcdef0123456789ff"),
        ("handle", "@someone")]
    assert pii.redact("mail a@b.co now") == "mail [email] now" and pii.redact(None) is None


def test_extra_spans_reach_their_end():
    """Long values are found whole, with dots and padding, after cues in any case."""
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    for cue in ("apiKey", "ApiKey", "API_Key", "token"):
        for value in (jwt, "a1" * 2000, "c2VjcmV0c2VjcmV0MTIzNA=="):
            assert pii.redact(f"é {cue}: {value}, x") == f"é {cue}: [secret], x"
    assert pii.redact("my token = abcdef0123456789ff. Next") == "my token = [secret]. Next"
    assert pii.redact("hi @" + "n" * 100 + " x") == "hi [handle] x"
    assert pii.redact("at https://" + "u" * 400 + ":p@" + "h" * 300 + "/x") == "at https://[url]/x"


def test_pii_report(spark, docs, none, rows):
    got = by_id(pii.pii_report(docs))
    assert sum(map(len, got.values())) == len(rows) and got[5][0].spans == ""
    one = spark.createDataFrame([(1, "é a@b.co 4111 1111 1111 1111, 10.0.0.1 +1 (555) 555-1234 x")], "doc_id bigint, text string")
    row = pii.pii_report(one).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert row.base_sha256 == pii.base_digest(slow_spans(one.first().text))
    assert pii.redacted(docs).columns == docs.columns and pii.pii_report(none).count() == 0


# mixing ---------------------------------------------------------------------------------------------------------

def slow_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        share, total, full = left, sum(w[s] for s in open_), set()
        for s in open_:
            room = cap * sizes[s] - target[s]
            add = min(room, share * w[s] / total)
            target[s] += add
            left -= add
            if room - add <= 1e-9:
                full.add(s)
        open_ -= full
        if not full:
            break
    return target


def test_mix(spark, docs, rows, none):
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows) and got == mixing.mix_plan(docs.repartition(5)).collect() or sorted(got, key=str) == sorted(
        mixing.mix_plan(docs.repartition(5)).collect(), key=str)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(re.findall(mixing.WORD, text or ""))
    want = slow_targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
    assert mixing.mix_plan(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_mix_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix_plan(docs).collect()
    taken, target, most = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 for s in target)


def test_mix_of_one_row_repeated_very_often(spark, monkeypatch):
    """A repeated row is dealt out in pieces, and its copies are numbered without gathering it in one task."""
    rows = spark.range(200_000).repartition(7).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"),
                                                      F.lit("x").alias("source"), F.col("id").alias("extra"))
    docs = rows.unionByName(spark.createDataFrame([(i, "w " * 500, "y", i) for i in range(30)], rows.schema))
    plan = mixing.mix_plan(docs)
    counted = plan.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("copies").alias("c"), F.max("taken").alias("t")).collect()
    hot = next(r for r in counted if r.doc_id == 5 and r.n > 1000)
    assert hot.n >= 200_000 and plan.count() == 200_030
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    told = {r.doc_id: r.c for r in counted}
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {k: v for k, v in told.items() if v}
    most = mixed.groupBy("source", "extra").count().agg(F.max("count")).first()[0]
    assert most <= 3


# licenses -------------------------------------------------------------------------------------------------------

def test_licenses(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "nothing here"), (3, "a/b/c/y.py", None),
        (4, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (5, "z/w.py", "no license talk"),
        (6, "a/own.py", "long text before. This work is licensed under the GNU General Public License, version 3. after"),
        (7, None, "x"), (8, "COPYING", "Licensed under CC BY-NC 4.0."), (2, "a/b/x.py", "nothing here"), (9, "z", "")]
    got = by_id(licenses.scan_licenses(spark.createDataFrame(
        [(*f, 1, "d") for f in files], "doc_id int, path string, text string, found int, dir string")))
    assert {i: (r[0].license, r[0].origin, r[0].from_dir) for i, r in got.items()} == {
        1: ("MIT", "stated", None), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("Apache-2.0", "inherited", "a/b"),
        4: ("Apache-2.0", "stated", None), 5: ("CC-BY-NC-4.0", "inherited", ""), 6: ("GPL-3.0", "stated", None),
        7: (None, "none", None), 8: ("CC-BY-NC-4.0", "stated", None), 9: ("CC-BY-NC-4.0", "inherited", "")}
    assert len(got[2]) == 2
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id int, path string, text string")).count() == 0


def test_license_cosine(spark):
    """The cosine is that of dense vectors."""
    n, seen = 500, {w: i + 1 for i, w in enumerate(licenses.Templates(licenses.TEMPLATES).vocabulary)}
    matcher = licenses.Matcher(licenses.TEMPLATES, n, seen)
    text = b"Released under the old MIT License."
    own = licenses.words(text)
    best = 0.0
    for (_, template), (vector, _) in zip(matcher.templates.rows, matcher.vectors):
        cue = next(i for i, w in enumerate(template) if w in licenses.CUES)
        for start in (max(0, i - cue) for i, w in enumerate(own) if w == template[cue]):
            beside = own[start:start + len(template)]
            names = sorted(set(template) | set(beside))
            a = np.array([template.count(w) * matcher.idf.get(w, matcher.rare) for w in names])
            b = np.array([beside.count(w) * matcher.idf.get(w, matcher.rare) for w in names])
            best = max(best, a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert math.isclose(matcher.match(text)["score"], best, abs_tol=1e-9)


def test_license_wordings():
    """Statements that are not templates word by word, and licenses that share their words."""
    n, seen = 500, {w: 3 for w in licenses.Templates(licenses.TEMPLATES).vocabulary}
    matcher = licenses.Matcher(licenses.TEMPLATES, n, seen)
    gnu = ("This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License "
           "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
    bsd = ("Copyright (c) 2020, Someone. All rights reserved. Redistribution and use in source and binary forms, with or without "
           "modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
           "retain the notice. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AS IS")
    for text, want in [
            ("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "GPL-2.0"),
            ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0"), ("SPDX-License-Identifier: Zlib", None),
            ("SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1"), ("SPDX-License-Identifier: CC-BY-4.0", "CC-BY-4.0"),
            ("Distributed under the MIT License, see the file", "MIT"), ("Distributed under the Foo License, see the file", None),
            (gnu.format("program", "", 3), "GPL-3.0"), (gnu.format("program", "Affero ", 3), "AGPL-3.0"),
            (gnu.format("program", "Lesser ", 3), "LGPL-3.0"), (gnu.format("library", "Lesser ", 2.1), "LGPL-2.1"),
            (gnu.format("program", "", 2), "GPL-2.0"), (bsd.format(""), "BSD-2-Clause"),
            (bsd.format("Neither the name of the holder nor the names of its contributors may be used. "), "BSD-3-Clause"),
            ("This is free and unencumbered software released into the public domain.", "Unlicense"),
            ("The person has waived all copyright and related or neighboring rights to the work", "CC0-1.0"),
            ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("the license of a driver", None)]:
        assert matcher.match(text.encode())["license"] == want, (text, matcher.match(text.encode()))


# language-model scores ------------------------------------------------------------------------------------------

def test_scores(spark, docs, rows, none, monkeypatch):
    got = context_mixing.text_scores(docs).collect()
    monkeypatch.setattr(context_mixing, "FAN_BITS", 1)  # more levels of sums
    assert len(got) == len(rows)
    words = {(r[0], r[1]): (r[1] or "").encode().lower().split() + [b"\n"] for r in rows}
    counts = Counter()
    for i, text, *_ in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update(words[i, text])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text, *_ in rows:
        own = words[i, text]
        plain = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want.append((i, len(own), sum(counts[w] > 0 for w in own), n, round(plain, 6)))
    have = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in got)
    again = context_mixing.text_scores(docs.repartition(5)).collect()
    scores = [np.array([x for _, x in sorted((str(r.doc_id), r.score) for r in part)]) for part in (got, again)]
    assert np.allclose(*scores)
    assert context_mixing.text_scores(none).count() == 0


def test_corpora_in_turn_have_models_of_their_own(spark):
    """Python workers live on between runs; the model of the corpus before must not score this one."""
    one = spark.createDataFrame([(i, long_text(i, 40)) for i in range(30)], "doc_id bigint, text string").coalesce(1)
    two = spark.createDataFrame([(i, " ".join(["zq", "xj"] * 20) + f" {i}") for i in range(30)], "doc_id bigint, text string").coalesce(1)
    sums = [[context_mixing.text_scores(d).agg(F.sum("score")).first()[0] for d in (one, two)] for _ in range(3)]
    assert np.allclose(sums, sums[0])


def test_code_is_a_probability():
    """One decision costs the bits of its probability: over all bytes the chances of a next byte add up to one."""
    code = context_mixing.Code(np.arange(256))
    model = context_mixing.Model(code, [np.random.default_rng(b).integers(-60, 60, 1 << b).astype(np.int8)
                                        for b in context_mixing.TABLES])
    numbers = context_mixing.Numbers()
    texts = [bytes([65, b]) for b in range(256) if b not in (10, 32)]
    entries = context_mixing.Entries(numbers, {}, [numbers.of(t) for t in texts])
    found = context_mixing.Decisions(code, entries.words, np.zeros(len(entries.words)), np.zeros(len(entries.words)))
    odds, gate = model._inputs(found)
    one = model._last(found, model._mixed(odds, gate))
    ends = np.append(found.word_start[1:], len(one))
    total = 0.0
    for word, a, b in zip(entries.words, found.word_start, ends):
        if word == b"\n":
            continue
        skip = int(code.length[65])
        n = int(code.length[word[1]])
        part = slice(a + skip, a + skip + n)
        total += float(np.prod(np.where(found.bit[part] == 1, one[part], 1 - one[part])))
    assert 0.9 < total <= 1.0 + 1e-4


def test_class_of_a_text_is_paid_for():
    """Over all short texts of some classes the probabilities add up to at most one, and each class costs its share."""
    code = context_mixing.Code(np.eye(1, 256, 97, dtype=np.int64)[0] * 1000)
    model = context_mixing.Model(code, [np.zeros(1 << b, np.int8) for b in context_mixing.TABLES])
    kinds = context_mixing.class_bits(np.arange(context_mixing.CLASSES) * 10)
    assert math.isclose(np.exp2(-kinds).sum(), 1.0)
    common = {b"a": 1, b"b": 2, b"c": 3}
    texts = [b"", *(bytes([c]) for c in range(256) if c not in b" \n"), b"a b", b"b b a"]
    numbers = context_mixing.Numbers()
    entries = context_mixing.Entries(numbers, common, [numbers.of(t) for t in texts])
    assert entries.text_class[[0, 1 + 95, 1 + 96]].tolist() == [0, 1, 2] and entries.text_class[-1] == 2
    bits = context_mixing.text_bits(model, entries, kinds)
    assert np.exp2(-bits).sum() <= 1
    assert np.allclose(bits - entries.per_text(model.bits(entries)), kinds[entries.text_class])


def test_scores_beat_word_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = context_mixing.text_scores(docs).collect()
    seen = [r for r in got if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_all_training_texts_make_the_model(spark, monkeypatch):
    """Where the weights start matters little: classes, counts, weights and last table come from every training row."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    seen, step = [], context_mixing.Model.step

    def spied(self, sums):
        start = self.weights.copy()
        step(self, sums)
        seen.append((start, self.weights, sums.seen.sum()))

    monkeypatch.setattr(context_mixing.Model, "step", spied)
    totals = [context_mixing.text_scores(docs, sample=n).agg(F.sum("score")).first()[0] for n in (100, 600)]
    assert abs(totals[0] - totals[1]) < 0.02 * abs(totals[1])
    learnt = [r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    words = sum(len((t or "").encode().lower().split()) for t in learnt)
    assert seen[0][2] == seen[1][2] > 8 * words
    assert not np.allclose(seen[1][0], seen[1][1])


def test_counts_without_the_own_document():
    codes = context_mixing.coded(np.arange(100))
    assert (codes[:64] == np.arange(64)).all() and (np.diff(codes.astype(int)) >= 0).all()
    table = context_mixing.left_out_odds().reshape(len(context_mixing.LEVELS), 2, 256, 256)
    for level, many in enumerate((1, 2, 3, 5)):
        want = context_mixing.log_odds(np.array([[7 - many, 3], [7, max(0, 3 - many)]], float))
        assert table[level, 0, 3, 7] == want[0] and table[level, 1, 3, 7] == want[1]
    assert table[0, 1, 1, 0] == 0  # seen in this document alone
    ids = [np.array([0, 1, 0, 2, 0, 0]), np.array([0, 2])]
    assert context_mixing.own_levels(ids).tolist() == [3, 0, 3, 0, 3, 3, 0, 0]


# token shards ---------------------------------------------------------------------------------------------------

def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        for key in (1, 42):
            assert sorted(token_shards.slots_of(np.arange(n), n, key)) == list(range(n))
    assert list(token_shards.slots_of(np.arange(50), 50, 1)) != list(token_shards.slots_of(np.arange(50), 50, 2))


def test_tokenizer_equals_library():
    own, rng = token_shards.Tokenizer(), np.random.default_rng(0)
    for alphabet in ("ab c\n\t d.é 1'st ", "abc .,!'s_#%ß²٣文\u0301 ", "a.'t _ \n", "a\uffff b\u00a0\u2003"):
        texts = [None, "", " "] + ["".join(rng.choice(list(alphabet), n)) for n in rng.integers(0, 14, 2000)]
        tokens, sizes = own.encode_batch(pa.array(texts))
        assert np.array_equal(tokens, np.frombuffer(b"".join(map(own.encode, texts)), "<u2"))
        assert sizes.tolist() == [len(own.encode(t)) // 2 for t in texts]


def test_shards_round_trip(tmp_path, docs, rows, none):
    folder = f"file:{tmp_path}/out"
    index = token_shards.write_shards(docs, folder, length=64, per_shard=8).orderBy("slot").collect()
    assert [r.slot for r in index] == list(range(len(index)))
    records = list(token_shards.read_slots(folder, 0, 10**9))
    assert [hashlib.sha256(x.tobytes()).hexdigest() for x in records] == [r.sha256 for r in index]
    assert all(r.shard == r.slot // 8 and r.byte_offset == r.slot % 8 * 128 for r in index)
    stream = np.concatenate([records[r.slot][:r.n_tokens] for r in sorted(index, key=lambda r: r.sequence)])
    own = token_shards.Tokenizer()
    ends = np.flatnonzero(stream == own.end)
    texts = [own.decode(part) for part in np.split(stream, ends + 1)[:-1]]
    assert Counter(texts) == Counter(r[1] or "" for r in rows)
    later = list(token_shards.read_slots(folder, 5, 11))
    assert all((a == b).all() for a, b in zip(later, records[5:11])) and len(later) == 6
    assert {i for r in index for i in r.doc_ids} == {r[0] for r in rows} - {None}
    assert token_shards.write_shards(none, f"file:{tmp_path}/none").count() == 0
    assert list(token_shards.read_slots(f"file:{tmp_path}/none", 0, 5)) == []
