"""Phrase collocations from counting quotient filters.

The text is cut into shards.  A shard numbers the words it sees; a join gives it the numbers of the words that are frequent in
their language, since a phrase is at most as frequent as each of its words.  (Numbers are per language and word, so a phrase
carries its language.)  A phrase is the packed numbers of its words.  An invertible mix of these bits makes them evenly spread: the
high bits are the quotient, all others the remainder, so nothing is lost and no two phrases share a counter.

A filter holds phrases of one range of quotients: slots for the quotients within the range, each with a count of its entries,
the remainders in order, and a byte per counter, with a list of those that need more.  Shards send one filter per range.
Ranges and groups of shards are merged in rounds of bounded fan-in: filters are sorted, so equal entries of two meet in a merge.
After the last round a range is in one place, and its frequent phrases are turned back into words.  What is hot in
a corpus is one entry per shard here, and ranges are equally full, whatever the words.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import discard, slices, stash

#: Least number of occurrences of a phrase, words of the longest one, rows per language.
LEAST, LONGEST, TOP = 10, 3, 2000
#: A phrase is dropped in favour of a longer one that makes up so many hundredths of it.
SHARE = 50
#: Text of a shard in bytes, entries of a range, bits of the fan-in of a round.
SHARD_BYTES, RANGE_ENTRIES, FAN_BITS = 4_000_000, 1 << 20, 10
#: Words that can be numbered: three numbers fill the two parts of a key.
MOST_BITS = 32
#: Characters that end a piece of text, here all turned into full stops.
BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)
#: Language of texts without one.
NO_LANG = "und"
_ROUND_KEYS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
_CODEC = pa.Codec("zstd", 1)


def words_and_breaks(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased; a full stop stands for each end of a piece."""
    return text.lower().translate(BREAKS).replace(b".", b" . ").split()


# shards -------------------------------------------------------------------------------------------------------------

def _packed(values: np.ndarray) -> bytes:
    return _CODEC.compress(np.ascontiguousarray(values), asbytes=True)


def _unpacked(data: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(data, n * np.dtype(kind).itemsize, asbytes=True), kind)


class _Shard:
    """Numbers of the words of a shard in the order of their first use; 0 ends a piece."""

    def __init__(self):
        self.words, self.codes, self.size, self.last = {}, [], 0, count(1)

    def add(self, lang: str, texts: list[bytes]) -> None:
        if lang not in self.words:
            self.words[lang] = defaultdict(self.last.__next__)
            self.words[lang][b"."] = 0
        found = words_and_breaks(b".".join(texts))
        self.codes.append(np.fromiter(map(self.words[lang].__getitem__, found), np.uint32, len(found)))
        self.codes.append(np.zeros(1, np.uint32))
        self.size += sum(map(len, texts))

    def row(self, number: int) -> pa.RecordBatch:
        codes = np.concatenate(self.codes)
        uses = np.bincount(codes)
        langs, words, local = [], [], []
        for lang, own in self.words.items():
            del own[b"."]
            langs += [lang] * len(own)
            words += own.keys()
            local += own.values()
        at = np.array(local, np.int64)
        row = {"shard": [number], "n": [len(codes)], "codes": [_packed(codes)], "lang": [langs], "word": [words],
               "local": [at.astype(np.int32)], "uses": [uses[at] if len(at) else at]}
        kinds = {"shard": pa.int64(), "n": pa.int64(), "codes": pa.binary(), "lang": pa.list_(pa.string()),
                 "word": pa.list_(pa.binary()), "local": pa.list_(pa.int32()), "uses": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([pa.array(row[k], kinds[k]) for k in kinds], names=list(kinds))


_SHARD_ROW = ("shard bigint, n bigint, codes binary, lang array<string>, word array<binary>, local array<int>, "
              "uses array<bigint>")


def _shards(stream):
    """Texts of a task as rows of numbered words, a row for about ``SHARD_BYTES`` of text."""
    number, shard = TaskContext.get().partitionId() << 32, _Shard()
    for batch in stream:
        for part in slices(batch, 1, 1, 1_000_000):
            by_lang = defaultdict(list)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if text:
                    by_lang[lang].append(text)
            for lang, texts in by_lang.items():
                shard.add(lang, texts)
            if shard.size >= SHARD_BYTES:
                yield shard.row(number)
                number, shard = number + 1, _Shard()
    if shard.size:
        yield shard.row(number)


# keys ---------------------------------------------------------------------------------------------------------------

def _scrambled(value: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    out = (value + np.uint64(key & 0xFFFFFFFF)) * np.uint64(key | 1)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x9FB21C651E98DF25)
    return (out >> np.uint64(16)) & mask


def half_bits(bits: int) -> int:
    """Bits of one half of a key for word numbers of ``bits`` bits."""
    return (LONGEST * bits + 1) // 2


def permuted(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves of the keys of packed phrases; ``words`` has a row per phrase place, missing words are 0."""
    half = np.uint64(half_bits(bits))
    mask = np.uint64((1 << int(half)) - 1)
    a, b, c = (w.astype(np.uint64) for w in words)
    bits, cut = np.uint64(bits), half - np.uint64(bits)
    # a, then b: the low part of the left half has the first bits of b, the right half the others, and c.
    left = (a << cut | b >> (bits - cut)) & mask
    right = ((b & np.uint64((1 << int(bits - cut)) - 1)) << bits | c) & mask
    for key in _ROUND_KEYS:
        left, right = right, left ^ _scrambled(right, key, mask)
    return left, right


def restored(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """The word numbers of keys, a row per phrase place."""
    half = np.uint64(half_bits(bits))
    mask = np.uint64((1 << int(half)) - 1)
    for key in reversed(_ROUND_KEYS):
        left, right = right ^ _scrambled(left, key, mask), left
    bits, cut = np.uint64(bits), half - np.uint64(bits)
    word = np.uint64((1 << int(bits)) - 1)
    low = np.uint64((1 << int(bits - cut)) - 1)
    return np.stack([left >> cut, ((left & np.uint64((1 << int(cut)) - 1)) << (bits - cut) | right >> bits & low), right & word])


def joined(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A key as high part (what is beyond 64 bits) and low part (64 bits)."""
    high = left >> np.uint64(64 - half) if 2 * half > 64 else np.zeros(len(left), np.uint64)
    return high, left << np.uint64(half) | right


def parted(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves of a key."""
    right = low & np.uint64((1 << half) - 1)
    left = low >> np.uint64(half)
    return (left | high << np.uint64(64 - half) if 2 * half > 64 else left), right


# filters --------------------------------------------------------------------------------------------------------------

def _merged(high, low, uses):
    """Sorted distinct keys with the sums of their counters."""
    if len(low) and high.any():
        order = np.lexsort((low, high))
    else:
        order = np.argsort(low)
    high, low, uses = high[order], low[order], uses[order]
    first = np.ones(len(low), bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    at = np.flatnonzero(first)
    return high[at], low[at], np.add.reduceat(uses, at) if len(at) else uses


def _shifted(high, low, bits: int):
    """``key >> bits`` as one number of at most 64 bits."""
    if bits >= 64:
        return high >> np.uint64(bits - 64)
    if bits == 0:
        return low
    return low >> np.uint64(bits) | (high << np.uint64(64 - bits))


def write_filter(high: np.ndarray, low: np.ndarray, uses: np.ndarray, bits: int) -> bytes:
    """A filter of sorted distinct keys whose bits from ``bits`` upwards are equal (the range).

    Slots for about two entries each; a slot's byte or two say how many it has.  Then the remainders, cut to the bytes they
    need, then a byte per counter; counters of 255 and more follow in full.
    """
    n = len(low)
    slot_bits = min(max(n.bit_length() - 2, 0), 20, bits)
    rest = bits - slot_bits
    slot = _shifted(high, low, rest) & np.uint64((1 << slot_bits) - 1)
    slots = np.bincount(slot.astype(np.int64), minlength=1 << slot_bits).astype("<u2" if n < 65536 else "<u4")
    width = -(-rest // 8)
    body = np.concatenate([low.astype("<u8").view(np.uint8).reshape(n, 8), high.astype("<u8").view(np.uint8).reshape(n, 8)], 1)
    body = np.ascontiguousarray(body[:, :width])
    if rest % 8 and width:
        body[:, -1] &= (1 << rest % 8) - 1
    small = np.minimum(uses, 255).astype(np.uint8)
    head = np.array([n, slot_bits, rest], "<u4")
    return b"".join([head.tobytes(), slots.tobytes(), body.tobytes(), small.tobytes(), uses[small == 255].astype("<i8").tobytes()])


def read_filter(data: bytes, bits: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counters of a filter of the range ``number``; ``bits`` as in ``write_filter``."""
    n, slot_bits, rest = (int(v) for v in np.frombuffer(data, "<u4", 3))
    at = 12
    kind = np.dtype("<u2" if n < 65536 else "<u4")
    slots = np.frombuffer(data, kind, 1 << slot_bits, at)
    at += slots.nbytes
    width = -(-rest // 8)
    body = np.zeros((n, 16), np.uint8)
    body[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    uses = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    at += n
    large = np.flatnonzero(uses == 255)
    uses[large] = np.frombuffer(data, "<i8", len(large), at)
    parts = body.view("<u8").reshape(n, 2)
    low, high = parts[:, 0].astype(np.uint64), parts[:, 1].astype(np.uint64)
    slot = np.repeat(np.arange(1 << slot_bits, dtype=np.uint64), slots)
    for value, shift in ((slot, rest), (np.full(n, number, np.uint64), bits)):
        if shift < 64:
            low |= value << np.uint64(shift)
            if shift:
                high |= value >> np.uint64(64 - shift)
        else:
            high |= value << np.uint64(shift - 64)
    return high, low, uses


_FILTER_ROW = "group bigint, range bigint, filter binary"


def _filters_by_range(high, low, uses, group: int, before: int, after: int, total: int):
    """Filters of sorted keys, one per range of ``after`` quotient bits; ``before`` of them are equal."""
    ranges = _shifted(high, low, total - after) if after else np.zeros(len(low), np.uint64)
    edges = np.flatnonzero(np.diff(ranges)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(low)]])
    for first in range(0, len(starts) if len(low) else 0, 64):
        cuts = list(zip(starts[first:first + 64], ends[first:first + 64]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([group] * len(cuts), pa.int64()), pa.array([int(ranges[a]) for a, _ in cuts], pa.int64()),
             pa.array([write_filter(high[a:b], low[a:b], uses[a:b], total - after) for a, b in cuts], pa.binary())],
            names=["group", "range", "filter"])


def _phrase_filters(bits: int, after: int, fan: int):
    """Task: the phrases of each shard (``group, n, codes, known``) as filters of the first round."""
    half = half_bits(bits)

    def run(stream):
        for batch in stream:
            for i, (group, n, codes) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                known = batch.column(3)[i].values
                codes = _unpacked(codes, n, np.uint32)
                number = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
                number[known.field("local").to_numpy()] = known.field("id").to_numpy()
                own = number[codes]
                del codes
                pair = (own[:-1] > 0) & (own[1:] > 0)
                three = pair[:-1] & pair[1:]
                a, b = np.flatnonzero(pair), np.flatnonzero(three)
                words = np.stack([np.concatenate([own[a], own[b]]), np.concatenate([own[a + 1], own[b + 1]]),
                                  np.concatenate([np.zeros(len(a), np.int64), own[b + 2]])])
                high, low = joined(*permuted(words, bits), half)
                del words, own
                yield from _filters_by_range(*_merged(high, low, np.ones(len(low), np.int64)), group >> fan, 0, after, 2 * half)

    return run


def _merge_filters(before: int, after: int, total: int, fan: int, finish=None):
    """Task: filters sorted by (group, range) are merged; each result is split for the next round, or finished.

    Filters of a range are merged as soon as they have grown to the size of what is merged already, so an entry
    takes part in few merges and no more than twice the entries of a range are held.
    """
    def done(where, parts):
        merged = _merged(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        if finish is not None:
            yield finish(*merged)
        else:
            yield from _filters_by_range(*merged, where[0] >> fan, before, after, total)

    def run(stream):
        where, parts, waiting = None, [], 0
        for batch in stream:
            for group, number, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (group, number) != where:
                    if parts:
                        yield from done(where, parts)
                    where, parts, waiting = (group, number), [], 0
                parts.append(read_filter(data, total - before, number))
                waiting += len(parts[-1][1])
                if len(parts) > 2 and waiting >= max(len(parts[0][1]), 1 << 18):
                    parts, waiting = [_merged(*(np.concatenate([p[i] for p in parts]) for i in range(3)))], 0
        if parts:
            yield from done(where, parts)

    return run


_COUNTED = "a bigint, b bigint, c bigint, f bigint"


def _frequent(bits: int, least: int):
    half = half_bits(bits)

    def finish(high, low, uses):
        often = uses >= least
        words = restored(*parted(high[often], low[often], half), bits).astype(np.int64)
        return pa.RecordBatch.from_arrays([*map(pa.array, words), pa.array(uses[often])], names=["a", "b", "c", "f"])

    return finish


# Spark ----------------------------------------------------------------------------------------------------------------

def _numbered(words: DataFrame) -> DataFrame:
    """``words`` with a dense number from 1 on as ``id``; the totals of the partitions are one row per partition."""
    placed = stash(words.withColumn("_row", F.monotonically_increasing_id()), "words")
    part, place = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("part")).agg(F.max(place + 1).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, part == starts["part"]).select(*words.columns, (F.col("start") + place + 1).alias("id"))


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                  fan_bits: int = FAN_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: ``id, lang, word, f`` of the words that occur ``least`` times in their language, ``a, b, c, f`` of the
    phrases of two (c is 0) and three word ids that do, and ``lang, n``, all word occurrences."""
    lang, text = F.coalesce(lang_col, F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("binary").alias("text")
    shards = stash(docs.select(lang, text).mapInArrow(_shards, _SHARD_ROW), "shards")
    seen = shards.select("shard", F.explode(F.arrays_zip("lang", "word", "local", "uses")).alias("w")).select("shard", "w.*")
    words = stash(seen.groupBy("lang", "word").agg(F.sum("uses").alias("f")), "vocabulary")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = stash(_numbered(words.where(F.col("f") >= least)), "numbered")
    last, all_words = known.agg(F.max("id")).first()[0] or 0, words.agg(F.sum("f")).first()[0] or 0
    bits = max(int(last).bit_length(), 2)
    if bits > MOST_BITS:
        raise ValueError(f"{last} frequent words need {bits} bits; a key has room for {MOST_BITS}")
    told = seen.join(known, ["lang", "word"]).groupBy("shard").agg(
        F.collect_list(F.struct("local", "id")).alias("known"))
    total = 2 * half_bits(bits)
    # Shards get numbers in a row, so that groups of them are full.
    numbers = _numbered(shards.select("shard")).select("shard", (F.col("id") - 1).alias("group"))
    groups = max(shards.count() - 1, 0).bit_length()
    wanted = max((int(all_words) * (LONGEST - 1) // RANGE_ENTRIES).bit_length(), 1)
    rounds = max(-(-groups // fan_bits), -(-wanted // fan_bits), 1)
    cuts = [min(fan_bits * (i + 1), total) for i in range(rounds - 1)] + [min(max(wanted, fan_bits * (rounds - 1)), total)]
    asked = shards.select("shard", "n", "codes").join(told, "shard").join(numbers, "shard").select("group", "n", "codes", "known")
    level = stash(asked.mapInArrow(_phrase_filters(bits, cuts[0], fan_bits), _FILTER_ROW), "filters")
    discard(shards)
    for i, cut in enumerate(cuts):
        # The filters of a range come together, whole; a round has as many of them as its fan-in at most.
        sent = level.repartition("group", "range").sortWithinPartitions("group", "range")
        if i + 1 < len(cuts):
            after = stash(sent.mapInArrow(_merge_filters(cut, cuts[i + 1], total, fan_bits), _FILTER_ROW), "filters")
        else:
            after = stash(sent.mapInArrow(_merge_filters(cut, cut, total, fan_bits, _frequent(bits, least)), _COUNTED), "phrases")
        discard(level)
        level = after
    return known, level, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP,
                 share: int = SHARE, fan_bits: int = FAN_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two and three words of each language.

    Words are runs of anything but space and tab, A-Z lower-cased, within pieces that end at ``. , ; : ! ?`` and line breaks.
    ``a`` counts the phrase, ``l`` and ``r`` the parts of its weakest cut, ``n`` all words of the language; ``score`` is
    ``floor(1000000 a a / (l r))``, exactly.  Phrases of which a longer one makes up ``share`` hundredths are dropped.
    A null text is empty, a null language is ``und`` (and one with a language of that name).  Ties go to the larger ``a``,
    then to the phrase that comes first in UTF-8.  Languages without a frequent phrase give no rows, nor does an
    empty table; repeated rows count as often as they stand; other columns are ignored.
    """
    known, counts, totals = phrase_counts(docs, lang_col, text_col, least, fan_bits)
    one = known.select("id", "f")
    two = counts.where("c = 0").select("a", "b", "f")
    pairs = two.join(one.toDF("a", "fa"), "a").join(one.toDF("b", "fb"), "b").select(
        "a", "b", F.lit(0).cast("bigint").alias("c"), "f", F.col("fa").alias("l1"), F.col("fb").alias("r1"),
        F.lit(None).cast("bigint").alias("l2"), F.lit(None).cast("bigint").alias("r2"))
    three = counts.where("c > 0").join(one.toDF("a", "fa"), "a").join(two.toDF("b", "c", "fbc"), ["b", "c"]).join(
        two.toDF("a", "b", "fab"), ["a", "b"]).join(one.toDF("c", "fc"), "c").select(
        "a", "b", "c", "f", F.col("fa").alias("l1"), F.col("fbc").alias("r1"), F.col("fab").alias("l2"), F.col("fc").alias("r2"))
    longer = counts.where("c > 0")
    inside = longer.select("a", "b", "f").union(longer.select("b", "c", "f")).groupBy("a", "b").agg(F.max("f").alias("longer"))
    kept = pairs.join(inside, ["a", "b"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("f").cast("decimal(38,0)") * share))

    def cut(left, right):
        whole = "cast({} as decimal(19,0))".format
        # Two factors of 19 digits fill the 38 of a decimal; a phrase is at most as frequent as its parts, so the quotient is small.
        return F.expr(f"case when {left} is not null then "
                      f"cast(1000000 * cast(f as decimal(15,0)) * cast(f as decimal(15,0)) as decimal(38,0)) "
                      f"div cast({whole(left)} * {whole(right)} as decimal(38,0)) end")

    scored = kept.drop("longer").unionByName(three).withColumns({"s1": cut("l1", "r1"), "s2": cut("l2", "r2")})
    second = F.col("s2") < F.col("s1")
    scored = scored.select(
        "a", "b", "c", "f", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"))
    langs = scored.join(known.select(F.col("id").alias("a"), "lang", F.col("word").alias("wa")), "a")
    order = [F.desc("score"), F.desc("f")]
    best = langs.withColumn("_place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_place") <= top)
    named = best.join(known.select(F.col("id").alias("b"), F.col("word").alias("wb")), "b").join(
        known.select(F.col("id").alias("c"), F.col("word").alias("wc")), "c", "left")
    phrase = F.concat_ws(" ", *[F.col(w).cast("string") for w in ("wa", "wb", "wc")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.asc("phrase")))
    ranked = named.select("lang", phrase.alias("phrase"), "f", "l", "r", "score").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
