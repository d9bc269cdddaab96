"""Training-order token shards.

The token streams of the input partitions, one after the other, are cut into sequences of equal length.  A keyed Feistel
network over the next even power of two, walked along its cycle until it falls below the number of sequences, is a
permutation of the sequence numbers: it gives every sequence its slot in training order, in constant memory and without
a sort.  Slots are range-partitioned, each task writes whole shards, and a shard holds records of one fixed stride.  So
slot ``s`` stands at byte ``s % per_shard * stride`` of shard ``s // per_shard``: readers go through the files from front to
back and resume at any slot by seeking.

Two passes tokenise the documents: the first only counts tokens per partition, which gives every partition its place in the
stream; the second sends the tokens straight to the shards.  Tokens are therefore stored once.  The second pass checks that
its partitions are those of the first (tokens and a checksum over ids) and fails otherwise.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import held, open_store, shared_folder, slices, write_bytes

#: Folder with the vocabulary files, and the file used: byte pairs as ranks, ids below 65 536.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Cuts texts into pieces before byte pairs are merged; belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a sequence, sequences of a shard, key of the permutation, rounds of the network.
LENGTH, PER_SHARD, KEY, ROUNDS = 1024, 4096, 42, 6
#: Words whose tokens a Python worker remembers, and the bytes of text it encodes at once; both set its memory.
REMEMBERED, PIECE = 400_000, 2_000_000

#: Two white-space characters in a row, for Arrow; and a character that marks cuts.
_RUN, _MARK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]{2}", "\uffff"
#: Letters, perhaps after a blank, and then only signs: no letters, digits, white space or apostrophes (endings such as 's).
_LETTERS = re.compile(r"( ?[^\W\d_]+)((?:[^\w\s']|_)*)\Z")


class _Known(dict):
    """Tokens of words seen before; when half of them are new, those not asked for since the last time are forgotten."""

    def __init__(self, make):
        super().__init__()
        self._make, self._older = make, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED // 2:
            self._older = dict(self)
            self.clear()
        made = self._older.get(word)
        if made is None:
            made = self._make(word)
        self[word] = made
        return made


class Tokenizer:
    """Texts to little-endian 16-bit token ids, closed by the end token.

    A single blank between two other characters always begins a piece, and a single line feed is one, so texts without a
    run of white space are cut there and the tokens of repeated words are looked up.  The result is that of the vocabulary's own tokenizer.
    """

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(f"{folder}/{vocabulary}", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.end = max(ranks.values()) + 1
        self._bpe = tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._closing = np.array([self.end], "<u2").tobytes()
        self._known = _Known(self._piece).__getitem__

    def _packed(self, text: str) -> bytes:
        tokens = self._bpe.encode_ordinary(text)
        return struct.pack(f"<{len(tokens)}H", *tokens)

    def _piece(self, word: str) -> bytes:
        """Tokens of a word (perhaps after a blank): its letters are one piece for the vocabulary, signs after them another."""
        m = _LETTERS.match(word)
        if not m:
            return self._packed(word)
        tokens = self._bpe._core_bpe.encode_single_piece(m[1].encode())
        own = struct.pack(f"<{len(tokens)}H", *tokens)
        return own + self._known(m[2]) if m[2] else own

    def encode(self, text: str | None) -> bytes:
        """One text, as the vocabulary's own tokenizer does it."""
        return self._packed(text or "") + self._closing

    def encode_batch(self, texts: pa.Array, count_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """Token ids of all texts behind each other (none with ``count_only``), and the number of each."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if pc.any(pc.match_substring(texts, _MARK)).as_py():
            made = [self.encode(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(made), "<u2"), np.fromiter(map(len, made), np.int64, len(made)) // 2
        cut = pc.replace_substring(pc.replace_substring(texts, " ", _MARK + " "), "\n", _MARK + "\n" + _MARK)
        parts = pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, _RUN), texts, cut), _MARK)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if max(map(len, words), default=0) < 100:
            made = [*map(self._known, words), self._closing]
        else:
            made = [*(self._known(w) if len(w) < 100 else self._piece(w) for w in words), self._closing]
        size = np.fromiter(map(len, made), np.int64, len(made)) // 2
        edges = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        chunk = np.insert(coded.indices.to_numpy(), edges[1:], len(made) - 1)
        many = size[chunk]
        sizes = np.add.reduceat(many, edges[:-1] + np.arange(len(texts))) if len(texts) else np.zeros(0, np.int64)
        if count_only:
            return None, sizes
        flat, start = np.frombuffer(b"".join(made), "<u2"), np.cumsum(size) - size
        place = np.repeat((start[chunk] - np.cumsum(many) + many).astype(np.int32), many)
        place += np.arange(len(place), dtype=np.int32)
        return flat.take(place), sizes

    def decode(self, tokens) -> str:
        return self._bpe.decode([int(t) for t in tokens if t != self.end])


def tokenizer(folder: str, vocabulary: str) -> Tokenizer:
    """One per Python worker."""
    return held(("tokenizer", folder, vocabulary), lambda: Tokenizer(folder, vocabulary))


def _mix(values: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function of values and a round key."""
    x = values.astype(np.uint64) + np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def slots_of(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of sequence numbers: a permutation of ``0 .. n-1`` that depends on ``key``."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{i}".encode()).digest()[:8], "big") for i in range(rounds)]
    out = np.array(numbers, np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        left, right = out[walking] >> np.uint64(half), out[walking] & low
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & low)
        out[walking] = left << np.uint64(half) | right
        walking = out >= n
    return out.astype(np.int64)


def _encoded(stream, make, count_only: bool = False):
    """(ids, tokens, number of tokens of each document) of pieces of the batches."""
    work = make()
    for batch in stream:
        for part in slices(batch, 1, 1, PIECE):
            yield part.column(0), *work.encode_batch(part.column(1), count_only)


def _sum(seen: int, ids: pa.Array) -> int:
    for value in ids.to_pylist():
        seen = (seen * 1_000_003 + hash(value) + 1) % (1 << 61)
    return seen


def write_shards(docs: DataFrame, folder: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD,
                 key: int = KEY, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Write all documents as shards below ``folder`` (a new one in the shared folder by default).

    Returns the index, one row per sequence: ``slot, sequence, shard, byte_offset, n_tokens, doc_ids, sha256``.  A document
    is its tokens and one end token, so a null or empty text is one token; documents follow each other without gaps, the
    last sequence is filled up with end tokens.  Repeated rows are written again; null ids are left out of ``doc_ids``.  An
    empty table gives no shard and no row.  ``docs`` should be the scan of a table, whose partitions are the same in both
    passes.  The folder also gets ``meta.json`` and the index as Parquet.  A lost task writes its shards again, same bytes.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "shards")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def make():
        return tokenizer(tokenizers, vocabulary)

    def count(stream):
        n = seen = 0
        for ids, _, sizes in _encoded(stream, make, count_only=True):
            n += int(sizes.sum())
            seen = _sum(seen, ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()]), pa.array([n], pa.int64()), pa.array([seen], pa.int64())],
            names=["part", "n", "seen"])

    counted = sorted(rows.mapInArrow(count, "part bigint, n bigint, seen bigint").collect())
    place, total = {}, 0
    for part, n, seen in counted:
        place[part] = total, n, seen
        total += n
    n_sequences = -(-total // length)
    n_shards = -(-n_sequences // per_shard)
    stride = 2 * length
    spread = min(max(1, n_shards), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = spark.sparkContext.broadcast(place)

    def cut(stream):
        """Pieces of sequences, with the partition that their shard belongs to."""
        start, n, seen = sent.value.get(TaskContext.get().partitionId(), (0, 0, 0))
        at, mine = start, 0
        for ids, tokens, sizes in _encoded(stream, make):
            mine = _sum(mine, ids)
            begin = np.cumsum(sizes) - sizes
            first, last = (at + begin) // length, (at + begin + sizes - 1) // length
            many = last - first + 1
            doc = np.repeat(np.arange(len(sizes)), many)
            number = np.repeat(first, many) + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            lo = np.maximum(number * length, at + begin[doc])
            slot = slots_of(number, n_sequences, key)
            whole = pa.py_buffer(tokens.tobytes())
            bounds = np.append(2 * (lo - at), 2 * len(tokens)).astype(np.int32)
            at += len(tokens)
            cuts = pa.BinaryArray.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(bounds.tobytes()), whole])
            for a in range(0, len(lo), 2000):
                part = slice(a, a + 2000)
                yield pa.RecordBatch.from_arrays([
                    pa.array((slot[part] // per_shard * spread // n_shards).astype(np.int32)), pa.array(slot[part]),
                    pa.array(number[part]), pa.array((lo - number * length)[part]), ids.take(pa.array(doc[part])),
                    cuts.slice(a, 2000)], names=names)
        if (at - start, mine) != (n, seen):
            raise RuntimeError("the partitions of the two passes differ; write the documents to a table first")

    names = ["target", "slot", "sequence", "at", "doc_id", "tokens"]
    pieces = rows.mapInArrow(cut, "target int, slot bigint, sequence bigint, at bigint, doc_id bigint, tokens binary")
    ordered = pieces.repartitionById(spread, "target").sortWithinPartitions("slot", "at")

    def write(stream):
        filler = np.array([make().end], "<u2").tobytes() if n_shards else b""
        shard, buffer, done = None, bytearray(), []

        def close():
            data = bytes(buffer)
            write_bytes(f"{folder}/shard-{shard:08d}.bin", data)
            digest = lambda at: hashlib.sha256(data[at:at + stride]).hexdigest()
            out = pa.RecordBatch.from_arrays([
                pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[0] // per_shard for d in done], pa.int64()),
                pa.array([d[0] % per_shard * stride for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()), pa.array([list(d[3]) for d in done], pa.list_(pa.int64())),
                pa.array([digest(d[0] % per_shard * stride) for d in done])],
                names=["slot", "sequence", "shard", "byte_offset", "n_tokens", "doc_ids", "sha256"])
            buffer.clear()
            done.clear()
            return out

        for batch in stream:
            for slot, number, at, doc, tokens in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                if shard is not None and slot // per_shard != shard:
                    _fill(buffer, stride, filler)
                    yield close()
                shard = slot // per_shard
                if not done or done[-1][0] != slot:
                    _fill(buffer, stride, filler)
                    done.append([slot, number, 0, {}])
                buffer += tokens
                done[-1][2] += len(tokens) // 2
                if doc is not None:
                    done[-1][3][doc] = True
        if done:
            _fill(buffer, stride, filler)
            yield close()

    index = ordered.mapInArrow(write, "slot bigint, sequence bigint, shard bigint, byte_offset bigint, n_tokens bigint, "
                                      "doc_ids array<bigint>, sha256 string")
    index.write.parquet(f"{folder}/index")
    write_bytes(f"{folder}/meta.json", json.dumps({
        "sequences": n_sequences, "tokens": total, "length": length, "per_shard": per_shard, "stride": stride,
        "shards": n_shards, "dtype": "uint16", "key": key, "rounds": ROUNDS, "vocabulary": vocabulary}).encode())
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def _fill(buffer: bytearray, stride: int, filler: bytes) -> None:
    """Complete the last record with end tokens."""
    missing = -len(buffer) % stride
    buffer += filler * (missing // 2)


def read_slots(folder: str, start: int, stop: int):
    """Yield the token arrays of slots ``start .. stop-1`` in order, seeking to the first and reading on."""
    store, path = open_store(folder)
    with store.open_input_file(f"{path}/meta.json") as f:
        meta = json.loads(f.read())
    stop = min(stop, meta["sequences"])
    while start < stop:
        shard, at = divmod(start, meta["per_shard"])
        end = min(stop, (shard + 1) * meta["per_shard"])
        with store.open_input_file(f"{path}/shard-{shard:08d}.bin") as f:
            f.seek(at * meta["stride"])
            for _ in range(end - start):
                yield np.frombuffer(f.read(meta["stride"]), "<u2")
        start = end


def original_order(spark: SparkSession, index: DataFrame) -> DataFrame:
    """The index in the order of the token stream, for putting documents together again."""
    return index.orderBy("sequence")
