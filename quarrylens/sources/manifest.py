"""Facts of files (hash, size, rows, columns), read by tasks in chunks; no row or task holds a whole file."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes read at once.
CHUNK = 8 << 20
_DELIMITED, _LINES = {"csv", "tsv"}, {"jsonl", "ndjson", "json"}


def _opened(uri: str):
    """A file opened for reading through Arrow's file systems."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri[5:].lstrip("/"))
    if "://" not in uri:
        return fs.LocalFileSystem().open_input_file(uri)
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


class LineCounter:
    """Non-empty lines of a file fed in pieces; a line break inside double quotes counts where ``quotes`` is off only."""

    def __init__(self, quotes: bool):
        self.quotes, self.inside, self.lines, self.last, self.first = quotes, 0, 0, 10, b""

    def feed(self, data: bytes) -> None:
        if not self.first.endswith(b"\n"):
            self.first += data[:65536].split(b"\n", 1)[0] + (b"\n" if b"\n" in data[:65536] else b"")
        codes = np.frombuffer(data.replace(b"\r", b""), np.uint8)
        if not len(codes):
            return
        ends = codes == 10
        if self.quotes:
            depth = self.inside + np.cumsum(codes == 34)
            ends &= depth % 2 == 0
            self.inside = int(depth[-1] % 2)
        before = np.concatenate([[self.last], codes[:-1]])
        self.lines += int((ends & (before != 10)).sum())
        self.last = int(codes[-1])

    def total(self) -> int:
        return self.lines + (self.last != 10)


def _columns(kind: str, line: bytes) -> int | None:
    """Columns named by the first line of a text file."""
    line = line.decode("utf-8", "replace").strip("﻿\r\n")
    if kind in _LINES:
        try:
            found = json.loads(line)
        except ValueError:
            return None
        return len(found) if isinstance(found, dict) else None
    bare = re.sub(r'"[^"]*"', "", line)
    return 1 + max(bare.count(d) for d in ",;\t|") if line else None


def file_facts(uri: str, kind: str) -> tuple[str, int | None, int | None]:
    """SHA-256, rows and columns of one file; rows and columns are NULL for kinds that have none."""
    digest, counter = hashlib.sha256(), LineCounter(kind in _DELIMITED) if kind in _DELIMITED | _LINES else None
    with _opened(uri) as file:
        while data := file.read(CHUNK):
            digest.update(data)
            if counter:
                counter.feed(data)
    rows = columns = None
    if counter:
        rows = max(0, counter.total() - (kind in _DELIMITED))
        columns = _columns(kind, counter.first)
        if kind == "json" and columns is None:
            rows = None  # one document, not one per line
    elif kind in ("parquet", "pq"):
        import pyarrow.parquet as pq

        with _opened(uri) as file:
            meta = pq.ParquetFile(file).metadata
            rows, columns = meta.num_rows, len(pq.ParquetFile(file).schema_arrow)
    elif kind == "orc":
        from pyarrow import orc

        with _opened(uri) as file:
            found = orc.ORCFile(file)
            rows, columns = found.nrows, len(found.schema)
    return digest.hexdigest(), rows, columns


def file_manifest(spark: SparkSession, path) -> DataFrame:
    """``(path, format, bytes, sha256, rows, columns, modificationTime)`` per file.

    Delimited files are taken to have a header; their quoted line breaks are part of a value.  Empty lines do not count, and
    empty files are not listed.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    kinds = listed.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("format"), F.col("length").alias("bytes"),
                          "modificationTime")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            facts = [file_facts(p, k) for p, k in zip(batch["path"], batch["format"])]
            yield batch.assign(**{name: pd.Series([f[i] for f in facts], index=batch.index, dtype=kind) for i, (name, kind) in enumerate(
                [("sha256", "object"), ("rows", "Int64"), ("columns", "Int64")])})

    schema = "path string, format string, bytes bigint, modificationTime timestamp, sha256 string, rows bigint, columns bigint"
    return kinds.repartition("path").mapInPandas(read, schema).select(
        "path", "format", "bytes", "sha256", "rows", "columns", "modificationTime")
