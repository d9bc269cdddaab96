"""Tables inside gz, zip and tar files."""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABULAR = (".csv", ".tsv", ".txt", ".json", ".jsonl", ".ndjson")
LINES_PER_BATCH = 20_000


def safe_member(name: str) -> bool:
    """False for absolute names and names that leave the archive."""
    tidy = posixpath.normpath(name.replace("\\", "/"))
    return not (tidy.startswith("/") or tidy.startswith("..") or ":" in tidy.split("/")[0])


def _members(content: bytes, wanted: str | None) -> Iterator[tuple[str, io.BufferedIOBase]]:
    """The named member, else the first tabular one, as an open stream."""
    fits = lambda n: safe_member(n) and (n == wanted if wanted else n.lower().endswith(TABULAR))
    data = io.BytesIO(content)
    if zipfile.is_zipfile(data):
        with zipfile.ZipFile(data) as z:
            for n in sorted(z.namelist()):
                if fits(n):
                    with z.open(n) as f:
                        yield n, f
                    return
    else:
        data.seek(0)
        with tarfile.open(fileobj=data) as t:
            for m in sorted((m for m in t.getmembers() if m.isfile()), key=lambda m: m.name):
                if fits(m.name):
                    yield m.name, t.extractfile(m)
                    return


def archive_lines(spark: SparkSession, path, member: str | None = None) -> DataFrame:
    """``(path, member, line_no, line)``: archives are spread over tasks and streamed line by line."""
    if member and not safe_member(member):
        raise ValueError(f"unsafe member name: {member}")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                for name, stream in _members(content, member):
                    block = []
                    for i, raw in enumerate(stream):
                        block.append((p, name, i, raw.decode("utf-8", "replace").rstrip("\r\n")))
                        if len(block) >= LINES_PER_BATCH:
                            yield pd.DataFrame(block, columns=["path", "member", "line_no", "line"])
                            block = []
                    if block:
                        yield pd.DataFrame(block, columns=["path", "member", "line_no", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, "path string, member string, line_no bigint, line string")


def read_compressed(spark: SparkSession, path: str, member: str | None = None, schema: str | None = None,
                    delimiter: str = ",") -> DataFrame:
    """A table from gz (native), zip or tar; csv unless the member name says json."""
    low = path.lower()
    if low.endswith(".gz") and not low.endswith(".tar.gz"):
        if ".json" in low:
            return spark.read.json(path)
        reader = spark.read.options(sep=delimiter, header=True, inferSchema=schema is None)
        return (reader.schema(schema) if schema else reader).csv(path)
    lines = archive_lines(spark, path, member)
    first = lines.orderBy("line_no").select("member", "line").limit(1).first()
    if first is None:
        raise ValueError(f"no tabular member in {path}")
    if first["member"].lower().endswith((".json", ".jsonl", ".ndjson")):
        kind = schema or lines.select(F.schema_of_json(F.lit(first["line"]))).first()[0]
        return lines.select(F.from_json("line", kind).alias("r")).select("r.*")
    names = [n.strip().strip('"') for n in first["line"].split(delimiter)]
    kind = schema or ", ".join(f"`{n}` string" for n in names)
    body = lines.where((F.col("line_no") > 0) & (F.trim("line") != ""))
    return body.select(F.from_csv("line", kind, {"sep": delimiter}).alias("r")).select("r.*")
