"""Readers for tabular files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Delimiters considered, in order of preference.
DELIMITERS = (",", ";", "\t", "|")


# Spark's names of encodings that have another usual name.
CHARSETS = {"latin-1": "iso-8859-1", "latin1": "iso-8859-1", "utf-8-sig": "utf-8", "ascii": "us-ascii"}


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop rows and columns that hold no value at all."""
    rows = df.dropna("all")
    if not df.columns:
        return rows
    filled = rows.agg(*[F.count(c).alias(c) for c in rows.columns]).first()
    return rows.drop(*[c for c in rows.columns if filled[c] == 0])


def read_csv(spark: SparkSession, path, *, delimiter: str | None = None, encoding: str = "utf-8", header: bool = True,
             nrows: int | None = None, na_values: str | None = None, schema: str | None = None,
             timestamp_format: str | None = None, infer: bool = True) -> DataFrame:
    """Delimited text; header names are stripped, NaN becomes NULL, empty rows and columns are removed.

    Lines with too few fields are filled up with NULL, lines with too many are left out, values that do not fit their
    column become NULL.  ``encoding="auto"`` scans for bytes that are not UTF-8 and falls back to latin-1.
    """
    if encoding == "auto":
        broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1)
        encoding = "utf-8" if broken.isEmpty() else "latin-1"
    sep = delimiter or detect_delimiter(spark, path)
    options = {"sep": sep, "encoding": CHARSETS.get(encoding, encoding), "header": header}
    if na_values is not None:
        options["nullValue"] = na_values
    if timestamp_format:
        options["timestampFormat"] = timestamp_format
    reader = spark.read.options(**options)
    if schema:
        kinds = T.StructType.fromDDL(schema)
    else:
        kinds = reader.option("inferSchema", infer).csv(path).schema
    line = "_line"
    while line in kinds.names:
        line = "_" + line
    df = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=line, columnPruning=False, enforceSchema=True) \
        .schema(T.StructType([*kinds.fields, T.StructField(line, T.StringType())])).csv(path)
    fields = F.from_csv(line, ", ".join(f"f{i} string" for i in range(len(kinds) + 1)), {"sep": sep})
    df = df.where(F.col(f"`{line}`").isNull() | fields.getField(f"f{len(kinds)}").isNull()).drop(line)
    df = drop_empty(nan_to_null(df.toDF(*[c.strip() for c in df.columns])))
    return df.limit(nrows) if nrows else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns as NULL."""
    loose = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in loose})


def detect_delimiter(spark: SparkSession, path) -> str:
    """Delimiter with the most even, non-zero count over all lines."""
    aggs = []
    for i, d in enumerate(DELIMITERS):
        n = F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))
        aggs += [F.avg(n).alias(f"m{i}"), F.stddev_pop(n).alias(f"s{i}")]
    row = spark.read.text(path).agg(*aggs).first()
    scored = [(row[f"s{i}"] / row[f"m{i}"], -row[f"m{i}"], i) for i in range(len(DELIMITERS)) if row[f"m{i}"]]
    return DELIMITERS[min(scored)[2]] if scored else ","


def read_parquet(spark: SparkSession, path, columns: Sequence[str] | None = None, nrows: int | None = None,
                 nan_as_null: bool = False) -> DataFrame:
    """``nan_as_null`` turns NaN into NULL; filters on those columns then no longer reach the scan."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    df = nan_to_null(df) if nan_as_null else df
    return df.limit(nrows) if nrows else df


def read_orc(spark: SparkSession, path, columns: Sequence[str] | None = None, nrows: int | None = None,
                 nan_as_null: bool = False) -> DataFrame:
    """``nan_as_null`` turns NaN into NULL; filters on those columns then no longer reach the scan."""
    df = spark.read.orc(path)
    df = df.select(*columns) if columns else df
    df = nan_to_null(df) if nan_as_null else df
    return df.limit(nrows) if nrows else df


def read_feather(spark: SparkSession, path, columns: Sequence[str] | None = None) -> DataFrame:
    """Arrow IPC files, one file per task; the schema comes from the first file."""
    files = spark.read.format("binaryFile").load(path)
    first = files.select("content").limit(1).first()["content"]
    from pyspark.sql.pandas.types import from_arrow_schema

    arrow = pa.ipc.open_file(pa.BufferReader(first)).schema
    schema = from_arrow_schema(arrow)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                reader = pa.ipc.open_file(pa.BufferReader(content.as_buffer()))
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i)

    df = files.select("content").mapInArrow(decode, schema)
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def flatten_structs(df: DataFrame, depth: int = 3) -> DataFrame:
    """Struct columns to dotted names, down to ``depth`` levels."""
    def leaves(col, name: str, kind: T.DataType, level: int):
        if isinstance(kind, T.StructType) and level < depth:
            for f in kind.fields:
                yield from leaves(col.getField(f.name), f"{name}.{f.name}", f.dataType, level + 1)
        else:
            yield col.alias(name)

    out = []
    for f in df.schema.fields:
        out += list(leaves(F.col(f"`{f.name}`"), f.name, f.dataType, 0))
    return df.select(*out)


def read_json_nested(spark: SparkSession, path, depth: int = 3) -> DataFrame:
    """JSON documents: the first list-valued field is the table, its structs are flattened."""
    df = spark.read.option("multiLine", True).json(path)
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if lists:
        item = df.select(F.explode(F.col(f"`{lists[0]}`")).alias("item"))
        is_struct = isinstance(item.schema["item"].dataType, T.StructType)
        df = item.select("item.*") if is_struct else item
    return flatten_structs(df, depth)


def read_xml(spark: SparkSession, path, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def decode_report(name: str, content: bytes) -> tuple[str, str]:
    """Encoding of one file: byte-order mark, strict UTF-8, else latin-1."""
    if content[:3] == b"\xef\xbb\xbf":
        return name, "utf-8-sig"
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return name, "utf-16"
    try:
        content.decode("utf-8")
        return name, "utf-8"
    except UnicodeDecodeError:
        return name, "latin-1"


def encoding_report(spark: SparkSession, path) -> DataFrame:
    """Encoding per file."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([decode_report(p, c) for p, c in zip(b["path"], b["content"])], columns=["path", "encoding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(scan, "path string, encoding string")


def sql_on_file(spark: SparkSession, path: str, fmt: str = "parquet", select: str = "*", where: str | None = None) -> DataFrame:
    """Columns and filter applied to a file in place (both reach the scan)."""
    if "`" in path:
        raise ValueError("path must not contain a backtick")
    tail = f" WHERE {where}" if where else ""
    return spark.sql(f"SELECT {select} FROM {fmt}.`{path}`{tail}")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader chosen by file extension."""
    from quarrylens.sources.archives import read_compressed

    kind = path.rsplit(".", 1)[-1].lower()
    readers = {
        "csv": read_csv, "tsv": read_csv, "txt": read_csv, "parquet": read_parquet, "pq": read_parquet, "orc": read_orc,
        "feather": read_feather, "arrow": read_feather, "jsonl": read_jsonl, "ndjson": read_jsonl,
        "json": read_json_nested, "xml": read_xml, "zip": read_compressed, "gz": read_compressed, "tgz": read_compressed,
        "tar": read_compressed,
    }
    if kind not in readers:
        raise ValueError(f"no reader for .{kind} files")
    return readers[kind](spark, path, **options)
