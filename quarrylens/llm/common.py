"""Small helpers shared by the text operators."""

from __future__ import annotations

import gc
import os
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarrylens.session import checkpoint_dir

#: A word: a run of anything but space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A run of the characters that separate words.
GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, nothing is computed twice.

    The shuffle files of the write go when it has ended; until then lost ones are made again.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.stash_path = path
    return back


def discard(*stashed: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more, since what was made of them is stashed itself."""
    for df in stashed:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_HELD: dict = {}


def held(name, make):
    """What ``make()`` gives, kept in this Python worker until something else is asked for.

    Workers outlive their tasks and serve all operators of a session; so only one large object stays in each.
    """
    if name not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[name] = make()
    return _HELD[name]


def held_out(doc_id, folds: int):
    """Whether the crc32 of the id as text leaves 1; a null id counts as the empty text (crc32 0), so it is learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 1


def fresh_name(columns, wish: str) -> str:
    """``wish``, lengthened until no column (any case) has that name."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def utf8_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased; bytes.split() cuts at exactly the six separators."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def add_column(docs: DataFrame, inputs: dict, name: str, kind: str, make, keep=None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with one more column, computed in Arrow batches.

    ``inputs`` are named columns handed to the function that ``make()`` builds once per task; it takes lists of Python
    values, of about 4 MB at most (but at least one row), and returns the list of results.
    """
    keep = docs.columns if keep is None else list(keep)
    target = T.StructType([*docs.select(*keep).schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    out = to_arrow_schema(target)
    width, keys = len(keep), list(inputs)

    def run(stream):
        work = make()
        for batch in stream:
            for part in slices(batch, width, len(keys)):
                made = work(*[part.column(width + i).to_pylist() for i in range(len(keys))])
                kept = [part.column(i).cast(out.field(i).type) for i in range(width)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(made, out.field(width).type)], schema=out)

    asked = [inputs[k].alias(fresh_name(keep, f"_in{i}")) for i, k in enumerate(keys)]
    return docs.select(*keep, *asked).mapInArrow(run, target)


def slices(batch: pa.RecordBatch, first: int, n: int, most: int = 4_000_000):
    """The batch in pieces of about ``most`` bytes of input columns."""
    import numpy as np

    size = np.full(batch.num_rows, 16, np.int64)
    for i in range(first, first + n):
        kind = batch.column(i).type
        if pa.types.is_binary(kind) or pa.types.is_string(kind):
            size += pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def batches(rows: dict[str, list], schema: pa.Schema, size: int = 20_000):
    """Columns of Python values as record batches of at most ``size`` rows."""
    n = len(next(iter(rows.values())))
    for at in range(0, n, size):
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[f.name][at:at + size], f.type) for f in schema], schema=schema)


def write_bytes(uri: str, data: bytes) -> None:
    """Write one file into a shared folder: under another name first, then moved, so a lost task leaves no half file."""
    from pyarrow import fs

    store, path = open_store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{os.path.dirname(path)}/_writing-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(part, path)


def open_store(uri: str):
    """Arrow file system and path of a URI such as file:, hdfs: or s3: (or a plain path)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
