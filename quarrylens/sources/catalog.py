"""Named tables, guarded SQL and guarded export."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import DataFrame, SparkSession

from quarrylens.sources.jdbc import IDENTIFIER, check_select


def check_name(name: str) -> str:
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"invalid table name: {name!r}")
    return name


def register_table(df: DataFrame, name: str, persistent: bool = False) -> DataFrame:
    """Replace the named view (or saved table) by ``df`` and return it."""
    check_name(name)
    if persistent:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def query_table(spark: SparkSession, sql: str) -> DataFrame:
    """Run a query over the registered tables; stays lazy.  Spark's own grammar of queries refuses every other statement."""
    check_select(sql)
    try:
        spark._jsparkSession.sessionState().sqlParser().parseQuery(sql)
    except Exception as e:
        raise ValueError("only SELECT or WITH queries are allowed") from e
    return spark.sql(sql)


def _uri(path: str, base: str = ".") -> str:
    """A path without ``..`` as a URI; paths without a scheme are local and their links are followed."""
    scheme, sep, rest = path.partition("://")
    if not sep:
        if path.startswith("file:"):
            path = path[5:]
        return os.path.realpath(path if os.path.isabs(path) else os.path.join(base, path))
    host, _, tail = rest.partition("/")
    return f"{scheme.lower()}://{host}{posixpath.normpath('/' + tail)}"


def export_table(df: DataFrame, path: str, fmt: str = "csv", allowed: tuple[str, ...] = ("outputs", "data"),
                 base: str = ".") -> str:
    """Write csv, parquet or json below one of the allowed folders (as a partitioned directory).

    Folders and target may be URIs such as ``s3://bucket/folder``; they are compared as such.
    """
    target = _uri(path, base)
    if not any(target == r or target.startswith(r.rstrip("/") + "/") for r in (_uri(a, base) for a in allowed)):
        raise ValueError(f"{path!r} is outside the allowed folders")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(target)
    elif fmt == "parquet":
        writer.parquet(target)
    elif fmt == "json":
        writer.json(target)
    else:
        raise ValueError(f"unsupported format: {fmt}")
    return target


class Catalogue:
    """Named sources backed by temporary views."""

    def __init__(self, spark: SparkSession):
        self.spark, self._origin = spark, {}

    def add(self, name: str, df: DataFrame, origin: str = "") -> DataFrame:
        self._origin[check_name(name)] = origin
        return register_table(df, name)

    def get(self, name: str) -> DataFrame:
        if name not in self._origin:
            raise KeyError(name)
        return self.spark.table(name)

    def remove(self, name: str) -> None:
        self._origin.pop(name)
        self.spark.catalog.dropTempView(name)

    def columns(self) -> DataFrame:
        """``(table_name, column_name, dtype, position, origin)`` of all sources."""
        rows = [(n, c, t, i, o) for n, o in self._origin.items() for i, (c, t) in enumerate(self.spark.table(n).dtypes)]
        return self.spark.createDataFrame(
            rows, "table_name string, column_name string, dtype string, position int, origin string")
