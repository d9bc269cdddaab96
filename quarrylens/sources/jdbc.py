"""Relational databases through Spark's JDBC source."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

IDENTIFIER = re.compile(r"[A-Za-z_]\w*")

# URL prefix and driver class per dialect.
DRIVERS = {
    "postgres": ("jdbc:postgresql", "org.postgresql.Driver"),
    "redshift": ("jdbc:redshift", "com.amazon.redshift.jdbc42.Driver"),
    "mysql": ("jdbc:mysql", "com.mysql.cj.jdbc.Driver"),
    "sqlserver": ("jdbc:sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
}
_TABLE_LIST = "SELECT table_schema, table_name FROM information_schema.tables"


def check_identifier(name: str) -> str:
    if not all(IDENTIFIER.fullmatch(part) for part in name.split(".")):
        raise ValueError(f"invalid table name: {name!r}")
    return name


def check_select(sql: str) -> str:
    """Only SELECT / WITH statements are passed on."""
    word = sql.strip().split(None, 1)[0].lower() if sql.strip() else ""
    if word not in ("select", "with"):
        raise ValueError("only SELECT or WITH queries are allowed")
    return sql


def jdbc_url(dialect: str, host: str, port: int, database: str) -> str:
    prefix, _ = DRIVERS[dialect]
    if dialect == "sqlserver":
        return f"{prefix}://{host}:{port};databaseName={database}"
    return f"{prefix}://{host}:{port}/{database}"


def read_jdbc(spark: SparkSession, url: str, *, table: str | None = None, query: str | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              partitions: int = 8, fetch_size: int = 10_000, **options: str) -> DataFrame:
    """A table or a SELECT query; with ``partition_column`` the read runs in parallel ranges.

    Filters, columns and limits reach the database through Spark's pushdown.
    """
    if (table is None) == (query is None):
        raise ValueError("give either table or query")
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size).options(**options)
    source = check_identifier(table) if table else f"({check_select(query)}) q"
    reader = reader.option("dbtable", source)
    if partition_column:
        if lower is None or upper is None:
            ends = reader.load().selectExpr(f"min({check_identifier(partition_column)}) lo",
                                            f"max({partition_column}) hi").first()
            lower, upper = ends["lo"], ends["hi"]
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", str(lower))
                  .option("upperBound", str(upper)).option("numPartitions", partitions))
    return reader.load()


def jdbc_tables(spark: SparkSession, url: str, listing: str = _TABLE_LIST, **options: str) -> DataFrame:
    """Tables of the database (``listing`` replaces the information-schema query where a dialect lacks it)."""
    return read_jdbc(spark, url, query=listing, **options)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", check_identifier(table)).options(**options).mode(mode).save()
