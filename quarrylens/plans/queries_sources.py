"""Readers and export: the given tables are written in each format and read back inside the query."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrylens.plans.registry import query
from quarrylens.session import checkpoint_dir
from quarrylens.sources import catalog, files
from quarrylens.sources.manifest import file_manifest


def _folder(t, name: str) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]
_ORDERS_SQL = f"SELECT {', '.join(_ORDERS)} FROM orders"


def _bare(path: str) -> str:
    return path[5:] if path.startswith("file:") else path


@query("scan_csv", _ORDERS_SQL.replace("o_orderkey, o_custkey", "o_orderkey::INTEGER AS o_orderkey, o_custkey::INTEGER AS o_custkey").replace(
    "o_orderdate", "o_orderdate::TIMESTAMP AS o_orderdate"))
def _(t):
    path = _folder(t, "csv")
    t.orders.select(*_ORDERS).write.option("header", True).option("sep", ";").csv(path)
    return files.read_csv(t.spark, path)


@query("scan_csv_ragged", """SELECT c_custkey::INTEGER AS a, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS b FROM customer WHERE c_custkey % 3 <> 1""")
def _(t):
    """Every third line lacks its last field and stays, every third has one too many and goes."""
    path, key = _folder(t, "ragged"), F.col("c_custkey")
    line = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, F.concat_ws(",", key, "c_nationkey", F.lit("x"))).otherwise(
        F.concat_ws(",", key, "c_nationkey"))
    t.customer.select(line.alias("value")).write.text(path)
    return files.read_csv(t.spark, path, delimiter=",", header=False, schema="a int, b int")


@query("scan_jsonl", _ORDERS_SQL)
def _(t):
    path = _folder(t, "jsonl")
    t.orders.select(*_ORDERS).write.json(path)
    schema = ", ".join(f"{c} {kind}" for c, kind in t.orders.select(*_ORDERS).dtypes)
    return files.read_jsonl(t.spark, path, schema).select(*_ORDERS)


@query("scan_json_nested", """SELECT c_custkey AS key, c_acctbal AS "money.balance", c_mktsegment AS "money.segment" FROM customer""")
def _(t):
    """One document per nation, whose list of customers is the table."""
    path = _folder(t, "nested")
    item = F.struct(F.col("c_custkey").alias("key"), F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).alias("money"))
    t.customer.groupBy("c_nationkey").agg(F.collect_list(item).alias("customers")).write.option("maxRecordsPerFile", 1).json(path)
    return files.read_json_nested(t.spark, path)


@query("scan_xml", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def _(t):
    path = _folder(t, "xml")
    t.supplier.write.format("xml").option("rowTag", "supplier").save(path)
    return files.read_xml(t.spark, path, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("scan_orc", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_tax END AS l_tax FROM lineitem")
def _(t):
    """NaN is read as NULL."""
    path = _folder(t, "orc")
    tax = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    t.lineitem.select("l_orderkey", "l_linenumber", tax.alias("l_tax")).write.orc(path)
    return files.read_orc(t.spark, path, nan_as_null=True)


@query("export_table", _ORDERS_SQL)
def _(t):
    root = _bare(_folder(t, "export"))
    catalog.export_table(t.orders.select(*_ORDERS), f"{root}/orders", "parquet", allowed=(root,))
    return files.read_parquet(t.spark, f"{root}/orders")


@query("file_manifest_formats", """SELECT format, (SELECT count(*) FROM orders) AS rows, 3::BIGINT AS columns, TRUE AS hashed
    FROM (VALUES ('csv'), ('json'), ('orc'), ('parquet')) AS v(format)""")
def _(t):
    """The orders in several files of four formats; a column has line breaks inside quotes."""
    root = _folder(t, "manifest")
    rows = t.orders.select("o_orderkey", F.concat_ws("\n", "o_orderstatus", "o_orderpriority").alias("o_note"), "o_totalprice").repartition(3)
    rows.write.option("header", True).option("quoteAll", True).csv(f"{root}/csv")
    rows.write.orc(f"{root}/orc")
    rows.write.parquet(f"{root}/parquet")
    rows.write.json(f"{root}/json")
    return file_manifest(t.spark, root).where("format <> ''").groupBy("format").agg(
        F.sum("rows").alias("rows"), F.max("columns").alias("columns"), F.bool_and(F.length("sha256") == 64).alias("hashed"))
