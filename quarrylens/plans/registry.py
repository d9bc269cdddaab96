"""Named queries over the sample tables, each with its SQL cross-check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.scalars import rnd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy parquet tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under ``name`` with an optional DuckDB cross-check."""
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round all double columns (``special`` sets digits per column) for value comparison."""
    return df.select(*[
        rnd(F.col(c), special.get(c, digits)).alias(c) if k in ("double", "float") else F.col(c)
        for c, k in df.dtypes])


def r(expr: str, digits: int = 6) -> str:
    """The SQL side of :func:`tidy` for one expression."""
    return f"(round({expr}, {digits}) + 0.0)"


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for part in ("profile", "clean", "stats", "features", "domain", "charts", "models", "sources", "edges", "streaming"):
        importlib.import_module(f"quarrylens.plans.queries_{part}")
