"""Training schemas: extract, check new data against them, adapt new data to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.scalars import numeric_columns, string_columns
from quarrylens.operators.profile import _rows_from, text_melt, unique_counts


def training_schema(df: DataFrame) -> DataFrame:
    """Type, distinct count and numeric range / moments per column."""
    nums = set(numeric_columns(df))
    aggs = []
    for c in df.columns:
        x = F.col(c).cast("double") if c in nums else F.lit(None).cast("double")
        aggs += [F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max"),
                 F.avg(x).alias(f"{c}|mean"), F.stddev_samp(x).alias(f"{c}|std")]
    stats = _rows_from(df.agg(*aggs), df.columns, ["min", "max", "mean", "std"])
    names = df.sparkSession.createDataFrame(
        [(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "position int, column string, dtype string")
    uniq = unique_counts(df, df.columns).withColumnRenamed("unique", "n_unique")
    return names.join(uniq, "column").join(stats, "column")


def training_categories(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Known categories as rows ``(column, category)`` - never one array per column."""
    columns = string_columns(df) if columns is None else list(columns)
    return text_melt(df, columns).where(F.col("value").isNotNull()).select(
        "column", F.col("value").alias("category")).distinct()


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def validate_schema(df: DataFrame, schema: DataFrame, categories: DataFrame) -> DataFrame:
    """Findings: missing (critical), extra (info), type, range and unseen categories (warning)."""
    here = training_schema(df).select(
        "column", F.col("dtype").alias("new_dtype"), F.col("min").alias("new_min"),
        F.col("max").alias("new_max"))
    both = schema.select("column", "dtype", "min", "max").join(here, "column", "full")
    numeric_pair = F.col("dtype").isin(*_NUMBERS) & F.col("new_dtype").isin(*_NUMBERS)
    has = F.col("dtype").isNotNull() & F.col("new_dtype").isNotNull()

    def finding(cond, kind, severity):
        return F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
                                     F.lit(None).cast("bigint").alias("count")))

    checks = F.array(
        finding(F.col("new_dtype").isNull(), "missing_column", "critical"),
        finding(F.col("dtype").isNull(), "extra_column", "info"),
        finding(has & (F.col("dtype") != F.col("new_dtype")) & ~numeric_pair, "dtype_mismatch", "warning"),
        finding(has & ((F.col("new_min") < F.col("min")) | (F.col("new_max") > F.col("max"))),
                "out_of_range", "warning"),
    )
    found = both.select("column", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("f")).select(
        "column", "f.type", "f.severity", "f.count")
    texts = string_columns(df)
    if not texts:
        return found
    known_cols = categories.select("column").distinct()
    unseen = (
        training_categories(df, texts).join(known_cols, "column", "left_semi")
        .join(categories, ["column", "category"], "left_anti")
        .groupBy("column").agg(F.count(F.lit(1)).alias("count"))
        .select("column", F.lit("unknown_categories").alias("type"), F.lit("warning").alias("severity"),
                "count"))
    return found.unionByName(unseen)


def adapt_to_schema(df: DataFrame, schema: DataFrame, categories: DataFrame) -> DataFrame:
    """Reorder, cast, add missing columns (mean / first category / NULL) and drop extras."""
    entries = schema.orderBy("position").collect()
    firsts = {r["column"]: r["c"] for r in categories.groupBy("column").agg(F.min("category").alias("c")).collect()}
    out = []
    for e in entries:
        name, kind = e["column"], e["dtype"]
        if name in df.columns:
            have = dict(df.dtypes)[name]
            if have == kind:
                col = F.col(name)
            elif kind in _NUMBERS:
                col = F.col(name).try_cast("double").cast(kind) if kind in ("float", "double") else (
                    F.col(name) if have in _NUMBERS else F.col(name).try_cast("double"))
            else:
                col = F.col(name).try_cast(kind)
        elif e["mean"] is not None:
            col = F.lit(float(e["mean"]))
        elif name in firsts:
            col = F.lit(firsts[name])
        else:
            col = F.lit(None).cast(kind)
        out.append(col.alias(name))
    return df.select(*out)


