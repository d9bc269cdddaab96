"""Checks run before modelling; each returns rows ``(type, severity, column, other, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.ranks import value_counts
from quarrylens.functions.scalars import numeric_columns, string_columns
from quarrylens.operators.correlation import pair_columns, pearson_pairs
from quarrylens.operators.profile import missing_summary, unique_counts

# Fixed value: names taken to be identifiers.
ID_NAME = r"(?i)^(id|index|row_?id|row_?num(ber)?|pk|.*_id|.*_pk|.*_key|uuid|guid)$"

_FIELDS = ["type", "severity", "column", "other", "value"]


def _issue(df: DataFrame, kind: str, severity, column: Column, value: Column,
           other: Column | None = None) -> DataFrame:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    gap = F.lit(None).cast("string")
    return df.select(
        F.lit(kind).alias("type"), sev.alias("severity"), column.alias("column"),
        (gap if other is None else other).alias("other"), value.cast("double").alias("value"))


def _rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def single_class_target(df: DataFrame, target: str) -> DataFrame:
    seen = unique_counts(df, [target]).where(F.col("unique") <= 1)
    return _issue(seen, "single_class", "critical", F.col("column"), F.col("unique"))


def extreme_imbalance(df: DataFrame, target: str, threshold: float = 0.01) -> DataFrame:
    """Smallest class below ``threshold`` of the labelled rows; ``other`` names the class."""
    counts = value_counts(df.select(F.col(target).cast("string").alias("v")), "v")
    least = counts.agg(
        F.sum("n").alias("total"), F.min(F.struct("n", "v")).alias("m"))
    share = F.col("m.n") / F.col("total")
    return _issue(least.where(share < threshold), "extreme_imbalance", "warning", F.lit(target),
                  share, F.col("m.v"))


def target_leakage(df: DataFrame, target: str, threshold: float = 0.95) -> DataFrame:
    nums = numeric_columns(df)
    if target not in nums or len(nums) < 2:
        return _none(df)
    r = pearson_pairs(df, [(c, target) for c in nums if c != target])
    return _issue(r.where(F.abs("r") > threshold), "leakage", "critical", F.col("col1"), F.col("r"),
                  F.col("col2"))


def constant_columns(df: DataFrame) -> DataFrame:
    seen = unique_counts(df, df.columns).where(F.col("unique") <= 1)
    return _issue(seen, "constant_column", "warning", F.col("column"), F.col("unique"))


def high_cardinality(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    texts = string_columns(df)
    if not texts:
        return _none(df)
    seen = unique_counts(df, texts).withColumn("n", _rows(df).scalar())
    ratio = F.col("unique") / F.col("n")
    return _issue(seen.where((F.col("n") > 0) & (ratio > threshold)), "high_cardinality", "warning",
                  F.col("column"), ratio)


def too_few_rows(df: DataFrame, min_rows: int = 30) -> DataFrame:
    few = _rows(df).where(F.col("n") < min_rows)
    return _issue(few, "too_few_rows", F.when(F.col("n") < 10, "critical").otherwise("warning"),
                  F.lit(None).cast("string"), F.col("n"))


def too_many_missing(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    gaps = missing_summary(df).where(F.col("missing_pct") > 100 * threshold)
    return _issue(gaps, "too_many_missing", "warning", F.col("column"), F.col("missing_pct") / 100)


def perfect_correlation(df: DataFrame, threshold: float = 0.99) -> DataFrame:
    nums = numeric_columns(df)
    if len(nums) < 2:
        return _none(df)
    r = pearson_pairs(df, pair_columns(nums)).where(F.abs("r") >= threshold)
    return _issue(r, "perfect_correlation", "warning", F.col("col1"), F.col("r"), F.col("col2"))


def id_like_columns(df: DataFrame) -> DataFrame:
    """Identifier by name, by all values being unique, or by consecutive integers."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    spans = {c: (F.col(f"`{c}|hi`") - F.col(f"`{c}|lo`") + 1) for c in ints}
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(f"{c}|lo") for c in ints], *[F.max(c).alias(f"{c}|hi") for c in ints],
        *[F.count(c).alias(f"{c}|filled") for c in ints])
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col("n"),
            (spans[c] if c in ints else F.lit(None)).cast("bigint").alias("span"),
            (F.col(f"`{c}|filled`") if c in ints else F.lit(None)).cast("bigint").alias("filled"))
        for c in df.columns]
    facts = stats.select(F.inline(F.array(*rows))).join(unique_counts(df, df.columns), "column")
    by_name = F.col("column").rlike(ID_NAME)
    unique = (F.col("unique") == F.col("n")) & (F.col("n") > 1)
    run = (F.col("span") == F.col("unique")) & (F.col("filled") == F.col("unique")) & (F.col("filled") > 1)
    run = F.coalesce(run, F.lit(False))
    reasons = F.concat_ws(
        ", ", F.when(by_name, "name matches ID pattern"), F.when(unique, "all values unique"),
        F.when(run, "sequential integers"))
    return _issue(facts.where((F.col("n") > 0) & (by_name | unique | run)), "id_like_column", "info",
                  F.col("column"), F.col("unique"), reasons)


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [], "type string, severity string, column string, other string, value double")


def edge_cases(df: DataFrame, target: str | None = None) -> DataFrame:
    """All checks, critical first."""
    parts = []
    if target and target in df.columns:
        parts += [single_class_target(df, target), extreme_imbalance(df, target),
                  target_leakage(df, target)]
    parts += [constant_columns(df), high_cardinality(df), too_few_rows(df), too_many_missing(df),
              perfect_correlation(df), id_like_columns(df)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return out.select(*_FIELDS).orderBy(rank, "type", "column")
