"""Category encoders: statistics per category, joined back (skew is split by AQE)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.ranks import dense_index, value_counts


def _attach(df: DataFrame, column: str, table: DataFrame, value: str, default=None) -> DataFrame:
    """Replace ``column`` by its entry in ``table`` (``column``, ``value``); NULL stays ``default``."""
    small = table.select(F.col(column).alias("_k"), F.col(value).alias("_v"))
    out = df.join(small, df[column] == F.col("_k"), "left")
    new = F.col("_v") if default is None else F.coalesce("_v", F.lit(default))
    return out.select(*[new.alias(c) if c == column else df[c] for c in df.columns])


def one_hot(df: DataFrame, columns: Sequence[str], drop_first: bool = True,
            max_categories: int | None = None) -> DataFrame:
    """0/1 column per category in sorted order; more than ``max_categories``, where given, are an error."""
    new = []
    for c in columns:
        found = df.where(F.col(c).isNotNull()).select(c).distinct()
        values = sorted(r[0] for r in (found.limit(max_categories + 1) if max_categories else found).collect())
        if max_categories and len(values) > max_categories:
            raise ValueError(f"{c} has more than {max_categories} categories")
        new += [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
                for v in values[1 if drop_first else 0:]]
    return df.select(*[c for c in df.columns if c not in columns], *new)


def target_encode(df: DataFrame, columns: Sequence[str], target: str, smoothing: float = 10) -> DataFrame:
    """Category mean of the target, pulled towards the global mean."""
    overall = df.agg(F.avg(target)).scalar()
    out = df
    for c in columns:
        stats = df.where(F.col(c).isNotNull()).groupBy(c).agg(
            F.count(target).alias("n"), F.avg(target).alias("mean"))
        table = stats.select(
            c, ((F.col("n") * F.col("mean") + smoothing * overall) / (F.col("n") + smoothing)).alias("v"))
        out = _attach(out, c, table, "v")
    return out


def ordinal_encode(df: DataFrame, columns: Sequence[str],
                   order: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Position in the given order, else in sort order; unknown values become NULL."""
    out = df
    for c in columns:
        if order and c in order:
            pos = F.array_position(F.array(*[F.lit(v) for v in order[c]]), F.col(c))
            out = out.withColumn(c, F.nullif(pos, F.lit(0)) - 1)
        else:
            out = _attach(out, c, dense_index(df, c), "code")
    return out


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Position in sort order, NULL as -1."""
    out = df
    for c in columns:
        out = _attach(out, c, dense_index(df, c), "code", default=-1)
    return out


def binary_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bits (lowest first) of the 1-based position in string sort order, NULL as 0."""
    out = df
    for c in columns:
        codes = dense_index(df.select(F.col(c).cast("string").alias(c)), c)
        k = codes.count()
        if k == 0:
            continue
        bits = max(1, math.ceil(math.log2(k + 1)))
        coded = _attach(out.withColumn(c, F.col(c).cast("string")), c,
                        codes.withColumn("code", F.col("code") + 1), "code", default=0)
        out = coded.select(
            *[x for x in coded.columns if x != c],
            *[F.shiftright(F.col(c), b).bitwiseAND(F.lit(1)).cast("int").alias(f"{c}_bin_{b}")
              for b in range(bits)])
    return out


def frequency_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of the non-null rows holding the value."""
    out = df
    for c in columns:
        counts = value_counts(df, c)
        total = counts.agg(F.sum("n")).scalar()
        out = _attach(out, c, counts.select(c, (F.col("n") / total).alias("v")), "v")
    return out


def woe_table(df: DataFrame, column: str, target: str) -> DataFrame:
    """Weight of evidence per category of a 0/1 target (0.5 added to every count)."""
    totals = df.agg(F.sum(target).alias("e"), F.count(F.lit(1)).alias("n"))
    e, ne = totals.select("e").scalar(), totals.select(F.col("n") - F.col("e")).scalar()
    stats = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.sum(target).alias("events"), F.count(target).alias("n"))
    good = (F.col("events") + 0.5) / (e + 0.5)
    bad = (F.col("n") - F.col("events") + 0.5) / (ne + 0.5)
    return stats.select(column, F.log(good / bad).alias("woe"))


def woe_encode(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    out = df
    for c in columns:
        out = _attach(out, c, woe_table(df, c, target), "woe")
    return out


def hash_encode(df: DataFrame, columns: Sequence[str], buckets: int = 32) -> DataFrame:
    """Stable bucket number per value (no fitting needed)."""
    def bucket(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(F.col(c)), F.lit(buckets)).cast("int"))

    return df.withColumns({c: bucket(c) for c in columns})
