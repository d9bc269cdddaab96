"""Global ranks, running totals and row numbers without a single-task window.

The order key is cut into range buckets.  The cut points are an evenly spaced
subset of a small hash sample of the key, so they are the same in every branch
of the plan and need no driver round trip.  Inside a bucket an ordinary window
does the work; across buckets only one total per bucket is carried over.  No
task ever sees more than about one bucket of rows, even when a single key or
group holds most of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OVERSAMPLE = 8


def bucket_target(spark: SparkSession) -> int:
    """Number of range buckets: a power of two near twice the shuffle width."""
    width = max(4, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    target = 1
    while target < width and target < 4096:
        target *= 2
    return target


def _count_not_above(splits: Column, key: Column, upper: int) -> Column:
    """How many of the ascending ``splits`` are <= ``key`` (binary search)."""
    steps, step = [], 1
    while step <= upper:
        steps.insert(0, step)
        step *= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda found, s: F.when(F.get(splits, found + s - 1) <= key, found + s).otherwise(found),
    )


def _hash_sample(keys: DataFrame, size: int) -> DataFrame:
    """About ``size`` keys with the smallest hashes, the same ones in every evaluation.

    Larger samples are drawn per hash shard: every task passes on at most ``size`` keys
    and the merge is spread over the shards instead of one task.
    """
    if size <= 512:
        return keys.orderBy(F.xxhash64("_key"), "_key").limit(size)
    shards = size // 512
    w = W.partitionBy("_shard").orderBy("_h", "_key")
    ranked = keys.select("_key", F.xxhash64("_key").alias("_h")).withColumn(
        "_shard", F.pmod(F.xxhash64("_h"), F.lit(shards)))
    return ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 512).select("_key")


def with_bucket(df: DataFrame, key: Column, name: str = "_bucket") -> DataFrame:
    """Add an order-preserving range bucket of ``key`` (balanced for unique keys)."""
    target = bucket_target(df.sparkSession)
    sample = _hash_sample(df.select(key.alias("_key")).where(F.col("_key").isNotNull()), target * _OVERSAMPLE)
    cuts = sample.agg(F.array_sort(F.collect_list("_key")).alias("_all")).select(
        F.transform(
            F.sequence(F.lit(1), F.lit(target - 1)),
            lambda i: F.get(
                F.col("_all"), F.floor(i * F.size("_all") / F.lit(target)).cast("int")
            ),
        )
    )
    return (
        df.withColumn("_cuts", cuts.scalar())
        .withColumn(name, _count_not_above(F.col("_cuts"), key, target - 1))
        .drop("_cuts")
    )


def _by(keys: Sequence[str]) -> list:
    return list(keys) if keys else [F.lit(0)]


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating NULL keys as equal; keeps the left columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def running_totals(
    counts: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``{s}_before`` (sum over smaller values) and ``{s}_total`` per ``by`` group.

    ``counts`` must hold one row per ``(by, value)``: aggregate first, so that a
    value repeated a billion times is one row here.
    """
    by = list(by)
    rest = [c for c in counts.columns if c != value and c not in by]
    # The condition always holds.  It reads every column, so that the branches below (sample,
    # bucket totals, rows) keep equal plans under the shuffle and Spark reuses its exchange.
    counts = counts.where(F.xxhash64(*rest) >= F.lit(-(2**63)))
    rows = with_bucket(counts, F.col(value))
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    whole = W.partitionBy(*_by(by))
    ahead = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{s}").over(ahead), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"{s}_total") for s in sums],
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    out = same_keys(rows, offsets, [*by, "_bucket"])
    return out.select(
        *counts.columns,
        *[
            (F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"{s}_before")
            for s in sums
        ],
        *[f"{s}_total" for s in sums],
    )


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "n") -> DataFrame:
    """Rows per distinct ``(by, value)``, NULL and NaN left out."""
    known = F.col(value).isNotNull()
    if dict(df.dtypes)[value] in ("double", "float"):
        known = known & ~F.isnan(value)
    return (
        df.where(known).groupBy(*by, value).agg(F.count(F.lit(1)).alias(name))
    )


def mid_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with count ``n`` and average rank ``mid_rank`` (ties share it)."""
    ranked = running_totals(value_counts(df, value, by), value, ["n"], by)
    return ranked.withColumn("mid_rank", F.col("n_before") + (F.col("n") + 1) / 2)


def dense_index(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values with their 0-based position in sort order."""
    distinct = df.where(F.col(value).isNotNull()).select(*by, value).distinct()
    ranked = running_totals(distinct.withColumn("_one", F.lit(1)), value, ["_one"], by)
    return ranked.select(
        *by,
        value,
        F.col("_one_before").cast("long").alias("code"),
        F.col("_one_total").cast("long").alias("n_codes"),
    )


def sequence_index(
    df: DataFrame,
    order_by: Sequence[str],
    by: Sequence[str] = (),
    name: str = "_index",
    descending: Sequence[str] = (),
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in ``order_by`` order (per ``by`` group).

    ``order_by`` should end in a unique column.  Numeric columns listed in
    ``descending`` are ordered from high to low.
    """
    by = list(by)
    parts = [(-F.col(c) if c in descending else F.col(c)).alias(f"k{i}")
             for i, c in enumerate(order_by)]
    rows = with_bucket(df.withColumn("_order", F.struct(*parts)), F.col("_order"))
    totals = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    whole = W.partitionBy(*_by(by))
    ahead = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(whole).alias("_group_rows"),
    )
    inside = W.partitionBy(*by, "_bucket").orderBy("_order")
    out = same_keys(rows, offsets, [*by, "_bucket"]).withColumn(
        name, (F.col("_offset") + F.row_number().over(inside) - 1).cast("long")
    )
    extra = [F.col("_group_rows").alias(total)] if total else []
    return out.select(*df.columns, name, *extra)
