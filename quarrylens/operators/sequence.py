"""Order-dependent features on tables of any size.

Rows get a global position first (see ``functions.ranks``), then are cut into
blocks of consecutive positions.  A block also receives the few rows just before
it (its halo), so lags and rolling frames never look outside their own task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions.ranks import _by, same_keys, sequence_index, with_bucket

BLOCK_ROWS = 1 << 16


def _blocks(df: DataFrame, order_by: Sequence[str], by: Sequence[str], halo: int,
            block_rows: int) -> DataFrame:
    block_rows = max(block_rows, halo + 1)
    rows = sequence_index(df, order_by, by).withColumn(
        "_block", F.floor(F.col("_index") / block_rows))
    if not halo:
        return rows.withColumn("_own", F.lit(True))
    near_end = F.pmod(F.col("_index"), F.lit(block_rows)) >= block_rows - halo
    copies = F.when(
        near_end,
        F.array(F.struct(F.col("_block").alias("b"), F.lit(True).alias("own")),
                F.struct((F.col("_block") + 1).alias("b"), F.lit(False).alias("own"))),
    ).otherwise(F.array(F.struct(F.col("_block").alias("b"), F.lit(True).alias("own"))))
    return rows.withColumn("_c", F.explode(copies)).withColumns(
        {"_block": F.col("_c.b"), "_own": F.col("_c.own")}).drop("_c")


def with_frames(df: DataFrame, features: dict, order_by: Sequence[str], halo: int,
                by: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``name -> f(window)`` columns computed over the previous ``halo`` rows."""
    blocks = _blocks(df, order_by, by, halo, block_rows)
    w = W.partitionBy(*by, "_block").orderBy("_index")
    out = blocks.select("*", *[f(w).alias(k) for k, f in features.items()])
    return out.where("_own").select(*df.columns, *features)


def lag_features(df: DataFrame, column: str, lags: Sequence[int], order_by: Sequence[str],
                 by: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``{column}_lag_{k}``: the value k rows earlier."""
    features = {f"{column}_lag_{k}": (lambda w, k=k: F.lag(column, k).over(w)) for k in lags}
    return with_frames(df, features, order_by, max(lags), by, block_rows)


_AGGS = {
    "mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max,
    "count": F.count, "var": F.var_samp, "median": F.median,
}


def rolling_features(df: DataFrame, column: str, windows: Sequence[int], order_by: Sequence[str],
                     aggs: Sequence[str] = ("mean", "std"), by: Sequence[str] = (),
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``{column}_rolling_{w}_{agg}`` over the current and previous w-1 rows."""
    def frame(agg: str, size: int):
        return lambda w: _AGGS[agg](column).over(w.rowsBetween(-(size - 1), 0))

    features = {f"{column}_rolling_{s}_{a}": frame(a, s) for s in windows for a in aggs}
    return with_frames(df, features, order_by, max(windows) - 1, by, block_rows)


def fill(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], forward: bool = True,
         by: Sequence[str] = ()) -> DataFrame:
    """Forward or backward fill: range buckets filled locally, one carried value per bucket."""
    order = F.struct(*order_by)
    rows = with_bucket(df.withColumn("_order", order), F.col("_order"))
    pick = F.max_by if forward else F.min_by
    ends = rows.groupBy(*by, "_bucket").agg(*[
        pick(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))),
             F.when(F.col(c).isNotNull(), F.col("_order"))).alias(f"_e_{c}") for c in columns])
    whole = W.partitionBy(*_by(by)).orderBy("_bucket")
    span = (W.unboundedPreceding, -1) if forward else (1, W.unboundedFollowing)
    take = F.last if forward else F.first
    carried = ends.select(*by, "_bucket", *[
        take(f"_e_{c}", ignorenulls=True).over(whole.rowsBetween(*span)).alias(f"_c_{c}")
        for c in columns])
    inside = W.partitionBy(*by, "_bucket").orderBy("_order")
    reach = inside.rowsBetween(W.unboundedPreceding, 0) if forward else inside.rowsBetween(
        0, W.unboundedFollowing)
    joined = same_keys(rows, carried, [*by, "_bucket"])
    filled = {c: F.coalesce(take(c, ignorenulls=True).over(reach), F.col(f"_c_{c}.v"))
              for c in columns}
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def running(df: DataFrame, sums: dict[str, Column], order_by: Sequence[str],
            by: Sequence[str] = ()) -> DataFrame:
    """Add running sums (current row included) of the given expressions."""
    rows = df.withColumns({f"_x_{k}": e for k, e in sums.items()}).withColumn(
        "_order", F.struct(*order_by))
    rows = with_bucket(rows, F.col("_order"))
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(f"_x_{k}").alias(f"_t_{k}") for k in sums])
    ahead = W.partitionBy(*_by(by)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bucket", *[
        F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_o_{k}") for k in sums])
    inside = W.partitionBy(*by, "_bucket").orderBy("_order").rowsBetween(W.unboundedPreceding, 0)
    out = same_keys(rows, offsets, [*by, "_bucket"])
    return out.select(*df.columns, *[
        (F.col(f"_o_{k}") + F.coalesce(F.sum(f"_x_{k}").over(inside), F.lit(0))).alias(k)
        for k in sums])
