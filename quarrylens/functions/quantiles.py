"""Exact interpolated quantiles, computed from distributed value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.ranks import running_totals, value_counts
from quarrylens.functions.scalars import no_nan


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as ``(keep..., column, value)`` rows with double values, NaN as NULL."""
    wide = df.select(*keep, *[no_nan(F.col(c).cast("double")).alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), "column", "value")


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolation quantiles as rows ``(by..., prob, quantile)``."""
    return quantiles_of_counts(value_counts(df, value, by), value, probs, by)


def quantiles_of_counts(
    counts: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """As :func:`quantiles`, from rows holding a distinct value and its count ``n``."""
    by = list(by)
    ranked = running_totals(counts, value, ["n"], by)
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("n_total") - 1)

    covers = [
        (first <= F.ceil(position(p))) & (last >= F.floor(position(p))) for p in probs
    ]
    any_cover = covers[0]
    for c in covers[1:]:
        any_cover = any_cover | c
    hits = ranked.where(any_cover).select(
        *by,
        F.col(value).cast("double").alias("_v"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(float(p)).alias("prob"),
                        position(p).alias("pos"),
                        c.alias("hit"),
                    )
                    for p, c in zip(probs, covers)
                ]
            )
        ).alias("_q"),
    )
    frac = F.max("_q.pos") - F.floor(F.max("_q.pos"))
    return (
        hits.where("_q.hit")
        .groupBy(*by, F.col("_q.prob").alias("prob"))
        .agg((F.min("_v") + (F.max("_v") - F.min("_v")) * frac).alias("quantile"))
    )


def quantiles_wide(
    df: DataFrame, value: str, named: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """One row per group with one column per entry of ``named`` (name -> probability)."""
    return widen(quantiles(df, value, sorted(set(named.values())), by), named, by)


def widen(long: DataFrame, named: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    return long.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(name)
            for name, p in named.items()
        ]
    )


def edge_array(
    df: DataFrame, value: str, bins: int, by: Sequence[str] = (), name: str = "edges"
) -> DataFrame:
    """Distinct ascending quantile edges as one array per group."""
    probs = [i / bins for i in range(bins + 1)]
    return (
        quantiles(df, value, probs, by)
        .groupBy(*by)
        .agg(F.array_sort(F.collect_set("quantile")).alias(name))
    )


def bin_right_closed(x: Column, edges: Column) -> Column:
    """1-based bin of ``x`` for right-closed bins, lowest edge included; NULL outside."""
    below = F.size(F.filter(edges, lambda e: e < x))
    return F.when(
        x.isNotNull() & (x >= F.get(edges, F.lit(0))) & (below < F.size(edges)),
        F.greatest(below, F.lit(1)),
    )


def bin_left_closed(x: Column, edges: Column) -> Column:
    """1-based histogram bin of ``x``: left-closed bins, the last one closed; NULL outside."""
    reached = F.size(F.filter(edges, lambda e: e <= x))
    return F.when(
        x.isNotNull() & (reached >= 1) & (x <= F.get(edges, F.size(edges) - 1)),
        F.least(reached, F.size(edges) - 1),
    )
