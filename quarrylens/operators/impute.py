"""Imputation by column statistics or nearest neighbours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.quantiles import melt, quantiles
from quarrylens.functions.ranks import value_counts
from quarrylens.functions.scalars import one_row
from quarrylens.operators.neighbors import nearest


def fill_values(df: DataFrame, strategy: Mapping[str, str]) -> DataFrame:
    """Fill NULLs with each column's mean, median or mode (smallest of the most frequent)."""
    means = [c for c, s in strategy.items() if s == "mean"]
    meds = [c for c, s in strategy.items() if s == "median"]
    mods = [c for c, s in strategy.items() if s == "mode"]
    out = df
    if means:
        stats = df.agg(*[F.avg(c).alias(c) for c in means])
        out = out.withColumn("_m", one_row(stats)).withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.col(f"_m.`{c}`")) for c in means}).drop("_m")
    if meds:
        q = quantiles(melt(df, meds), "value", [0.5], ["column"])
        stats = q.agg(*[F.max(F.when(F.col("column") == c, F.col("quantile"))).alias(c) for c in meds])
        out = out.withColumn("_m", one_row(stats)).withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.col(f"_m.`{c}`")) for c in meds}).drop("_m")
    for c in mods:
        counts = value_counts(df.select(F.col(c).alias("value")), "value")
        best = counts.agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("value"))).alias("b"))
        out = out.withColumn(c, F.coalesce(F.col(c), best.select("b.value").scalar()))
    return out


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill_values(df, {c: "mean" for c in columns})


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill_values(df, {c: "median" for c in columns})


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill_values(df, {c: "mode" for c in columns})


def impute_knn(df: DataFrame, columns: Sequence[str], targets: Sequence[str] | None = None,
               key: str = "id", k: int = 5) -> DataFrame:
    """Fill gaps with the mean of the ``k`` nearest rows that know the value.

    Distance is Euclidean over the coordinates both rows have, scaled up for the
    missing ones.  Rows without a comparable donor get the column mean.
    """
    columns = list(columns)
    vec = F.array(*[F.col(c).cast("double") for c in columns])
    points = df.select(F.col(key), vec.alias("_v"))
    out = df
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    for c in targets or columns:
        at = columns.index(c)
        gaps = points.where(F.get("_v", F.lit(at)).isNull())
        others = F.array(*[F.lit(None).cast("double") if i == at else F.get("_v", F.lit(i)) for i in range(len(columns))])
        donors = points.where(F.get("_v", F.lit(at)).isNotNull()).select(  # no gap knows the coordinate that is filled
            F.col(key).alias("_donor"), others.alias("_v"), F.get("_v", F.lit(at)).alias("_known"))
        found = nearest(gaps, donors, query_key=key, item_key="_donor", vector="_v", k=k,
                        metric="nan_euclidean", payload=["_known"])
        guess = found.groupBy(key).agg(F.avg("_known").alias("_guess"))
        out = (
            out.join(guess, key, "left")
            .withColumn(c, F.coalesce(F.col(c).cast("double"), "_guess",
                                      means.select(F.col(c)).scalar()))
            .drop("_guess").select(*df.columns)
        )
    return out
