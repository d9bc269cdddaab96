"""A set of standard tests over all suitable column pairs of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import dist
from quarrylens.functions.scalars import numeric_columns, string_columns
from quarrylens.operators.correlation import pair_columns, pearson_pairs, vif
from quarrylens.operators.stats_tests import (
    anova_from_moments, chi_square_from_cells, group_moments, shapiro_wilk, welch_from_moments)


def test_battery(df: DataFrame, target: str | None = None, numerics: Sequence[str] | None = None,
                 categories: Sequence[str] | None = None) -> DataFrame:
    """t-tests per two-valued column, ANOVA by target, chi-square pairs, correlations, inflation factors and normality.

    All group comparisons share one (column, group) aggregation and all chi-square
    pairs share one pass over unpivoted pairs.
    """
    nums = list(numerics or numeric_columns(df))
    cats = list(categories or string_columns(df))
    out = None

    def add(part: DataFrame) -> None:
        nonlocal out
        cols = ["test", "a", "b", "statistic", "p_value", "effect_size"]
        out = part.select(cols) if out is None else out.unionByName(part.select(cols))

    if nums and cats:
        moments = group_moments(df, nums, cats)
        by = ["numeric", "grouping"]
        t = welch_from_moments(moments, by).where("_ok")
        add(t.select(F.lit("t_test").alias("test"), F.col("numeric").alias("a"), F.col("grouping").alias("b"), "statistic",
                     "p_value", "effect_size"))
        if target in cats:
            a = anova_from_moments(moments.where(F.col("grouping") == target), by).where(F.col("_min") >= 2)
            p = dist.f_p(F.col("f_statistic"), F.col("k") - 1, F.col("n") - F.col("k"))
            add(a.select(F.lit("anova").alias("test"), F.col("numeric").alias("a"), F.col("grouping").alias("b"),
                         F.col("f_statistic").alias("statistic"), p.alias("p_value"), F.col("eta_squared").alias("effect_size")))
    pairs = pair_columns(cats)
    if pairs:
        listed = F.array(*[F.struct(F.lit(x).alias("first"), F.lit(y).alias("second"), F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])
        cells = df.select(F.inline(listed)).where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("first", "second", "a", "b").agg(
            F.count(F.lit(1)).alias("o"))
        c = chi_square_from_cells(cells, ["first", "second"])
        p = F.when(F.col("dof") == 0, 1.0).otherwise(dist.chi2_p(F.col("statistic"), F.col("dof")))
        add(c.select(F.lit("chi_square").alias("test"), F.col("first").alias("a"), F.col("second").alias("b"), "statistic", p.alias("p_value"),
                     F.col("cramers_v").alias("effect_size")))
    if len(nums) > 1:
        r = pearson_pairs(df, pair_columns(nums)).where(F.col("r").isNotNull())
        tt = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-300), 1 - F.col("r") * F.col("r")))
        add(r.select(F.lit("pearson").alias("test"), F.col("col1").alias("a"), F.col("col2").alias("b"), F.col("r").alias("statistic"),
                     dist.t_p(tt, F.col("n") - 2).alias("p_value"), F.col("r").alias("effect_size")))
        v = vif(df, nums)
        add(v.select(F.lit("vif").alias("test"), F.col("column").alias("a"), F.lit(None).cast("string").alias("b"), F.col("vif").alias("statistic"),
                     F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("double").alias("effect_size")))
    if nums:
        s = shapiro_wilk(df, nums)
        add(s.select(F.col("method").alias("test"), F.col("column").alias("a"), F.lit(None).cast("string").alias("b"), "statistic", "p_value",
                     F.lit(None).cast("double").alias("effect_size")))
    if out is None:
        raise ValueError("the table has no columns to test")
    return out.withColumn("significant", F.col("p_value") < 0.05)
