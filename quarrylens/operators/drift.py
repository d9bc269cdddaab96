"""Distribution drift between a reference and a current table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import dist
from quarrylens.functions.quantiles import bin_left_closed, melt, quantiles_of_counts
from quarrylens.functions.ranks import running_totals
from quarrylens.functions.scalars import numeric_columns, one_row
from quarrylens.operators.profile import text_melt
from quarrylens.operators.stats_tests import chi_square_from_cells


def _level(psi: Column, p: Column, alpha: float) -> Column:
    by_psi = F.when(psi < 0.1, "none").when(psi < 0.2, "low").when(psi < 0.25, "medium").otherwise("high")
    return F.when((p < alpha) & (psi < 0.1), "low").otherwise(by_psi)


def _judge(t: DataFrame, alpha: float, psi_limit: float) -> DataFrame:
    p, psi = F.col("p_value"), F.col("psi")
    return t.withColumns({
        "drift_detected": F.coalesce(p < alpha, F.lit(False)) | (psi > psi_limit),
        "drift_level": _level(psi, p, alpha)})


def drift_numeric(reference: DataFrame, current: DataFrame, columns: Sequence[str], alpha: float = 0.05,
                  psi_limit: float = 0.2, bins: int = 10) -> DataFrame:
    """Two-sample KS distance with p, and PSI on reference quantile bins, per column."""
    side = lambda df, ref: melt(df, columns).where(F.col("value").isNotNull()).withColumn("_r", F.lit(ref))
    counts = side(reference, 1).unionByName(side(current, 0)).groupBy("column", "value").agg(
        F.sum("_r").alias("e"), F.sum(1 - F.col("_r")).alias("a"))
    ranked = running_totals(counts, "value", ["e", "a"], ["column"])
    gap = F.abs((F.col("e_before") + F.col("e")) / F.col("e_total") - (F.col("a_before") + F.col("a")) / F.col("a_total"))
    ks = ranked.groupBy("column").agg(
        F.max(gap).alias("statistic"), F.max("e_total").cast("double").alias("_m"), F.max("a_total").cast("double").alias("_n"))
    edges = quantiles_of_counts(
        counts.where(F.col("e") > 0).select("column", "value", F.col("e").alias("n")), "value",
        [i / bins for i in range(bins + 1)], ["column"])
    table = edges.agg(*[
        F.array_sort(F.collect_set(F.when(F.col("column") == c, F.col("quantile")))).alias(c) for c in columns])
    mine = F.coalesce(*[F.when(F.col("column") == c, F.col(f"_t.`{c}`")) for c in columns])
    binned = counts.withColumn("_t", one_row(table)).withColumn("_edges", mine)
    binned = binned.withColumn("bin", bin_left_closed(F.col("value"), F.col("_edges")))
    # values outside the reference range keep a NULL bin and weigh nothing
    inside = lambda c: F.sum(F.when(F.col("bin").isNotNull(), F.col(c)).otherwise(0)).alias(c)
    cells = binned.groupBy("column", "bin").agg(inside("e"), inside("a"))
    sums = cells.groupBy("column").agg(F.sum("e").alias("_es"), F.sum("a").alias("_as"))
    share = lambda c, s: F.when(F.col(c) == 0, 1e-6).otherwise(F.col(c) / F.greatest(F.col(s), F.lit(1)))
    pe, pa = share("e", "_es"), share("a", "_as")
    psi = cells.join(sums, "column").groupBy("column").agg(
        F.greatest(F.sum((pa - pe) * F.log(pa / pe)), F.lit(0.0)).alias("psi"))
    t = ks.join(psi, "column", "left").withColumn("psi", F.coalesce("psi", F.lit(0.0)))
    size = F.col("_m") * F.col("_n") / (F.col("_m") + F.col("_n"))
    t = t.withColumn("p_value", dist.kolmogorov_p(F.col("statistic"), size)).drop("_m", "_n")
    return _judge(t.select("column", F.lit("ks").alias("test"), "statistic", "p_value", "psi"), alpha, psi_limit)


def drift_categorical(reference: DataFrame, current: DataFrame, columns: Sequence[str], alpha: float = 0.05,
                      psi_limit: float = 0.2) -> DataFrame:
    """Chi-square (Yates at one degree of freedom) and PSI per column."""
    side = lambda df, ref: text_melt(df, columns).where(F.col("value").isNotNull()).withColumn("_r", F.lit(ref))
    counts = side(reference, 1).unionByName(side(current, 0)).groupBy("column", "value").agg(
        F.sum("_r").alias("e"), F.sum(1 - F.col("_r")).alias("a"))
    cells = counts.select("column", F.col("value").alias("b"), F.inline(F.array(
        F.struct(F.lit("reference").alias("a"), F.col("e").alias("o")),
        F.struct(F.lit("current").alias("a"), F.col("a").alias("o"))))).where(F.col("o") > 0)
    chi = chi_square_from_cells(cells, ["column"])
    sums = counts.groupBy("column").agg(F.sum("e").alias("_es"), F.sum("a").alias("_as"))
    pe = F.col("e") / F.greatest(F.col("_es"), F.lit(1))
    pa = F.col("a") / F.greatest(F.col("_as"), F.lit(1))
    psi = counts.join(sums, "column").groupBy("column").agg(
        F.greatest(F.sum((pa - pe) * F.log((pa + 1e-6) / (pe + 1e-6))), F.lit(0.0)).alias("psi"))
    p = F.when(F.col("dof") == 0, 1.0).otherwise(dist.chi2_p(F.col("statistic"), F.col("dof")))
    t = chi.join(psi, "column").withColumn("p_value", p)
    return _judge(t.select("column", F.lit("chi_square").alias("test"), "statistic", "p_value", "psi"), alpha, psi_limit)


def drift_report(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None,
                 alpha: float = 0.05, psi_limit: float = 0.2) -> DataFrame:
    """Findings for every shared column, numeric and categorical."""
    shared = [c for c in (columns or reference.columns) if c in reference.columns and c in current.columns]
    nums = [c for c in shared if c in numeric_columns(reference)]
    cats = [c for c in shared if c not in nums]
    parts = []
    if nums:
        parts.append(drift_numeric(reference, current, nums, alpha, psi_limit))
    if cats:
        parts.append(drift_categorical(reference, current, cats, alpha, psi_limit))
    if not parts:
        raise ValueError("the tables share no columns")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def drift_score(report: DataFrame) -> DataFrame:
    """Share of drifted features and the action it calls for."""
    t = report.agg(
        F.avg(F.col("drift_detected").cast("double")).alias("drift_score"),
        F.count(F.when(F.col("drift_detected"), 1)).alias("drifted"), F.count(F.lit(1)).alias("features"),
        F.count(F.when(F.col("drift_level") == "high", 1)).alias("high"))
    return t.withColumns({
        "investigate": F.col("high") > 0,
        "recommendation": F.when(F.col("drifted") == 0, "none").when(F.col("drift_score") >= 0.5, "retrain")
        .when(F.col("drift_score") >= 0.2, "consider_retraining").otherwise("monitor")})
