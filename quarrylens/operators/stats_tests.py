"""Hypothesis tests: a distributed aggregation, then one p-value per test row."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions import dist
from quarrylens.functions.quantiles import melt, quantiles_of_counts
from quarrylens.functions.ranks import running_totals, value_counts
from quarrylens.functions.scalars import normal_cdf_expr, one_row, require


def _verdict(df: DataFrame, alpha: float) -> DataFrame:
    return df.withColumns({
        "significant": F.col("p_value") < alpha,
        "evidence": dist.evidence(F.col("p_value"), alpha),
    })


def _clean(df: DataFrame, numeric: str, group: str) -> DataFrame:
    return df.select(F.col(numeric).cast("double").alias("x"), F.col(group).cast("string").alias("g")
                     ).where(F.col("x").isNotNull() & F.col("g").isNotNull())


def group_moments(df: DataFrame, numerics: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """n, mean and variance for every (numeric column, group column, group) in one pass."""
    nums = F.array(*[F.struct(F.lit(c).alias("numeric"), F.col(c).cast("double").alias("x"))
                     for c in numerics])
    grps = F.array(*[F.struct(F.lit(c).alias("grouping"), F.col(c).cast("string").alias("g"))
                     for c in groups])
    rows = df.select(F.explode(nums).alias("a"), grps.alias("gs")).select("a.*", F.explode("gs").alias("b"))
    rows = rows.select("numeric", "x", "b.grouping", "b.g").where(
        F.col("x").isNotNull() & F.col("g").isNotNull())
    return rows.groupBy("numeric", "grouping", "g").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def welch_from_moments(moments: DataFrame, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Welch t-test per ``by`` group of two (n, mean, var) rows; groups in label order."""
    first = lambda c: F.min_by(c, "g")
    second = lambda c: F.max_by(c, "g")
    s = moments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.min("g").alias("group1"), F.max("g").alias("group2"),
        *[f(c).alias(f"{c}{i}") for c in ("n", "mean", "var") for i, f in ((1, first), (2, second))])
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "var1", "var2"))
    ok = (F.col("k") == 2) & (n1 >= 2) & (n2 >= 2)
    diff = F.col("mean1") - F.col("mean2")
    e1, e2 = v1 / n1, v2 / n2
    se = F.sqrt(e1 + e2)
    dof = F.when(se > 0, (e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)))
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    facts = s.select(
        *by, "group1", "group2", "n1", "n2", ok.alias("_ok"), diff.alias("mean_diff"), se.alias("_se"),
        dof.alias("dof"), F.when(se > 0, diff / se).alias("statistic"),
        F.when(pooled > 0, diff / pooled).otherwise(0.0).alias("effect_size"))
    half = F.coalesce(dist.t_quantile(F.lit(1 - alpha / 2), F.col("dof")) * F.col("_se"), F.lit(0.0))
    return facts.withColumn("p_value", dist.t_p(F.col("statistic"), F.col("dof"))).withColumn(
        "ci_lower", F.col("mean_diff") - half).withColumn("ci_upper", F.col("mean_diff") + half)


def t_test_independent(df: DataFrame, numeric: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Welch's t-test between exactly two groups, Cohen's d and a confidence interval."""
    m = _clean(df, numeric, group).groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))
    out = welch_from_moments(m, (), alpha).withColumn(
        "statistic", require(F.col("_ok"), "exactly two groups of two or more rows are needed",
                             F.col("statistic")))
    return _verdict(out.drop("_ok", "_se"), alpha)


def t_test_paired(df: DataFrame, a: str, b: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Paired t-test of ``a - b``; a difference that is always zero gives t = 0, p = 1."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    s = df.groupBy(*by).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"),
        F.max(F.abs(d)).alias("_far"))
    n, sd, md = F.col("n"), F.col("sd"), F.col("mean_diff")
    s = s.withColumn("statistic", F.when(F.col("_far") == 0, 0.0).when(sd > 0, md / (sd / F.sqrt(n))))
    s = s.withColumn("effect_size", F.when(sd > 0, md / sd).otherwise(0.0))
    s = s.withColumn("p_value", F.when(F.col("_far") == 0, 1.0).otherwise(dist.t_p(F.col("statistic"), n - 1)))
    half = dist.t_quantile(F.lit(1 - alpha / 2), n - 1) * sd / F.sqrt(n)
    s = s.withColumn("ci_lower", md - half).withColumn("ci_upper", md + half)
    return _verdict(s.drop("_far", "sd"), alpha)


def _two_groups(rows: DataFrame) -> DataFrame:
    """Attach the smallest and largest group label (``_g.lo`` / ``_g.hi``) to every row."""
    ends = rows.agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    return rows.withColumn("_g", one_row(ends))


def mann_whitney_u(df: DataFrame, numeric: str, group: str, alpha: float = 0.05) -> DataFrame:
    """U of the first group (label order), rank-biserial effect, tie-corrected p.

    The p-value is exact without ties when the smaller group has at most 8 rows.
    """
    rows = _two_groups(_clean(df, numeric, group))
    counts = rows.groupBy("x").agg(
        F.sum((F.col("g") == F.col("_g.lo")).cast("bigint")).alias("a"),
        F.count(F.lit(1)).alias("n"),
        F.sum((~F.col("g").isin(F.col("_g.lo"), F.col("_g.hi"))).cast("bigint")).alias("_odd"))
    ranked = running_totals(counts, "x", ["n"])
    mid = F.col("n_before") + (F.col("n") + 1) / 2
    t = F.col("n").cast("double")
    s = ranked.agg(
        F.sum(F.col("a") * mid).alias("r1"), F.sum("a").cast("double").alias("n1"),
        F.sum(F.col("n") - F.col("a")).cast("double").alias("n2"),
        F.sum(t * t * t - t).alias("ties"), F.sum("_odd").alias("_odd"))
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    s = s.withColumn("statistic", require(
        (F.col("_odd") == 0) & (n1 > 0) & (n2 > 0), "exactly two groups are needed",
        F.col("r1") - n1 * (n1 + 1) / 2))
    u = F.col("statistic")
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sigma
    exact = (F.least(n1, n2) <= 8) & (F.col("ties") == 0) & (F.greatest(n1, n2) <= 200)
    normal = F.least(F.lit(1.0), 2 * (1 - normal_cdf_expr(z)))
    small = dist.rank_sum_exact_p(F.when(exact, u), F.when(exact, n1), F.when(exact, n2))
    s = s.withColumn("p_value", F.coalesce(small, normal, F.lit(1.0)))
    s = s.withColumn("effect_size", 1 - 2 * u / (n1 * n2))
    return _verdict(s.select("statistic", "p_value", "effect_size", "n1", "n2"), alpha)


def _pairs(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        *by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")
    ).agg(F.count(F.lit(1)).alias("o"))


def chi_square_from_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Chi-square per ``by`` group of (a, b, o) cells; empty cells need not be listed."""
    rows = cells.groupBy(*by, "a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy(*by, "b").agg(F.sum("o").alias("cb"))
    body = cells.join(rows, [*by, "a"]).join(cols, [*by, "b"]).groupBy(*by).agg(
        F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("_q"),
        F.sum("o").cast("double").alias("n"))
    rdim = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("r"), F.sum(1 / F.col("ra")).alias("_ir"))
    cdim = cols.groupBy(*by).agg(F.count(F.lit(1)).alias("c"), F.sum(1 / F.col("cb")).alias("_ic"))
    if by:
        s = body.join(rdim, list(by)).join(cdim, list(by))
    else:
        s = body.withColumn("_r", one_row(rdim)).withColumn("_c", one_row(cdim)).select(
            "_q", "n", "_r.*", "_c.*")
    n = F.col("n")
    plain = F.greatest(n * (F.col("_q") - 1), F.lit(0.0))
    inv = n * F.col("_ir") * F.col("_ic")
    gap = F.greatest(F.sqrt(plain / inv) - 0.5, F.lit(0.0))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    s = s.withColumn("dof", dof).withColumn(
        "statistic", F.when(dof == 1, gap * gap * inv).when(dof == 0, 0.0).otherwise(plain))
    small = F.least(F.col("r"), F.col("c")) - 1
    return s.select(
        *by, "statistic", "dof", n.cast("bigint").alias("n"),
        F.when(small > 0, F.sqrt(F.col("statistic") / (n * small))).otherwise(0.0).alias("cramers_v"))


def chi_square(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Independence test with Yates correction at one degree of freedom; Cramer's V."""
    s = chi_square_from_cells(_pairs(df, a, b))
    p = F.when(F.col("dof") == 0, 1.0).otherwise(dist.chi2_p(F.col("statistic"), F.col("dof")))
    return _verdict(s.withColumn("p_value", p), alpha)


def expected_frequencies(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected count of every cell that occurs."""
    cells = _pairs(df, a, b)
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    total = cells.agg(F.sum("o").alias("n")).scalar()
    return cells.join(rows, "a").join(cols, "b").select(
        "a", "b", F.col("o").alias("observed"), (F.col("ra") * F.col("cb") / total).alias("expected"))


def fisher_exact(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Odds ratio and exact two-sided p of a 2 x 2 table."""
    cells = _pairs(df, a, b)
    ends = cells.agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"),
                     F.max("b").alias("b1"), F.count_distinct("a").alias("ka"),
                     F.count_distinct("b").alias("kb"))
    at = lambda x, y: F.sum(F.when((F.col("a") == F.col(f"_e.{x}")) & (F.col("b") == F.col(f"_e.{y}")),
                                   F.col("o")).otherwise(0)).cast("double")
    s = cells.withColumn("_e", one_row(ends)).agg(
        at("a0", "b0").alias("n00"), at("a0", "b1").alias("n01"), at("a1", "b0").alias("n10"),
        at("a1", "b1").alias("n11"), F.first("_e.ka").alias("_ka"), F.first("_e.kb").alias("_kb"))
    ok = (F.col("_ka") == 2) & (F.col("_kb") == 2)
    cross = F.col("n01") * F.col("n10")
    s = s.withColumn("odds_ratio", require(
        ok, "a 2 x 2 table is needed",
        F.when(cross > 0, F.col("n00") * F.col("n11") / F.nullif(cross, F.lit(0.0)))
        .when(F.col("n00") * F.col("n11") > 0, F.lit(float("inf")))))
    s = s.withColumn("p_value", dist.fisher_p(F.col("n00"), F.col("n01"), F.col("n10"), F.col("n11")))
    return _verdict(s.drop("_ka", "_kb"), alpha)


def anova_from_moments(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F and eta squared per ``by`` group of (n, mean, var) rows."""
    grand = (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m")
    base = moments.groupBy(*by).agg(grand)
    rows = moments.join(base, list(by)) if by else moments.withColumn("_m", base.scalar())
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.min("n").alias("_min"),
        F.sum(F.col("n") * (F.col("mean") - F.col("_m")) * (F.col("mean") - F.col("_m"))).alias("_ssb"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("_ssw"))
    k, n, ssb, ssw = F.col("k"), F.col("n"), F.col("_ssb"), F.col("_ssw")
    return s.select(
        *by, "k", "n", "_min",
        F.when((ssw > 0) & (n > k) & (k > 1), (ssb / (k - 1)) / (ssw / (n - k))).alias("f_statistic"),
        F.when(ssb + ssw > 0, ssb / (ssb + ssw)).otherwise(0.0).alias("eta_squared"))


def anova_oneway(df: DataFrame, numeric: str, group: str, alpha: float = 0.05) -> DataFrame:
    m = _clean(df, numeric, group).groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))
    s = anova_from_moments(m).withColumn("f_statistic", require(
        (F.col("k") >= 2) & (F.col("_min") >= 2), "two groups of two or more rows are needed",
        F.col("f_statistic"))).drop("_min")
    s = s.withColumn("p_value", dist.f_p(F.col("f_statistic"), F.col("k") - 1, F.col("n") - F.col("k")))
    return _verdict(s, alpha)


def kruskal_wallis(df: DataFrame, numeric: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Tie-corrected H and epsilon squared."""
    cells = _clean(df, numeric, group).groupBy("x", "g").agg(F.count(F.lit(1)).alias("c"))
    values = cells.groupBy("x").agg(F.sum("c").alias("n"))
    ranked = running_totals(values, "x", ["n"]).select(
        "x", "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("mid"))
    per_group = cells.join(ranked, "x").groupBy("g").agg(
        F.sum(F.col("c") * F.col("mid")).alias("r"), F.sum("c").cast("double").alias("n"))
    t = F.col("n").cast("double")
    ties = values.agg(F.sum(t * t * t - t).alias("ties"))
    s = per_group.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("r") * F.col("r") / F.col("n")).alias("_q")).withColumn("_ties", ties.scalar())
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)) / (1 - F.col("_ties") / (n * n * n - n))
    s = s.withColumn("h_statistic", require(F.col("k") >= 2, "two or more groups are needed", h))
    s = s.withColumn("epsilon_squared", F.col("h_statistic") / ((n * n - 1) / (n + 1)))
    s = s.withColumn("p_value", dist.chi2_p(F.col("h_statistic"), F.col("k") - 1))
    return _verdict(s.drop("_q", "_ties"), alpha)


def levene(df: DataFrame, numeric: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Equality of variances: ANOVA on distances from the exact group medians."""
    counts = value_counts(_clean(df, numeric, group), "x", ["g"])
    med = quantiles_of_counts(counts, "x", [0.5], ["g"]).select("g", F.col("quantile").alias("_med"))
    z, w = F.abs(F.col("x") - F.col("_med")), F.col("n")
    rows = counts.join(med, "g").select("g", z.alias("z"), w.cast("double").alias("w"))
    m = rows.groupBy("g").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("mean"))
    spread = rows.join(m.select("g", "mean"), "g").groupBy("g").agg(
        F.sum(F.col("w") * (F.col("z") - F.col("mean")) * (F.col("z") - F.col("mean"))).alias("_ss"))
    moments = m.join(spread, "g").withColumn(
        "var", F.when(F.col("n") > 1, F.col("_ss") / (F.col("n") - 1)))
    s = anova_from_moments(moments).select(
        "k", F.col("n").cast("bigint").alias("n"), F.col("f_statistic").alias("statistic"))
    s = s.withColumn("p_value", dist.f_p(F.col("statistic"), F.col("k") - 1, F.col("n") - F.col("k")))
    return s.withColumn("equal_variance", F.col("p_value") >= alpha).withColumn(
        "evidence", dist.evidence(F.col("p_value"), alpha))


def ks_one_sample(df: DataFrame, column: str, reference: str = "norm") -> DataFrame:
    """Distance between the data and a fitted norm, expon or uniform distribution."""
    counts = value_counts(df.select(F.col(column).cast("double").alias("x")), "x")
    ranked = running_totals(counts, "x", ["n"])
    w, x = F.col("n"), F.col("x")
    mean = F.sum(w * x) / F.sum(w)
    first = counts.agg(mean.alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    centred = counts.withColumn("_m", one_row(first))
    fit = centred.agg(
        F.sqrt(F.sum(w * (x - F.col("_m.mean")) * (x - F.col("_m.mean"))) / F.sum(w)).alias("sd"),
        F.first("_m.mean").alias("mean"), F.first("_m.lo").alias("lo"), F.first("_m.hi").alias("hi"))
    rows = ranked.withColumn("_p", one_row(fit))
    p = lambda f: F.col(f"_p.{f}")
    if reference == "norm":
        cdf = normal_cdf_expr((x - p("mean")) / p("sd"))
    elif reference == "expon":
        cdf = 1 - F.exp(-(x - p("lo")) / (p("mean") - p("lo")))
    elif reference == "uniform":
        cdf = (x - p("lo")) / (p("hi") - p("lo"))
    else:
        raise ValueError(f"unknown reference distribution: {reference}")
    total = F.col("n_total")
    gap = F.greatest((F.col("n_before") + w) / total - cdf, cdf - F.col("n_before") / total)
    s = rows.agg(F.max(gap).alias("ks_statistic"), F.max(total).alias("n"))
    return s.withColumn("p_value", dist.kolmogorov_p(F.col("ks_statistic"), F.col("n"))).withColumn(
        "reference", F.lit(reference))


# Royston (1995) polynomials for the Shapiro-Wilk weights and p-value.
_SW_C1 = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157)
_SW_C2 = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
_SW_SMALL_MU = (-0.0006714, 0.025054, -0.39978, 0.5440)
_SW_SMALL_SD = (-0.0020322, 0.062767, -0.77857, 1.3822)
_SW_LARGE_MU = (0.0038915, -0.083751, -0.31082, -1.5861)
_SW_LARGE_SD = (0.0030302, -0.082676, -0.4803)

SHAPIRO_ROWS = 5000


def shapiro_values(values: np.ndarray) -> tuple[float, float]:
    """W and p of at most a few thousand values."""
    x = np.sort(np.asarray(values, dtype="float64"))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return (float("nan"), float("nan")) if n < 3 else (1.0, 1.0)
    m = np.array([dist.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        ssq, u = float(m @ m), 1.0 / math.sqrt(n)
        last = np.polyval((*_SW_C1, m[-1] / math.sqrt(ssq)), u)
        if n > 5:
            prev = np.polyval((*_SW_C2, m[-2] / math.sqrt(ssq)), u)
            phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prev**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = prev, -prev
        else:
            phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
        a[-1], a[0] = last, -last
    w = float(min(1.0, (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, float(min(1.0, max(0.0, p)))
    y = math.log(max(1.0 - w, 1e-300))
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if y >= gamma:
            return w, 0.0
        y = -math.log(gamma - y)
        mu, sd = np.polyval(_SW_SMALL_MU, n), math.exp(np.polyval(_SW_SMALL_SD, n))
    else:
        ln = math.log(n)
        mu, sd = np.polyval(_SW_LARGE_MU, ln), math.exp(np.polyval(_SW_LARGE_SD, ln))
    return w, 1.0 - dist.norm_cdf((y - mu) / sd)


def _francia(counts: DataFrame) -> DataFrame:
    """Shapiro-Francia W' and p per column, from distinct values and their counts: the squared correlation with normal scores."""
    ranked = running_totals(counts, "value", ["n"], ["column"])
    score = dist.normal_quantile((F.col("n_before") + (F.col("n") + 1) / 2 - 0.375) / (F.col("n_total") + 0.25))
    rows = ranked.select("column", "n", F.col("value").alias("x"), score.alias("m"))
    total = lambda e: F.sum(F.col("n") * e)
    s = rows.groupBy("column").agg(
        F.sum("n").alias("n"), total(F.col("x")).alias("sx"), total(F.col("m")).alias("sm"), total(F.col("x") * F.col("x")).alias("sxx"),
        total(F.col("m") * F.col("m")).alias("smm"), total(F.col("x") * F.col("m")).alias("sxm"))
    vx, vm = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("smm") - F.col("sm") * F.col("sm") / F.col("n")
    w = F.when(vx * vm > 0, F.least(F.lit(1.0), F.pow(F.col("sxm") - F.col("sx") * F.col("sm") / F.col("n"), F.lit(2.0)) / (vx * vm))).otherwise(1.0)
    u = F.log(F.col("n"))
    mu, sd = 1.0521 * (F.log(u) - u) - 1.2725, 1.0308 - 0.26758 * (F.log(u) + 2 / u)
    p = 1 - normal_cdf_expr((F.log(F.greatest(F.lit(1e-300), 1 - F.col("statistic"))) - mu) / sd)
    return s.withColumn("statistic", w).select("column", "n", "statistic", p.alias("p_value"), F.lit("shapiro_francia").alias("method"))


def shapiro_wilk(df: DataFrame, columns: Sequence[str], key: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Normality per column over all its values.

    Shapiro-Wilk is defined up to 5000 values; larger columns get the Shapiro-Francia form of it, and ``method`` says which.
    """
    counts = value_counts(melt(df, columns), "value", ["column"])
    sizes = counts.groupBy("column").agg(F.sum("n").alias("_n"))
    counts = counts.join(sizes, "column")

    def test(part: pd.DataFrame) -> pd.DataFrame:
        stat, p = shapiro_values(np.repeat(part["value"].to_numpy(), part["n"].to_numpy()))
        return pd.DataFrame({"column": [part["column"].iloc[0]], "n": [int(part["n"].sum())],
                             "statistic": [stat], "p_value": [p], "method": ["shapiro_wilk"]})

    small = counts.where(F.col("_n") <= SHAPIRO_ROWS).select("column", "value", "n").groupBy("column").applyInPandas(
        test, "column string, n bigint, statistic double, p_value double, method string")
    large = _francia(counts.where(F.col("_n") > SHAPIRO_ROWS).select("column", "value", "n"))
    return small.unionByName(large).withColumn("is_normal", F.col("p_value") >= alpha)


def binary_rate_z(rate1: Column, n1: Column, rate0: Column, n0: Column) -> Column:
    """Pooled two-proportion z (0 where the pooled rate is 0 or 1)."""
    pooled = (rate1 * n1 + rate0 * n0) / (n1 + n0)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    return F.when(se > 0, (rate1 - rate0) / se).otherwise(0.0)
