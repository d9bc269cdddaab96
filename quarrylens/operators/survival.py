"""Survival analysis on tables of (duration, event, group...)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions import dist
from quarrylens.functions.quantiles import quantiles
from quarrylens.functions.ranks import running_totals
from quarrylens.functions.scalars import rnd, safe_div
from quarrylens.operators.correlation import dominance_counts
from quarrylens.session import cut_lineage

#: Cells (time x group) of a block of the log-rank test.
RISK_CELLS = 1 << 20


def _times(df: DataFrame, duration: str, event: str, group: str | None = None) -> DataFrame:
    keys = ["group"] if group else []
    rows = df.select(
        *([F.col(group).cast("string").alias("group")] if group else []),
        F.col(duration).cast("double").alias("time"), F.col(event).cast("int").alias("event")).dropna()
    return rows.groupBy(*keys, "time").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"))


def kaplan_meier(df: DataFrame, duration: str, event: str, group: str | None = None) -> DataFrame:
    """Survival probability after each distinct time (plus time 0), optionally per group."""
    by = ["group"] if group else []
    ranked = running_totals(_times(df, duration, event, group), "time", ["n"], by)
    steps = ranked.withColumn("at_risk", F.col("n_total") - F.col("n_before"))
    alive = F.col("events") < F.col("at_risk")
    steps = steps.select(
        *by, "time", "at_risk", "events", (F.col("n") - F.col("events")).alias("censored"),
        F.when(alive, F.log1p(-F.col("events") / F.col("at_risk"))).otherwise(0.0).alias("_log"),
        F.when(alive, 0).otherwise(1).alias("_dead"))
    steps = cut_lineage(steps)  # one row per distinct time; ranked a second time below
    cum = running_totals(steps, "time", ["_log", "_dead"], by)
    surv = F.when(F.col("_dead_before") + F.col("_dead") > 0, 0.0).otherwise(
        F.exp(F.col("_log_before") + F.col("_log")))
    curve = cum.select(*by, "time", "at_risk", "events", "censored", surv.alias("survival"))
    start = steps.groupBy(*by).agg(F.max("at_risk").alias("at_risk"), F.min("time").alias("_t0")).where(
        F.col("_t0") > 0).select(
        *by, F.lit(0.0).alias("time"), "at_risk", F.lit(0).cast("bigint").alias("events"),
        F.lit(0).cast("bigint").alias("censored"), F.lit(1.0).alias("survival"))
    return curve.unionByName(start)


def median_survival(curve: DataFrame) -> DataFrame:
    """First time at which survival is at most one half (NULL if never), per group."""
    by = ["group"] if "group" in curve.columns else []
    return curve.groupBy(*by).agg(
        F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median_survival"))


def log_rank(df: DataFrame, duration: str, event: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Log-rank test for two or more groups, however many.

    Deaths and departures are counted per (time, group); distinct times are cut into blocks.  A block starts with
    the members of each group still at risk (carried totals, one row per block and group) and adds up its part of the
    expected deaths and of the covariance.  One row per label and the k x k covariance reach the driver.
    """
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(duration).cast("double").alias("time"),
                     F.col(event).cast("int").alias("e")).dropna()
    cells = cut_lineage(rows.groupBy("time", "g").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("d")))
    observed = {r["g"]: r["d"] for r in cells.groupBy("g").agg(F.sum("d").alias("d")).collect()}
    labels = sorted(observed)
    k = len(labels)
    if k < 2:
        raise ValueError("log_rank needs at least 2 groups")
    size = max(64, RISK_CELLS // k)
    times = running_totals(cells.groupBy("time").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).withColumn(
        "_one", F.lit(1)), "time", ["n", "_one"]).select(
        F.col("time").alias("_time"), (F.col("n_total") - F.col("n_before")).alias("at_risk"), F.col("d").alias("deaths"),
        F.floor(F.col("_one_before") / size).alias("block"), F.pmod(F.col("_one_before"), F.lit(size)).cast("int").alias("at"))
    index = F.create_map(*[x for i, g in enumerate(labels) for x in (F.lit(g), F.lit(i))])
    placed = cut_lineage(cells.join(times, cells["time"] == times["_time"]).select(
        "block", "at", "at_risk", "deaths", "n", F.element_at(index, F.col("g")).alias("i")))
    later = W.partitionBy("i").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, 0)
    blocks = placed.select("block").distinct()
    grid = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    totals = placed.groupBy("block", "i").agg(F.sum("n").alias("n"))
    carried = grid.join(totals, ["block", "i"], "left").select(F.col("block").alias("_block"), "i", F.sum(F.coalesce("n", F.lit(0))).over(later).alias("start"))

    def parts(inside: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        at, i = inside["at"].to_numpy(), inside["i"].to_numpy()
        length = int(at.max()) + 1
        left, risk, deaths = np.zeros((length, k)), np.ones(length), np.zeros(length)
        left[at, i] = inside["n"]
        risk[at], deaths[at] = inside["at_risk"], inside["deaths"]
        start = np.zeros(k)
        start[starts["i"]] = starts["start"]
        share = (start - (np.cumsum(left, axis=0) - left)) / risk[:, None]
        spread = np.where(risk > 1, deaths * (risk - deaths) / np.maximum(risk - 1, 1), 0.0)
        weighted = share * spread[:, None]
        cov = np.diag(weighted.sum(0)) - weighted.T @ share
        return pd.DataFrame({"i": np.arange(k), "expected": deaths @ share, "cov": list(cov)})

    found = placed.groupBy("block").cogroup(carried.groupBy("_block")).applyInPandas(parts, "i int, expected double, cov array<double>")
    total = found.select("i", "expected", F.posexplode("cov").alias("j", "v")).groupBy("i", "j").agg(
        F.sum("expected").alias("expected"), F.sum("v").alias("v")).groupBy("i").agg(
        F.max("expected").alias("expected"), F.sort_array(F.collect_list(F.struct("j", "v"))).alias("cov")).collect()
    gap, cov = np.zeros(k), np.zeros((k, k))
    for row in total:
        gap[row["i"]] = observed[labels[row["i"]]] - row["expected"]
        cov[row["i"]] = [c["v"] for c in row["cov"]]
    gap, cov = gap[:-1], cov[:-1, :-1]
    stat = float(gap @ np.linalg.pinv(cov) @ gap)
    p = dist.chi2_sf(stat, k - 1)
    return df.sparkSession.createDataFrame(
        [(stat, k - 1, p, p < alpha)], "statistic double, dof int, p_value double, significant boolean")


def concordance_index(df: DataFrame, time: str, risk: str, event: str) -> DataFrame:
    """Harrell's C over every comparable pair, with its approximate interval."""
    points = df.select(
        F.col(time).cast("double").alias("t"), F.col(risk).cast("double").alias("r"),
        F.col(event).cast("int").alias("e")).dropna().groupBy("t", "r").agg(
        F.sum((F.col("e") != 0).cast("bigint")).alias("first"), F.count(F.lit(1)).alias("second"))
    dom = dominance_counts(points, "t", "r", "first", "second")
    lower, higher, tied = (F.col(f"later_{c}").cast("double") for c in ("lower", "higher", "tied"))
    total = lower + higher + tied
    c = safe_div(lower + 0.5 * tied, total, 0.5)
    s = dom.select(
        c.alias("c_index"), total.alias("_total"), F.col("later_lower").cast("bigint").alias("n_concordant"),
        F.col("later_higher").cast("bigint").alias("n_discordant"),
        F.col("later_tied").cast("bigint").alias("n_tied"))
    c = F.col("c_index")
    se = F.sqrt(c * (1 - c) / F.greatest(F.col("_total"), F.lit(1.0)))
    return s.select(
        "c_index", se.alias("se"), F.greatest(F.lit(0.0), c - 1.96 * se).alias("ci_lower"),
        F.least(F.lit(1.0), c + 1.96 * se).alias("ci_upper"), "n_concordant", "n_discordant", "n_tied",
        F.when(c >= 0.75, "excellent").when(c >= 0.65, "good").when(c >= 0.55, "moderate")
        .otherwise("poor").alias("band"))


def cox_ph(df: DataFrame, duration: str, event: str, covariates: Sequence[str],
           max_iter: int = 30, tol: float = 1e-9) -> DataFrame:
    """Cox proportional hazards (Efron ties) by Newton steps; ``converged`` says whether ``max_iter`` of them were enough.

    Each step is one Spark job: risk-set sums per distinct time through running
    totals.  The driver sees only the gradient and the p x p Hessian.
    """
    p = len(covariates)
    rows = df.select(
        F.col(duration).cast("double").alias("t"), F.col(event).cast("int").alias("e"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)]).dropna()
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)],
                     *[F.stddev_samp(f"x{i}").alias(f"s{i}") for i in range(p)]).first()
    if stats["n"] <= p + 2:
        raise ValueError("too few rows for the number of covariates")
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(p)])
    rows = rows.select("t", "e", *[((F.col(f"x{i}") - stats[f"m{i}"]) / float(scale[i])).alias(f"x{i}")
                                   for i in range(p)]).persist()
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    xs = [F.col(f"x{i}") for i in range(p)]
    beta, converged = np.zeros(p), False
    try:
        for _ in range(max_iter):
            eta = sum((float(beta[i]) * xs[i] for i in range(1, p)), float(beta[0]) * xs[0])
            w = F.exp(eta)
            dead = F.col("e") == 1
            s_names = ["s", *[f"s{i}" for i in range(p)], *[f"s{i}_{j}" for i, j in pairs]]
            s_exprs = [w, *[w * xs[i] for i in range(p)], *[w * xs[i] * xs[j] for i, j in pairs]]
            per_time = rows.groupBy("t").agg(
                F.count(F.when(dead, 1)).alias("d"),
                *[F.sum(x).alias(a) for a, x in zip(s_names, s_exprs)],
                *[F.sum(F.when(dead, x).otherwise(0.0)).alias(f"d_{a}") for a, x in zip(s_names, s_exprs)],
                *[F.sum(F.when(dead, xs[i]).otherwise(0.0)).alias(f"g{i}") for i in range(p)])
            ranked = running_totals(per_time, "t", s_names).where(F.col("d") > 0)
            at = ranked.select(
                "d", *[f"g{i}" for i in range(p)],
                *[(F.col(f"{a}_total") - F.col(f"{a}_before")).alias(a) for a in s_names],
                *[f"d_{a}" for a in s_names])
            chunk = 4096
            parts = at.withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("d") - 1) / chunk))))
            # tied deaths of one time are spread over the tasks in blocks
            parts = parts.repartition(F.xxhash64("d", "_c", "s")).withColumn("_l", F.explode(F.sequence(
                F.col("_c") * chunk, F.least((F.col("_c") + 1) * chunk, F.col("d")) - 1)))
            share = F.col("_l") / F.col("d")
            z = parts.select(
                "_l", "d", *[f"g{i}" for i in range(p)],
                *[(F.col(a) - share * F.col(f"d_{a}")).alias(f"z_{a}") for a in s_names])
            once = F.col("_l") == 0
            mean = [F.col(f"z_s{i}") / F.col("z_s") for i in range(p)]
            row = z.agg(
                *[(F.sum(F.when(once, F.col(f"g{i}")).otherwise(0.0)) - F.sum(mean[i])).alias(f"g{i}")
                  for i in range(p)],
                *[F.sum(F.col(f"z_s{i}_{j}") / F.col("z_s") - mean[i] * mean[j]).alias(f"h{i}_{j}")
                  for i, j in pairs]).first()
            grad = np.array([row[f"g{i}"] for i in range(p)])
            hess = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
            step = np.linalg.solve(hess, grad)
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
            beta = beta + step
            if np.abs(step).max() < tol:
                converged = True
                break
        cov = np.linalg.inv(hess)
        risk = sum((float(beta[i]) * xs[i] for i in range(1, p)), float(beta[0]) * xs[0])
        c_index = concordance_index(rows.withColumn("risk", risk), "t", "risk", "e").first()["c_index"]
    finally:
        rows.unpersist()
    out = []
    for i, c in enumerate(covariates):
        b, se = float(beta[i] / scale[i]), float(np.sqrt(cov[i, i]) / scale[i])
        out.append((c, b, se, float(np.exp(b)), float(np.exp(b - 1.959963984540054 * se)),
                    float(np.exp(b + 1.959963984540054 * se)), dist.norm_two_sided(b / se), float(c_index), converged))
    return df.sparkSession.createDataFrame(
        out, "covariate string, coef double, se double, hazard_ratio double, ci_lower double, "
             "ci_upper double, p_value double, concordance_index double, converged boolean")


def survival_summary(df: DataFrame, duration: str, event: str) -> DataFrame:
    """Totals, median event time, share lasting 30/60/90/365 and duration statistics."""
    d = F.col(duration).try_cast("double")
    rows = df.select(d.alias("d"), F.coalesce(F.col(event).try_cast("double"), F.lit(0.0)).alias("e")).where(
        F.col("d").isNotNull())
    med_event = quantiles(rows.where(F.col("e") == 1), "d", [0.5]).select("quantile")
    med_all = quantiles(rows, "d", [0.5]).select("quantile")
    share = lambda t: rnd(F.avg((F.col("d") >= t).cast("double")), 4).alias(f"survival_rate_{t}d")
    s = rows.agg(
        F.count(F.lit(1)).alias("total_subjects"), F.sum("e").cast("bigint").alias("total_events"),
        *[share(t) for t in (30, 60, 90, 365)],
        F.avg("d").alias("duration_mean"), F.stddev_samp("d").alias("duration_std"),
        F.min("d").alias("duration_min"), F.max("d").alias("duration_max"))
    return s.withColumns({
        "total_censored": F.col("total_subjects") - F.col("total_events"),
        "median_survival_time": med_event.scalar(), "duration_median": med_all.scalar()})
