"""Manufacturing, people and marketing metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import dist
from quarrylens.functions.ranks import same_keys
from quarrylens.functions.quantiles import melt, quantiles, quantiles_wide
from quarrylens.functions.scalars import one_row, safe_div
from quarrylens.operators.create import days_between
from quarrylens.operators.profile import text_melt
from quarrylens.operators.sequence import with_frames
from quarrylens.operators.stats_tests import binary_rate_z

# ---- manufacturing ---------------------------------------------------------------------


def _as_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns whose median exceeds 1 are percentages and are divided by 100."""
    med = quantiles(melt(df, columns), "value", [0.5], ["column"])
    stats = med.agg(*[F.max(F.when(F.col("column") == c, F.col("quantile"))).alias(c) for c in columns])
    rows = df.withColumn("_m", one_row(stats))
    return rows.withColumns({
        c: F.when(F.col(f"_m.`{c}`") > 1, F.col(c) / 100.0).otherwise(F.col(c).cast("double"))
        for c in columns}).drop("_m")


def oee_records(df: DataFrame, availability: str, performance: str, quality: str) -> DataFrame:
    """Effectiveness per record after bringing the components to shares."""
    rows = _as_share(df, [availability, performance, quality])
    return rows.withColumn("oee", F.col(availability) * F.col(performance) * F.col(quality))


def oee(df: DataFrame, availability: str, performance: str, quality: str) -> DataFrame:
    """Mean effectiveness, component means and the three losses."""
    s = oee_records(df, availability, performance, quality).agg(
        F.avg("oee").alias("oee"), F.avg(availability).alias("availability"),
        F.avg(performance).alias("performance"), F.avg(quality).alias("quality"))
    a, p, q = F.col("availability"), F.col("performance"), F.col("quality")
    return s.withColumns({
        "availability_loss": 1 - a, "performance_loss": a * (1 - p), "quality_loss": a * p * (1 - q),
        "is_world_class": F.col("oee") >= 0.85})


def oee_score(df: DataFrame, availability: str, performance: str, quality: str) -> DataFrame:
    """Effectiveness and band per row of shares; NULL where a component is outside 0..1."""
    a, p, q = F.col(availability), F.col(performance), F.col(quality)
    valid = a.between(0, 1) & p.between(0, 1) & q.between(0, 1)
    rows = df.withColumn("oee", F.when(valid, a * p * q))
    o = F.col("oee")
    return rows.withColumns({
        "world_class": o >= 0.85,
        "band": F.when(o >= 0.85, "world_class").when(o >= 0.65, "typical").when(o.isNotNull(), "below_average")})


def mtbf_mttr(df: DataFrame, failure: str, repair: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean time between failures / to repair, availability, failure rate and both spreads."""
    by = list(by)
    long = melt(df, [failure, repair], by).where(F.col("value").isNotNull())
    med = quantiles(long, "value", [0.5], [*by, "column"])
    stats = long.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    stats = same_keys(stats, med.select(*by, "column", F.col("quantile").alias("median")), [*by, "column"])
    at = lambda c, f: F.max(F.when(F.col("column") == c, F.col(f)))
    out = stats.groupBy(*by).agg(
        at(failure, "mean").alias("mtbf"), at(repair, "mean").alias("mttr"), at(failure, "n").alias("total_failures"),
        *[at(c, f).alias(f"{n}_{f}") for n, c in (("mtbf", failure), ("mttr", repair))
          for f in ("median", "std", "min", "max")])
    up, down = F.col("mtbf"), F.col("mttr")
    return out.withColumns({
        "availability": F.when(up + down > 0, up / (up + down)).otherwise(0.0),
        "failure_rate": F.when(up > 0, 1 / up)})


def spc_individuals(df: DataFrame, value: str, order_by: Sequence[str], flag_rows: bool = False) -> DataFrame:
    """Individuals chart: mean +/- 3 x mean moving range / 1.128.

    With ``flag_rows`` the out-of-control rows themselves, else one summary row.
    """
    rows = df.where(F.col(value).isNotNull())
    moved = with_frames(rows, {"_prev": lambda w: F.lag(value).over(w)}, order_by, 1)
    limits = moved.agg(
        F.avg(value).alias("center_line"), (F.avg(F.abs(F.col(value) - F.col("_prev"))) / 1.128).alias("sigma"))
    limits = limits.select("center_line", "sigma", (F.col("center_line") + 3 * F.col("sigma")).alias("ucl"),
                           (F.col("center_line") - 3 * F.col("sigma")).alias("lcl"))
    marked = rows.withColumn("_l", one_row(limits))
    out = (F.col(value) > F.col("_l.ucl")) | (F.col(value) < F.col("_l.lcl"))
    if flag_rows:
        return marked.where(out).drop("_l")
    s = marked.agg(
        F.first("_l").alias("_l"), F.sum(out.cast("bigint")).alias("out_of_control"),
        F.count(F.lit(1)).alias("total_points"), F.stddev_samp(value).alias("_sd"))
    return s.select("_l.center_line", "_l.ucl", "_l.lcl", "_l.sigma", "out_of_control", "total_points",
                    safe_div(F.col("_l.ucl") - F.col("_l.lcl"), 6 * F.col("_sd")).alias("cp_proxy"))


def spc_xbar(df: DataFrame, value: str, subgroup: str) -> DataFrame:
    """Subgroup chart: mean of means +/- 3 / sqrt(mean size) x mean subgroup deviation."""
    g = df.groupBy(subgroup).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    g = g.where(F.col("s").isNotNull())
    lim = g.agg(F.avg("m").alias("c"), F.avg("s").alias("s"), F.avg("n").alias("n"))
    lim = lim.select("c", (3 / F.sqrt("n") * F.col("s")).alias("w"))
    rows = g.withColumn("_l", one_row(lim))
    far = F.abs(F.col("m") - F.col("_l.c")) > F.col("_l.w")
    s = rows.agg(F.first("_l").alias("_l"), F.sum(far.cast("bigint")).alias("out_of_control"),
                 F.count(F.lit(1)).alias("subgroups"))
    sd = df.agg(F.stddev_samp(value), ).scalar()
    c, w = F.col("_l.c"), F.col("_l.w")
    return s.select(c.alias("center_line"), (c + w).alias("ucl"), (c - w).alias("lcl"), (w / 3).alias("sigma"),
                    "out_of_control", "subgroups", safe_div(2 * w, 6 * sd).alias("cp_proxy"))


def process_capability(df: DataFrame, value: str, lsl: float, usl: float, by: Sequence[str] = ()) -> DataFrame:
    """Cp, Cpk (= Pp, Ppk) and band; infinite without variation."""
    if usl <= lsl:
        raise ValueError("usl must exceed lsl")
    s = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    sd, mu, inf = F.col("std"), F.col("mean"), F.lit(float("inf"))
    flat = sd < 1e-9
    cpk = F.when(flat, inf).otherwise(F.least((usl - mu) / (3 * sd), (mu - lsl) / (3 * sd)))
    cp = F.when(flat, inf).otherwise((usl - lsl) / (6 * sd))
    s = s.withColumns({"cp": cp, "cpk": cpk, "pp": cp, "ppk": cpk})
    k = F.col("cpk")
    return s.withColumns({
        "is_capable": k >= 1.33,
        "band": F.when(k >= 1.67, "excellent").when(k >= 1.33, "capable").when(k >= 1.0, "marginal")
        .otherwise("incapable")})


# ---- people ----------------------------------------------------------------------------


def attrition_features(df: DataFrame, hired: str | None = None, department: str | None = None,
                       salary: str | None = None, as_of: str | None = None) -> DataFrame:
    """Tenure, long-tenure flag, salary relative to the department mean, department size."""
    out = df
    if hired:
        now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.localtimestamp()
        days = days_between(F.col(hired).cast("timestamp_ntz"), now)
        out = out.withColumn("tenure_days", days).withColumn(
            "tenure_years", F.round(F.col("tenure_days") / 365.25, 2)).withColumn(
            "is_long_tenure", F.coalesce(F.col("tenure_years") > 3, F.lit(False)))
    if department:
        aggs = [F.count(F.lit(1)).alias("department_size")]
        if salary:
            aggs.append(F.avg(F.col(salary).cast("double")).alias("_mean"))
        dept = df.where(F.col(department).isNotNull()).groupBy(department).agg(*aggs)
        out = out.join(dept, department, "left")
        if salary:
            out = out.withColumn("salary_ratio_to_dept_avg", F.round(safe_div(F.col(salary), F.col("_mean")), 3)).drop("_mean")
    return out


def diversity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of every value (NULL included) and Simpson's index per column."""
    counts = text_melt(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    c = F.col("count").cast("double")
    per_column = counts.groupBy("column").agg(
        F.sum(c).alias("_n"), F.sum(c * c).alias("_s"), F.count(F.lit(1)).alias("unique_groups"))
    return counts.join(per_column, "column").select(
        "column", "value", "count", (F.col("count") / F.col("_n") * 100).alias("percentage"),
        (1 - F.col("_s") / (F.col("_n") * F.col("_n"))).alias("simpson_index"), "unique_groups")


def pay_gap(df: DataFrame, salary: str, group: str) -> DataFrame:
    """Pay per group and its gap to the best-paid group (means rounded to cents)."""
    rows = df.select(F.col(group).alias("group"), F.col(salary).cast("double").alias("s")).where(
        F.col("group").isNotNull())
    med = quantiles_wide(rows, "s", {"median": 0.5}, ["group"])
    t = rows.groupBy("group").agg(
        F.round(F.avg("s"), 2).alias("mean"), F.count("s").alias("count"), F.stddev_samp("s").alias("std")).join(med, "group")
    top = t.agg(F.max("mean")).scalar()
    return t.select("group", "mean", "median", "count", F.coalesce("std", F.lit(0.0)).alias("std"),
                    (top - F.col("mean")).alias("absolute_gap"),
                    F.when(top > 0, (top - F.col("mean")) / top * 100).otherwise(0.0).alias("percentage_gap"),
                    (F.col("mean") == top).alias("is_reference"))


def pay_gap_by_role(df: DataFrame, salary: str, group: str, role: str) -> DataFrame:
    """Gap of every group to the best-paid group of the same role."""
    t = df.where(F.col(group).isNotNull() & F.col(role).isNotNull()).groupBy(
        F.col(role).alias("role"), F.col(group).alias("group")).agg(F.avg(F.col(salary).cast("double")).alias("mean"))
    rows = t.join(t.groupBy("role").agg(F.max("mean").alias("_top")), "role")
    return rows.where(F.col("mean") < F.col("_top")).select(
        "role", "group", ((F.col("_top") - F.col("mean")) / F.col("_top") * 100).alias("gap_pct"))


# ---- marketing -------------------------------------------------------------------------


def _lift(rates: DataFrame, by: Sequence[str], missing: float) -> DataFrame:
    t, c = F.col("treatment_rate"), F.col("control_rate")
    nt, nc = F.col("n_treatment"), F.col("n_control")
    lift = t - c
    half = 1.96 * F.sqrt(t * (1 - t) / nt + c * (1 - c) / nc)
    out = rates.withColumns({
        "absolute_lift": lift, "relative_lift": F.when(c > 0, lift / c).otherwise(F.lit(missing)),
        "z_statistic": binary_rate_z(t, nt, c, nc), "ci_lower": lift - half, "ci_upper": lift + half})
    out = out.withColumn("p_value", dist.normal_p(F.col("z_statistic")))
    return out.withColumn("is_significant", F.col("p_value") < 0.05)


def campaign_lift(df: DataFrame, treatment: str, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """Treatment against control from one row per subject: lifts, pooled z, p and interval."""
    t, y = F.col(treatment).try_cast("double"), F.col(outcome).try_cast("double")
    rows = df.where(t.isNotNull() & y.isNotNull())
    rates = rows.groupBy(*by).agg(
        F.avg(F.when(t == 1, y)).alias("treatment_rate"), F.avg(F.when(t == 0, y)).alias("control_rate"),
        F.count(F.when(t == 1, 1)).alias("n_treatment"), F.count(F.when(t == 0, 1)).alias("n_control"))
    return _lift(rates.where((F.col("n_treatment") > 0) & (F.col("n_control") > 0)), by, float("inf"))


def campaign_lift_rates(df: DataFrame, control_rate: str, treatment_rate: str, control_n: str,
                        treatment_n: str) -> DataFrame:
    """The same from one row per campaign with rates and group sizes."""
    names = {control_rate: "control_rate", treatment_rate: "treatment_rate", control_n: "n_control",
             treatment_n: "n_treatment"}
    return _lift(df.withColumnsRenamed(names), (), float("nan")).withColumn(
        "relative_lift", F.when(F.col("control_rate") > 0, F.col("relative_lift")))


def attribution(df: DataFrame, channel: str, conversion: str, revenue: str | None = None) -> DataFrame:
    """Touches, conversions, rate, share and revenue per channel of the converting row."""
    y = F.coalesce(F.col(conversion).try_cast("double"), F.lit(0.0))
    aggs = [F.count(F.lit(1)).alias("touches"), F.sum(y).alias("conversions")]
    if revenue:
        aggs.append(F.sum(F.coalesce(F.col(revenue).try_cast("double"), F.lit(0.0))).alias("revenue"))
    t = df.where(F.col(channel).isNotNull()).groupBy(F.col(channel).alias("channel")).agg(*aggs)
    total = t.agg(F.sum("conversions")).scalar()
    out = t.withColumns({
        "conversion_rate": F.col("conversions") / F.col("touches"),
        "attribution_share": F.when(total > 0, F.col("conversions") / total).otherwise(0.0)})
    if revenue:
        out = out.withColumn("revenue_per_conversion", safe_div(F.col("revenue"), F.col("conversions"), 0.0))
    return out


def cost_threshold(df: DataFrame, label: str, score: str, false_negative: float, false_positive: float) -> DataFrame:
    """Total misclassification cost at every score used as threshold, cheapest first row."""
    from quarrylens.operators.finance import ranked_scores

    r = ranked_scores(df, label, score)
    cost = float(false_negative) * (F.col("pos_total") - F.col("tp")) + float(false_positive) * F.col("fp")
    return r.select(F.col("score").alias("threshold"), cost.alias("cost")).orderBy("cost", F.desc("threshold")).limit(1)
