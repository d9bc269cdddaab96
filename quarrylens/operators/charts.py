"""The numbers behind the usual charts (drawing is left to the caller)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions import dist
from quarrylens.functions.quantiles import quantiles, quantiles_of_counts, widen
from quarrylens.functions.ranks import same_keys, sequence_index, value_counts
from quarrylens.functions.scalars import one_row, safe_div, sample_skew
from quarrylens.operators.correlation import correlation_matrix, pearson_pairs
from quarrylens.operators.sampling import sample_random
from quarrylens.operators.sequence import running


def histogram(df: DataFrame, column: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins over the whole range, optionally per group."""
    x = F.col(column).cast("double")
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    rows = df.where(x.isNotNull()).select(*by, x.alias("_x")).withColumn("_s", one_row(span))
    lo, hi = F.col("_s.lo"), F.col("_s.hi")
    at = F.when(hi > lo, F.least(F.floor((F.col("_x") - lo) / F.nullif((hi - lo) / bins, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    t = rows.groupBy(*by, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.first("_s").alias("_s"))
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    return t.select(*by, "bin", (F.col("_s.lo") + F.col("bin") * width).alias("lower"),
                    (F.col("_s.lo") + (F.col("bin") + 1) * width).alias("upper"), "count")


def histogram_summary(df: DataFrame, column: str) -> DataFrame:
    """Skewness, range and median shown beside a histogram."""
    x = F.col(column).cast("double")
    med = quantiles(df.select(x.alias("v")), "v", [0.5]).select("quantile")
    t = df.agg(sample_skew(x).alias("skewness"), F.min(x).alias("min"), F.max(x).alias("max"))
    return t.withColumn("median", med.scalar()).withColumn(
        "shape", F.when(F.col("skewness") > 1, "right").when(F.col("skewness") < -1, "left").otherwise("symmetric"))


def box(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """Quartiles, fences, whisker ends and outlier count per group."""
    by = ["group"] if group else []
    rows = df.select(*([F.col(group).cast("string").alias("group")] if group else []), F.col(column).cast("double").alias("v"))
    counts = value_counts(rows, "v", by)
    named = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    q = widen(quantiles_of_counts(counts, "v", [0.25, 0.5, 0.75], by), named, by)
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumns({"lower_fence": F.col("q1") - 1.5 * iqr, "upper_fence": F.col("q3") + 1.5 * iqr})
    lim = ["q1", "median", "q3", "lower_fence", "upper_fence"]
    both = same_keys(counts, q, by) if by else counts.withColumn("_q", one_row(q)).select("v", "n", "_q.*")
    inside = F.col("v").between(F.col("lower_fence"), F.col("upper_fence"))
    return both.groupBy(*by).agg(
        *[F.first(c).alias(c) for c in lim], F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outliers"), F.sum("n").alias("n"))


def violin(df: DataFrame, column: str, group: str, bins: int = 50) -> DataFrame:
    """Density per group on a fine common grid."""
    t = histogram(df.where(F.col(group).isNotNull()), column, bins, [group])
    total = F.sum("count").over(W.partitionBy(group))
    return t.withColumn("density", safe_div(F.col("count") / total, F.col("upper") - F.col("lower")))


def violin_summary(df: DataFrame, column: str, group: str) -> DataFrame:
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.count(column).alias("n"))


def qq(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """Sample quantiles against normal quantiles at fixed places, with the fitted line."""
    probs = [(i - 0.3175) / (points + 0.365) for i in range(1, points + 1)]
    q = quantiles(df.select(F.col(column).cast("double").alias("v")), "v", probs)
    t = q.select("prob", F.col("quantile").alias("sample"), dist.normal_quantile(F.col("prob")).alias("theoretical"))
    line = t.agg(F.regr_slope("sample", "theoretical").alias("slope"), F.regr_intercept("sample", "theoretical").alias("intercept"))
    return t.withColumn("_l", one_row(line)).select("prob", "theoretical", "sample", "_l.slope", "_l.intercept")


def scatter_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line and correlation of a scatter plot."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    t = df.where(ok).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"),
        F.count(F.lit(1)).alias("n"))
    return t.withColumn("relation", F.when(F.abs("r") > 0.7, "strong").when(F.abs("r") > 0.4, "moderate").otherwise("weak"))


def scatter_points(df: DataFrame, x: str, y: str, key: str, n: int = 1000, color: str | None = None) -> DataFrame:
    return sample_random(df.select(key, x, y, *([color] if color else [])).dropna(subset=[x, y]), n, key)


def pair_plot(df: DataFrame, columns: Sequence[str], key: str, n: int = 1000) -> DataFrame:
    """Sampled rows of all columns given."""
    return sample_random(df.select(key, *columns), n, key)


def corr_heatmap(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    return correlation_matrix(df, columns, method)


def top_correlations(df: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """The ``k`` pairs with the largest absolute correlation."""
    from quarrylens.operators.correlation import pair_columns

    r = pearson_pairs(df, pair_columns(columns))
    return r.where(F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "col1", "col2").limit(k)


def bar(df: DataFrame, column: str, value: str | None = None) -> DataFrame:
    """Counts (or sums of ``value``) and shares per category."""
    size = F.sum(value) if value else F.count(F.lit(1))
    t = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(size.alias("total"))
    return t.withColumn("share", F.col("total") / t.agg(F.sum("total")).scalar() * 100)


def pie(df: DataFrame, column: str, value: str | None = None) -> DataFrame:
    """As :func:`bar`, with the rank of the slice and the share covered so far."""
    t = sequence_index(bar(df, column, value), ["total", "category"], descending=["total"])
    t = running(t, {"cumulative_share": F.col("share")}, ["_index"])
    return t.withColumn("rank", (F.col("_index") + 1).cast("int")).drop("_index")


def heatmap(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Mean of ``value`` per cell, in long form."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull()).groupBy(
        F.col(x).alias("x"), F.col(y).alias("y")).agg(F.avg(value).alias("value"))


def line(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """Points of a line chart in x order."""
    cols = [F.col(group).alias("group")] if group else []
    return df.select(*cols, F.col(x).alias("x"), F.col(y).alias("y")).orderBy(*(["group"] if group else []), "x")


def time_series(df: DataFrame, date: str, value: str, grain: str = "day") -> DataFrame:
    """Mean per period; periods without rows appear with NULL."""
    t = df.where(F.col(date).isNotNull() & F.col(value).isNotNull()).groupBy(
        F.date_trunc(grain, F.col(date)).alias("period")).agg(F.avg(value).alias("value"))
    step = F.expr(f"make_interval({ {'year': '1', 'month': '0,1', 'week': '0,0,1', 'day': '0,0,0,1', 'hour': '0,0,0,0,1'}[grain] })")
    calendar = t.agg(F.min("period").alias("a"), F.max("period").alias("b")).select(
        F.explode(F.sequence("a", "b", step)).alias("period"))
    return calendar.join(t, "period", "left")


def time_series_change(series: DataFrame) -> DataFrame:
    """Change from the first to the last known value, mean and spread."""
    known = series.where(F.col("value").isNotNull())
    t = known.agg(F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last"),
                  F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n"))
    change = (F.col("last") - F.col("first")) / F.nullif(F.abs(F.col("first")), F.lit(0.0)) * 100
    return t.withColumn("overall_change_pct", F.when(F.col("n") > 1, F.coalesce(change, F.lit(0.0))).otherwise(0.0))


def residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean and population deviation of label - prediction, and its range."""
    e = F.col(label).cast("double") - F.col(prediction)
    return df.agg(F.avg(e).alias("mean_residual"), F.stddev_pop(e).alias("std_residual"),
                  F.min(e).alias("min_residual"), F.max(e).alias("max_residual"), F.count(e).alias("n"))


def residual_points(df: DataFrame, label: str, prediction: str, key: str) -> DataFrame:
    return df.select(key, F.col(prediction).alias("predicted"),
                     (F.col(label).cast("double") - F.col(prediction)).alias("residual"))


def waterfall(contributions: DataFrame, key: str, top: int = 15) -> DataFrame:
    """Largest contributions of every row, with the sum of all its contributions."""
    w = W.partitionBy(key).orderBy(F.desc(F.abs(F.col("impact"))), "feature")
    ranked = contributions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    whole = contributions.groupBy(key).agg(F.sum("impact").alias("total_impact"))
    return ranked.select(key, "feature", "impact", "rank").join(whole, key)


def importance(table: DataFrame, top: int = 20) -> DataFrame:
    """Top features with the share covered by the first three."""
    best = table.orderBy(F.desc("importance"), "feature").limit(top)
    w = W.partitionBy(F.lit(0))
    ranked = best.withColumn("rank", F.row_number().over(w.orderBy(F.desc("importance"), "feature")))
    lead = F.sum(F.when(F.col("rank") <= 3, F.col("importance")).otherwise(0.0)).over(w)
    return ranked.withColumn("top3_share", safe_div(lead * 100, F.sum("importance").over(w), 0.0))


def funnel_summary(stages: DataFrame) -> DataFrame:
    """Overall conversion and the step with the biggest loss, in the given stage order."""
    w = W.partitionBy(F.lit(0)).orderBy("position")
    prev = F.lag("count").over(w)
    rows = stages.select("position", "stage", "count", F.lag("stage").over(w).alias("_from"),
                         F.when(prev > 0, (prev - F.col("count")) / prev * 100).alias("_drop"))
    worst = F.max_by(F.concat_ws(" -> ", "_from", "stage"), F.struct("_drop", -F.col("position")))
    return rows.agg(
        (F.max_by("count", "position") / F.min_by("count", "position") * 100).alias("overall_conversion_pct"),
        worst.alias("biggest_drop"), F.max("_drop").alias("biggest_drop_pct"))


def cohort_heatmap(df: DataFrame, cohort: str, period: str, value: str) -> DataFrame:
    """Mean per cohort and period relative to the earliest period of the table (in percent)."""
    t = df.groupBy(F.col(cohort).alias("cohort"), F.col(period).alias("period")).agg(F.avg(value).alias("value"))
    start = t.agg(F.min("period")).scalar()
    base = F.max(F.when(F.col("period") == start, F.col("value"))).over(W.partitionBy("cohort"))
    return t.withColumn("retention_pct", safe_div(F.col("value"), base) * 100)


def survival_curve(curve: DataFrame) -> DataFrame:
    """Median time (first with survival at most one half) and final survival per curve."""
    by = ["group"] if "group" in curve.columns else []
    return curve.groupBy(*by).agg(
        F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"),
        F.max_by("survival", "time").alias("final_survival"), F.count(F.lit(1)).alias("steps"))

