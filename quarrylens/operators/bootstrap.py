"""Bootstrap intervals by Poisson resampling of sufficient statistics.

Every (row, replicate) pair gets a Poisson(1) weight from a hash of the row key, so
the draw does not depend on partitioning.  A task keeps one running sum per
replicate; the result has as many rows as there are replicates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import dist
from quarrylens.functions.quantiles import quantiles_wide
from quarrylens.functions.scalars import one_row, safe_div

# Cumulative Poisson(1) probabilities.
_POISSON = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 20)])])


def _stats(metric: str, y: Column, p: Column) -> list[Column]:
    """Per-row terms whose sums determine the metric."""
    if metric == "accuracy":
        return [F.lit(1.0), (y == p).cast("double")]
    if metric in ("precision", "recall", "f1"):
        return [((p == 1) & (y == 1)).cast("double"), ((p == 1) & (y != 1)).cast("double"),
                ((p != 1) & (y == 1)).cast("double")]
    e = (y - p).cast("double")
    return {
        "mse": [F.lit(1.0), e * e], "rmse": [F.lit(1.0), e * e], "mae": [F.lit(1.0), F.abs(e)],
        "r2": [F.lit(1.0), e * e, y.cast("double"), (y * y).cast("double")],
        "mean": [F.lit(1.0), p.cast("double")],
    }[metric]


def _value(metric: str, s: Sequence[Column]) -> Column:
    """The metric as an expression of the summed terms."""
    if metric in ("accuracy", "mse", "mae", "mean"):
        return safe_div(s[1], s[0])
    if metric == "rmse":
        return F.sqrt(safe_div(s[1], s[0]))
    if metric == "precision":
        return safe_div(s[0], s[0] + s[1], 0.0)
    if metric == "recall":
        return safe_div(s[0], s[0] + s[2], 0.0)
    if metric == "f1":
        return safe_div(2 * s[0], 2 * s[0] + s[1] + s[2], 0.0)
    if metric == "r2":
        return 1 - safe_div(s[1], s[3] - safe_div(s[2] * s[2], s[0]))
    raise ValueError(f"unknown metric: {metric}")


def poisson_weights(row_hash: np.ndarray, replicates: int) -> np.ndarray:
    """rows x replicates Poisson(1) weights from mixed 64-bit hashes."""
    with np.errstate(over="ignore"):
        step = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = row_hash.astype(np.uint64)[:, None] + step[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)).astype("float64") / 2.0**53).astype("float64")


def _replicate_sums(rows: DataFrame, terms: Sequence[str], replicates: int) -> DataFrame:
    """Weighted sums of ``terms`` per replicate."""
    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((replicates, len(terms)))
        seen = False
        for batch in batches:
            values = batch[list(terms)].to_numpy(dtype="float64")
            hashes = batch["_h"].to_numpy(dtype="int64").view("uint64")
            for start in range(0, len(batch), 2048):
                part = slice(start, start + 2048)
                sums += poisson_weights(hashes[part], replicates).T @ values[part]
            seen = True
        if seen:
            out = pd.DataFrame(sums, columns=list(terms))
            out.insert(0, "replicate", np.arange(replicates, dtype="int32"))
            yield out

    schema = "replicate int, " + ", ".join(f"{t} double" for t in terms)
    return rows.select("_h", *terms).mapInPandas(resample, schema).groupBy("replicate").agg(
        *[F.sum(t).alias(t) for t in terms])


def _check(df: DataFrame, replicates: int) -> None:
    if replicates < 100:
        raise ValueError("at least 100 replicates are needed")
    if df.limit(20).count() < 20:
        raise ValueError("at least 20 rows are needed")


def bootstrap_multi_metric(df: DataFrame, label: str, prediction: str, metrics: Sequence[str], key: str,
                           replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of several metrics from one resampling."""
    _check(df, replicates)
    y, p = F.col(label), F.col(prediction)
    rows = df.where(y.isNotNull() & p.isNotNull()).withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    terms = []
    for i, m in enumerate(metrics):
        for j, t in enumerate(_stats(m, y, p)):
            rows = rows.withColumn(f"t{i}_{j}", t)
            terms.append(f"t{i}_{j}")
    mine = lambda i: [F.col(t) for t in terms if t.startswith(f"t{i}_")]
    packed = lambda: F.array(*[F.struct(F.lit(m).alias("metric"), _value(m, mine(i)).alias("value"))
                               for i, m in enumerate(metrics)])
    draws = _replicate_sums(rows, terms, replicates).select("replicate", F.inline(packed()))
    point = rows.agg(*[F.sum(t).alias(t) for t in terms]).select(F.inline(packed()))
    a = (1 - level) / 2
    ends = quantiles_wide(draws, "value", {"ci_lower": a, "ci_upper": 1 - a}, ["metric"])
    spread = draws.groupBy("metric").agg(F.stddev_samp("value").alias("std_error"))
    return point.withColumnRenamed("value", "point_estimate").join(ends, "metric").join(spread, "metric")


def bootstrap_ci(df: DataFrame, label: str, prediction: str, metric: str, key: str, replicates: int = 1000,
                 level: float = 0.95, method: str = "percentile", seed: int = 42) -> DataFrame:
    """Percentile or bias-corrected accelerated (bca) interval of one metric."""
    if method == "percentile":
        return bootstrap_multi_metric(df, label, prediction, [metric], key, replicates, level, seed).withColumn(
            "method", F.lit(method))
    if method != "bca":
        raise ValueError("method must be percentile or bca")
    _check(df, replicates)
    y, p = F.col(label), F.col(prediction)
    rows = df.where(y.isNotNull() & p.isNotNull()).withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    exprs = _stats(metric, y, p)
    terms = [f"t0_{j}" for j in range(len(exprs))]
    rows = rows.withColumns(dict(zip(terms, exprs)))
    whole = rows.agg(*[F.sum(t).alias(t) for t in terms])
    point = whole.select(_value(metric, [F.col(t) for t in terms]).alias("v"))
    # leaving one row out only subtracts its terms
    left_out = rows.withColumn("_w", one_row(whole)).select(
        _value(metric, [F.col(f"_w.{t}") - F.col(t) for t in terms]).alias("v"))
    centre = left_out.agg(F.avg("v")).scalar()
    gap = F.col("m") - F.col("v")
    jack = left_out.withColumn("m", centre).agg(
        F.sum(gap * gap * gap).alias("s3"), F.sum(gap * gap).alias("s2")).first()
    draws = _replicate_sums(rows, terms, replicates).select(_value(metric, [F.col(t) for t in terms]).alias("v"))
    est = point.first()["v"]
    d = np.sort(np.array([r["v"] for r in draws.where(F.col("v").isNotNull()).collect()]))
    z0 = dist.norm_ppf(float(np.clip((d < est).mean(), 1e-10, 1 - 1e-10)))
    bottom = 6.0 * (jack["s2"] or 0.0) ** 1.5
    accel = 0.0 if abs(bottom) < 1e-12 else jack["s3"] / bottom

    def bound(prob: float) -> float:
        z = z0 + dist.norm_ppf(prob)
        q = dist.norm_cdf(z0 + z / (1 - accel * z))
        return float(d[min(len(d) - 1, max(0, int(np.floor(q * len(d)))))])

    a = (1 - level) / 2
    return df.sparkSession.createDataFrame(
        [(metric, est, bound(a), bound(1 - a), float(d.std(ddof=1)), method)],
        "metric string, point_estimate double, ci_lower double, ci_upper double, std_error double, method string")


def bootstrap_compare(df: DataFrame, label: str, prediction_a: str, prediction_b: str, metric: str, key: str,
                      replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Paired difference of a metric between two models: interval, p-value, share A better."""
    _check(df, replicates)
    y = F.col(label)
    rows = df.where(y.isNotNull()).withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    a, b = _stats(metric, y, F.col(prediction_a)), _stats(metric, y, F.col(prediction_b))
    names_a, names_b = [f"a{i}" for i in range(len(a))], [f"b{i}" for i in range(len(b))]
    rows = rows.withColumns({**dict(zip(names_a, a)), **dict(zip(names_b, b))})
    diff = _value(metric, [F.col(n) for n in names_a]) - _value(metric, [F.col(n) for n in names_b])
    draws = _replicate_sums(rows, [*names_a, *names_b], replicates).select(diff.alias("d")).where(F.col("d").isNotNull())
    tail = (1 - level) / 2
    ends = quantiles_wide(draws, "d", {"ci_lower": tail, "ci_upper": 1 - tail})
    s = draws.agg(
        F.avg("d").alias("mean_diff"), F.avg((F.col("d") <= 0).cast("double")).alias("_le"),
        F.avg((F.col("d") >= 0).cast("double")).alias("_ge"), (F.avg((F.col("d") > 0).cast("double")) * 100).alias("a_better_pct"))
    s = s.withColumn("_q", one_row(ends)).withColumn(
        "p_value", F.least(F.lit(1.0), 2 * F.when(F.col("mean_diff") >= 0, F.col("_le")).otherwise(F.col("_ge"))))
    return s.select("mean_diff", "_q.ci_lower", "_q.ci_upper", "p_value",
                    (F.col("p_value") < 1 - level).alias("significant"), "a_better_pct")
