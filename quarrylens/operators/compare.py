"""Statistical comparison of models from long tables (experiment, model, fold, score)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions import dist
from quarrylens.operators.stats_tests import t_test_paired

# Studentised range divided by sqrt(2), Demsar (2006), for 3..10 models.
NEMENYI_Q = {
    0.05: {3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164},
    0.10: {3: 2.052, 4: 2.291, 5: 2.459, 6: 2.589, 7: 2.693, 8: 2.780, 9: 2.855, 10: 2.920},
}


def paired_scores(scores: DataFrame, model_a: str, model_b: str, by: Sequence[str] = ()) -> DataFrame:
    """Fold scores of two models side by side (``a``, ``b``)."""
    at = lambda m: F.max(F.when(F.col("model") == m, F.col("score")))
    return scores.groupBy(*by, "fold").agg(at(model_a).alias("a"), at(model_b).alias("b")).dropna(subset=["a", "b"])


def paired_ttest(scores: DataFrame, model_a: str, model_b: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    return t_test_paired(paired_scores(scores, model_a, model_b, by), "a", "b", alpha, by)


def mcnemar(df: DataFrame, label: str, prediction_a: str, prediction_b: str, by: Sequence[str] = (),
            alpha: float = 0.05) -> DataFrame:
    """Exact binomial below 25 discordant rows, else corrected chi-square."""
    a, b = F.col(prediction_a) == F.col(label), F.col(prediction_b) == F.col(label)
    cell = lambda x, y: F.sum((x & y).cast("bigint"))
    t = df.groupBy(*by).agg(cell(a, b).alias("n11"), cell(a, ~b).alias("n10"), cell(~a, b).alias("n01"),
                            cell(~a, ~b).alias("n00"))
    n10, n01 = F.col("n10"), F.col("n01")
    disc = n10 + n01
    chi = F.when(disc > 0, F.pow(F.abs(n10 - n01) - 1, F.lit(2)) / F.nullif(disc, F.lit(0)))
    t = t.withColumn("statistic", F.when(disc == 0, 0.0).when(disc < 25, n10.cast("double")).otherwise(chi))
    exact = dist.binomial_p(F.when((disc > 0) & (disc < 25), n10), F.when((disc > 0) & (disc < 25), disc))
    large = dist.chi2_p(F.when(disc >= 25, F.col("statistic")), F.lit(1.0))
    t = t.withColumn("p_value", F.when(disc == 0, 1.0).otherwise(F.coalesce(exact, large)))
    return t.withColumn("significant", F.col("p_value") < alpha)


def _mid_rank(value: Column, by: Sequence[str]) -> Column:
    """Average rank within a small group (folds of one experiment, models of one fold)."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    same = (W.partitionBy(*by, value) if by else W.partitionBy(F.lit(0), value))
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(same) - 1) / 2


def wilcoxon_signed_rank(scores: DataFrame, model_a: str, model_b: str, by: Sequence[str] = (),
                         alpha: float = 0.05) -> DataFrame:
    """Signed ranks of non-zero differences: exact p up to 50 untied folds, else normal."""
    d = paired_scores(scores, model_a, model_b, by).withColumn("d", F.round(F.col("a") - F.col("b"), 12))
    nz = d.where(F.col("d") != 0).withColumn("_abs", F.abs("d"))
    ranked = nz.withColumn("_rank", _mid_rank(F.col("_abs"), by))
    same = W.partitionBy(*by, "_abs") if by else W.partitionBy("_abs")
    ranked = ranked.withColumn("_t", F.count(F.lit(1)).over(same))
    t = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("_rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("_rank")).otherwise(0.0)).alias("w_minus"),
        F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"))
    n = F.col("n").cast("double")
    w = F.least("w_plus", "w_minus")
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_ties") / 2) / 24)
    exact_ok = (n <= 50) & (F.col("_ties") == 0)
    exact = dist.signed_rank_exact_p(F.when(exact_ok, w), F.when(exact_ok, n))
    normal = dist.normal_p((w - n * (n + 1) / 4) / se)
    return t.withColumn("statistic", w).withColumn("p_value", F.coalesce(exact, normal, F.lit(1.0))).withColumn(
        "significant", F.col("p_value") < alpha).drop("_ties")


def fold_ranks(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average rank of every model within its fold, rank 1 for the highest score."""
    return scores.withColumn("_neg", -F.col("score")).withColumn(
        "rank", _mid_rank(F.col("_neg"), [*by, "fold"])).drop("_neg")


def mean_ranks(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return fold_ranks(scores, by).groupBy(*by, "model").agg(F.avg("rank").alias("mean_rank"),
                                                            F.count(F.lit(1)).alias("folds"))


def friedman(scores: DataFrame, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Tie-corrected Friedman statistic over folds and the best-ranked model."""
    by = list(by)
    ranks = fold_ranks(scores, by)
    ties = ranks.groupBy(*by, "fold", "rank").agg(F.count(F.lit(1)).cast("double").alias("t"))
    ties = ties.groupBy(*by).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("_ties"))
    m = mean_ranks(scores, by).groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.max("folds").cast("double").alias("n"),
        F.sum(F.pow(F.col("mean_rank") * F.col("folds"), F.lit(2))).alias("_ss"), F.min_by("model", F.struct("mean_rank", "model")).alias("best_model"))
    t = m.join(ties, by) if by else m.withColumn("_ties", ties.scalar())
    k, n = F.col("k"), F.col("n")
    raw = 12 / (n * k * (k + 1)) * F.col("_ss") - 3 * n * (k + 1)
    fix = 1 - F.col("_ties") / (n * k * (k * k - 1))
    t = t.withColumn("statistic", F.when(fix > 0, raw / fix).otherwise(0.0))
    t = t.withColumn("p_value", dist.chi2_p(F.col("statistic"), k - 1))
    return t.select(*by, F.col("k").cast("int").alias("models"), F.col("n").cast("int").alias("folds"),
                    "statistic", "p_value", (F.col("p_value") < alpha).alias("significant"), "best_model")


def nemenyi(scores: DataFrame, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Pairs of models with their rank difference against the critical difference.

    Critical values are tabulated up to 10 models and integrated from the studentised range for more.
    """
    by = list(by)
    m = mean_ranks(scores, by)
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    m = m.withColumn("k", F.count(F.lit(1)).over(w))
    table = NEMENYI_Q.get(round(alpha, 2), {})
    known = None
    for k, q in table.items():
        known = F.when(F.col("k") == k, q) if known is None else known.when(F.col("k") == k, q)
    wide = dist.studentized_range_q(F.col("k").cast("double"), F.lit(alpha)) / math.sqrt(2)
    q = F.coalesce(known, wide) if known is not None else wide
    m = m.withColumn("critical_difference", q * F.sqrt(F.col("k") * (F.col("k") + 1) / (6 * F.col("folds"))))
    listed = m.groupBy(*by, "critical_difference").agg(
        F.array_sort(F.collect_list(F.struct("model", "mean_rank"))).alias("_m"))
    pairs = listed.select(*by, "critical_difference", F.explode(F.flatten(F.transform(
        F.col("_m"),
        lambda x, i: F.transform(
            F.slice(F.col("_m"), i + 2, F.size("_m")),
            lambda y: F.struct(x["model"].alias("model_a"), x["mean_rank"].alias("mean_rank_a"),
                               y["model"].alias("model_b"), y["mean_rank"].alias("mean_rank_b")))))).alias("p"))
    pairs = pairs.select(*by, "p.*", "critical_difference")
    diff = F.abs(F.col("mean_rank_a") - F.col("mean_rank_b"))
    return pairs.withColumn("rank_diff", diff).withColumn("significant", F.col("rank_diff") > F.col("critical_difference"))


def compare_models(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Paired t-test for two models, Friedman for more: one row with the test chosen."""
    found = scores.agg(F.count_distinct("model").alias("k"), F.min("model").alias("first"), F.max("model").alias("last")).first()
    if found["k"] < 2:
        raise ValueError("two or more models are needed")
    if found["k"] == 2:
        t = paired_ttest(scores, found["first"], found["last"], (), alpha)
        better = F.when(F.col("mean_diff") >= 0, found["first"]).otherwise(found["last"])
        return t.select(F.lit("paired_ttest").alias("test"), "statistic", "p_value", "significant",
                        better.alias("best_model"))
    return friedman(scores, (), alpha).select(F.lit("friedman").alias("test"), "statistic", "p_value",
                                              "significant", "best_model")
