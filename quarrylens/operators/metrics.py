"""Model metrics from tables of (label, prediction, score), for any number of models at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions.scalars import safe_div
from quarrylens.operators.finance import auc


def confusion(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Cells of the confusion matrix with their share."""
    cells = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).groupBy(
        *by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(W.partitionBy(*by)) if by else cells.agg(F.sum("count")).scalar()
    return cells.withColumn("pct", F.col("count") / total * 100)


def class_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class (0 where undefined)."""
    cells = confusion(df, label, prediction, by)
    both = F.array(
        F.struct(F.col("label").alias("cls"), F.col("count").alias("actual"), F.lit(0).cast("bigint").alias("called"),
                 F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("actual"), F.col("count").alias("called"),
                 F.lit(0).cast("bigint").alias("hit")))
    t = cells.select(*by, F.explode(both).alias("c")).groupBy(*by, F.col("c.cls").alias("cls")).agg(
        F.sum("c.actual").alias("support"), F.sum("c.called").alias("called"), F.sum("c.hit").alias("hit"))
    p, r = safe_div(F.col("hit"), F.col("called"), 0.0), safe_div(F.col("hit"), F.col("support"), 0.0)
    t = t.withColumns({"precision": p, "recall": r})
    return t.withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def classification_metrics(df: DataFrame, label: str, prediction: str, score: str | None = None,
                           by: Sequence[str] = (), average: str = "auto", positive=1) -> DataFrame:
    """Accuracy, precision, recall, F1 (binary for two classes, else weighted) and AUC."""
    by = list(by)
    t = class_metrics(df, label, prediction, by)
    total = F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / total
    binary = lambda c: F.max(F.when(F.col("cls").cast("string") == str(positive), F.col(c)))
    classes = F.count(F.when(F.col("support") > 0, 1))
    use_binary = (classes == 2) if average == "auto" else F.lit(average == "binary")
    out = t.groupBy(*by).agg(
        classes.alias("classes"), total.alias("n"), (F.sum("hit") / total).alias("accuracy"),
        *[F.when(use_binary, F.coalesce(binary(c), F.lit(0.0))).otherwise(weighted(c)).alias(c)
          for c in ("precision", "recall", "f1")])
    if score:
        a = auc(df, label, score, by).select(*by, "auc")
        out = out.join(a, by, "left") if by else out.withColumn("auc", a.scalar())
    return out


def regression_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """mse, rmse, mae, r2, mape (zero labels skipped) and rmse relative to the label spread."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    t = df.where(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("_v"), (F.avg(F.when(y != 0, F.abs(e / F.nullif(y, F.lit(0.0))))) * 100).alias("mape"))
    v = F.col("_v")
    return t.withColumns({
        "rmse": F.sqrt("mse"), "r2": F.when(v > 0, 1 - F.col("mse") / v).otherwise(0.0),
        "rmse_ratio": F.when(v > 0, F.sqrt(F.col("mse") / v)).otherwise(float("inf"))}).drop("_v")


def rank_models(results: DataFrame, metric: str, within: Sequence[str] = ()) -> DataFrame:
    """Models ranked by a metric, best first (ties by name)."""
    w = (W.partitionBy(*within) if within else W.partitionBy(F.lit(0))).orderBy(F.desc_nulls_last(metric), "model")
    return results.withColumn("rank", F.row_number().over(w))


def best_model(results: DataFrame, metric: str = "f1", within: Sequence[str] = ()) -> DataFrame:
    return rank_models(results.where(F.col(metric).isNotNull()), metric, within).where(F.col("rank") == 1)


# Performance demanded before deployment.
DEFAULT_LIMITS = {
    "classification": {"min_accuracy": 0.5, "min_auc": 0.6},
    "regression": {"min_r2": 0.0, "max_rmse_ratio": 2.0},
}
DOMAIN_LIMITS = {
    "healthcare": {"min_sensitivity": 0.7, "min_auc": 0.65},
    "finance": {"min_auc": 0.65},
    "generic": {"min_accuracy": 0.5},
}
_LIMIT_METRIC = {"min_accuracy": "accuracy", "min_auc": "auc", "min_sensitivity": "recall",
                 "min_r2": "r2", "max_rmse_ratio": "rmse_ratio"}


def validation_checks(df: DataFrame, label: str, prediction: str, score: str | None, problem: str,
                      domain: str = "generic", limits: Mapping[str, float] | None = None,
                      by: Sequence[str] = (), features: tuple[int, int] | None = None) -> DataFrame:
    """One row per check: constant predictions, number of features, every applicable performance limit.

    ``features`` = (expected by the model, given); another number is a warning, so its check is NULL rather than failed.
    """
    by = list(by)
    bounds = {**DEFAULT_LIMITS[problem], **DOMAIN_LIMITS.get(domain, {}), **(limits or {})}
    if problem == "classification":
        m = classification_metrics(df, label, prediction, score, by, average="weighted")
    else:
        m = regression_metrics(df, label, prediction, by)
    vary = df.groupBy(*by).agg((F.min(prediction) != F.max(prediction)).alias("_vary"))
    m = m.join(vary, by) if by else m.withColumn("_vary", vary.scalar())
    rows = [F.struct(F.lit("non_constant").alias("check"), F.lit(None).cast("double").alias("value"),
                     F.lit(None).cast("double").alias("limit"), F.col("_vary").alias("passed"))]
    if features is not None:
        rows.append(F.struct(F.lit("feature_count").alias("check"), F.lit(float(features[1])).alias("value"),
                             F.lit(float(features[0])).alias("limit"), F.lit(True if features[0] == features[1] else None).cast(
                                 "boolean").alias("passed")))
    for name, bound in bounds.items():
        metric = _LIMIT_METRIC[name]
        v = F.col(metric) if metric in m.columns else F.lit(None).cast("double")
        ok = (v <= bound) if name.startswith("max_") else (v >= bound)
        rows.append(F.struct(F.lit(name).alias("check"), v.cast("double").alias("value"),
                             F.lit(float(bound)).alias("limit"), ok.alias("passed")))
    return m.select(*by, F.inline(F.array(*rows)))


def validate_model(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """deploy without failures, review for up to two missed limits, else reject."""
    failed = F.coalesce(~F.col("passed"), F.lit(False))
    t = checks.groupBy(*by).agg(
        F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count(F.when(failed, 1)).alias("failed"),
        F.count(F.when(failed & (F.col("check") == "non_constant"), 1)).alias("_hard"),
        F.count(F.when(F.col("passed").isNull(), 1)).alias("skipped"))
    return t.withColumn(
        "recommendation",
        F.when(F.col("failed") == 0, "deploy").when((F.col("failed") <= 2) & (F.col("_hard") == 0), "review")
        .otherwise("reject")).drop("_hard")


def prediction_stability(runs: DataFrame, key: str, prediction: str) -> DataFrame:
    """Largest variance of one row's prediction over repeated scoring runs (long table)."""
    t = runs.groupBy(key).agg(F.var_pop(F.col(prediction).cast("double")).alias("v"))
    return t.agg(F.max("v").alias("max_variance")).withColumn("is_stable", F.col("max_variance") == 0.0)
