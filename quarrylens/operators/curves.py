"""ROC, precision-recall, gain and lift curves from distributed score totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.ranks import sequence_index
from quarrylens.functions.scalars import safe_div
from quarrylens.operators.finance import ranked_scores
from quarrylens.operators.sequence import running


def roc_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score used as threshold."""
    r = ranked_scores(df, label, score, by)
    return r.select(*by, F.col("score").alias("threshold"), safe_div(F.col("fp"), F.col("neg_total")).alias("fpr"),
                    safe_div(F.col("tp"), F.col("pos_total")).alias("tpr"))


def pr_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    r = ranked_scores(df, label, score, by)
    return r.select(*by, F.col("score").alias("threshold"),
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    safe_div(F.col("tp"), F.col("pos_total")).alias("recall"))


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision at every threshold weighted by the recall gained there."""
    r = ranked_scores(df, label, score, by)
    step = F.col("pos") / F.col("pos_total") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return r.where(F.col("pos_total") > 0).groupBy(*by).agg(F.sum(step).alias("average_precision"))


def gain_lift(df: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """Cumulative gain and lift after every row by falling score (ties by ``key``)."""
    rows = df.select(F.col(key), F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("score")).dropna()
    ranked = sequence_index(rows, ["score", key], descending=["score"], total="_n")
    total = rows.agg(F.sum("y")).scalar()
    cum = running(ranked, {"_cum": F.col("y")}, ["_index"])
    pop = (F.col("_index") + 1) / F.col("_n")
    return cum.select(
        key, "score", (F.col("_index") + 1).alias("position"), pop.alias("population_pct"),
        (F.col("_cum") / total).alias("gain"), (F.col("_cum") / total / pop).alias("lift"))


def top_share(curve: DataFrame, share: float = 0.1) -> DataFrame:
    """Gain and lift at the best-scored ``share`` of rows (the last row of a short table)."""
    n = curve.agg(F.max("position")).scalar()
    at = F.when(n >= 10, F.floor(n * share)).otherwise(n)
    return curve.where(F.col("position") == at).select("position", "gain", "lift")

