"""All metrics of an industry from one table of labels, predictions and scores; long tables as matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators import finance, health

#: The metrics of each industry, in order; those without a function here need other columns.
DOMAIN_METRICS = {
    "finance": ("ks_statistic", "gini_coefficient", "psi"),
    "healthcare": ("clinical_metrics", "concordance_index"),
    "ecommerce": ("rfm_scores", "clv_simple"),
    "manufacturing": ("oee_score", "process_capability"),
    "marketing": ("campaign_lift",),
}
#: What a metric needs beyond label, prediction and score.
NEEDS = {
    "concordance_index": "event times", "rfm_scores": "transactions", "clv_simple": "transactions",
    "oee_score": "availability, performance and quality", "process_capability": "measurements and limits",
    "campaign_lift": "treatment and outcome",
}
_SCHEMA = "metric string, measure string, value double, note string"


def _measures(row: DataFrame, metric: str) -> DataFrame:
    """A one-row table as ``metric, measure, value, note``; texts become the note of the metric's own row."""
    cells = []
    for name, kind in row.dtypes:
        text = kind == "string"
        cells.append(F.struct(F.lit(metric).alias("metric"), F.lit(name).alias("measure"),
                              (F.lit(None) if text else F.col(name)).cast("double").alias("value"),
                              (F.col(name) if text else F.lit(None)).cast("string").alias("note")))
    return row.select(F.inline(F.array(*cells)))


def domain_metrics(df: DataFrame, domain: str, label: str, prediction: str | None = None, score: str | None = None,
                   problem: str = "classification") -> DataFrame:
    """``(metric, measure, value, note)`` for every metric of ``domain``; an unknown domain has none.

    A metric that cannot be computed from these columns has one row without a value, whose note says what it needs.
    """
    def psi(rows: DataFrame) -> DataFrame:
        shares = finance.psi_bins_b(rows.select(F.col(label).alias("x")), rows.select(F.col(score).alias("x")), "x")
        return finance.psi_total(shares, 0.1, 0.25)

    known = {
        "ks_statistic": (score, "a score", lambda: finance.ks_statistic(df, label, score)),
        "gini_coefficient": (score, "a score", lambda: finance.gini(df, label, score)),
        "psi": (score, "a score", lambda: psi(df)),
        "clinical_metrics": (prediction if problem == "classification" else None, "a class prediction",
                             lambda: health.clinical_metrics(df, label, prediction)),
    }
    out = df.sparkSession.createDataFrame([], _SCHEMA)
    for metric in DOMAIN_METRICS.get(domain.lower(), ()):
        given, need, make = known.get(metric, (None, NEEDS.get(metric), None))
        part = _measures(make(), metric) if given else df.sparkSession.createDataFrame(
            [(metric, None, None, f"needs {need}")], _SCHEMA)
        out = out.unionByName(part)
    return out


def as_matrix(cells: DataFrame, rows: str, columns: str, value: str, order: Sequence | None = None) -> DataFrame:
    """Long cells as a matrix: one row per value of ``rows``, one column per value of ``columns`` in their order.

    The headings (one per distinct value) are collected unless ``order`` names them; cells without a row are NULL.
    """
    if order is None:
        order = [r[0] for r in cells.where(F.col(columns).isNotNull()).select(columns).distinct().orderBy(columns).collect()]
    return cells.groupBy(rows).pivot(columns, list(order)).agg(F.first(value))
