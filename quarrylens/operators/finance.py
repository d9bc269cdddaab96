"""Finance: score discrimination, stability and vintages.  Input: label / score rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions.quantiles import bin_left_closed, edge_array
from quarrylens.functions.ranks import running_totals, sequence_index
from quarrylens.functions.scalars import no_nan, near_zero_div, safe_div


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: everything below works on these."""
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    rows = df.select(*by, y.alias("y"), s.alias("score")).where(
        F.col("y").isNotNull() & F.col("score").isNotNull())
    return rows.groupBy(*by, "score").agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("pos"), F.count(F.when(F.col("y") != 1, 1)).alias("neg"))


def ranked_scores(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per score: counts at the score and at or above it (``tp``, ``fp``), with totals."""
    r = running_totals(score_counts(df, label, score, by), "score", ["pos", "neg"], by)
    return r.withColumns({
        "tp": F.col("pos_total") - F.col("pos_before"), "fp": F.col("neg_total") - F.col("neg_before")})


def ks_statistic(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest gap between the class score distributions and the score where it occurs."""
    r = ranked_scores(df, label, score, by)
    gap = F.abs(F.col("tp") / F.col("pos_total") - F.col("fp") / F.col("neg_total"))
    best = r.where((F.col("pos_total") > 0) & (F.col("neg_total") > 0)).groupBy(*by).agg(
        F.max(F.struct(F.round(gap, 12).alias("g"), F.col("score").alias("s"))).alias("b"))
    return best.select(*by, F.col("b.g").alias("ks_statistic"), F.col("b.s").alias("ks_threshold"))


def _cumulate_deciles(t: DataFrame) -> DataFrame:
    """Cumulative shares over at most ten decile rows."""
    w = W.partitionBy(F.lit(0)).orderBy("decile").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns({"_e": F.sum("events").over(w), "_n": F.sum(F.col("count") - F.col("events")).over(w)})
    t = t.withColumns({
        "event_rate": near_zero_div(F.col("events"), F.col("count")),
        "cum_event_pct": F.col("_e") / F.col("_p"), "cum_nonevent_pct": F.col("_n") / F.col("_q")})
    return t.withColumn("ks", F.abs(F.col("cum_event_pct") - F.col("cum_nonevent_pct"))).drop("_e", "_n", "_p", "_q")


def ks_deciles_a(df: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """Ten equal-count deciles by falling score (ties by ``key``), the last takes the rest."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    ranked = sequence_index(rows, [score, key], descending=[score], total="_n")
    size = F.greatest(F.floor(F.col("_n") / 10), F.lit(1))
    y = F.col(label).cast("bigint")
    t = ranked.groupBy((F.least(F.floor(F.col("_index") / size), F.lit(9)) + 1).cast("int").alias("decile")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(y).alias("events"))
    totals = rows.agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"))
    return _cumulate_deciles(t.withColumns({
        "_p": totals.select("p").scalar(), "_q": totals.select("q").scalar()}))


def ks_deciles_b(df: DataFrame, label: str, score: str) -> DataFrame:
    """Ten deciles between score percentiles, both ends included (edge scores count twice)."""
    counts = score_counts(df, label, score)
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        F.col(score).cast("double").alias("score"))
    from quarrylens.functions.quantiles import quantiles

    q = quantiles(rows, "score", [i / 10 for i in range(11)])
    edges = q.agg(F.array_sort(F.collect_list("quantile"))).scalar()
    spread = counts.withColumn("_e", edges).withColumn(
        "decile", F.explode(F.sequence(F.lit(1), F.lit(10))))
    lo, hi = F.get("_e", 10 - F.col("decile")), F.get("_e", 11 - F.col("decile"))
    inside = spread.where((F.col("score") >= lo) & (F.col("score") <= hi))
    t = inside.groupBy("decile").agg(
        F.first(lo).alias("min_score"), F.first(hi).alias("max_score"),
        F.sum(F.col("pos") + F.col("neg")).alias("count"), F.sum("pos").alias("events"))
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return _cumulate_deciles(t.withColumns({
        "_p": totals.select("p").scalar(), "_q": totals.select("q").scalar()}))


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by mid-ranks."""
    r = running_totals(score_counts(df, label, score, by), "score", ["pos", "neg"], by)
    p, n = F.max("pos_total").cast("double"), F.max("neg_total").cast("double")
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    return r.groupBy(*by).agg(safe_div(wins, p * n).alias("auc"), p.alias("n_pos"), n.alias("n_neg"))


def gini(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """2 AUC - 1 with its verbal band."""
    g = auc(df, label, score, by).withColumn("gini", 2 * F.col("auc") - 1)
    return g.select(*by, "gini", "auc", F.when(F.col("gini") >= 0.6, "excellent")
                    .when(F.col("gini") >= 0.4, "good").when(F.col("gini") >= 0.2, "moderate")
                    .otherwise("poor").alias("band"))


def lorenz_curve(df: DataFrame, label: str, score: str, key: str, points: int = 20) -> DataFrame:
    """Share of events among the best-scored share of rows, at ``points`` + 1 places."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    ranked = sequence_index(rows, [score, key], descending=[score], total="_n")
    at = [F.rint(F.lit(k / points) * F.col("_n")) for k in range(points + 1)]
    first = F.lit(points)
    for k in range(points - 1, -1, -1):
        first = F.when(F.col("_index") < at[k], F.lit(k)).otherwise(first)
    seg = ranked.groupBy(first.alias("k")).agg(F.sum(F.col(label).cast("bigint")).alias("e"))
    grid = df.sparkSession.range(points + 1).select(F.col("id").cast("int").alias("k"))
    w = W.partitionBy(F.lit(0)).orderBy("k")
    full = grid.join(seg, "k", "left").withColumn("e", F.coalesce("e", F.lit(0)))
    return full.select(
        (F.col("k") / points).alias("population_pct"),
        (F.sum("e").over(w.rowsBetween(W.unboundedPreceding, 0))
         / F.sum("e").over(W.partitionBy(F.lit(0)))).alias("event_pct"))


def _psi_rows(expected: DataFrame, actual: DataFrame, at: Column, edges: DataFrame, eps: float,
              inside_only: bool) -> DataFrame:
    """Per-bin shares and PSI terms, from one pass over both tables with a side flag."""
    both = expected.select("x", F.lit(1).alias("_side")).unionAll(actual.select("x", F.lit(0).alias("_side")))
    both = both.where(F.col("x").isNotNull() & ~F.isnan("x")).withColumn("edges", edges.scalar())
    binned = both.groupBy(at.alias("bin")).agg(
        F.sum("_side").alias("e"), F.sum(1 - F.col("_side")).alias("a"))
    if inside_only:
        binned = binned.where(F.col("bin").isNotNull())
    bins = edges.select(F.posexplode(F.slice(F.col("edges"), 1, F.greatest(F.size("edges") - 1, F.lit(0)))).alias("i", "lower"), "edges")
    bins = bins.select((F.col("i") + 1).alias("bin"), "lower", F.get("edges", F.col("i") + 1).alias("upper"))
    w = W.partitionBy(F.lit(0))
    full = bins.join(binned, "bin", "left").fillna(0, subset=["e", "a"])

    def share(c: str) -> Column:
        return F.greatest(F.col(c) / F.greatest(F.sum(c).over(w), F.lit(1)), F.lit(eps))

    t = full.select("bin", "lower", "upper", share("e").alias("expected_pct"), share("a").alias("actual_pct"))
    return t.withColumn("psi", (F.col("actual_pct") - F.col("expected_pct"))
                        * F.log(F.col("actual_pct") / F.col("expected_pct")))


def _as_x(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("double").alias("x"))


def psi_bins_a(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the expected range, outer bins open, shares at least 1e-6."""
    e = _as_x(expected, column)
    span = e.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    edges = span.select(F.array(lo, *[lo + i * ((hi - lo) / bins) for i in range(1, bins)], hi).alias("edges"))
    inner = F.slice(F.col("edges"), 2, bins - 1)
    at = F.size(F.filter(inner, lambda v: v <= F.col("x"))) + 1
    return _psi_rows(e, _as_x(actual, column), at, edges, 1e-6, False)


def psi_bins_b(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10,
               eps: float = 1e-9) -> DataFrame:
    """Quantile bins of the expected values, values outside dropped, empty bins at ``eps``."""
    e = _as_x(expected, column)
    edges = edge_array(e.withColumn("x", no_nan(F.col("x"))), "x", bins)
    return _psi_rows(e, _as_x(actual, column), bin_left_closed(F.col("x"), F.col("edges")), edges, eps, True)


def psi_total(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Total index and its band: (A) uses 0.1 / 0.2, (B) uses 0.1 / 0.25."""
    t = rows.agg(F.coalesce(F.sum("psi"), F.lit(0.0)).alias("psi"))
    return t.withColumn("band", F.when(F.col("psi") < low, "stable")
                        .when(F.col("psi") <= high if high == 0.25 else F.col("psi") < high, "moderate_shift")
                        .otherwise("significant_shift"))


def vintage(df: DataFrame, originated: str, performance: str, observed: str) -> DataFrame:
    """Mean performance per origination month and months on book, with the cohort size."""
    o, t = F.col(originated), F.col(observed)
    rows = df.select(
        F.date_format(o, "yyyy-MM").alias("cohort"),
        ((F.year(t) - F.year(o)) * 12 + F.month(t) - F.month(o)).alias("months_on_book"),
        F.col(performance).cast("double").alias("y")).dropna()
    cells = rows.groupBy("cohort", "months_on_book").agg(F.sum("y").alias("_s"), F.count("y").alias("n"))
    size = F.sum("n").over(W.partitionBy("cohort"))
    return cells.select("cohort", "months_on_book", (F.col("_s") / F.col("n")).alias("performance"), "n",
                        size.alias("cohort_size"))
