"""Chart data, drift, fairness and calibration over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import charts as G
from quarrylens.operators import curves as R
from quarrylens.operators import drift as D
from quarrylens.operators import fairness as A
from quarrylens.operators import survival as V
from quarrylens.operators.ecommerce import funnel
from quarrylens.plans.queries_domain import _FUNNEL, _RANKED, _SCORED, _SIDES, halves, scored
from quarrylens.plans.queries_stats import _km_sql, surv
from quarrylens.plans.registry import query, r, tidy

# ---- distributions ---------------------------------------------------------------------

_HIST = "least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29)::INTEGER"
_LIM = "(SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) l"


@query("histogram", f"""SELECT {_HIST} AS bin, {r(f'any_value(lo) + {_HIST} * ((any_value(hi) - any_value(lo)) / 30)', 4)} AS lower,
    {r(f'any_value(lo) + ({_HIST} + 1) * ((any_value(hi) - any_value(lo)) / 30)', 4)} AS upper, count(*) AS "count" FROM orders, {_LIM} GROUP BY {_HIST}""")
def _(t):
    return tidy(G.histogram(t.orders, "o_totalprice"), 4)


@query("histogram_groups", f"""SELECT o_orderstatus, {_HIST} AS bin, count(*) AS "count" FROM orders, {_LIM} GROUP BY 1, 2""")
def _(t):
    return G.histogram(t.orders, "o_totalprice", by=["o_orderstatus"]).select("o_orderstatus", "bin", "count")


@query("histogram_summary", f"""SELECT {r('skewness(value)')} AS skewness, min(value) AS min, max(value) AS max, {r('median(value)')} AS median,
    CASE WHEN skewness(value) > 1 THEN 'right' WHEN skewness(value) < -1 THEN 'left' ELSE 'symmetric' END AS shape FROM events""")
def _(t):
    return tidy(G.histogram_summary(t.events, "value"))


@query("box", f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
    SELECT event_type AS "group", {r('any_value(q1)')} AS q1, {r('any_value(median)')} AS median, {r('any_value(q3)')} AS q3, {r('any_value(lo)')} AS lower_fence, {r('any_value(hi)')} AS upper_fence,
      min(value) FILTER (WHERE value BETWEEN lo AND hi) AS whisker_low, max(value) FILTER (WHERE value BETWEEN lo AND hi) AS whisker_high,
      count(*) FILTER (WHERE value < lo OR value > hi) AS outliers, count(*) AS n FROM events JOIN f USING (event_type) GROUP BY 1""")
def _(t):
    return tidy(G.box(t.events, "value", "event_type"))


@query("violin", f"""WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT event_type, least(floor((value - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, count(*) AS "count", any_value((hi - lo) / 50) AS w FROM events, l GROUP BY 1, 2)
    SELECT event_type, bin, "count", {r('"count" / sum("count") OVER (PARTITION BY event_type) / w')} AS density FROM b""")
def _(t):
    return tidy(G.violin(t.events, "value", "event_type").select("event_type", "bin", "count", "density"))


@query("violin_summary", f"SELECT event_type, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return tidy(G.violin_summary(t.events, "value", "event_type"))


@query("qq")
def _(t):
    return tidy(G.qq(t.orders, "o_totalprice"), 4)


@query("scatter", f"""SELECT {r('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept, {r('corr(l_quantity, l_extendedprice)')} AS r, count(*) AS n,
    CASE WHEN abs(corr(l_quantity, l_extendedprice)) > 0.7 THEN 'strong' WHEN abs(corr(l_quantity, l_extendedprice)) > 0.4 THEN 'moderate' ELSE 'weak' END AS relation FROM lineitem""")
def _(t):
    return tidy(G.scatter_fit(t.lineitem, "l_quantity", "l_extendedprice"), slope=4, intercept=4)


@query("scatter_points")
def _(t):
    return G.scatter_points(t.orders, "o_custkey", "o_totalprice", "o_orderkey", 500, "o_orderstatus")


@query("corr_heatmap", " UNION ALL ".join(
    (f"SELECT '{a}' AS col1, '{b}' AS col2, {r(f'corr({a}, {b})')} AS r FROM events" if a != b else f"SELECT '{a}' AS col1, '{b}' AS col2, 1.0::DOUBLE AS r")
    for a in ("event_id", "user_id", "value") for b in ("event_id", "user_id", "value")))
def _(t):
    return tidy(G.corr_heatmap(t.events, ["event_id", "user_id", "value"]))


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]


@query("top_correlations", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS col1, '{b}' AS col2, {r(f'corr({a}, {b})')} AS r, count(*) AS n FROM lineitem" for a, b in _PAIRS)
       + ") ORDER BY abs(r) DESC, col1, col2 LIMIT 3")
def _(t):
    return tidy(G.top_correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("pair_plot")
def _(t):
    return G.pair_plot(t.orders, ["o_totalprice", "o_custkey"], "o_orderkey", 500)


# ---- categories and time ---------------------------------------------------------------


@query("bar", f"SELECT o_orderpriority AS category, count(*) AS total, {r('count(*) * 100.0 / sum(count(*)) OVER ()')} AS share FROM orders GROUP BY 1")
def _(t):
    return tidy(G.bar(t.orders, "o_orderpriority"))


@query("pie", f"""WITH c AS (SELECT p_type AS category, count(*) AS total, count(*) * 100.0 / sum(count(*)) OVER () AS s FROM part GROUP BY 1)
    SELECT category, total, {r('s')} AS share, (row_number() OVER (ORDER BY total DESC, category))::INTEGER AS rank, {r('sum(s) OVER (ORDER BY total DESC, category ROWS UNBOUNDED PRECEDING)')} AS cumulative_share FROM c""")
def _(t):
    return tidy(G.pie(t.part, "p_type"))


@query("heatmap", f"SELECT o_orderstatus AS x, o_orderpriority AS y, {r('avg(o_totalprice)', 3)} AS value FROM orders GROUP BY 1, 2")
def _(t):
    return tidy(G.heatmap(t.orders, "o_orderstatus", "o_orderpriority", "o_totalprice"), 3)


@query("line", "SELECT event_type AS \"group\", ts AS x, value AS y FROM events")
def _(t):
    return G.line(t.events, "ts", "value", "event_type")


_TS = f"""cal AS (SELECT unnest(range(date_trunc('hour', (SELECT min(ts) FROM events)), (SELECT max(ts) FROM events), INTERVAL 1 HOUR)) AS period),
    v AS (SELECT date_trunc('hour', ts) AS period, avg(value) AS value FROM events GROUP BY 1)"""


@query("time_series", f"WITH {_TS} SELECT cal.period, {r('v.value')} AS value FROM cal LEFT JOIN v ON v.period = cal.period")
def _(t):
    return tidy(G.time_series(t.events, "ts", "value", "hour"))


@query("time_series_change", f"""WITH {_TS} SELECT {r('arg_min(value, period)')} AS first, {r('arg_max(value, period)')} AS last, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, count(*) AS n,
    {r('(arg_max(value, period) - arg_min(value, period)) / abs(arg_min(value, period)) * 100', 4)} AS overall_change_pct FROM v""")
def _(t):
    return tidy(G.time_series_change(G.time_series(t.events, "ts", "value", "hour")), overall_change_pct=4)


@query("chart_funnel", f"""WITH {_FUNNEL}, d AS (SELECT *, lag(stage) OVER (ORDER BY position) AS ps, (pc - c) * 100.0 / pc AS dr FROM p)
    SELECT {r('arg_max(c, position) * 100.0 / arg_min(c, position)')} AS overall_conversion_pct, arg_max(ps || ' -> ' || stage, dr) AS biggest_drop, {r('max(dr)')} AS biggest_drop_pct FROM d""")
def _(t):
    return tidy(G.funnel_summary(funnel(t.events, "event_type")))


_COH = "c AS (SELECT c_nationkey AS cohort, (o_orderkey % 6)::BIGINT AS period, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("cohort_heatmap", f"""WITH {_COH}, m AS (SELECT cohort, period, avg(v) AS value FROM c GROUP BY 1, 2)
    SELECT cohort, period, {r('value', 3)} AS value, {r('value / max(value) FILTER (WHERE period = 0) OVER (PARTITION BY cohort) * 100')} AS retention_pct FROM m""")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("co"), (F.col("o_orderkey") % 6).alias("pe"), "o_totalprice")
    return tidy(G.cohort_heatmap(rows, "co", "pe", "o_totalprice"), value=3)


@query("survival_curve", f"""WITH km AS ({_km_sql(True)}) SELECT "group", min(time) FILTER (WHERE survival <= 0.5) AS median, {r('arg_max(survival, time)')} AS final_survival, count(*) AS steps FROM km GROUP BY 1""")
def _(t):
    return tidy(G.survival_curve(V.kaplan_meier(surv(t), "days", "event", "grp")))


# ---- curves ----------------------------------------------------------------------------


@query("roc", f"WITH {_SCORED}, {_RANKED} SELECT {r('score')} AS threshold, {r('fp / nq')} AS fpr, {r('tp / np')} AS tpr FROM k")
def _(t):
    return tidy(R.roc_curve(scored(t), "label", "score"))


@query("pr", f"WITH {_SCORED}, {_RANKED} SELECT {r('score')} AS threshold, {r('tp / (tp + fp)')} AS precision, {r('tp / np')} AS recall FROM k")
def _(t):
    return tidy(R.pr_curve(scored(t), "label", "score"))


@query("average_precision", f"WITH {_SCORED}, {_RANKED} SELECT {r('sum(p / np * tp / (tp + fp))')} AS average_precision FROM k")
def _(t):
    return tidy(R.average_precision(scored(t), "label", "score"))


_GAIN = """g AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS position, count(*) OVER () AS n, sum(label) OVER (ORDER BY score DESC, doc_id)::DOUBLE AS c, (sum(label) OVER ())::DOUBLE AS tot FROM scored)"""


@query("gain_lift", f"WITH {_SCORED}, {_GAIN} SELECT doc_id, {r('score')} AS score, position, {r('position * 1.0 / n')} AS population_pct, {r('c / tot')} AS gain, {r('c / tot / (position * 1.0 / n)')} AS lift FROM g")
def _(t):
    return tidy(R.gain_lift(scored(t), "label", "score", "doc_id"))


@query("gain_lift_top", f"WITH {_SCORED}, {_GAIN} SELECT position, {r('c / tot')} AS gain, {r('c / tot / (position * 1.0 / n)')} AS lift FROM g WHERE position = CASE WHEN n >= 10 THEN floor(n * 0.1) ELSE n END")
def _(t):
    return tidy(R.top_share(R.gain_lift(scored(t), "label", "score", "doc_id")))


@query("residuals", f"""SELECT {r('avg(l_extendedprice - 2000 * l_quantity)', 4)} AS mean_residual, {r('stddev_pop(l_extendedprice - 2000 * l_quantity)', 4)} AS std_residual,
    {r('min(l_extendedprice - 2000 * l_quantity)', 4)} AS min_residual, {r('max(l_extendedprice - 2000 * l_quantity)', 4)} AS max_residual, count(*) AS n FROM lineitem""")
def _(t):
    return tidy(G.residuals(t.lineitem.withColumn("p", F.col("l_quantity") * 2000), "l_extendedprice", "p"), 4)


# ---- drift, fairness, calibration ------------------------------------------------------


@query("drift_numeric", f"""WITH {_SIDES}, c AS (SELECT x, sum(s)::DOUBLE AS e, sum(1 - s)::DOUBLE AS a FROM (SELECT x, 1 AS s FROM e UNION ALL SELECT x, 0 FROM a) GROUP BY 1),
    k AS (SELECT max(abs(ce / ne - ca / na)) AS d FROM (SELECT sum(e) OVER (ORDER BY x) AS ce, sum(a) OVER (ORDER BY x) AS ca, sum(e) OVER () AS ne, sum(a) OVER () AS na FROM c)),
    b AS (SELECT quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM e), w AS (SELECT e, a, least(len(list_filter(q, lambda v: v <= x)), 10) AS bin FROM c, b WHERE x >= q[1] AND x <= q[11]),
    g AS (SELECT bin, sum(e) AS e, sum(a) AS a FROM w GROUP BY 1), p AS (SELECT CASE WHEN e = 0 THEN 1e-6 ELSE e / sum(e) OVER () END AS pe, CASE WHEN a = 0 THEN 1e-6 ELSE a / sum(a) OVER () END AS pa FROM g)
    SELECT 'value' AS "column", 'ks' AS test, {r('(SELECT d FROM k)')} AS statistic, {r('sum((pa - pe) * ln(pa / pe))')} AS psi FROM p""")
def _(t):
    return tidy(D.drift_numeric(*halves(t), ["value"]).select("column", "test", "statistic", "psi"))


_CUT = "(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END)"


@query("drift_categorical", f"""WITH c AS (SELECT event_type AS v, sum({_CUT})::DOUBLE AS e, sum(1 - {_CUT})::DOUBLE AS a FROM events GROUP BY 1), s AS (SELECT *, sum(e) OVER () AS ne, sum(a) OVER () AS na FROM c)
    SELECT 'event_type' AS "column", 'chi_square' AS test, {r('sum((e - (e + a) * ne / (ne + na)) ** 2 / ((e + a) * ne / (ne + na)) + (a - (e + a) * na / (ne + na)) ** 2 / ((e + a) * na / (ne + na)))')} AS statistic,
      {r('sum((a / na - e / ne) * ln((a / na + 1e-6) / (e / ne + 1e-6)))')} AS psi FROM s""")
def _(t):
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return tidy(D.drift_categorical(t.events.where(F.col("ts") < cut), t.events.where(F.col("ts") >= cut), ["event_type"]).select("column", "test", "statistic", "psi"))


@query("drift_report")
def _(t):
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    rows = t.events.select("ts", "user_id", "value", "event_type")
    return tidy(D.drift_report(rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut), ["user_id", "value", "event_type"]))


@query("drift_score")
def _(t):
    e, a = halves(t)
    return tidy(D.drift_score(D.drift_report(e, a)))


_FAIR = f"""WITH {_SCORED}, l AS (SELECT 'lang' AS attribute, lang AS "group", label, prediction FROM scored UNION ALL SELECT 'toxic', toxic::VARCHAR, label, prediction FROM scored),
    g AS (SELECT attribute, "group", count(*) AS "count", avg(prediction) AS selection_rate, avg(prediction) FILTER (WHERE label = 1) AS tpr, avg(prediction) FILTER (WHERE label = 0) AS fpr FROM l GROUP BY 1, 2)"""


@query("fairness_groups", f'{_FAIR} SELECT attribute, "group", "count", {r("selection_rate")} AS selection_rate, {r("tpr")} AS tpr, {r("fpr")} AS fpr FROM g')
def _(t):
    return tidy(A.fairness_groups(scored(t), "label", "prediction", ["lang", "toxic"]))


@query("fairness", f"""{_FAIR}, m AS (SELECT attribute, count(*) AS groups, max(selection_rate) - min(selection_rate) AS dp, greatest(max(tpr) - min(tpr), coalesce(max(fpr) - min(fpr), 0)) AS eo,
      min(selection_rate) / max(selection_rate) AS di FROM g GROUP BY 1)
    SELECT attribute, groups, {r('dp')} AS demographic_parity_diff, {r('eo')} AS equalized_odds_diff, {r('di')} AS disparate_impact, dp > 0.1 AS parity_flag, di < 0.8 AS impact_flag FROM m""")
def _(t):
    return tidy(A.fairness(scored(t), "label", "prediction", ["lang", "toxic"]))


_BINS = "b AS (SELECT least(floor(score * 10), 9)::INTEGER AS bin, avg(score) AS mp, avg(label) AS fp, count(*) AS c FROM scored GROUP BY 1)"


@query("calibration_bins", f"""WITH {_SCORED}, {_BINS} SELECT i::INTEGER AS bin, {r('mp')} AS mean_predicted, {r('fp')} AS fraction_positive, coalesce(c, 0) AS "count", {r('i * 0.1')} AS lower, {r('(i + 1) * 0.1')} AS upper
    FROM range(10) g(i) LEFT JOIN b ON bin = i""")
def _(t):
    return tidy(A.calibration_bins(scored(t), "label", "score"))


@query("chart_calibration", f"""WITH {_SCORED}, {_BINS} SELECT bin, {r('mp')} AS mean_predicted, {r('fp')} AS fraction_positive, c AS "count" FROM b""")
def _(t):
    return tidy(A.calibration_bins(scored(t), "label", "score", keep_empty=False).drop("lower", "upper"))


@query("ece", f"WITH {_SCORED}, {_BINS} SELECT {r('sum(c * abs(fp - mp)) / sum(c)')} AS ece FROM b")
def _(t):
    return tidy(A.ece(scored(t), "label", "score"))


@query("brier", f"WITH {_SCORED} SELECT lang, {r('avg((label - score) ** 2)')} AS brier FROM scored GROUP BY 1")
def _(t):
    return tidy(A.brier(scored(t), "label", "score", ["lang"]))
