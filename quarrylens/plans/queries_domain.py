"""Industry metrics over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import domain_metrics as X
from quarrylens.operators import ecommerce as C
from quarrylens.operators import finance as B
from quarrylens.operators import health as H
from quarrylens.operators import operations as O
from quarrylens.plans.registry import query, r, tidy

# ---- health: ICD lists derived from order keys -----------------------------------------

_CODES = ["I50,E11,N18", "j44, M05", "C78,B20", None, "I10,Z00", "C77.1,K70", "F32,F11,E112", "I21,I22"]
_CODES_SQL = "[" + ", ".join("NULL" if c is None else f"'{c}'" for c in _CODES) + "]"
_ICD = f"icd AS (SELECT o_orderkey, ({_CODES_SQL})[(o_orderkey % {len(_CODES)} + 1)::INTEGER] AS codes FROM orders)"
_ONE = "one AS (SELECT DISTINCT o_orderkey, replace(upper(trim(unnest(string_split(codes, ',')))), '.', '') AS code FROM icd WHERE codes IS NOT NULL)"


def icd(t):
    codes = F.array(*[F.lit(c) for c in _CODES])
    return t.orders.select("o_orderkey", F.get(codes, (F.col("o_orderkey") % len(_CODES)).cast("int")).alias("codes"))


def _charlson_sql():
    rows = ", ".join(f"('{p}', '{c}', {w})" for c, (w, ps) in H.CHARLSON.items() for p in ps)
    return f"""WITH {_ICD}, {_ONE}, m(prefix, category, weight) AS (VALUES {rows}),
      c AS (SELECT o_orderkey, category, max(weight) AS w FROM one JOIN m ON starts_with(code, prefix) GROUP BY 1, 2)
      SELECT icd.o_orderkey, coalesce(sum(w), 0)::INTEGER AS charlson_score FROM icd LEFT JOIN c ON c.o_orderkey = icd.o_orderkey GROUP BY 1"""


@query("charlson", _charlson_sql())
def _(t):
    return H.charlson(icd(t), "codes").drop("codes")


@query("charlson_summary", f"""WITH s AS ({_charlson_sql()}) SELECT charlson_score, count(*) AS rows, {r('(SELECT avg(charlson_score) FROM s)', 4)} AS mean,
    {r('(SELECT stddev_samp(charlson_score) FROM s)', 4)} AS std, (SELECT min(charlson_score) FROM s) AS min, (SELECT max(charlson_score) FROM s) AS max,
    (SELECT median(charlson_score) FROM s) AS median FROM s GROUP BY 1""")
def _(t):
    return tidy(H.charlson_summary(icd(t), "codes"), 4)


_ELIX = ", ".join(f"('{p}', '{c}')" for c, ps in H.ELIXHAUSER.items() for p in ps)


@query("elixhauser", f"""WITH {_ICD}, {_ONE}, m(prefix, category) AS (VALUES {_ELIX}),
    c AS (SELECT o_orderkey, count(DISTINCT category) AS n FROM one JOIN m ON starts_with(code, prefix) GROUP BY 1)
    SELECT icd.o_orderkey, coalesce(n, 0)::INTEGER AS elixhauser_count FROM icd LEFT JOIN c ON c.o_orderkey = icd.o_orderkey""")
def _(t):
    return H.elixhauser(icd(t), "codes").drop("codes")


@query("elixhauser_categories", f"""WITH {_ICD}, {_ONE}, m(prefix, category) AS (VALUES {_ELIX})
    SELECT category, count(DISTINCT o_orderkey) AS rows FROM one JOIN m ON starts_with(code, prefix) GROUP BY 1""")
def _(t):
    return H.elixhauser_categories(icd(t), "codes")


# ---- scores: document length as a score for the quality label --------------------------

_SCORED = """scored AS (SELECT doc_id, quality AS label, toxic, lang, source, least(n_chars / 6000.0, 1.0)::DOUBLE AS score,
    CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS prediction FROM labels JOIN documents USING (doc_id))"""


def scored(t):
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    return t.labels.join(d, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), "toxic", "lang", "source",
        F.least(F.col("n_chars") / 6000.0, F.lit(1.0)).alias("score"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("prediction"))


_RANKED = """c AS (SELECT score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS q FROM scored GROUP BY 1),
    k AS (SELECT score, p, q, sum(p) OVER (ORDER BY score DESC) AS tp, sum(q) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM c)"""


@query("ks_statistic", f"""WITH {_SCORED}, {_RANKED} SELECT {r('abs(tp / np - fp / nq)')} AS ks_statistic, {r('score')} AS ks_threshold FROM k
    ORDER BY round(abs(tp / np - fp / nq), 12) DESC, score DESC LIMIT 1""")
def _(t):
    return tidy(B.ks_statistic(scored(t), "label", "score"))


_CUM = """{base}, d AS ({dec}), e AS (SELECT *, sum(events) OVER (ORDER BY decile) AS ce, sum("count" - events) OVER (ORDER BY decile) AS cn FROM d),
    n AS (SELECT sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS q FROM scored)"""


@query("ks_table_a", "WITH " + _CUM.format(base=_SCORED, dec="""SELECT (least((rn - 1) // greatest(n // 10, 1), 9) + 1)::INTEGER AS decile, count(*) AS "count", sum(label)::BIGINT AS events
      FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rn, count(*) OVER () AS n FROM scored) GROUP BY 1""")
       + f""" SELECT decile, "count", events, {r('events * 1.0 / "count"')} AS event_rate, {r('ce / p')} AS cum_event_pct, {r('cn / q')} AS cum_nonevent_pct, {r('abs(ce / p - cn / q)')} AS ks FROM e, n""")
def _(t):
    return tidy(B.ks_deciles_a(scored(t), "label", "score", "doc_id"))


@query("ks_table_b", "WITH " + _CUM.format(base=_SCORED, dec="""SELECT i::INTEGER AS decile, q[11 - i] AS min_score, q[12 - i] AS max_score, count(*) AS "count", sum(label)::BIGINT AS events
      FROM scored, (SELECT quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM scored) z, range(1, 11) g(i)
      WHERE score >= q[11 - i] AND score <= q[12 - i] GROUP BY 1, 2, 3""")
       + f""" SELECT decile, {r('min_score')} AS min_score, {r('max_score')} AS max_score, "count", events, {r('events * 1.0 / "count"')} AS event_rate,
      {r('ce / p')} AS cum_event_pct, {r('cn / q')} AS cum_nonevent_pct, {r('abs(ce / p - cn / q)')} AS ks FROM e, n""")
def _(t):
    return tidy(B.ks_deciles_b(scored(t), "label", "score"))


_AUC = "(sum(p * (nq - fp + q / 2)) / any_value(np * nq))"


@query("gini", f"""WITH {_SCORED}, {_RANKED.replace('fp,', 'fp,')} SELECT {r('2 * ' + _AUC.replace('nq - fp + q / 2', '(nq - fp) + q / 2') + ' - 1')} AS gini, {r(_AUC)} AS auc,
    CASE WHEN 2 * {_AUC} - 1 >= 0.6 THEN 'excellent' WHEN 2 * {_AUC} - 1 >= 0.4 THEN 'good' WHEN 2 * {_AUC} - 1 >= 0.2 THEN 'moderate' ELSE 'poor' END AS band FROM k""")
def _(t):
    return tidy(B.gini(scored(t), "label", "score"))


@query("gini_by_group", f"""WITH {_SCORED}, p AS (SELECT a.lang, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc
      FROM scored a JOIN scored b ON a.lang = b.lang AND a.label = 1 AND b.label = 0 GROUP BY 1)
    SELECT lang, {r('2 * auc - 1')} AS gini, {r('auc')} AS auc, CASE WHEN 2 * auc - 1 >= 0.6 THEN 'excellent' WHEN 2 * auc - 1 >= 0.4 THEN 'good'
      WHEN 2 * auc - 1 >= 0.2 THEN 'moderate' ELSE 'poor' END AS band FROM p""")
def _(t):
    return tidy(B.gini(scored(t), "label", "score", ["lang"]))


@query("lorenz_curve", f"""WITH {_SCORED}, s AS (SELECT label, row_number() OVER (ORDER BY score DESC, doc_id) AS rn, count(*) OVER () AS n FROM scored)
    SELECT {r('k / 20.0')} AS population_pct, {r('coalesce(sum(label) FILTER (WHERE rn <= round_even(k / 20.0 * n, 0)), 0) * 1.0 / sum(label)')} AS event_pct FROM s, range(21) g(k) GROUP BY k""")
def _(t):
    return tidy(B.lorenz_curve(scored(t), "label", "score", "doc_id"))


_SIDES = "e AS (SELECT value AS x FROM events WHERE ts < TIMESTAMP '2024-01-16'), a AS (SELECT value * 1.1 AS x FROM events WHERE ts >= TIMESTAMP '2024-01-16')"


def halves(t):
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    e = t.events.where(F.col("ts") < cut).select("value")
    return e, t.events.where(F.col("ts") >= cut).select((F.col("value") * 1.1).alias("value"))


_PSI = """s AS (SELECT i AS bin, q[i] AS lower, q[i + 1] AS upper,
      greatest((SELECT count(*) FROM e WHERE {inside}) * 1.0 / (SELECT count(*) FROM e WHERE {all_e}), {eps}) AS pe,
      greatest((SELECT count(*) FROM a AS e WHERE {inside}) * 1.0 / (SELECT count(*) FROM a AS e WHERE {all_e}), {eps}) AS pa FROM b, range(1, 11) g(i))
    SELECT bin::INTEGER AS bin, {lo} AS lower, {hi} AS upper, {pe} AS expected_pct, {pa} AS actual_pct, {psi} AS psi FROM s"""


def _psi_sql(edges, inside, all_e, eps):
    return f"WITH {_SIDES}, b AS (SELECT {edges} AS q FROM e), " + _PSI.format(
        inside=inside, all_e=all_e, eps=eps, lo=r("lower"), hi=r("upper"), pe=r("pe"), pa=r("pa"), psi=r("(pa - pe) * ln(pa / pe)"))


_PSI_A = _psi_sql("list_transform(range(11), lambda i: CASE WHEN i = 10 THEN max(x) ELSE min(x) + i * ((max(x) - min(x)) / 10) END)".replace("max(x)", "hi").replace("min(x)", "lo"),
                  "(i = 1 OR x >= q[i]) AND (i = 10 OR x < q[i + 1])", "TRUE", "1e-6").replace("AS q FROM e)", "AS q FROM (SELECT min(x) AS lo, max(x) AS hi FROM e))")
_PSI_B = _psi_sql("quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])",
                  "x >= q[i] AND (x < q[i + 1] OR (i = 10 AND x = q[i + 1]))", "x >= q[1] AND x <= q[11]", "1e-9")


@query("psi_bins_a", _PSI_A)
def _(t):
    return tidy(B.psi_bins_a(*halves(t), "value"))


@query("psi_bins_b", _PSI_B)
def _(t):
    return tidy(B.psi_bins_b(*halves(t), "value"))


@query("psi_a", f"WITH x AS ({_PSI_A}) SELECT {r('sum(psi)', 4)} AS psi, CASE WHEN sum(psi) < 0.1 THEN 'stable' WHEN sum(psi) < 0.2 THEN 'moderate_shift' ELSE 'significant_shift' END AS band FROM x")
def _(t):
    return tidy(B.psi_total(B.psi_bins_a(*halves(t), "value"), 0.1, 0.2), 4)


@query("psi_b", f"WITH x AS ({_PSI_B}) SELECT {r('sum(psi)', 4)} AS psi, CASE WHEN sum(psi) < 0.1 THEN 'stable' WHEN sum(psi) <= 0.25 THEN 'moderate_shift' ELSE 'significant_shift' END AS band FROM x")
def _(t):
    return tidy(B.psi_total(B.psi_bins_b(*halves(t), "value"), 0.1, 0.25), 4)


@query("vintage", f"""SELECT strftime(o_orderdate, '%Y-%m') AS cohort, ((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate))::INTEGER AS months_on_book,
    {r('avg(l_quantity)')} AS performance, count(*) AS n, (sum(count(*)) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')))::BIGINT AS cohort_size
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def _(t):
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return tidy(B.vintage(rows, "o_orderdate", "l_quantity", "l_shipdate"))


# ---- e-commerce ------------------------------------------------------------------------

_CUST = """cust AS (SELECT o_custkey, floor(date_diff('microsecond', max(o_orderdate), (SELECT max(o_orderdate) FROM orders)) / 86400000000)::BIGINT + {extra} AS recency_days,
    count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary FROM orders GROUP BY 1)"""


def _edges(c):
    return f"(SELECT list_sort(list_distinct(quantile_cont({c}::DOUBLE, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) FROM cust)"


def _qbin(c):
    return f"greatest(len(list_filter({_edges(c)}, lambda e: e < {c})), 1)"


def _rbin(order):
    return f"greatest(ceil((row_number() OVER (ORDER BY {order}) - 1) * 5.0 / (count(*) OVER () - 1)), 1)::INTEGER"


@query("rfm_a", "WITH " + _CUST.format(extra=1) + f""", s AS (SELECT o_custkey, recency_days, frequency, monetary, (6 - {_qbin('recency_days')})::INTEGER AS r_score,
    {_rbin('frequency, o_custkey')} AS f_score, {_rbin('monetary, o_custkey')} AS m_score FROM cust)
    SELECT *, concat(r_score, f_score, m_score) AS rfm_segment FROM s""")
def _(t):
    return C.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice")


def _score(c, flip):
    b = _qbin(c)
    return f"(CASE WHEN len({_edges(c)}) = 6 THEN {'6 - ' + b if flip else b} ELSE 3 END)::INTEGER"


_RFM_B = "WITH " + _CUST.format(extra=0) + f""", s AS (SELECT o_custkey, recency_days, frequency, monetary, {_score('recency_days', True)} AS r_score,
    {_score('frequency', False)} AS f_score, {_score('monetary', False)} AS m_score FROM cust)
    SELECT *, r_score * 100 + f_score * 10 + m_score AS rfm_score, CASE WHEN (r_score + f_score + m_score) / 3.0 >= 4.5 THEN 'Champions' WHEN r_score >= 4 AND f_score >= 3 THEN 'Loyal Customers'
      WHEN r_score >= 4 AND f_score <= 2 THEN 'Recent Customers' WHEN r_score >= 3 AND m_score >= 4 THEN 'Potential Loyalists' WHEN r_score <= 2 AND f_score >= 4 THEN 'At Risk'
      WHEN r_score <= 2 AND f_score >= 2 THEN 'Cant Lose Them' WHEN r_score <= 2 AND f_score <= 1 THEN 'Lost' ELSE 'Needs Attention' END AS segment FROM s"""


@query("rfm_segments_b", _RFM_B)
def _(t):
    return C.rfm_segments(t.orders, "o_custkey", "o_orderdate", "o_totalprice")


@query("rfm_distribution_b", f"WITH z AS ({_RFM_B}) SELECT segment, count(*) AS customers, (row_number() OVER (ORDER BY count(*) DESC, segment))::INTEGER AS rank FROM z GROUP BY 1")
def _(t):
    return C.segment_distribution(C.rfm_segments(t.orders, "o_custkey", "o_orderdate", "o_totalprice"))


@query("clv_a", f"""WITH c AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total_spend, count(*) AS purchase_count,
      greatest(floor(date_diff('microsecond', min(o_orderdate), max(o_orderdate)) / 86400000000)::BIGINT, 1) AS customer_lifespan_days FROM orders GROUP BY 1),
    d AS (SELECT *, round_even(total_spend / purchase_count * 100, 0) / 100 AS avg_order_value, round_even(purchase_count / (customer_lifespan_days / 30.0) * 1000, 0) / 1000 AS purchase_frequency FROM c)
    SELECT o_custkey, {r('total_spend', 2)} AS total_spend, purchase_count, customer_lifespan_days, avg_order_value, purchase_frequency,
      {r('round_even(avg_order_value * purchase_frequency * 12 * 100, 0) / 100', 1)} AS clv_estimate FROM d""")
def _(t):
    return tidy(C.clv(t.orders, "o_custkey", "o_totalprice", "o_orderdate"), 3, total_spend=2, clv_estimate=1)


_CLV_B = """c AS (SELECT o_custkey, sum(o_totalprice) AS total_spend, count(*) AS purchase_count FROM orders GROUP BY 1),
    k AS (SELECT least(greatest(avg(CASE WHEN purchase_count > 1 THEN 1.0 ELSE 0 END), 0.01), 0.99) AS ret FROM c),
    v AS (SELECT c.*, total_spend / purchase_count AS avg_purchase_value, total_spend / purchase_count * purchase_count * 0.3 * (ret / (1.1 - ret)) AS clv FROM c, k)"""


@query("clv_b", f"WITH {_CLV_B} SELECT o_custkey, {r('total_spend', 2)} AS total_spend, purchase_count, {r('avg_purchase_value', 5)} AS avg_purchase_value, {r('clv', 5)} AS clv FROM v")
def _(t):
    return tidy(C.clv_margin(t.orders, "o_custkey", "o_totalprice"), 5, total_spend=2)


@query("clv_distribution_b", f"""WITH {_CLV_B} SELECT {r('avg(clv)', 2)} AS mean, {r('sum(clv)', 1)} AS total, {r('stddev_samp(clv)', 2)} AS std, {r('max(clv)', 2)} AS max,
    {r('quantile_cont(clv, 0.25)', 2)} AS p25, {r('median(clv)', 2)} AS median, {r('quantile_cont(clv, 0.75)', 2)} AS p75 FROM v""")
def _(t):
    return tidy(C.clv_distribution(C.clv_margin(t.orders, "o_custkey", "o_totalprice")), 2, total=1)


@query("cohort_retention", f"""WITH m AS (SELECT DISTINCT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m FROM orders),
    f AS (SELECT o_custkey, m, min(m) OVER (PARTITION BY o_custkey) AS c FROM m), g AS (SELECT c, m - c AS period, count(*) AS customers FROM f GROUP BY 1, 2)
    SELECT printf('%04d-%02d', c // 12, c % 12 + 1) AS cohort, period::INTEGER AS period, customers, max(customers) FILTER (WHERE period = 0) OVER (PARTITION BY c) AS cohort_size,
      {r('customers * 1.0 / max(customers) FILTER (WHERE period = 0) OVER (PARTITION BY c)')} AS retention FROM g""")
def _(t):
    return tidy(C.cohort_retention(t.orders, "o_custkey", "o_orderdate"))


@query("basket_items", f"""SELECT l_partkey::VARCHAR AS item, count(*) AS "count", {r('count(*) * 1.0 / (SELECT count(DISTINCT l_orderkey) FROM lineitem)')} AS support
    FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def _(t):
    return tidy(C.basket_items(t.lineitem, "l_orderkey", "l_partkey"))


@query("basket_pairs", f"""WITH b AS (SELECT DISTINCT l_orderkey AS o, l_suppkey::VARCHAR AS i FROM lineitem)
    SELECT x.i AS item_a, y.i AS item_b, count(*) AS "count", {r('count(*) * 1.0 / (SELECT count(DISTINCT l_orderkey) FROM lineitem)')} AS support
    FROM b x JOIN b y ON x.o = y.o AND x.i < y.i GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 30""")
def _(t):
    return tidy(C.basket_pairs(t.lineitem, "l_orderkey", "l_suppkey"))


_FUNNEL = "f AS (SELECT event_type AS stage, count(*) AS c FROM events GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY c DESC, stage) AS position, lag(c) OVER (ORDER BY c DESC, stage) AS pc FROM f)"


@query("funnel", f"""WITH {_FUNNEL} SELECT position::INTEGER AS position, stage, c AS "count", {r('coalesce(c * 1.0 / pc, 1)')} AS conversion_rate, coalesce(pc - c, 0) AS dropoff,
    {r('coalesce(1 - c * 1.0 / pc, 0)')} AS dropoff_rate, {r('(min(c) OVER ()) * 1.0 / (max(c) OVER ())')} AS overall_conversion FROM p""")
def _(t):
    return tidy(C.funnel(t.events, "event_type"))


# ---- manufacturing: components derived from line items ---------------------------------

_OEE = "mach AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 AS a, 1 - l_discount AS p, 1 - l_tax AS q, l_suppkey FROM lineitem)"


def machines(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 2).alias("a"), (1 - F.col("l_discount")).alias("p"),
                             (1 - F.col("l_tax")).alias("q"), "l_suppkey")


@query("oee_a", f"""WITH {_OEE}, s AS (SELECT a / 100 AS a, p, q FROM mach) SELECT {r('avg(a * p * q)')} AS oee, {r('avg(a)')} AS availability, {r('avg(p)')} AS performance,
    {r('avg(q)')} AS quality, {r('1 - avg(a)')} AS availability_loss, {r('avg(a) * (1 - avg(p))')} AS performance_loss, {r('avg(a) * avg(p) * (1 - avg(q))')} AS quality_loss,
    avg(a * p * q) >= 0.85 AS is_world_class FROM s""")
def _(t):
    return tidy(O.oee(machines(t), "a", "p", "q"))


@query("oee_b", f"""WITH {_OEE}, s AS (SELECT l_orderkey, l_linenumber, l_partkey, a / 100 AS a, p, q FROM mach) SELECT l_orderkey, l_linenumber, l_partkey, {r('a * p * q')} AS oee,
    a * p * q >= 0.85 AS world_class, CASE WHEN a * p * q >= 0.85 THEN 'world_class' WHEN a * p * q >= 0.65 THEN 'typical' ELSE 'below_average' END AS band FROM s""")
def _(t):
    return tidy(O.oee_score(machines(t).withColumn("a", F.col("a") / 100), "a", "p", "q").select(
        "l_orderkey", "l_linenumber", "l_partkey", "oee", "world_class", "band"))


@query("mtbf_mttr", f"""SELECT l_suppkey, {r('avg(l_quantity)')} AS mtbf, {r('avg(l_linenumber)')} AS mttr, count(*) AS total_failures, median(l_quantity) AS mtbf_median,
    {r('stddev_samp(l_quantity)')} AS mtbf_std, min(l_quantity) AS mtbf_min, max(l_quantity) AS mtbf_max, median(l_linenumber)::DOUBLE AS mttr_median, {r('stddev_samp(l_linenumber)')} AS mttr_std,
    min(l_linenumber)::DOUBLE AS mttr_min, max(l_linenumber)::DOUBLE AS mttr_max, {r('avg(l_quantity) / (avg(l_quantity) + avg(l_linenumber))')} AS availability,
    {r('1 / avg(l_quantity)')} AS failure_rate FROM lineitem GROUP BY 1""")
def _(t):
    return tidy(O.mtbf_mttr(t.lineitem, "l_quantity", "l_linenumber", ["l_suppkey"]))


_SPC = """s AS (SELECT event_id, value, lag(value) OVER (ORDER BY ts) AS p FROM events), l AS (SELECT avg(value) AS c, avg(abs(value - p)) / 1.128 AS sg FROM s)"""


@query("spc_individuals", f"""WITH {_SPC} SELECT {r('any_value(c)')} AS center_line, {r('any_value(c + 3 * sg)')} AS ucl, {r('any_value(c - 3 * sg)')} AS lcl, {r('any_value(sg)')} AS sigma,
    count(*) FILTER (WHERE value > c + 3 * sg OR value < c - 3 * sg) AS out_of_control, count(*) AS total_points, {r('any_value(sg) / stddev_samp(value)')} AS cp_proxy FROM s, l""")
def _(t):
    return tidy(O.spc_individuals(t.events, "value", ["ts", "event_id"]))


@query("spc_individuals_points", f"WITH {_SPC} SELECT event_id, value FROM s, l WHERE value > c + 3 * sg OR value < c - 3 * sg")
def _(t):
    return O.spc_individuals(t.events.select("event_id", "ts", "value"), "value", ["ts", "event_id"], flag_rows=True).drop("ts")


@query("spc_xbar", f"""WITH g AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1),
    l AS (SELECT avg(m) AS c, 3 / sqrt(avg(n)) * avg(s) AS w FROM g)
    SELECT {r('any_value(c)')} AS center_line, {r('any_value(c + w)')} AS ucl, {r('any_value(c - w)')} AS lcl, {r('any_value(w / 3)')} AS sigma, count(*) FILTER (WHERE m > c + w OR m < c - w) AS out_of_control,
      count(*) AS subgroups, {r('any_value(w) / (3 * (SELECT stddev_samp(value) FROM events))')} AS cp_proxy FROM g, l""")
def _(t):
    return tidy(O.spc_xbar(t.events, "value", "user_id"))


@query("process_capability", f"""WITH s AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS std FROM events GROUP BY 1),
    k AS (SELECT *, 600 / (6 * std) AS cp, least((500 - mean) / (3 * std), (mean + 100) / (3 * std)) AS cpk FROM s)
    SELECT event_type, {r('mean')} AS mean, {r('std')} AS std, {r('cp')} AS cp, {r('cpk')} AS cpk, {r('cp')} AS pp, {r('cpk')} AS ppk, cpk >= 1.33 AS is_capable,
      CASE WHEN cpk >= 1.67 THEN 'excellent' WHEN cpk >= 1.33 THEN 'capable' WHEN cpk >= 1 THEN 'marginal' ELSE 'incapable' END AS band FROM k""")
def _(t):
    return tidy(O.process_capability(t.events, "value", -100, 500, ["event_type"]))


# ---- people and marketing --------------------------------------------------------------


@query("diversity", f"""WITH v AS (SELECT 'seg' AS "column", CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer),
    c AS (SELECT "column", value, count(*) AS "count" FROM v GROUP BY 1, 2), p AS (SELECT *, "count" * 1.0 / sum("count") OVER (PARTITION BY "column") AS p FROM c)
    SELECT "column", value, "count", {r('p * 100')} AS percentage, {r('1 - sum(p * p) OVER (PARTITION BY "column")')} AS simpson_index, count(*) OVER (PARTITION BY "column") AS unique_groups FROM p""")
def _(t):
    rows = t.customer.select(F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("seg"), "c_nationkey")
    return tidy(O.diversity(rows, ["seg", "c_nationkey"]))


@query("pay_gap", f"""WITH g AS (SELECT c_mktsegment AS "group", round(avg(c_acctbal), 2) AS mean, median(c_acctbal) AS median, count(*) AS "count", stddev_samp(c_acctbal) AS std FROM customer GROUP BY 1)
    SELECT "group", mean, {r('median', 3)} AS median, "count", {r('std', 4)} AS std, {r('max(mean) OVER () - mean', 4)} AS absolute_gap,
      {r('(max(mean) OVER () - mean) / (max(mean) OVER ()) * 100', 4)} AS percentage_gap, mean = max(mean) OVER () AS is_reference FROM g""")
def _(t):
    return tidy(O.pay_gap(t.customer, "c_acctbal", "c_mktsegment"), 4, mean=2, median=3)


@query("pay_gap_by_role", f"""WITH g AS (SELECT c_nationkey AS role, c_mktsegment AS "group", avg(c_acctbal) AS m FROM customer GROUP BY 1, 2), h AS (SELECT *, max(m) OVER (PARTITION BY role) AS top FROM g)
    SELECT role, "group", {r('(top - m) / top * 100')} AS gap_pct FROM h WHERE m < top""")
def _(t):
    return tidy(O.pay_gap_by_role(t.customer, "c_acctbal", "c_mktsegment", "c_nationkey"))


_LIFT = f"""{r('t')} AS treatment_rate, {r('c')} AS control_rate, nt AS n_treatment, nc AS n_control, {r('t - c')} AS absolute_lift, {r('(t - c) / c')} AS relative_lift,
    {r('(t - c) / sqrt((t * nt + c * nc) / (nt + nc) * (1 - (t * nt + c * nc) / (nt + nc)) * (1.0 / nt + 1.0 / nc))')} AS z_statistic,
    {r('t - c - 1.96 * sqrt(t * (1 - t) / nt + c * (1 - c) / nc)')} AS ci_lower, {r('t - c + 1.96 * sqrt(t * (1 - t) / nt + c * (1 - c) / nc)')} AS ci_upper"""
_AB = """ab AS (SELECT user_id, event_type, event_id % 2 AS treat, CASE WHEN value > 50 THEN 1 ELSE 0 END AS won FROM events)"""


def ab(t):
    return t.events.select("user_id", "event_type", (F.col("event_id") % 2).alias("treat"), F.when(F.col("value") > 50, 1).otherwise(0).alias("won"))


_LIFT_COLS = ["treatment_rate", "control_rate", "n_treatment", "n_control", "absolute_lift", "relative_lift", "z_statistic", "ci_lower", "ci_upper"]


@query("campaign_lift_a", f"""WITH {_AB}, x AS (SELECT event_type, avg(won) FILTER (WHERE treat = 1) AS t, avg(won) FILTER (WHERE treat = 0) AS c, count(*) FILTER (WHERE treat = 1) AS nt,
    count(*) FILTER (WHERE treat = 0) AS nc FROM ab GROUP BY 1) SELECT event_type, {_LIFT} FROM x""")
def _(t):
    return tidy(O.campaign_lift(ab(t), "treat", "won", ["event_type"]).select("event_type", *_LIFT_COLS))


@query("campaign_lift_b", f"""WITH {_AB}, x AS (SELECT user_id, avg(won) FILTER (WHERE treat = 1) AS t, avg(won) FILTER (WHERE treat = 0) AS c, count(*) FILTER (WHERE treat = 1) AS nt,
    count(*) FILTER (WHERE treat = 0) AS nc FROM ab GROUP BY 1) SELECT user_id, {_LIFT} FROM x""")
def _(t):
    rates = ab(t).groupBy("user_id").agg(
        F.avg(F.when(F.col("treat") == 1, F.col("won"))).alias("tr"), F.avg(F.when(F.col("treat") == 0, F.col("won"))).alias("cr"),
        F.count(F.when(F.col("treat") == 1, 1)).alias("tn"), F.count(F.when(F.col("treat") == 0, 1)).alias("cn"))
    return tidy(O.campaign_lift_rates(rates, "cr", "tr", "cn", "tn").select("user_id", *_LIFT_COLS))


@query("attribution", f"""WITH a AS (SELECT event_type AS channel, count(*) AS touches, sum(CASE WHEN value > 50 THEN 1.0 ELSE 0 END)::DOUBLE AS conversions, sum(value) AS revenue FROM events GROUP BY 1)
    SELECT channel, touches, conversions, {r('revenue', 2)} AS revenue, {r('conversions / touches')} AS conversion_rate, {r('conversions / sum(conversions) OVER ()')} AS attribution_share,
      {r('revenue / conversions', 4)} AS revenue_per_conversion FROM a""")
def _(t):
    rows = t.events.withColumn("won", F.when(F.col("value") > 50, 1).otherwise(0))
    return tidy(O.attribution(rows, "event_type", "won", "value"), 6, revenue=2, revenue_per_conversion=4)


def _clin(prev):
    ppv = "tp / (tp + fp)" if prev is None else f"se * {prev} / (se * {prev} + (1 - sp) * (1 - {prev}))"
    npv = "tn / (tn + fn)" if prev is None else f"sp * (1 - {prev}) / (sp * (1 - {prev}) + (1 - se) * {prev})"
    p = "(tp + fn) / (tp + tn + fp + fn)" if prev is None else str(prev)
    return f"""WITH {_SCORED}, c AS (SELECT sum((prediction = 1 AND label = 1)::INTEGER)::DOUBLE AS tp, sum((prediction = 0 AND label = 0)::INTEGER)::DOUBLE AS tn,
      sum((prediction = 1 AND label = 0)::INTEGER)::DOUBLE AS fp, sum((prediction = 0 AND label = 1)::INTEGER)::DOUBLE AS fn FROM scored), s AS (SELECT *, tp / (tp + fn) AS se, tn / (tn + fp) AS sp FROM c)
      SELECT {r('se')} AS sensitivity, {r('sp')} AS specificity, {r(ppv)} AS ppv, {r(npv)} AS npv, {r('se / (1 - sp)')} AS lr_positive, {r('(1 - se) / sp')} AS lr_negative,
        {r('1 / (tp / (tp + fp) - fn / (fn + tn))', 4)} AS nnt, {r(f'1 / (se * {p})', 4)} AS nns, {r(p)} AS prevalence FROM s"""


@query("clinical_metrics", _clin(None))
def _(t):
    return tidy(H.clinical_metrics(scored(t), "label", "prediction"), nnt=4, nns=4)


@query("clinical_metrics_prevalence", _clin(0.2))
def _(t):
    return tidy(H.clinical_metrics(scored(t), "label", "prediction", 0.2), nnt=4, nns=4)


@query("cost_threshold", f"""WITH {_SCORED}, {_RANKED} SELECT {r('score')} AS threshold, {r('10 * (np - tp) + fp')} AS cost FROM k ORDER BY 10 * (np - tp) + fp, score DESC LIMIT 1""")
def _(t):
    return tidy(O.cost_threshold(scored(t), "label", "score", 10, 1))


# ---- dispatcher and matrices -------------------------------------------------------------

_KS_GINI = f"""{_RANKED}, best AS (SELECT abs(tp / np - fp / nq) AS ks, score FROM k ORDER BY round(abs(tp / np - fp / nq), 12) DESC, score DESC LIMIT 1),
    g AS (SELECT {_AUC} AS auc FROM k)"""


@query("domain_metrics", f"""WITH {_SCORED}, {_KS_GINI}
    SELECT 'ks_statistic' AS metric, 'ks_statistic' AS measure, {r('ks')} AS value, NULL::VARCHAR AS note FROM best
    UNION ALL SELECT 'ks_statistic', 'ks_threshold', {r('score')}, NULL FROM best
    UNION ALL SELECT 'gini_coefficient', 'gini', {r('2 * auc - 1')}, NULL FROM g UNION ALL SELECT 'gini_coefficient', 'auc', {r('auc')}, NULL FROM g
    UNION ALL SELECT 'gini_coefficient', 'band', NULL, CASE WHEN 2 * auc - 1 >= 0.6 THEN 'excellent' WHEN 2 * auc - 1 >= 0.4 THEN 'good'
      WHEN 2 * auc - 1 >= 0.2 THEN 'moderate' ELSE 'poor' END FROM g""")
def _(t):
    return tidy(X.domain_metrics(scored(t), "finance", "label", "prediction", "score").where("metric <> 'psi'"))


@query("cohort_matrix", """WITH m AS (SELECT DISTINCT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m FROM orders),
    f AS (SELECT o_custkey, m, min(m) OVER (PARTITION BY o_custkey) AS c FROM m), g AS (SELECT c, m - c AS period, count(*) AS n FROM f GROUP BY 1, 2)
    SELECT printf('%04d-%02d', c // 12, c % 12 + 1) AS cohort, """ + ", ".join(
    r(f"sum(n) FILTER (WHERE period = {i}) * 1.0 / sum(n) FILTER (WHERE period = 0)") + f' AS "{i}"' for i in range(6)) + """
    FROM g GROUP BY c""")
def _(t):
    """The first six periods as columns."""
    return tidy(X.as_matrix(C.cohort_retention(t.orders, "o_custkey", "o_orderdate"), "cohort", "period", "retention", range(6)))


@query("vintage_matrix", """WITH v AS (SELECT strftime(o_orderdate, '%Y-%m') AS cohort, o_orderstatus AS s, l_quantity AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT cohort, """ + ", ".join(r(f"avg(y) FILTER (WHERE s = '{x}')") + f' AS "{x}"' for x in "FOP") + " FROM v GROUP BY 1")
def _(t):
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(
        F.date_format("o_orderdate", "yyyy-MM").alias("cohort"), "o_orderstatus").agg(F.avg("l_quantity").alias("y"))
    return tidy(X.as_matrix(rows, "cohort", "o_orderstatus", "y"))
