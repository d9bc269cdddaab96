"""Encoders, scalers, transforms, new features, imputation and selection over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import create as N
from quarrylens.operators import encode as E
from quarrylens.operators import impute as I
from quarrylens.operators import scale as X
from quarrylens.operators import select as L
from quarrylens.operators import sequence as Q
from quarrylens.operators import text as B
from quarrylens.operators.operations import attrition_features
from quarrylens.operators.health import readmission_features
from quarrylens.plans.queries_profile import _GAPPY_SQL, gappy
from quarrylens.plans.registry import query, r, tidy

_CAT_SQL = "cat AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS seg, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS y FROM customer)"


def cat(t):
    return t.customer.select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("seg"),
                             F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("y"))


_SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", f"WITH {_CAT_SQL} SELECT c_custkey, y, " + ", ".join(
    f"CASE WHEN seg = '{s}' THEN 1 ELSE 0 END AS seg_{s}" for s in _SEGMENTS) + " FROM cat")
def _(t):
    return E.one_hot(cat(t), ["seg"])


@query("target_encode", f"WITH {_CAT_SQL}, g AS (SELECT seg, count(*) AS n, avg(y) AS m FROM cat WHERE seg IS NOT NULL GROUP BY 1), "
       f"a AS (SELECT avg(y) AS m FROM cat) SELECT c_custkey, {r('(g.n * g.m + 10 * a.m) / (g.n + 10)')} AS seg, y FROM cat LEFT JOIN g USING (seg) CROSS JOIN a")
def _(t):
    return tidy(E.target_encode(cat(t), ["seg"], "y"))


_CODE = "(SELECT seg AS k, row_number() OVER (ORDER BY seg) - 1 AS code FROM (SELECT DISTINCT seg FROM cat WHERE seg IS NOT NULL)) d"


@query("ordinal_encode", f"WITH {_CAT_SQL} SELECT c_custkey, code AS seg, y FROM cat LEFT JOIN {_CODE} ON seg = k")
def _(t):
    return E.ordinal_encode(cat(t), ["seg"])


@query("ordinal_encode_given", f"WITH {_CAT_SQL} SELECT c_custkey, CASE seg WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 END::BIGINT AS seg, y FROM cat")
def _(t):
    return E.ordinal_encode(cat(t), ["seg"], {"seg": ["MACHINERY", "BUILDING"]}).withColumn("seg", F.col("seg").cast("bigint"))


@query("label_encode", f"WITH {_CAT_SQL} SELECT c_custkey, coalesce(code, -1) AS seg, y FROM cat LEFT JOIN {_CODE} ON seg = k")
def _(t):
    return E.label_encode(cat(t), ["seg"])


@query("binary_encode", f"WITH {_CAT_SQL}, c AS (SELECT c_custkey, y, coalesce(code + 1, 0)::BIGINT AS v FROM cat LEFT JOIN {_CODE} ON seg = k) "
       "SELECT c_custkey, y, (v & 1)::INTEGER AS seg_bin_0, ((v >> 1) & 1)::INTEGER AS seg_bin_1, ((v >> 2) & 1)::INTEGER AS seg_bin_2 FROM c")
def _(t):
    return E.binary_encode(cat(t), ["seg"])


@query("frequency_encode", f"SELECT p_partkey, {r('(count(*) OVER (PARTITION BY p_brand)) * 1.0 / (count(*) OVER ())')} AS p_brand FROM part")
def _(t):
    return tidy(E.frequency_encode(t.part.select("p_partkey", "p_brand"), ["p_brand"]))


@query("woe_encode", f"""WITH {_CAT_SQL}, g AS (SELECT seg, sum(y) AS e, count(*) AS n FROM cat WHERE seg IS NOT NULL GROUP BY 1), a AS (SELECT sum(y) AS e, count(*) AS n FROM cat)
    SELECT c_custkey, {r('ln(((g.e + 0.5) / (a.e + 0.5)) / ((g.n - g.e + 0.5) / (a.n - a.e + 0.5)))')} AS seg, y FROM cat LEFT JOIN g USING (seg) CROSS JOIN a""")
def _(t):
    return tidy(E.woe_encode(cat(t), ["seg"], "y"))


@query("hash_encode")
def _(t):
    return E.hash_encode(t.part.select("p_partkey", "p_brand"), ["p_brand"])


# ---- scaling and transforms ------------------------------------------------------------


@query("standard_scale", f"SELECT o_orderkey, {r('(o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()')} AS o_totalprice FROM orders")
def _(t):
    return tidy(X.standard_scale(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


@query("minmax_scale", f"SELECT o_orderkey, {r('(o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ())')} AS o_totalprice FROM orders")
def _(t):
    return tidy(X.minmax_scale(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


@query("robust_scale", f"""SELECT event_id, {r('(value - m) / (q3 - q1)')} AS value FROM events,
    (SELECT median(value) AS m, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)""")
def _(t):
    return tidy(X.robust_scale(t.events.select("event_id", "value"), ["value"]))


@query("normalize", f"""SELECT l_orderkey, l_linenumber, {r('l_quantity / sqrt(l_quantity ** 2 + l_discount ** 2)')} AS l_quantity,
    {r('l_discount / sqrt(l_quantity ** 2 + l_discount ** 2)')} AS l_discount FROM lineitem""")
def _(t):
    return tidy(X.normalize(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"]))


@query("log_transform", f"SELECT event_id, {r('ln(1 + value)')} AS value FROM events")
def _(t):
    return tidy(X.log_transform(t.events.select("event_id", "value"), ["value"]))


@query("log_transform_base", f"SELECT event_id, {r('log2(1 + value)')} AS value, {r('log10(1 + user_id)')} AS user_id FROM events")
def _(t):
    rows = X.log_transform(t.events.select("event_id", "value", "user_id"), ["value"], "log2")
    return tidy(X.log_transform(rows, ["user_id"], "log10"))


@query("box_cox")
def _(t):
    return tidy(X.box_cox(t.events.select("event_id", "value"), ["value"]), 4)


@query("yeo_johnson")
def _(t):
    return tidy(X.yeo_johnson(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]), 3)


def _peak(table, column, curve, bend):
    """Greatest log-likelihood per row, from a coarse grid of lambda and a fine one around its best point."""
    score = f"-ln(var_pop({curve})) / 2 + (any_value(lam) - 1) * avg({bend})"
    return f"""SELECT max(l) AS l FROM (
        WITH v AS MATERIALIZED (SELECT {column}::DOUBLE AS x FROM {table} WHERE {column} IS NOT NULL),
        c AS (SELECT lam, {score} AS l FROM v, (SELECT unnest(range(-8, 9)) / 4.0 + 1e-9 AS lam) GROUP BY lam),
        b AS (SELECT arg_max(lam, l) AS top FROM c),
        f AS (SELECT top + unnest(range(-200, 201)) / 800.0 AS lam FROM b)
        SELECT {score} AS l FROM v, f GROUP BY lam)"""


_YJ = "CASE WHEN x >= 0 THEN ((x + 1) ** lam - 1) / lam ELSE -((1 - x) ** (2 - lam) - 1) / (2 - lam) END"


@query("power_transform_likelihood", f"""SELECT 'c_acctbal' AS "column", 'yeo_johnson' AS method, {r('l', 4)} AS log_likelihood
      FROM ({_peak('customer', 'c_acctbal', _YJ, 'sign(x) * ln(1 + abs(x))')})
    UNION ALL SELECT 'p_retailprice', 'box_cox', {r('l', 4)} FROM ({_peak('part', 'p_retailprice', '(x ** lam - 1) / lam', 'ln(x)')})""")
def _(t):
    each = [X.power_transform_lambdas(df, [c], m).select("column", F.lit(m).alias("method"), (F.col("log_likelihood") / F.col("n")).alias(
        "log_likelihood")) for df, c, m in ((t.customer, "c_acctbal", "yeo_johnson"), (t.part, "p_retailprice", "box_cox"))]
    return tidy(each[0].unionByName(each[1]), 4)


@query("sqrt_transform", f"SELECT c_custkey, {r('sqrt(greatest(c_acctbal, 0))')} AS c_acctbal FROM customer")
def _(t):
    return tidy(X.sqrt_transform(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query("power_transform", f"SELECT p_partkey, {r('power(p_size, 1.5)')} AS p_size FROM part")
def _(t):
    return tidy(X.power_transform(t.part.select("p_partkey", "p_size"), ["p_size"], 1.5))


# ---- creation --------------------------------------------------------------------------


@query("polynomial", f"""SELECT l_orderkey, l_quantity, l_discount, {r('l_quantity * l_quantity')} AS "l_quantity^2",
    {r('l_quantity * l_discount')} AS "l_quantity l_discount", {r('l_discount * l_discount')} AS "l_discount^2" FROM lineitem""")
def _(t):
    return N.polynomial(t.lineitem.select("l_orderkey", "l_quantity", "l_discount"), ["l_quantity", "l_discount"]).select(
        "l_orderkey", "l_quantity", "l_discount", *[(F.round(F.col(f"`{c}`"), 6) + 0.0).alias(c)
                                                    for c in ("l_quantity^2", "l_quantity l_discount", "l_discount^2")])


@query("interactions", f"SELECT l_orderkey, {r('l_quantity * l_tax')} AS l_quantity_x_l_tax FROM lineitem")
def _(t):
    return tidy(N.interactions(t.lineitem, [("l_quantity", "l_tax")]).select("l_orderkey", "l_quantity_x_l_tax"))


_PARTS = """year({c})::INTEGER AS {c}_year, month({c})::INTEGER AS {c}_month, day({c})::INTEGER AS {c}_day, (isodow({c}) - 1)::INTEGER AS {c}_dow,
    quarter({c})::INTEGER AS {c}_quarter, CASE WHEN isodow({c}) >= 6 THEN 1 ELSE 0 END AS {c}_is_weekend"""


@query("date_parts", "SELECT o_orderkey, o_orderdate, " + _PARTS.format(c="o_orderdate") + " FROM orders")
def _(t):
    return N.date_parts(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("date_parts_hour", "SELECT event_id, " + _PARTS.format(c="ts") + ", hour(ts)::INTEGER AS ts_hour FROM events")
def _(t):
    return N.date_parts(t.events.select("event_id", "ts"), "ts").drop("ts")


@query("lag_features", f"""SELECT event_id, value, lag(value, 1) OVER (ORDER BY ts) AS value_lag_1, lag(value, 7) OVER (ORDER BY ts) AS value_lag_7 FROM events""")
def _(t):
    return Q.lag_features(t.events.select("event_id", "ts", "value"), "value", [1, 7], ["ts", "event_id"]).drop("ts")


@query("lag_features_by", "SELECT event_id, user_id, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts) AS value_lag_2 FROM events")
def _(t):
    rows = t.events.select("event_id", "user_id", "ts", "value")
    return Q.lag_features(rows, "value", [2], ["ts", "event_id"], by=["user_id"], block_rows=16).select("event_id", "user_id", "value_lag_2")


def _roll(w, part=""):
    f = f"OVER ({part}ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return (f"{r(f'avg(value) {f}')} AS value_rolling_{w}_mean, {r(f'stddev_samp(value) {f}', 4)} AS value_rolling_{w}_std, "
            f"{r(f'max(value) {f}')} AS value_rolling_{w}_max")


@query("rolling_features", f"SELECT event_id, {_roll(3)}, {_roll(10)} FROM events")
def _(t):
    rows = Q.rolling_features(t.events.select("event_id", "ts", "value"), "value", [3, 10], ["ts", "event_id"], ["mean", "std", "max"],
                              block_rows=1000)
    return tidy(rows.drop("ts", "value"), value_rolling_3_std=4, value_rolling_10_std=4)


@query("rolling_features_by", f"SELECT event_id, {_roll(5, 'PARTITION BY user_id ')} FROM events")
def _(t):
    rows = Q.rolling_features(t.events.select("event_id", "user_id", "ts", "value"), "value", [5], ["ts", "event_id"], ["mean", "std", "max"],
                              by=["user_id"])
    return tidy(rows.drop("ts", "value", "user_id"), value_rolling_5_std=4)


@query("bin_quantile", f"""WITH e AS (SELECT quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM events)
    SELECT event_id, greatest(len(list_filter(q, lambda x: x < value)), 1)::INTEGER AS value_bin, {r('q[greatest(len(list_filter(q, lambda x: x < value)), 1)]', 4)} AS value_lo,
      {r('q[greatest(len(list_filter(q, lambda x: x < value)), 1) + 1]', 4)} AS value_hi FROM events, e""")
def _(t):
    return tidy(N.bin_quantile(t.events.select("event_id", "value"), "value").drop("value"), 4)


@query("bin_uniform", """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    b AS (SELECT o_orderkey, (o_totalprice <= lo)::INTEGER + (o_totalprice > lo)::INTEGER + (o_totalprice > lo + 1 * (hi - lo) / 4)::INTEGER
      + (o_totalprice > lo + 2 * (hi - lo) / 4)::INTEGER + (o_totalprice > lo + 3 * (hi - lo) / 4)::INTEGER AS b FROM orders, e)
    SELECT o_orderkey, b AS o_totalprice_bin, (['low', 'mid', 'high', 'top'])[b] AS o_totalprice_label FROM b""")
def _(t):
    return N.bin_uniform(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 4, ["low", "mid", "high", "top"]).select(
        "o_orderkey", "o_totalprice_bin", "o_totalprice_label")


@query("ratio", f"SELECT l_orderkey, {r('l_tax / nullif(l_discount, 0)')} AS l_tax_over_l_discount FROM lineitem")
def _(t):
    return tidy(N.ratio(t.lineitem, "l_tax", "l_discount").select("l_orderkey", "l_tax_over_l_discount"))


@query("text_length", f"""WITH w AS (SELECT doc_id, length(text)::INTEGER AS c, len(regexp_extract_all(text, '\\S+'))::INTEGER AS w FROM documents)
    SELECT doc_id, c AS text_char_count, w AS text_word_count, {r('CASE WHEN w > 0 THEN c * 1.0 / w ELSE 0 END')} AS text_avg_word_len FROM w""")
def _(t):
    return tidy(N.text_length(t.documents.select("doc_id", "text"), "text").drop("text"))


@query("missing_indicators", f"WITH {_GAPPY_SQL} SELECT c_custkey, (bal IS NULL)::INTEGER AS bal_missing, (seg IS NULL)::INTEGER AS seg_missing FROM gappy")
def _(t):
    return N.missing_indicators(gappy(t), ["bal", "seg"]).select("c_custkey", "bal_missing", "seg_missing")


@query("interpolate_linear", f"""WITH {_GAPPY_SQL}, s AS (SELECT c_custkey AS i, bal,
      max(CASE WHEN bal IS NOT NULL THEN c_custkey END) OVER (ORDER BY c_custkey) AS a, min(CASE WHEN bal IS NOT NULL THEN c_custkey END) OVER (ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM gappy),
    f AS (SELECT s.*, x.bal AS va, y.bal AS vb FROM s LEFT JOIN gappy x ON x.c_custkey = s.a LEFT JOIN gappy y ON y.c_custkey = s.b)
    SELECT i AS c_custkey, {r('CASE WHEN bal IS NOT NULL THEN bal WHEN a IS NULL THEN NULL WHEN b IS NULL THEN va ELSE va + (vb - va) * (i - a) * 1.0 / (b - a) END', 4)} AS bal FROM f""")
def _(t):
    return tidy(N.interpolate_linear(gappy(t).select("c_custkey", "bal"), "bal", ["c_custkey"]), 4)


@query("velocity", f"""SELECT event_id, count(*) OVER w AS value_count_24h, {r('sum(value) OVER w', 4)} AS value_sum_24h FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)""")
def _(t):
    return tidy(N.velocity(t.events.select("event_id", "user_id", "ts", "value"), "user_id", "ts", "value", [24]).drop("user_id", "ts", "value"), 4)


_HOT = "CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END"


@query("velocity_hot", f"""SELECT event_id, count(*) OVER a AS value_count_1h, {r('sum(value) OVER a', 4)} AS value_sum_1h,
      count(*) OVER b AS value_count_24h, {r('sum(value) OVER b', 4)} AS value_sum_24h FROM (SELECT *, {_HOT} AS entity FROM events)
    WINDOW a AS (PARTITION BY entity ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW),
      b AS (PARTITION BY entity ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)""")
def _(t):
    entity = F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id"))
    rows = t.events.select("event_id", entity.alias("entity"), "ts", "value")
    return tidy(N.velocity(rows, "entity", "ts", "value").drop("entity", "ts", "value"), 4)


# ---- texts ----------------------------------------------------------------------------------

_TERMS = r"""terms AS (SELECT doc_id, term, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY 1, 2)"""


@query("tfidf_terms", f"""WITH {_TERMS}, f AS (SELECT term, count(*) AS df FROM terms GROUP BY 1), d AS (SELECT count(*) AS d FROM documents),
    w AS (SELECT doc_id, term, n, df, ln((1 + d) / (1.0 + df)) + 1 AS idf FROM terms JOIN f USING (term), d WHERE df >= 2 AND df <= d * 0.5)
    SELECT doc_id, term, n, df, {r('idf')} AS idf, {r('n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY doc_id))')} AS weight FROM w""")
def _(t):
    return tidy(B.tfidf_terms(t.documents, "doc_id", "text", min_df=2, max_share=0.5))


def _sentiment_sql():
    listed = lambda names: "[" + ", ".join(f"'{w}'" for w in names) + "]"
    turned = f"i > 1 AND list_contains({listed(B.NEGATIONS)}, w[i - 1])"
    sign = f"""CASE WHEN list_contains({listed(B.POSITIVE)}, w[i]) THEN CASE WHEN {turned} THEN -1 ELSE 1 END
        WHEN list_contains({listed(B.NEGATIVE)}, w[i]) THEN CASE WHEN {turned} THEN 1 ELSE -1 END ELSE 0 END"""
    return rf"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM conversations),
      s AS (SELECT conv_id, turn, list_transform(range(1, len(w) + 1), lambda i: {sign}) AS s FROM t),
      c AS (SELECT conv_id, turn, len(list_filter(s, lambda x: x > 0))::INTEGER AS p, len(list_filter(s, lambda x: x < 0))::INTEGER AS n FROM s)
    SELECT conv_id, turn, p AS text_positive, n AS text_negative, {r('CASE WHEN p + n > 0 THEN (p - n) * 1.0 / (p + n) ELSE 0 END')} AS text_sentiment FROM c"""


@query("sentiment", _sentiment_sql())
def _(t):
    return tidy(B.sentiment(t.conversations, "text").select("conv_id", "turn", "text_positive", "text_negative", "text_sentiment"))


@query("term_statistics", f"WITH {_TERMS} SELECT term, count(*) AS df, sum(n)::BIGINT AS n FROM terms GROUP BY 1")
def _(t):
    return B.term_statistics(t.documents, "doc_id", "text")


# ---- imputation and selection ----------------------------------------------------------


@query("impute_mean", f"WITH {_GAPPY_SQL} SELECT c_custkey, {r('coalesce(bal, (SELECT avg(bal) FROM gappy))', 4)} AS bal FROM gappy")
def _(t):
    return tidy(I.impute_mean(gappy(t).select("c_custkey", "bal"), ["bal"]), 4)


@query("impute_median", f"WITH {_GAPPY_SQL} SELECT c_custkey, {r('coalesce(bal, (SELECT median(bal) FROM gappy))', 4)} AS bal, coalesce(nat, (SELECT median(nat) FROM gappy))::DOUBLE AS nat FROM gappy")
def _(t):
    return tidy(I.impute_median(gappy(t).drop("seg"), ["bal", "nat"]), 4)


@query("impute_mode", f"WITH {_GAPPY_SQL} SELECT c_custkey, coalesce(nat, (SELECT nat FROM gappy WHERE nat IS NOT NULL GROUP BY nat ORDER BY count(*) DESC, nat LIMIT 1)) AS nat FROM gappy")
def _(t):
    return I.impute_mode(gappy(t).select("c_custkey", "nat"), ["nat"])


@query("impute_knn", f"""WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_acctbal END AS bal, c_nationkey::DOUBLE AS nat FROM customer),
    d AS (SELECT q.c_custkey AS k, i.bal, row_number() OVER (PARTITION BY q.c_custkey ORDER BY sqrt(2.0 * (q.nat - i.nat) ** 2), i.c_custkey) AS rn
      FROM g q, g i WHERE q.bal IS NULL AND i.bal IS NOT NULL), f AS (SELECT k, avg(bal) AS v FROM d WHERE rn <= 5 GROUP BY k)
    SELECT c_custkey, {r('coalesce(bal, v)', 4)} AS bal, nat FROM g LEFT JOIN f ON k = c_custkey""")
def _(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 50 != 0, F.col("c_acctbal")).alias("bal"),
                             F.col("c_nationkey").cast("double").alias("nat"))
    return tidy(I.impute_knn(rows, ["bal", "nat"], ["bal"], key="c_custkey"), 4)


@query("drop_low_variance", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(t):
    return L.drop_low_variance(t.lineitem.select("l_orderkey", "l_quantity", "l_discount", "l_tax"), 0.01)


@query("column_variances", f"""SELECT 'l_discount' AS "column", {r('var_pop(l_discount)')} AS variance FROM lineitem UNION ALL
    SELECT 'l_quantity', {r('var_pop(l_quantity)')} FROM lineitem""")
def _(t):
    return tidy(L.column_variances(t.lineitem, ["l_discount", "l_quantity"]))


@query("select_by_importance")
def _(t):
    rows = t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag")
    return tidy(L.select_by_importance(rows, "l_extendedprice", 2, trees=10))


@query("readmission_features", f"""WITH e AS (SELECT event_id, user_id, ts, ts + to_hours((event_id % 200)::INTEGER) AS done FROM events),
    l AS (SELECT *, floor(date_diff('microsecond', ts, done) / 86400000000)::BIGINT AS los FROM e)
    SELECT event_id, los AS length_of_stay, row_number() OVER w - 1 AS prior_admissions_count,
      floor(date_diff('microsecond', lag(ts) OVER w, ts) / 86400000000)::BIGINT AS days_since_last_admission, {r('avg(los) OVER w')} AS avg_length_of_stay
    FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def _(t):
    rows = t.events.select("event_id", "user_id", "ts", (F.col("ts") + F.make_interval(hours=(F.col("event_id") % 200).cast("int"))).alias("done"))
    return tidy(readmission_features(rows, "user_id", "event_id", "ts", "done").drop("user_id", "ts", "done"))


@query("attrition_features", f"""WITH c AS (SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate, floor(date_diff('microsecond', o_orderdate, TIMESTAMP '2002-01-01') / 86400000000)::BIGINT AS d FROM orders)
    SELECT o_orderkey, d AS tenure_days, {r('d / 365.25', 2)} AS tenure_years, round(d / 365.25, 2) > 3 AS is_long_tenure,
      {r('o_totalprice / avg(o_totalprice) OVER (PARTITION BY o_orderpriority)', 3)} AS salary_ratio_to_dept_avg, count(*) OVER (PARTITION BY o_orderpriority) AS department_size FROM c""")
def _(t):
    out = attrition_features(t.orders, "o_orderdate", "o_orderpriority", "o_totalprice", "2002-01-01")
    return tidy(out.select("o_orderkey", "tenure_days", "tenure_years", "is_long_tenure", "salary_ratio_to_dept_avg", "department_size"), 3)
