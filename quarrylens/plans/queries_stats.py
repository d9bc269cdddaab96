"""Hypothesis tests, correlations and survival analysis over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import correlation as K
from quarrylens.operators import stats_tests as T
from quarrylens.operators import survival as V
from quarrylens.plans.battery import test_battery
from quarrylens.plans.registry import query, r, tidy

_MID = "rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0"


def _pick(df, *cols):
    return tidy(df.select(*cols))


@query("t_test_independent", f"""WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1),
    w AS (SELECT arg_min(n, g) AS n1, arg_max(n, g) AS n2, arg_min(m, g) - arg_max(m, g) AS d, arg_min(v, g) AS v1, arg_max(v, g) AS v2 FROM g)
    SELECT n1, n2, {r('d / sqrt(v1 / n1 + v2 / n2)')} AS statistic, {r('d / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))')} AS effect_size,
      {r('(v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))', 4)} AS dof FROM w""")
def _(t):
    return tidy(T.t_test_independent(t.lineitem, "l_extendedprice", "l_linestatus").select(
        "n1", "n2", "statistic", "effect_size", "dof"), dof=4)


@query("t_test_paired", f"""SELECT count(*) AS n, {r('avg(l_discount - l_tax)')} AS mean_diff,
    {r('avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*)))', 4)} AS statistic,
    {r('avg(l_discount - l_tax) / stddev_samp(l_discount - l_tax)')} AS effect_size FROM lineitem""")
def _(t):
    return tidy(T.t_test_paired(t.lineitem, "l_discount", "l_tax").select("n", "mean_diff", "statistic", "effect_size"), statistic=4)


@query("mann_whitney_u", f"""WITH s AS (SELECT l_linestatus AS g, {_MID.replace('x', 'l_quantity')} AS rk FROM lineitem),
    a AS (SELECT sum(rk) FILTER (WHERE g = 'F') AS r1, count(*) FILTER (WHERE g = 'F') AS n1, count(*) FILTER (WHERE g = 'O') AS n2 FROM s)
    SELECT {r('r1 - n1 * (n1 + 1) / 2.0', 2)} AS statistic, {r('1 - 2 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2)')} AS effect_size,
      n1::DOUBLE AS n1, n2::DOUBLE AS n2 FROM a""")
def _(t):
    return tidy(T.mann_whitney_u(t.lineitem, "l_quantity", "l_linestatus").select("statistic", "effect_size", "n1", "n2"), statistic=2)


def _chi_sql(a, b, table, yates):
    core = ("greatest(abs(o - e) - 0.5, 0) * greatest(abs(o - e) - 0.5, 0) / e" if yates else "(o - e) * (o - e) / e")
    return f"""WITH rs AS (SELECT {a} AS a, count(*) AS ra FROM {table} GROUP BY 1), cs AS (SELECT {b} AS b, count(*) AS cb FROM {table} GROUP BY 1),
      n AS (SELECT count(*) AS n FROM {table}), c AS (SELECT rs.a, cs.b, ra * cb * 1.0 / n AS e, coalesce(o, 0) AS o FROM rs CROSS JOIN cs CROSS JOIN n
        LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {table} GROUP BY 1, 2) x ON x.a = rs.a AND x.b = cs.b)
      SELECT {r(f'sum({core})')} AS statistic, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1)) AS dof, sum(o)::BIGINT AS n,
        {r(f'sqrt(sum({core}) / (sum(o) * (least(count(DISTINCT a), count(DISTINCT b)) - 1)))')} AS cramers_v FROM c"""


@query("chi_square", _chi_sql("o_orderstatus", "o_orderpriority", "orders", False))
def _(t):
    return _pick(T.chi_square(t.orders, "o_orderstatus", "o_orderpriority"), "statistic", "dof", "n", "cramers_v")


_BIN = "(SELECT CASE WHEN l_linestatus = 'F' THEN 'f' ELSE 'o' END AS a, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS b FROM lineitem)"


@query("chi_square_yates", _chi_sql("a", "b", _BIN, True))
def _(t):
    rows = t.lineitem.select(F.when(F.col("l_linestatus") == "F", "f").otherwise("o").alias("a"),
                             F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("b"))
    return _pick(T.chi_square(rows, "a", "b"), "statistic", "dof", "n", "cramers_v")


@query("expected_frequencies", f"""WITH x AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS observed FROM orders GROUP BY 1, 2)
    SELECT a, b, observed, {r('sum(observed) OVER (PARTITION BY a) * sum(observed) OVER (PARTITION BY b) / sum(observed) OVER ()')} AS expected FROM x""")
def _(t):
    return tidy(T.expected_frequencies(t.orders, "o_orderstatus", "o_orderpriority"))


@query("fisher_exact", f"""SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0)::DOUBLE AS n00, count(*) FILTER (WHERE quality = 0 AND toxic = 1)::DOUBLE AS n01,
    count(*) FILTER (WHERE quality = 1 AND toxic = 0)::DOUBLE AS n10, count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE AS n11,
    {r('count(*) FILTER (WHERE quality = 0 AND toxic = 0) * count(*) FILTER (WHERE quality = 1 AND toxic = 1) * 1.0 / (count(*) FILTER (WHERE quality = 0 AND toxic = 1) * count(*) FILTER (WHERE quality = 1 AND toxic = 0))')} AS odds_ratio
    FROM labels""")
def _(t):
    return _pick(T.fisher_exact(t.labels, "quality", "toxic"), "n00", "n01", "n10", "n11", "odds_ratio")


_ANOVA = """WITH s AS (SELECT {x} AS x, {g} AS g FROM {src}), k AS (SELECT g, count(*) AS n, avg(x) AS m FROM s GROUP BY g), a AS (SELECT avg(x) AS m, count(*) AS n FROM s),
    q AS (SELECT (SELECT sum(k.n * (k.m - a.m) ** 2) FROM k, a) AS b, (SELECT sum((s.x - k.m) ** 2) FROM s JOIN k USING (g)) AS w, (SELECT count(*) FROM k) AS k, (SELECT n FROM a) AS n)"""


@query("anova_oneway", _ANOVA.format(x="o_totalprice", g="o_orderpriority", src="orders")
       + f" SELECT k, n, {r('(b / (k - 1)) / (w / (n - k))')} AS f_statistic, {r('b / (b + w)')} AS eta_squared FROM q")
def _(t):
    return _pick(T.anova_oneway(t.orders, "o_totalprice", "o_orderpriority"), "k", "n", "f_statistic", "eta_squared")


@query("kruskal_wallis", f"""WITH s AS (SELECT o_orderpriority AS g, o_totalprice AS x, {_MID.replace('x', 'o_totalprice')} AS rk FROM orders),
    k AS (SELECT g, count(*) AS n, sum(rk) AS rs FROM s GROUP BY g), t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM s GROUP BY x)),
    h AS (SELECT (12.0 / (sum(n) * (sum(n) + 1)) * sum(rs * rs / n) - 3 * (sum(n) + 1)) / (1 - any_value(ties) / (sum(n)::DOUBLE ** 3 - sum(n))) AS h, count(*) AS k, sum(n)::DOUBLE AS n FROM k, t)
    SELECT k, n, {r('h')} AS h_statistic, {r('h / ((n * n - 1) / (n + 1))', 8)} AS epsilon_squared FROM h""")
def _(t):
    return tidy(T.kruskal_wallis(t.orders, "o_totalprice", "o_orderpriority").select("k", "n", "h_statistic", "epsilon_squared"), epsilon_squared=8)


@query("shapiro_wilk")
def _(t):
    return tidy(T.shapiro_wilk(t.events, ["value", "user_id"], "event_id"))


@query("levene", _ANOVA.format(x="abs(c_acctbal - (SELECT median(c_acctbal) FROM customer i WHERE i.c_mktsegment = o.c_mktsegment))",
                               g="c_mktsegment", src="customer o") + f" SELECT k, n, {r('(b / (k - 1)) / (w / (n - k))')} AS statistic FROM q")
def _(t):
    return _pick(T.levene(t.customer, "c_acctbal", "c_mktsegment"), "k", "n", "statistic")


@query("pearson", f"SELECT 'l_quantity' AS col1, 'l_extendedprice' AS col2, {r('corr(l_quantity, l_extendedprice)')} AS r, count(*) AS n FROM lineitem")
def _(t):
    return _pick(K.correlation_test(t.lineitem, "l_quantity", "l_extendedprice"), "col1", "col2", "r", "n")


@query("spearman", f"""WITH s AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
      rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
    SELECT 'l_quantity' AS col1, 'l_extendedprice' AS col2, {r('corr(a, b)')} AS r, count(*) AS n FROM s""")
def _(t):
    return _pick(K.correlation_test(t.lineitem, "l_quantity", "l_extendedprice", "spearman"), "col1", "col2", "r", "n")


def _matrix_sql(cols, table):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col1, '{b}' AS col2, {'1.0' if a == b else r(f'corr({a}, {b})')} AS r FROM {table}"
        + (" GROUP BY ALL" if a == b else "") for a in cols for b in cols)


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_matrix", " UNION ALL ".join(
    (f"SELECT '{a}' AS col1, '{b}' AS col2, {r(f'corr({a}, {b})')} AS r FROM lineitem" if a != b
     else f"SELECT '{a}' AS col1, '{b}' AS col2, 1.0::DOUBLE AS r") for a in _COLS for b in _COLS))
def _(t):
    return tidy(K.correlation_matrix(t.lineitem, _COLS))


_RANKED = [*_COLS, "l_linenumber"]


@query("correlation_matrix_spearman", "WITH k AS MATERIALIZED (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _RANKED) + " FROM lineitem) " + " UNION ALL ".join(
    (f"SELECT '{a}' AS col1, '{b}' AS col2, {r(f'corr({a}, {b})')} AS r FROM k" if a != b
     else f"SELECT '{a}' AS col1, '{b}' AS col2, 1.0::DOUBLE AS r") for a in _RANKED for b in _RANKED))
def _(t):
    return tidy(K.correlation_matrix(t.lineitem, _RANKED, "spearman"))


def _tau(a, b):
    """Tau-b of two columns of few values, through their counted pairs."""
    return f"""SELECT '{a}' AS col1, '{b}' AS col2, {r('s / sqrt((n0 - tx) * (n0 - ty))')} AS r FROM (
        WITH g AS (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2)
        SELECT (SELECT sum(a.n * b.n * sign(b.y - a.y)) FROM g a JOIN g b ON a.x < b.x) AS s, sum(n) * (sum(n) - 1) / 2 AS n0,
          (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(n) AS c FROM g GROUP BY x)) AS tx,
          (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(n) AS c FROM g GROUP BY y)) AS ty FROM g)"""


_FEW = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("correlation_matrix_kendall", " UNION ALL ".join(
    _tau(a, b) if a != b else f"SELECT '{a}' AS col1, '{b}' AS col2, 1.0::DOUBLE AS r" for a in _FEW for b in _FEW))
def _(t):
    return tidy(K.correlation_matrix(t.lineitem, _FEW, "kendall"))


@query("kendall", f"""WITH g AS (SELECT l_quantity AS x, l_discount AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
    p AS (SELECT sum(a.n * b.n * sign(b.y - a.y)) AS s FROM g a JOIN g b ON a.x < b.x),
    q AS (SELECT sum(n) * (sum(n) - 1) / 2 AS n0, (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(n) AS c FROM g GROUP BY x)) AS tx,
      (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(n) AS c FROM g GROUP BY y)) AS ty, sum(n)::BIGINT AS n FROM g)
    SELECT 'l_quantity' AS col1, 'l_discount' AS col2, {r('s / sqrt((n0 - tx) * (n0 - ty))')} AS r, n FROM p, q""")
def _(t):
    return tidy(K.kendall(t.lineitem, "l_quantity", "l_discount"))


@query("high_pairs", f"""SELECT * FROM (SELECT 'l_extendedprice' AS col1, 'gross' AS col2, {r('corr(l_extendedprice, l_extendedprice * (1 + l_tax))')} AS r FROM lineitem) x
    WHERE abs(r) > 0.8""".replace("'l_extendedprice' AS col1, 'gross' AS col2", "'gross' AS col1, 'l_extendedprice' AS col2"))
def _(t):
    rows = t.lineitem.select("l_discount", "l_extendedprice", (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross"))
    return tidy(K.high_pairs(K.correlation_matrix(rows)))


def _ks_sql(cdf):
    return f"""WITH f AS (SELECT avg(value) AS mu, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events),
      c AS (SELECT value AS x, count(*) AS k FROM events GROUP BY 1), s AS (SELECT x, k, sum(k) OVER (ORDER BY x) AS upto FROM c)
      SELECT {r(f'max(greatest(upto * 1.0 / n - ({cdf}), ({cdf}) - (upto - k) * 1.0 / n))')} AS ks_statistic, any_value(n) AS n FROM s, f"""


@query("ks_one_sample_expon", _ks_sql("1 - exp(-(x - lo) / (mu - lo))"))
def _(t):
    return _pick(T.ks_one_sample(t.events, "value", "expon"), "ks_statistic", "n")


@query("ks_one_sample_uniform", _ks_sql("(x - lo) / (hi - lo)"))
def _(t):
    return _pick(T.ks_one_sample(t.events, "value", "uniform"), "ks_statistic", "n")


@query("ks_one_sample_norm")
def _(t):
    return tidy(T.ks_one_sample(t.orders, "o_totalprice"))


@query("vif", f"""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS p FROM lineitem) SELECT 'l_quantity' AS "column", {r('1 / (1 - p * p)')} AS vif, 1 / (1 - p * p) > 10 AS high FROM c
    UNION ALL SELECT 'l_extendedprice', {r('1 / (1 - p * p)')}, 1 / (1 - p * p) > 10 FROM c""")
def _(t):
    return tidy(K.vif(t.lineitem, ["l_quantity", "l_extendedprice"]))


# ---- survival: days between order and shipping, both counted, so every line has a duration; received lines are events ----

_SURV = """surv AS (SELECT l_orderkey, abs(date_diff('day', o_orderdate, l_shipdate))::DOUBLE + 1 AS days, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS event,
    l_linestatus AS grp, l_returnflag AS grp3, l_quantity, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def surv(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", (F.abs(F.date_diff("l_shipdate", "o_orderdate")) + 1).cast("double").alias("days"),
                       F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("event"), F.col("l_linestatus").alias("grp"),
                       F.col("l_returnflag").alias("grp3"), "l_quantity", "l_discount")


def _km_sql(by):
    part = "PARTITION BY grp " if by else ""
    g = "grp, " if by else ""
    name = 'grp AS "group", ' if by else ""
    return f"""WITH {_SURV}, d AS (SELECT {g}days AS time, count(*) AS n, sum(event)::BIGINT AS events FROM surv GROUP BY {g}days),
      k AS (SELECT *, (sum(n) OVER ({part}ORDER BY time DESC))::BIGINT AS at_risk FROM d),
      s AS (SELECT {name}time, at_risk, events, n - events AS censored,
        CASE WHEN bool_or(events = at_risk) OVER ({part}ORDER BY time) THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events * 1.0 / at_risk) ELSE 0 END) OVER ({part}ORDER BY time)) END AS v FROM k)
      SELECT {'"group", ' if by else ''}time, at_risk, events, censored, {r('v')} AS survival FROM s
      UNION ALL SELECT {'grp, ' if by else ''}0.0, max(at_risk), 0, 0, 1.0 FROM k {'GROUP BY grp' if by else ''}"""


@query("kaplan_meier", _km_sql(False))
def _(t):
    return tidy(V.kaplan_meier(surv(t), "days", "event"))


@query("kaplan_meier_groups", _km_sql(True))
def _(t):
    return tidy(V.kaplan_meier(surv(t), "days", "event", "grp"))


@query("median_survival", f"""WITH km AS ({_km_sql(True)}) SELECT "group", min(time) FILTER (WHERE survival <= 0.5) AS median_survival FROM km GROUP BY 1""")
def _(t):
    return V.median_survival(V.kaplan_meier(surv(t), "days", "event", "grp"))


@query("log_rank", f"""WITH {_SURV}, d AS (SELECT days AS time, count(*)::DOUBLE AS n, sum(event)::DOUBLE AS d, count(*) FILTER (WHERE grp = 'F')::DOUBLE AS n1, sum(event) FILTER (WHERE grp = 'F')::DOUBLE AS d1
      FROM surv GROUP BY 1), k AS (SELECT time, d, coalesce(d1, 0) AS d1, sum(n) OVER (ORDER BY time DESC) AS n, sum(n1) OVER (ORDER BY time DESC) AS n1 FROM d)
    SELECT {r('sum(d1 - d * n1 / n) ** 2 / sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * (n1 / n) * (1 - n1 / n) ELSE 0 END)', 4)} AS statistic, 1 AS dof FROM k""")
def _(t):
    return tidy(V.log_rank(surv(t), "days", "event", "grp").select("statistic", "dof"), 4)


@query("log_rank_groups", f"""WITH {_SURV}, d AS (SELECT days AS time, count(*)::DOUBLE AS n, count(*) FILTER (WHERE grp3 = 'A')::DOUBLE AS a,
      count(*) FILTER (WHERE grp3 = 'N')::DOUBLE AS b FROM surv GROUP BY 1),
    k AS (SELECT n AS d, a AS da, b AS db, sum(n) OVER w AS n, sum(a) OVER w AS a, sum(b) OVER w AS b FROM d WINDOW w AS (ORDER BY time DESC)),
    u AS (SELECT *, CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0 END AS s FROM k),
    m AS (SELECT sum(da - d * a / n) AS g, sum(db - d * b / n) AS h, sum(s * a / n * (1 - a / n)) AS x, sum(s * b / n * (1 - b / n)) AS z,
      -sum(s * a * b / n / n) AS y FROM u)
    SELECT {r('(g * g * z - 2 * g * h * y + h * h * x) / (x * z - y * y)', 4)} AS statistic, 2 AS dof FROM m""")
def _(t):
    return tidy(V.log_rank(surv(t).withColumn("event", F.lit(1)), "days", "event", "grp3").select("statistic", "dof"), 4)


@query("log_rank_many", f"""WITH {_SURV} SELECT count(DISTINCT l_quantity::VARCHAR)::INTEGER - 1 AS dof, TRUE AS fine FROM surv""")
def _(t):
    found = V.log_rank(surv(t), "days", "event", "l_quantity")
    return found.select("dof", ((F.col("statistic") > 0) & F.col("p_value").between(0, 1)).alias("fine"))


@query("cox_ph")
def _(t):
    return tidy(V.cox_ph(surv(t), "days", "event", ["l_quantity", "l_discount"]), 5)


@query("concordance_index", f"""WITH {_SURV}, p AS (SELECT days AS t, l_quantity AS q, sum(event)::DOUBLE AS e, count(*)::DOUBLE AS n FROM surv GROUP BY 1, 2),
    c AS (SELECT sum(a.e * b.n) FILTER (WHERE a.q > b.q) AS con, sum(a.e * b.n) FILTER (WHERE a.q < b.q) AS dis, sum(a.e * b.n) FILTER (WHERE a.q = b.q) AS tie FROM p a JOIN p b ON a.t < b.t)
    SELECT {r('(con + 0.5 * tie) / (con + dis + tie)')} AS c_index, con::BIGINT AS n_concordant, dis::BIGINT AS n_discordant, tie::BIGINT AS n_tied FROM c""")
def _(t):
    return tidy(V.concordance_index(surv(t), "days", "l_quantity", "event").select("c_index", "n_concordant", "n_discordant", "n_tied"))


@query("survival_summary", f"""WITH {_SURV} SELECT count(*) AS total_subjects, sum(event)::BIGINT AS total_events, (count(*) - sum(event))::BIGINT AS total_censored,
    {r('avg(CASE WHEN days >= 30 THEN 1.0 ELSE 0 END)', 4)} AS survival_rate_30d, {r('avg(CASE WHEN days >= 60 THEN 1.0 ELSE 0 END)', 4)} AS survival_rate_60d,
    {r('avg(CASE WHEN days >= 90 THEN 1.0 ELSE 0 END)', 4)} AS survival_rate_90d, {r('avg(CASE WHEN days >= 365 THEN 1.0 ELSE 0 END)', 4)} AS survival_rate_365d,
    {r('avg(days)', 4)} AS duration_mean, {r('stddev_samp(days)', 4)} AS duration_std, min(days) AS duration_min, max(days) AS duration_max,
    median(days) AS duration_median, median(days) FILTER (WHERE event = 1) AS median_survival_time FROM surv""")
def _(t):
    return tidy(V.survival_summary(surv(t), "days", "event"), 4)


@query("test_battery")
def _(t):
    rows = t.lineitem.select("l_linestatus", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    return tidy(test_battery(rows, "l_returnflag"), 4)
