"""NULL group keys, NaN values and integers above 2**53 in the operators that rank, fill, bin and count."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions.quantiles import quantiles
from quarrylens.operators import charts as G
from quarrylens.operators import correlation as K
from quarrylens.operators import operations as O
from quarrylens.operators import profile as P
from quarrylens.operators import sampling as S
from quarrylens.operators import sequence as Q
from quarrylens.operators.clean import handle_outliers
from quarrylens.operators.finance import psi_bins_b
from quarrylens.plans.registry import query, r, tidy

# ---- groups with a NULL key ------------------------------------------------------------

_GROUPS = """g AS (SELECT c_custkey, nullif(c_nationkey % 5, 0) AS grp, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS bal FROM customer)"""


def groups(t):
    return t.customer.select("c_custkey", F.nullif(F.col("c_nationkey") % 5, F.lit(0)).alias("grp"),
                             F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("bal"))


@query("fill_null_groups", f"WITH {_GROUPS} SELECT c_custkey, grp, last_value(bal IGNORE NULLS) OVER (PARTITION BY grp ORDER BY c_custkey) AS bal FROM g")
def _(t):
    return Q.fill(groups(t), ["bal"], ["c_custkey"], by=["grp"])


@query("running_null_groups", f"WITH {_GROUPS} SELECT c_custkey, grp, {r('coalesce(sum(bal) OVER (PARTITION BY grp ORDER BY c_custkey), 0)', 4)} AS total, row_number() OVER (PARTITION BY grp ORDER BY c_custkey) AS n FROM g")
def _(t):
    rows = Q.running(groups(t), {"total": F.col("bal"), "n": F.lit(1)}, ["c_custkey"], by=["grp"])
    return tidy(rows.drop("bal").withColumn("n", F.col("n").cast("bigint")), 4)


@query("box_null_groups", f"""WITH {_GROUPS}, q AS (SELECT grp::VARCHAR AS "group", quantile_cont(bal, 0.25) AS q1, quantile_cont(bal, 0.5) AS median, quantile_cont(bal, 0.75) AS q3, count(bal) AS n FROM g GROUP BY 1)
    SELECT "group", {r('q1', 4)} AS q1, {r('median', 4)} AS median, {r('q3', 4)} AS q3, n FROM q""")
def _(t):
    return tidy(G.box(groups(t), "bal", "grp").select("group", "q1", "median", "q3", "n"), 4)


@query("mtbf_null_groups", f"WITH {_GROUPS} SELECT grp, {r('avg(bal)', 4)} AS mtbf, {r('avg(c_custkey)', 4)} AS mttr, count(bal) AS total_failures, {r('median(bal)', 4)} AS mtbf_median FROM g GROUP BY 1")
def _(t):
    out = O.mtbf_mttr(groups(t).withColumn("bal", F.col("bal")), "bal", "c_custkey", ["grp"])
    return tidy(out.select("grp", "mtbf", "mttr", "total_failures", "mtbf_median"), 4)


@query("split_null_strata", f"WITH {_GROUPS} SELECT grp, round(0.2 * count(*))::BIGINT AS test_rows, count(*) AS all_rows FROM g GROUP BY 1")
def _(t):
    cut = S.train_test_split(groups(t), "c_custkey", stratify="grp")
    return cut.groupBy("grp").agg(F.count(F.when(F.col("split") == "test", 1)).alias("test_rows"), F.count(F.lit(1)).alias("all_rows"))


@query("sample_counts", """WITH n AS (SELECT c_mktsegment AS segment, count(*) AS n, (SELECT count(*) FROM customer) AS total FROM customer GROUP BY 1)
    SELECT segment, least(n, greatest(round(300 * n / total::DOUBLE), 1))::BIGINT AS stratified, least(total, 400)::BIGINT AS drawn FROM n""")
def _(t):
    """Class quotas of the stratified sample, beside the size of a random one; all rows come from the table, none twice."""
    keys = t.customer.select("c_custkey", "c_mktsegment")
    strat = S.sample_stratified(keys, 300, "c_mktsegment", "c_custkey").groupBy("c_mktsegment").agg(F.countDistinct("c_custkey").alias("stratified"))
    drawn = S.sample_random(keys, 400, "c_custkey").join(t.customer.select("c_custkey"), "c_custkey", "left_semi").agg(F.countDistinct("c_custkey"))
    return strat.select(F.col("c_mktsegment").alias("segment"), "stratified", drawn.scalar().alias("drawn"))


# ---- NaN is a missing value ------------------------------------------------------------

_NAN = """v AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS price, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS quantity,
    l_discount, l_tax, l_suppkey FROM lineitem)"""


def with_nan(t):
    gone = lambda c, n: F.when(F.col("l_linenumber") == n, F.lit(float("nan"))).otherwise(F.col(c))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", gone("l_extendedprice", 2).alias("price"),
                             gone("l_quantity", 3).alias("quantity"), "l_discount", "l_tax", "l_suppkey")


@query("quantiles_nan", f"""WITH {_NAN} SELECT l_returnflag, p AS prob, {r('quantile_cont(price, 0.5) FILTER (p = 0.5)', 4)} AS quantile FROM v, (VALUES (0.5::DOUBLE)) z(p) GROUP BY 1, 2
    UNION ALL SELECT l_returnflag, 0.9::DOUBLE, {r('quantile_cont(price, 0.9)', 4)} FROM v GROUP BY 1""")
def _(t):
    return tidy(quantiles(with_nan(t), "price", [0.5, 0.9], ["l_returnflag"]), 4)


@query("outliers_nan", f"""WITH {_NAN}, q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM v)
    SELECT 'price' AS "column", count(*) FILTER (price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a)) AS n_outliers FROM v, q""")
def _(t):
    return P.detect_outliers(with_nan(t), ["price"]).select("column", F.col("count").alias("n_outliers"))


@query("clip_nan", f"""WITH {_NAN}, q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM v)
    SELECT count(price) AS known, {r('sum(least(greatest(price, a - 1.5 * (b - a)), b + 1.5 * (b - a)))', 2)} AS total FROM v, q WHERE price IS NOT NULL""")
def _(t):
    return tidy(handle_outliers(with_nan(t), "price", "clip").agg(F.count("price").alias("known"), F.sum("price").alias("total")), 2)


@query("psi_nan", f"""WITH {_NAN}, e AS (SELECT price AS x, l_suppkey % 2 AS side FROM v WHERE price IS NOT NULL)
    SELECT 10::BIGINT AS bins, {r('min(x)', 4)} AS low, {r('max(x)', 4)} AS high FROM e WHERE side = 0""")
def _(t):
    """The bins reach from the smallest to the largest known value of the reference side."""
    rows = with_nan(t)
    out = psi_bins_b(rows.where("l_suppkey % 2 = 0"), rows.where("l_suppkey % 2 = 1"), "price")
    return tidy(out.agg(F.count(F.lit(1)).alias("bins"), F.min("lower").alias("low"), F.max("upper").alias("high")), 4)


_PAIRS = [("price", "quantity"), ("price", "l_discount")]


def _corr_sql(pairs):
    return f"WITH {_NAN} " + " UNION ALL ".join(
        f"SELECT '{a}' AS col1, '{b}' AS col2, {r(f'corr({a}, {b})')} AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM v" for a, b in pairs)


@query("pearson_nan", _corr_sql(_PAIRS))
def _(t):
    return tidy(K.pearson_pairs(with_nan(t), _PAIRS))


_MANY = [(a, b) for i, a in enumerate(["price", "quantity", "l_discount", "l_tax", "l_suppkey", "l_linenumber"])
         for b in ["price", "quantity", "l_discount", "l_tax", "l_suppkey", "l_linenumber"][i + 1:]]


@query("pearson_nan_many", _corr_sql(_MANY))
def _(t):
    return tidy(K.pearson_pairs(with_nan(t), _MANY))


# ---- integers above 2**53 --------------------------------------------------------------


@query("column_stats_large_keys", "SELECT 'big' AS \"column\", count(*) AS \"count\", count(DISTINCT o_orderkey + 9007199254740993) AS \"unique\", 0::BIGINT AS missing FROM orders")
def _(t):
    rows = t.orders.select((F.col("o_orderkey") + F.lit(9007199254740993)).alias("big"))
    return P.column_stats(rows).select("column", "count", F.col("unique").cast("bigint").alias("unique"), F.col("missing").cast("bigint").alias("missing"))
