"""Profiling, data quality, schemas and edge cases over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import edge_cases as E
from quarrylens.operators import profile as P
from quarrylens.operators import schema as S
from quarrylens.operators import sketches as K
from quarrylens.plans.registry import query, r, tidy
from quarrylens.session import cut_lineage

# A column with gaps, written the same way on both sides.
_GAPPY_SQL = ("gappy AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal, "
              "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS seg, "
              "CASE WHEN c_custkey % 10 < 6 THEN NULL ELSE c_nationkey END AS nat FROM customer)")


def gappy(t):
    k = F.col("c_custkey")
    return t.customer.select(
        "c_custkey", F.when(k % 7 != 0, F.col("c_acctbal")).alias("bal"),
        F.when(k % 2 != 0, F.col("c_mktsegment")).alias("seg"),
        F.when(k % 10 >= 6, F.col("c_nationkey")).alias("nat"))


def _num(c, table, gap="FALSE"):
    return f"""SELECT '{c}' AS "column", count({c}) AS "count", count(*) - count({c}) AS missing,
        {r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct, count(DISTINCT {c}) AS "unique",
        {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, min({c})::DOUBLE AS min,
        {r(f'quantile_cont({c}::DOUBLE, 0.25)')} AS q25, {r(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median,
        {r(f'quantile_cont({c}::DOUBLE, 0.75)')} AS q75, max({c})::DOUBLE AS max,
        {r(f'skewness({c})')} AS skew, {r(f'kurtosis({c})')} AS kurtosis,
        count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives,
        NULL::VARCHAR AS top, NULL::BIGINT AS top_freq FROM {table}"""


def _txt(c, table):
    return f"""SELECT '{c}', count({c}), count(*) - count({c}), {r(f'(count(*) - count({c})) * 100.0 / count(*)')},
        count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 0,
        (SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        (SELECT count(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1) FROM {table}"""


@query("column_stats", f"""WITH {_GAPPY_SQL} {_num('bal', 'gappy')} UNION ALL {_num('nat', 'gappy')}
    UNION ALL {_txt('seg', 'gappy')}""")
def _(t):
    return tidy(P.column_stats(gappy(t), ["bal", "nat", "seg"]).drop("dtype"), mean=4, std=4)


@query("top_values", """SELECT "column", value, n, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INTEGER AS rank FROM (
      SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY 2
      UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2)) WHERE rank <= 5""")
def _(t):
    return P.top_values(t.part, ["p_brand", "p_type"])


def _type_rows(table, spec):
    rows = []
    for c, kind in spec:
        is_num, is_int, is_str = kind in ("int", "bigint", "double"), kind in ("int", "bigint"), kind == "string"
        u, n, length = f"count(DISTINCT {c})", "count(*)", f"coalesce(avg(length({c}::VARCHAR)), 0)"
        if kind == "timestamp_ntz":
            semantic = "'datetime'"
        elif is_num:
            semantic = f"""CASE WHEN {u} <= 2 THEN 'boolean' WHEN {str(is_int).upper()} AND {u} = {n} THEN 'id'
                WHEN {u} <= 20 AND {u} * 1.0 / {n} < 0.05 THEN 'categorical' ELSE 'numeric' END"""
        else:
            semantic = f"""CASE WHEN {u} > 0.9 * {n} AND {n} > 10 AND {length} < 30 THEN 'id'
                WHEN {length} > 50 THEN 'text' ELSE 'categorical' END"""
        label = f"""CASE WHEN {u} <= 1 THEN 'constant' WHEN {u} = 2 THEN 'binary' WHEN {u} <= 10 THEN 'low'
            WHEN {u} <= 50 THEN 'medium' WHEN {u} > 0.9 * {n} THEN 'unique' ELSE 'high' END"""
        rows.append(f"""SELECT '{c}' AS "column", '{kind}' AS dtype, {semantic} AS semantic_type, {u} AS "unique",
            {label} AS cardinality FROM {table}""")
        assert is_num or is_str or kind == "timestamp_ntz"
    return " UNION ALL ".join(rows)


@query("detect_column_types", _type_rows("orders", [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]))
def _(t):
    return P.detect_column_types(t.orders)


@query("detect_column_types_text", _type_rows("documents", [
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]))
def _(t):
    return P.detect_column_types(t.documents)


_MISS = " + ".join(f"(count(*) - count({c}))" for c in ("c_custkey", "bal", "seg", "nat"))
_FULL = "count(*) FILTER (WHERE bal IS NOT NULL AND seg IS NOT NULL AND nat IS NOT NULL)"


@query("missing_summary", f"WITH {_GAPPY_SQL} " + " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count(*) - count({c}) AS missing, {r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct,
      {_MISS} AS total_missing, count(*) * 4 AS total_cells, {r(f'({_MISS}) * 100.0 / (count(*) * 4)')} AS overall_pct,
      {_FULL} AS complete_rows, {r(f'{_FULL} * 100.0 / count(*)')} AS complete_rows_pct FROM gappy"""
    for c in ("c_custkey", "bal", "seg", "nat")))
def _(t):
    return tidy(P.missing_summary(gappy(t)))


@query("profile")
def _(t):
    return P.profile(t.customer)


@query("profile_warnings", f"""WITH {_GAPPY_SQL}, f AS (
    SELECT (count(*) - count(bal)) * 100.0 / count(*) AS bal, (count(*) - count(seg)) * 100.0 / count(*) AS seg,
      (count(*) - count(nat)) * 100.0 / count(*) AS nat, {_FULL} * 100.0 / count(*) AS done FROM gappy)
    SELECT 'nat' AS "column", 'high_missing' AS type, 'high' AS severity, {r('nat')} AS value FROM f WHERE nat > 50
    UNION ALL SELECT 'seg', 'high_missing', 'high', {r('seg')} FROM f WHERE seg > 50
    UNION ALL SELECT 'seg', 'moderate_missing', 'medium', {r('seg')} FROM f WHERE seg > 15 AND seg <= 50
    UNION ALL SELECT 'bal', 'moderate_missing', 'medium', {r('bal')} FROM f WHERE bal > 15 AND bal <= 50
    UNION ALL SELECT NULL, 'low_completeness', 'high', {r('done')} FROM f WHERE done < 50""")
def _(t):
    return tidy(P.profile_warnings(gappy(t)))


def _outl(c, table, lo, hi):
    return f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < b.lo OR {c} > b.hi) AS "count",
      {r(f'count(*) FILTER (WHERE {c} < b.lo OR {c} > b.hi) * 100.0 / count(*)')} AS percentage,
      {r('any_value(b.lo)', 4)} AS lower_bound, {r('any_value(b.hi)', 4)} AS upper_bound
      FROM {table}, (SELECT {lo} AS lo, {hi} AS hi FROM {table}) b"""


def _iqr(c, table):
    q1, q3 = f"quantile_cont({c}::DOUBLE, 0.25)", f"quantile_cont({c}::DOUBLE, 0.75)"
    return _outl(c, table, f"{q1} - 1.5 * ({q3} - {q1})", f"{q3} + 1.5 * ({q3} - {q1})")


def _z(c, table):
    return _outl(c, table, f"avg({c}) - 3 * stddev_samp({c})", f"avg({c}) + 3 * stddev_samp({c})")


@query("detect_outliers_iqr", _iqr("value", "events") + " UNION ALL " + _iqr("user_id", "events"))
def _(t):
    return tidy(P.detect_outliers(t.events, ["value", "user_id"]), lower_bound=4, upper_bound=4)


@query("detect_outliers_zscore", _z("l_extendedprice", "lineitem") + " UNION ALL " + _z("l_quantity", "lineitem"))
def _(t):
    return tidy(P.detect_outliers(t.lineitem, ["l_extendedprice", "l_quantity"], "zscore"), lower_bound=4, upper_bound=4)


_DUP = "dup AS (SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem)"


@query("detect_duplicates", f"""WITH {_DUP}, g AS (SELECT count(*) AS n FROM dup GROUP BY ALL, l_orderkey, l_quantity, l_returnflag)
    SELECT sum(n - 1)::BIGINT AS "count", {r('sum(n - 1) * 100.0 / sum(n)')} AS percentage FROM g""".replace("GROUP BY ALL, ", "GROUP BY "))
def _(t):
    return tidy(P.detect_duplicates(t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag")))


@query("quality_issues", f"""WITH o AS ({_iqr('value', 'events')} UNION ALL {_iqr('user_id', 'events')}),
    d AS (SELECT sum(n - 1)::BIGINT AS c, sum(n - 1) * 100.0 / sum(n) AS p FROM (
      SELECT count(*) AS n FROM events GROUP BY user_id, value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END))
    SELECT 'missing_values' AS type, 'kind' AS "column", count(*) FILTER (WHERE event_id % 5 = 0) AS "count",
      {r('count(*) FILTER (WHERE event_id % 5 = 0) * 100.0 / count(*)')} AS percentage,
      CASE WHEN count(*) FILTER (WHERE event_id % 5 = 0) * 100.0 / count(*) > 30 THEN 'high'
           WHEN count(*) FILTER (WHERE event_id % 5 = 0) * 100.0 / count(*) > 10 THEN 'medium' ELSE 'low' END AS severity FROM events
    UNION ALL SELECT 'duplicates', NULL, c, {r('p')}, CASE WHEN p < 10 THEN 'medium' ELSE 'high' END FROM d WHERE c > 0
    UNION ALL SELECT 'outliers', "column", "count", percentage, CASE WHEN percentage > 10 THEN 'high'
      WHEN percentage > 3 THEN 'medium' ELSE 'low' END FROM o WHERE "count" > 0""")
def _(t):
    return tidy(P.quality_issues(t.events.select(
        "user_id", "value", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("kind"))))


@query("infer_problem_type", """SELECT 'p_size' AS target, count(DISTINCT p_size) AS "unique", count(*) AS n,
      CASE WHEN count(DISTINCT p_size) <= 20 AND count(DISTINCT p_size) * 1.0 / count(*) < 0.05 THEN 'classification' ELSE 'regression' END AS problem_type FROM part
    UNION ALL SELECT 'p_type', count(DISTINCT p_type), count(*), 'classification' FROM part
    UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice), count(*),
      CASE WHEN count(DISTINCT p_retailprice) <= 20 THEN 'classification' ELSE 'regression' END FROM part""")
def _(t):
    parts = [P.infer_problem_type(t.part, c) for c in ("p_size", "p_type", "p_retailprice")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- edge cases ------------------------------------------------------------------------

_E = 'SELECT {kind} AS type, {sev} AS severity, {col} AS "column", {other} AS other, {value} AS value FROM {src}'


def _edge(kind, sev, col, value, src, other="NULL::VARCHAR"):
    return _E.format(kind=f"'{kind}'", sev=sev, col=col, other=other, value=value, src=src)


@query("single_class_target", _edge("single_class", "'critical'", "'flag'", "count(DISTINCT flag)::DOUBLE",
       "(SELECT CASE WHEN l_quantity > 0 THEN 'yes' ELSE 'no' END AS flag FROM lineitem) HAVING count(DISTINCT flag) <= 1"))
def _(t):
    return E.single_class_target(t.lineitem.select(F.when(F.col("l_quantity") > 0, "yes").otherwise("no").alias("flag")), "flag")


@query("extreme_imbalance", f"""WITH c AS (SELECT CASE WHEN event_id % 200 = 0 THEN 'rare' ELSE 'usual' END AS y, count(*) AS n FROM events GROUP BY 1)
    SELECT 'extreme_imbalance' AS type, 'warning' AS severity, 'y' AS "column", arg_min(y, n) AS other, {r('min(n) * 1.0 / sum(n)')} AS value
    FROM c HAVING min(n) * 1.0 / sum(n) < 0.01""")
def _(t):
    y = F.when(F.col("event_id") % 200 == 0, "rare").otherwise("usual").alias("y")
    return tidy(E.extreme_imbalance(t.events.select(y), "y"))


@query("target_leakage", f"""SELECT * FROM (SELECT 'leakage' AS type, 'critical' AS severity, 'twice' AS "column", 'o_totalprice' AS other,
    {r('corr(o_totalprice * 2 + o_custkey, o_totalprice)')} AS value FROM orders) WHERE abs(value) > 0.95""")
def _(t):
    rows = t.orders.select("o_custkey", "o_totalprice", (F.col("o_totalprice") * 2 + F.col("o_custkey")).alias("twice"))
    return tidy(E.target_leakage(rows, "o_totalprice"))


@query("constant_columns", _edge("constant_column", "'warning'", "'one'", "count(DISTINCT one)::DOUBLE",
                                 "(SELECT 1 AS one FROM part) HAVING count(DISTINCT one) <= 1"))
def _(t):
    return E.constant_columns(t.part.select("p_partkey", "p_size", F.lit(1).alias("one")))


@query("high_cardinality", "SELECT * FROM (" + _edge(
    "high_cardinality", "'warning'", "'c_name'", r("count(DISTINCT c_name) * 1.0 / count(*)"), "customer") + ") WHERE value > 0.95")
def _(t):
    return tidy(E.high_cardinality(t.customer))


@query("too_few_rows", _edge("too_few_rows", "CASE WHEN count(*) < 10 THEN 'critical' ELSE 'warning' END", "NULL::VARCHAR",
                             "count(*)::DOUBLE", "nation HAVING count(*) < 30"))
def _(t):
    return E.too_few_rows(t.nation)


@query("too_many_missing", f"WITH {_GAPPY_SQL} SELECT * FROM (" + " UNION ALL ".join(
    _edge("too_many_missing", "'warning'", f"'{c}'", r(f"(count(*) - count({c})) * 1.0 / count(*)"), "gappy") for c in ("bal", "seg", "nat"))
    + ") WHERE value > 0.5")
def _(t):
    return tidy(E.too_many_missing(gappy(t)))


@query("perfect_correlation", f"""SELECT * FROM (SELECT 'perfect_correlation' AS type, 'warning' AS severity, 'o_totalprice' AS "column",
    'cents' AS other, {r('corr(o_totalprice, o_totalprice * 100)')} AS value FROM orders) WHERE abs(value) >= 0.99""")
def _(t):
    return tidy(E.perfect_correlation(t.orders.select("o_custkey", "o_totalprice", (F.col("o_totalprice") * 100).alias("cents"))))


@query("id_like_columns", """SELECT 'id_like_column' AS type, 'info' AS severity, 'event_id' AS "column",
      concat_ws(', ', 'name matches ID pattern', CASE WHEN count(DISTINCT event_id) = count(*) THEN 'all values unique' END,
        CASE WHEN max(event_id) - min(event_id) + 1 = count(DISTINCT event_id) AND count(event_id) = count(DISTINCT event_id) THEN 'sequential integers' END) AS other,
      count(DISTINCT event_id)::DOUBLE AS value FROM events
    UNION ALL SELECT 'id_like_column', 'info', 'user_id', concat_ws(', ', 'name matches ID pattern'), count(DISTINCT user_id)::DOUBLE FROM events
    UNION ALL SELECT 'id_like_column', 'info', 'ts', 'all values unique', count(DISTINCT ts)::DOUBLE FROM events HAVING count(DISTINCT ts) = count(*)""")
def _(t):
    return E.id_like_columns(t.events.select("event_id", "user_id", "ts", "event_type"))


@query("edge_cases")
def _(t):
    return E.edge_cases(t.labels.join(t.documents.drop("text"), "doc_id"), "quality")


# ---- schemas ---------------------------------------------------------------------------


def _schema_row(i, c, kind, table):
    stats = (f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std"
             if kind != "string" else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std")
    return f'SELECT {i} AS position, \'{c}\' AS "column", \'{kind}\' AS dtype, count(DISTINCT {c}) AS n_unique, {stats} FROM {table}'


@query("training_schema", " UNION ALL ".join(_schema_row(i, c, k, "part") for i, (c, k) in enumerate([
    ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")])))
def _(t):
    return tidy(S.training_schema(t.part), mean=4, std=4)


@query("training_categories", """SELECT DISTINCT 'p_brand' AS "column", p_brand AS category FROM part
    UNION ALL SELECT DISTINCT 'p_type', p_type FROM part""")
def _(t):
    return S.training_categories(t.part, ["p_brand", "p_type"])


def _old_new(t):
    """Orders before 2000 as training data, later ones renamed and shifted as new data."""
    old = t.orders.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")).where("o_orderpriority <> '5-LOW'").select(
        "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")
    new = t.orders.select("o_orderstatus", "o_orderpriority", (F.col("o_totalprice") * 2).alias("o_totalprice"),
                          F.lit(1).alias("extra"))
    return old, new


@query("validate_schema", """WITH old AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderpriority <> '5-LOW')
    SELECT 'o_custkey' AS "column", 'missing_column' AS type, 'critical' AS severity, NULL::BIGINT AS "count"
    UNION ALL SELECT 'extra', 'extra_column', 'info', NULL
    UNION ALL SELECT 'o_totalprice', 'out_of_range', 'warning', NULL FROM orders
      HAVING min(o_totalprice * 2) < (SELECT min(o_totalprice) FROM old) OR max(o_totalprice * 2) > (SELECT max(o_totalprice) FROM old)
    UNION ALL SELECT 'o_orderpriority', 'unknown_categories', 'warning', count(DISTINCT o_orderpriority) FROM orders
      WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM old) HAVING count(*) > 0""")
def _(t):
    old, new = _old_new(t)
    return S.validate_schema(new, S.training_schema(old), S.training_categories(old))


@query("adapt_to_schema", f"""WITH old AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderpriority <> '5-LOW')
    SELECT o_orderstatus, o_orderpriority, {r('o_totalprice * 2', 4)} AS o_totalprice,
      {r('(SELECT avg(o_custkey) FROM old)', 4)} AS o_custkey FROM orders""")
def _(t):
    old, new = _old_new(t)
    return tidy(S.adapt_to_schema(new, S.training_schema(old), S.training_categories(old)), 4)


_SKETCHED = ("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")


@query("profile_approx", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS missing, TRUE AS distinct_within,
        {'NULL' if c == 'l_returnflag' else 'TRUE'}::BOOLEAN AS ranks_within, TRUE AS top_within FROM lineitem""" for c in _SKETCHED))
def _(t):
    rows = t.lineitem.select(*_SKETCHED).withColumn("part", F.pmod(F.xxhash64("l_orderkey"), F.lit(4)))
    parts = K.column_sketches(rows, _SKETCHED, ["part"])
    return K.sketch_errors(rows, cut_lineage(K.profile_approx(parts)))
