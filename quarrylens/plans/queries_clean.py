"""Sources, SQL entry, cleaning, joins and sampling over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import clean as C
from quarrylens.operators import joins as J
from quarrylens.operators import sampling as S
from quarrylens.operators.classify import classify_intent, detect_domain
from quarrylens.operators.health import clinical_flags
from quarrylens.plans.queries_profile import _GAPPY_SQL, gappy
from quarrylens.plans.registry import query, r, tidy
from quarrylens.sources import catalog, files, html_tables
from quarrylens.sources.manifest import file_manifest

# ---- sources and the SQL entry ---------------------------------------------------------


@query("read_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def _(t):
    return files.read_parquet(t.spark, t.path("orders"), ["o_orderkey", "o_totalprice"]).where("o_totalprice > 400000")


@query("sql_on_file", "SELECT c_mktsegment, c_acctbal FROM customer WHERE c_acctbal < 0")
def _(t):
    return files.sql_on_file(t.spark, t.path("customer"), select="c_mktsegment, c_acctbal", where="c_acctbal < 0")


@query("register_table", "SELECT count(*) AS n FROM supplier")
def _(t):
    return catalog.register_table(t.supplier, "quarry_supplier").agg(F.count(F.lit(1)).alias("n"))


@query("query_table", f"""SELECT n_name, count(*) AS customers, {r('sum(c_acctbal)', 2)} AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def _(t):
    catalog.register_table(t.customer, "quarry_customer")
    catalog.register_table(t.nation, "quarry_nation")
    return tidy(catalog.query_table(t.spark, """WITH c AS (SELECT * FROM quarry_customer)
        SELECT n_name, count(*) AS customers, sum(c_acctbal) AS balance
        FROM c JOIN quarry_nation ON c_nationkey = n_nationkey GROUP BY n_name"""), 2)


@query("query_table_grouping_sets", f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {r('sum(l_quantity)', 2)} AS qty
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def _(t):
    catalog.register_table(t.lineitem, "quarry_lineitem")
    return tidy(catalog.query_table(t.spark, """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty
        FROM quarry_lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"""), 2)


@query("query_table_window", f"""SELECT * FROM (SELECT o_custkey, o_orderkey, {r('o_totalprice', 2)} AS o_totalprice,
    rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rk FROM orders) WHERE rk <= 2""")
def _(t):
    catalog.register_table(t.orders, "quarry_orders")
    return tidy(catalog.query_table(t.spark, """SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice,
        rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM quarry_orders) WHERE rk <= 2"""), 2)


@query("query_table_set_ops", """SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
    INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def _(t):
    catalog.register_table(t.orders, "quarry_orders")
    catalog.register_table(t.customer, "quarry_customer")
    return catalog.query_table(t.spark, """SELECT c_custkey AS k FROM quarry_customer EXCEPT SELECT o_custkey FROM quarry_orders
        WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM quarry_orders WHERE o_orderstatus = 'O'""")


@query("file_manifest")
def _(t):
    return file_manifest(t.spark, t.path("orders")).drop("modificationTime", "path")


@query("html_tables", """WITH l AS (SELECT page_id, regexp_extract_all(split_part(split_part(html, '<ul>', 2), '</ul>', 1), '<li><a [^>]*>([^<]*)</a></li>', 1) AS t FROM pages)
    SELECT page_id, 0::INTEGER AS table_no, (unnest(range(len(t))))::INTEGER AS row_no, [replace(unnest(t), '&amp;', '&')] AS cells FROM l""")
def _(t):
    """Every page with its list of links rewritten as a one-column table, which is then parsed."""
    html = F.col("html")
    for old, new in (("<ul>", "<table>"), ("</ul>", "</table>"), ("<li>", "<tr><td>"), ("</li>", "</td></tr>")):
        html = F.replace(html, F.lit(old), F.lit(new))
    return html_tables.html_tables(t.pages.withColumn("html", html), "page_id").where("table_no = 0")


# ---- scalar cleaning -------------------------------------------------------------------


@query("clean_column_names", 'SELECT c_custkey AS customer_key, c_name AS full_name FROM customer')
def _(t):
    return C.clean_column_names(t.customer.select(F.col("c_custkey").alias(" Customer-Key "), F.col("c_name").alias("Full  Name!")))


@query("strip_and_null", "SELECT conv_id, turn, nullif(trim(CASE WHEN turn % 3 = 0 THEN '  ' ELSE '  ' || role || ' ' END), '') AS role FROM conversations")
def _(t):
    messy = F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.concat(F.lit("  "), F.col("role"), F.lit(" ")))
    return C.strip_and_null(t.conversations.select("conv_id", "turn", messy.alias("role")), ["role"])


@query("to_numeric_columns", f"""SELECT event_id, {r("try_cast(CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE)")} AS good,
    CASE WHEN event_id % 2 = 0 THEN 'n/a' ELSE user_id::VARCHAR END AS bad FROM events""")
def _(t):
    e = t.events
    raw = e.select("event_id", F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("good"),
                   F.when(F.col("event_id") % 2 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("bad"))
    return tidy(C.to_numeric_columns(raw))


@query("fix_mixed_types", f"""SELECT event_id, {r("CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id::DOUBLE END")} AS mixed,
    CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR ELSE event_type END AS words FROM events""")
def _(t):
    raw = t.events.select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string")).alias("mixed"),
        F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type")).alias("words"))
    return tidy(C.fix_mixed_types(raw))


@query("parse_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS d, o_orderpriority AS p FROM orders""")
def _(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, "unknown").when(
        F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    out = C.parse_dates(t.orders.select("o_orderkey", text.alias("d"), F.col("o_orderpriority").alias("p")))
    return out.withColumn("d", F.col("d").cast("timestamp_ntz"))


@query("sanitize")
def _(t):
    raw = t.events.select(F.col("event_id").alias("Event ID"), F.concat(F.lit(" "), F.col("event_type")).alias("Event-Type"),
                          F.col("value").cast("string").alias("Value"), F.date_format("ts", "yyyy-MM-dd").alias("Day"))
    return tidy(C.sanitize(raw)[0].withColumn("day", F.col("day").cast("string")))


@query("clinical_flags", """SELECT event_id, coalesce(value < 5, FALSE) OR coalesce(value > 150, FALSE) AS value_abnormal,
    coalesce(try_cast(CASE WHEN event_id % 9 = 0 THEN 'high' ELSE user_id::VARCHAR END AS DOUBLE) > 100, FALSE) AS reading_abnormal FROM events""")
def _(t):
    rows = t.events.withColumn("reading", F.when(F.col("event_id") % 9 == 0, "high").otherwise(F.col("user_id").cast("string")))
    return clinical_flags(rows, {"value": {"low": 5, "high": 150}, "reading": {"high": 100}}).select(
        "event_id", "value_abnormal", "reading_abnormal")


def _intent_sql():
    from quarrylens.operators.classify import INTENTS

    arms = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(p)}') THEN '{k}'" for k, p in INTENTS.items())
    return f"SELECT conv_id, turn, CASE {arms} ELSE 'unknown' END AS intent FROM conversations"


@query("classify_intent", _intent_sql())
def _(t):
    return classify_intent(t.conversations, "text").select("conv_id", "turn", "intent")


def _words_of_sources(t):
    """Catalogue entries read from the data: each document source is a table, its words are the names."""
    words = F.explode(F.split(F.lower("text"), r"\s+"))
    return t.documents.select(F.col("source").alias("table_name"), words.alias("column_name")).distinct()


def _domain_sql():
    from quarrylens.operators.classify import DOMAIN_KEYWORDS, KEYWORD_WEIGHT

    words = ", ".join(f"('{d}', {i}, '{k}', {KEYWORD_WEIGHT[lv]}, '{lv}')" for i, (d, levels) in enumerate(DOMAIN_KEYWORDS.items())
                      for lv, ks in levels.items() for k in ks)
    return f"""WITH kw(domain, pos, word, weight, level) AS (VALUES {words}),
      cat AS (SELECT DISTINCT source AS table_name, unnest(string_split_regex(lower(text), '\\s+')) AS column_name FROM documents),
      hit AS (SELECT DISTINCT table_name, domain, pos, level, word, weight FROM cat, kw WHERE contains(replace(column_name, '-', '_'), word)),
      sc AS (SELECT table_name, domain, pos, sum(weight) AS s FROM hit GROUP BY ALL),
      best AS (SELECT table_name, domain, s FROM sc QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY s DESC, pos) = 1)
      SELECT DISTINCT c.table_name, CASE WHEN s >= 3 THEN domain ELSE 'generic' END AS domain,
        {r('CASE WHEN s >= 3 THEN least(s / 15, 1) ELSE 0 END')} AS confidence FROM cat c LEFT JOIN best b ON b.table_name = c.table_name"""


@query("detect_domain", _domain_sql())
def _(t):
    return tidy(detect_domain(_words_of_sources(t)))


@query("handle_missing", f"""WITH {_GAPPY_SQL} SELECT c_custkey, {r('coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM gappy))', 4)} AS bal,
    coalesce(seg, (SELECT seg FROM gappy WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1)) AS seg, coalesce(nat, 0) AS nat FROM gappy""")
def _(t):
    return tidy(C.handle_missing(gappy(t), {"bal": "median", "seg": "mode", "nat": "zero"}), 4)


@query("handle_missing_fill", f"""WITH {_GAPPY_SQL} SELECT c_custkey,
    {r('last_value(bal IGNORE NULLS) OVER (ORDER BY c_custkey)', 4)} AS bal,
    first_value(seg IGNORE NULLS) OVER (ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS seg, nat FROM gappy""")
def _(t):
    return tidy(C.handle_missing(gappy(t), {"bal": "forward_fill", "seg": "backward_fill"}, ["c_custkey"]), 4)


@query("handle_missing_constant", f"""WITH {_GAPPY_SQL} SELECT c_custkey, {r('coalesce(bal, (SELECT avg(bal) FROM gappy))', 4)} AS bal,
    coalesce(seg, 'none') AS seg, nat FROM gappy WHERE nat IS NOT NULL""")
def _(t):
    return tidy(C.handle_missing(gappy(t), {"bal": "mean", "seg": "constant:none", "nat": "drop_rows"}), 4)


@query("handle_missing_knn")
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("cust"))
    return tidy(C.handle_missing(rows, {"cust": "knn"}, ["o_orderkey"]))


_Q = "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) q"


@query("handle_outliers_clip", f"""SELECT event_id, {r('least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1))', 4)} AS value FROM events, {_Q}""")
def _(t):
    return tidy(C.handle_outliers(t.events.select("event_id", "value"), "value", "clip"), 4)


@query("handle_outliers_remove", f"SELECT event_id, value FROM events, {_Q} WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)")
def _(t):
    return C.handle_outliers(t.events.select("event_id", "value"), "value", "remove")


@query("handle_outliers_winsorize", """WITH s AS (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n FROM events),
    b AS (SELECT min(value) FILTER (WHERE rn = floor(0.05 * n) + 1) AS lo, min(value) FILTER (WHERE rn = n - floor(0.05 * n)) AS hi FROM s)
    SELECT event_id, least(greatest(value, lo), hi) AS value FROM events, b""")
def _(t):
    return C.handle_outliers(t.events.select("event_id", "value"), "value", "winsorize")


@query("remove_duplicates_first", f"""SELECT user_id, event_type, event_id, {r('value')} AS value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) = 1""")
def _(t):
    return tidy(C.remove_duplicates(t.events, ["user_id", "event_type"], "first", ["ts"]).select("user_id", "event_type", "event_id", "value"))


@query("remove_duplicates_last", f"""SELECT user_id, event_id, {r('value')} AS value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""")
def _(t):
    return tidy(C.remove_duplicates(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], "last", ["ts"]).drop("ts"))


@query("remove_duplicates_none", "SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1")
def _(t):
    return C.remove_duplicates(t.lineitem.select("l_orderkey", "l_partkey"), keep=False)


@query("remove_duplicates_all", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(t):
    return C.remove_duplicates(t.lineitem.select("l_suppkey", "l_returnflag"))


# ---- joins -----------------------------------------------------------------------------


@query("merge", "SELECT n_name, r_name, n_regionkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return J.merge(t.nation.withColumnRenamed("n_regionkey", "k"), t.region.withColumnRenamed("r_regionkey", "k"), "k").select("n_name", "r_name", "k")


@query("merge_outer", f"""SELECT coalesce(c_custkey, o_custkey) AS k, c_mktsegment, {r('o_totalprice', 2)} AS o_totalprice
    FROM customer FULL JOIN orders ON c_custkey = o_custkey""")
def _(t):
    left = t.customer.select(F.col("c_custkey").alias("k"), "c_mktsegment")
    right = t.orders.select(F.col("o_custkey").alias("k"), "o_totalprice")
    return tidy(J.merge(left, right, "k", "outer"), 2)


@query("join_fanout", """SELECT (SELECT count(*) FROM orders) AS left_rows, count(*) AS joined_rows,
    count(*) > 3 * (SELECT count(*) FROM orders) AS exploding FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def _(t):
    return J.join_fanout(t.orders.withColumnRenamed("o_orderkey", "k"), t.lineitem.withColumnRenamed("l_orderkey", "k"), "k")


@query("join_sources", f"""SELECT c_custkey AS k, c_nationkey AS nation, {r('c_acctbal', 2)} AS bal, s_nationkey AS nation_supplier,
    {r('s_acctbal', 2)} AS bal_supplier FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def _(t):
    left = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))
    right = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    return tidy(J.join_sources(left, right, "k", "left", "supplier"), 2)


@query("suggest_join_keys", f"""WITH o AS (SELECT count(*) FILTER (WHERE k IN (SELECT c_custkey FROM customer)) * 1.0 / count(*) AS v
      FROM (SELECT DISTINCT o_custkey AS k FROM orders))
    SELECT 'o_custkey' AS left_col, 'c_custkey' AS right_col, 0.889 AS name_similarity, TRUE AS dtype_match,
      {r('v')} AS value_overlap, {r('0.4 * 16.0 / 18.0 + 0.2 + 0.4 * v')} AS score FROM o""")
def _(t):
    return tidy(J.suggest_join_keys(t.orders, t.customer))


@query("prefix_join", """WITH c AS (SELECT o_orderkey, (['I50','E11','C77','C18','Z00'])[(o_orderkey % 5 + 1)::INTEGER] AS code FROM orders)
    SELECT o_orderkey, CASE code WHEN 'I50' THEN 1 WHEN 'E11' THEN 1 WHEN 'C77' THEN 8 WHEN 'C18' THEN 2 ELSE 0 END AS charlson_score FROM c""")
def _(t):
    from quarrylens.operators.health import charlson

    code = F.get(F.array(*[F.lit(x) for x in ("I50", "E11", "C77", "C18", "Z00")]), (F.col("o_orderkey") % 5).cast("int"))
    return charlson(t.orders.select("o_orderkey", code.alias("code")), "code").drop("code")


# ---- sampling and top-k ----------------------------------------------------------------


@query("sample_random")
def _(t):
    return S.sample_random(t.events.select("event_id", "value"), 500, "event_id")


@query("sample_stratified")
def _(t):
    return S.sample_stratified(t.events.select("event_id", "event_type"), 500, "event_type", "event_id")


@query("sample_systematic", """WITH s AS (SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS i, greatest(count(*) OVER () // 700, 1) AS step FROM events)
    SELECT event_id FROM s WHERE i % step = 0 AND i // step < 700""")
def _(t):
    return S.sample_systematic(t.events.select("event_id", "ts"), 700, ["ts", "event_id"]).select("event_id")


@query("train_test_split", """SELECT event_type, CASE WHEN k = 'test' THEN round(0.2 * n)::BIGINT ELSE n - round(0.2 * n)::BIGINT END AS rows, k AS split
    FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1), (VALUES ('test'), ('train')) v(k)""")
def _(t):
    out = S.train_test_split(t.events.select("event_id", "event_type"), "event_id", 0.2, "event_type")
    return out.groupBy("event_type", "split").agg(F.count(F.lit(1)).alias("rows"))


@query("fold_ids", """SELECT (k)::INTEGER AS fold, (count(*) // 5 + CASE WHEN k < count(*) % 5 THEN 1 ELSE 0 END)::BIGINT AS rows
    FROM events, range(5) v(k) GROUP BY k""")
def _(t):
    return S.fold_ids(t.events.select("event_id"), "event_id", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))


@query("top_k", f"SELECT o_orderkey, {r('o_totalprice', 2)} AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def _(t):
    return tidy(S.top_k(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 30), 2)


@query("data_query", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 20")
def _(t):
    return S.data_query(t.events, ["event_id", "event_type", "nope"], ["event_id"])


@query("prefix_equi_join", """SELECT o_orderkey, n_nationkey FROM orders JOIN nation ON starts_with(o_orderkey::VARCHAR, n_nationkey::VARCHAR)""")
def _(t):
    codes = t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("code"))
    starts = t.nation.select("n_nationkey", F.col("n_nationkey").cast("string").alias("start"))
    return J.prefix_join(codes, "code", starts, "start").select("o_orderkey", "n_nationkey")
