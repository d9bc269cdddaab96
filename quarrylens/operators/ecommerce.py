"""E-commerce: RFM, lifetime value, cohorts, baskets and funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions.quantiles import bin_right_closed, melt, quantiles, quantiles_wide
from quarrylens.functions.ranks import sequence_index
from quarrylens.functions.scalars import half_even, one_row, safe_div
from quarrylens.operators.create import days_between
from quarrylens.session import cut_lineage


def _customers(df: DataFrame, customer: str, date: str, amount: str, extra_days: int,
               reference: str | None = None) -> DataFrame:
    """Recency (days), frequency and monetary value per customer, money rounded to cents."""
    rows = df.select(F.col(customer), F.col(date).cast("timestamp_ntz").alias("_d"),
                     F.col(amount).cast("double").alias("_a")).dropna(subset=["_d", "_a"])
    ref = (F.lit(reference).cast("timestamp_ntz") if reference else rows.agg(F.max("_d")).scalar())
    return rows.groupBy(customer).agg(
        F.max("_d").alias("_last"), F.count(F.lit(1)).alias("frequency"),
        F.round(F.sum("_a"), 2).alias("monetary")).select(
        customer, (days_between(F.col("_last"), ref) + extra_days).alias("recency_days"),
        "frequency", "monetary")


def _edges(table: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """One row with an array of distinct quantile edges per column."""
    q = quantiles(melt(table, columns), "value", [i / bins for i in range(bins + 1)], ["column"])
    return q.agg(*[F.array_sort(F.collect_set(F.when(F.col("column") == c, F.col("quantile")))).alias(c)
                   for c in columns])


def _rank_bin(index: str, total: str, bins: int = 5) -> Column:
    """Quantile bin of a 0-based rank among ``total`` ranks."""
    span = F.greatest(F.col(total) - 1, F.lit(1))
    up = F.floor((F.col(index) * bins + span - 1) / span)
    return F.greatest(F.least(up, F.lit(bins)), F.lit(1)).cast("int")


def rfm(df: DataFrame, customer: str, date: str, amount: str) -> DataFrame:
    """Quintile scores 1-5 per customer: recency by value, frequency and money by rank."""
    base = cut_lineage(_customers(df, customer, date, amount, 1))
    measures = ["recency_days", "frequency", "monetary"]
    # the three rankings share one pass over unpivoted (measure, value) rows
    ranked = sequence_index(melt(base, measures, [customer]), ["value", customer], ["column"], total="_n")
    at = lambda c: F.max(F.when(F.col("column") == c, F.col("_index")))
    value = lambda c: F.max(F.when(F.col("column") == c, F.col("value")))
    rows = ranked.groupBy(customer).agg(
        value("recency_days").cast("bigint").alias("recency_days"), value("frequency").cast("bigint").alias("frequency"),
        value("monetary").alias("monetary"), at("recency_days").alias("_r"), at("frequency").alias("_f"),
        at("monetary").alias("_m"), F.max("_n").alias("_n"))
    rows = rows.withColumn("_e", one_row(_edges(base, ["recency_days"], 5)))
    distinct = base.select("recency_days").distinct().limit(5).agg(F.count(F.lit(1))).scalar()
    by_value = 6 - bin_right_closed(F.col("recency_days").cast("double"), F.col("_e.recency_days"))
    span = F.greatest(F.col("_n") - 1, F.lit(1))
    nb = F.least(F.lit(5), distinct)
    by_rank = 6 - F.greatest(F.least(F.floor((F.col("_r") * nb + span - 1) / span), nb), F.lit(1))
    r = F.when(F.size("_e.recency_days") == 6, by_value).otherwise(by_rank).cast("int")
    out = rows.select(customer, "recency_days", "frequency", "monetary", r.alias("r_score"),
                      _rank_bin("_f", "_n").alias("f_score"), _rank_bin("_m", "_n").alias("m_score"))
    return out.withColumn("rfm_segment", F.concat("r_score", "f_score", "m_score"))


def _segment(r: Column, f: Column, m: Column) -> Column:
    return (
        F.when(r + f + m >= 13.5, "Champions")
        .when((r >= 4) & (f >= 3), "Loyal Customers")
        .when((r >= 4) & (f <= 2), "Recent Customers")
        .when((r >= 3) & (m >= 4), "Potential Loyalists")
        .when((r <= 2) & (f >= 4), "At Risk")
        .when((r <= 2) & (f >= 2), "Cant Lose Them")
        .when((r <= 2) & (f <= 1), "Lost")
        .otherwise("Needs Attention"))


def rfm_segments(df: DataFrame, customer: str, date: str, amount: str,
                 reference: str | None = None) -> DataFrame:
    """Quintile scores by value (3 where quintiles coincide) and the named segment."""
    base = cut_lineage(_customers(df, customer, date, amount, 0, reference))
    rows = base.withColumn("_e", one_row(_edges(base, ["recency_days", "frequency", "monetary"], 5)))

    def score(c: str) -> Column:
        return F.when(F.size(f"_e.{c}") == 6, bin_right_closed(F.col(c).cast("double"), F.col(f"_e.{c}")))

    rows = rows.select(
        customer, "recency_days", "frequency", "monetary",
        F.coalesce(6 - score("recency_days"), F.lit(3)).alias("r_score"),
        F.coalesce(score("frequency"), F.lit(3)).alias("f_score"),
        F.coalesce(score("monetary"), F.lit(3)).alias("m_score"))
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return rows.withColumns({"rfm_score": r * 100 + f * 10 + m, "segment": _segment(r, f, m)})


def segment_distribution(scored: DataFrame) -> DataFrame:
    """Customers per segment, ranked (the five largest have rank <= 5)."""
    counts = scored.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("customers"), "segment")
    return counts.withColumn("rank", F.row_number().over(w))


def clv(df: DataFrame, customer: str, amount: str, date: str) -> DataFrame:
    """Spend, order value, purchases per 30 days and a 12-month value estimate per customer."""
    rows = df.select(customer, F.col(amount).cast("double").alias("_a"),
                     F.col(date).cast("timestamp_ntz").alias("_d")).dropna(subset=["_a", "_d"])
    t = rows.groupBy(customer).agg(
        F.round(F.sum("_a"), 2).alias("total_spend"), F.count(F.lit(1)).alias("purchase_count"),
        F.min("_d").alias("_first"), F.max("_d").alias("_last"))
    t = t.withColumn("customer_lifespan_days", F.greatest(days_between("_first", "_last"), F.lit(1)))
    t = t.withColumns({
        "avg_order_value": half_even(F.col("total_spend") / F.col("purchase_count"), 2),
        "purchase_frequency": half_even(
            F.col("purchase_count") / (F.col("customer_lifespan_days") / F.lit(30.0)), 3)})
    return t.withColumn(
        "clv_estimate", half_even(F.col("avg_order_value") * F.col("purchase_frequency") * 12, 2)
    ).drop("_first", "_last")


def clv_margin(df: DataFrame, customer: str, amount: str, margin: float = 0.3,
               discount: float = 0.1) -> DataFrame:
    """Order value x frequency x margin x retention factor; retention = share buying again."""
    t = df.groupBy(customer).agg(F.sum(amount).alias("total_spend"), F.count(F.lit(1)).alias("purchase_count"))
    keep = t.agg(F.avg((F.col("purchase_count") > 1).cast("double")).alias("r"))
    ret = F.least(F.greatest(keep.select("r").scalar(), F.lit(0.01)), F.lit(0.99))
    t = t.withColumn("_ret", ret)
    factor = F.col("_ret") / (1 + discount - F.col("_ret"))
    avg = F.col("total_spend") / F.col("purchase_count")
    return t.select(customer, "total_spend", "purchase_count", avg.alias("avg_purchase_value"),
                    (avg * F.col("purchase_count") * margin * factor).alias("clv"))


def clv_distribution(table: DataFrame) -> DataFrame:
    """Mean, total, spread and quartiles of a lifetime-value column."""
    q = quantiles_wide(table, "clv", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    s = table.agg(F.avg("clv").alias("mean"), F.sum("clv").alias("total"), F.stddev_samp("clv").alias("std"),
                  F.max("clv").alias("max"))
    return s.withColumn("_q", one_row(q)).select("*", "_q.*").drop("_q")


def cohort_retention(df: DataFrame, customer: str, date: str) -> DataFrame:
    """Share of each first-purchase month still buying after k months."""
    month = (F.year(date) * 12 + F.month(date) - 1).alias("m")
    active = df.where(F.col(date).isNotNull()).select(customer, month).distinct()
    first = F.min("m").over(W.partitionBy(customer))
    cells = active.select(first.alias("c"), (F.col("m") - first).alias("period")).groupBy("c", "period").agg(
        F.count(F.lit(1)).alias("customers"))
    size = F.max(F.when(F.col("period") == 0, F.col("customers"))).over(W.partitionBy("c"))
    label = F.format_string("%04d-%02d", F.floor(F.col("c") / 12).cast("int"), (F.col("c") % 12 + 1).cast("int"))
    return cells.select(label.alias("cohort"), "period", "customers", size.alias("cohort_size"),
                        (F.col("customers") / size).alias("retention"))


def basket_items(df: DataFrame, transaction: str, item: str, top: int = 50) -> DataFrame:
    """Most frequent items by row count, with support relative to the transactions."""
    total = df.select(transaction).distinct().agg(F.count(transaction)).scalar()
    counts = df.where(F.col(item).isNotNull()).groupBy(F.col(item).cast("string").alias("item")).agg(
        F.count(F.lit(1)).alias("count"))
    best = counts.orderBy(F.desc("count"), "item").limit(top)
    return best.withColumn("support", F.col("count") / total)


#: Items of a basket that are listed together; pairs of larger baskets come from pairs of such lists.
BASKET_BLOCK = 64


def _pairs_of(lines: DataFrame) -> DataFrame:
    """``item_a, item_b, count`` over whole baskets; ``lines`` holds distinct ``_t, _i`` and the basket's size ``_n``.

    A basket's items are dealt into blocks by hash, and every two blocks meet in a cell of their own, so a basket of any
    size is spread over many rows and no list grows with it.
    """
    blocks = F.ceil(F.col("_n") / BASKET_BLOCK)
    rows = lines.withColumn("_k", F.pmod(F.xxhash64("_i"), blocks)).withColumn(
        "_j", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    cells = rows.groupBy("_t", F.least("_k", "_j").alias("_a"), F.greatest("_k", "_j").alias("_b")).agg(
        F.collect_list(F.when(F.col("_k") == F.least("_k", "_j"), F.col("_i"))).alias("_x"),
        F.collect_list(F.when(F.col("_k") == F.greatest("_k", "_j"), F.col("_i"))).alias("_y"))
    ordered = lambda x, y: F.struct(F.least(x, y).alias("item_a"), F.greatest(x, y).alias("item_b"))
    own = F.col("_a") == F.col("_b")
    pairs = cells.select(F.explode(F.flatten(F.transform("_x", lambda x: F.transform(
        F.filter("_y", lambda y: F.when(own, x < y).otherwise(F.lit(True))), lambda y: ordered(x, y))))).alias("p"))
    return pairs.groupBy("p.item_a", "p.item_b").agg(F.count(F.lit(1)).alias("count"))


def basket_pairs(df: DataFrame, transaction: str, item: str, top: int = 30) -> DataFrame:
    """Most frequent item pairs inside a transaction, over whole baskets.

    The pairs among the ``BASKET_BLOCK`` most frequent items give a first bound on the count of the last pair asked for;
    items below that count cannot be part of the answer and are left out before pairs are made.
    """
    total = df.select(transaction).distinct().agg(F.count(transaction)).scalar()
    lines = df.where(F.col(item).isNotNull() & F.col(transaction).isNotNull()).select(
        F.col(transaction).alias("_t"), F.col(item).cast("string").alias("_i")).distinct()
    sized = lambda rows: rows.join(rows.groupBy("_t").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "_t")
    often = lines.groupBy("_i").agg(F.count(F.lit(1)).alias("_c"))
    lead = often.orderBy(F.desc("_c"), "_i").limit(BASKET_BLOCK).select("_i")
    bound = _pairs_of(sized(lines.join(lead, "_i", "left_semi"))).orderBy(F.desc("count")).limit(top).agg(
        F.when(F.count(F.lit(1)) == top, F.min("count")).otherwise(1).alias("m"))
    kept = often.where(F.col("_c") >= bound.scalar()).select("_i")
    counts = _pairs_of(sized(lines.join(kept, "_i", "left_semi")))
    best = counts.orderBy(F.desc("count"), "item_a", "item_b").limit(top)
    return best.withColumn("support", F.col("count") / total)


def funnel(df: DataFrame, stage: str, count: str | None = None) -> DataFrame:
    """Stages by falling count with conversion, drop-off and overall conversion; the window is over one row per stage."""
    n = F.sum(count) if count else F.count(F.lit(1))
    t = df.where(F.col(stage).isNotNull()).groupBy(F.col(stage).cast("string").alias("stage")).agg(n.alias("count"))
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("count"), "stage")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumns({"position": F.row_number().over(order), "_prev": F.lag("count").over(order),
                       "_top": F.max("count").over(whole), "_low": F.min("count").over(whole)})
    prev = F.col("_prev")
    rate = safe_div(F.col("count"), prev)
    return t.select(
        "position", "stage", "count",
        F.coalesce(rate, F.lit(1.0)).alias("conversion_rate"),
        F.when(prev > 0, prev - F.col("count")).otherwise(0).cast("bigint").alias("dropoff"),
        F.coalesce(1 - rate, F.lit(0.0)).alias("dropoff_rate"),
        safe_div(F.col("_low"), F.col("_top")).alias("overall_conversion"))
