"""Approximate column profiles from mergeable sketches.

Sketches are made per part of a table (a day, a file, a batch), may be stored, and are merged later without the rows: distinct
counts by HyperLogLog, quantiles by KLL, frequent values by the frequent-items sketch.  Each estimate comes with the bound
of its error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.scalars import no_nan, numeric_columns

#: Sizes of the sketches: bits of the HyperLogLog index, k of the quantiles, frequent values tracked, values reported.
HLL_BITS, KLL_K, TRACKED, TOP = 14, 400, 1_000, 10
#: Error bounds that follow: three standard errors of merged HyperLogLog counts (of the count), the rank error of KLL at 99 %
#: (of the rows), and the most by which the count of a frequent value is off (of the rows).
DISTINCT_BOUND = 3 * 1.03896 / 2 ** (HLL_BITS / 2)
RANK_BOUND = 2.296 / KLL_K ** 0.9723
TOP_BOUND = 3.5 / TRACKED
QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def column_sketches(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, column, n, missing, hll, kll, items)``: one row of sketches per column and part, from one scan.

    NaN is missing.  ``kll`` is NULL for columns that are not numbers.
    """
    columns = [c for c in (columns or df.columns) if c not in by]
    numbers = set(numeric_columns(df))
    kinds = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(columns):
        value = no_nan(F.col(f"`{c}`")) if kinds[c] in ("double", "float") else F.col(f"`{c}`")
        known = value.isNotNull()
        kll = F.kll_sketch_agg_double(value.cast("double"), F.lit(KLL_K)) if c in numbers else F.lit(None).cast("binary")
        item = F.when(known, value.cast("string"))
        aggs += [
            F.count(F.when(known, 1)).alias(f"n{i}"), F.count(F.when(~known, 1)).alias(f"missing{i}"),
            F.hll_sketch_agg(F.when(known, F.xxhash64(value)), HLL_BITS).alias(f"hll{i}"), kll.alias(f"kll{i}"),
            F.call_function("approx_top_k_accumulate", item, F.lit(TRACKED)).alias(f"items{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    fields = ("n", "missing", "hll", "kll", "items")
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{f}{i}").alias(f) for f in fields]) for i, c in enumerate(columns)]
    return wide.select(*by, F.inline(F.array(*rows)))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of several parts as those of their union, per ``by`` and column."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.hll_union_agg("hll").alias("hll"),
        F.kll_merge_agg_double("kll").alias("kll"), F.call_function("approx_top_k_combine", F.col("items"), F.lit(TRACKED)).alias("items"))


def profile_approx(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, column, n, missing, distinct, distinct_error, quantiles, rank_error, top, top_error)`` of merged sketches.

    ``distinct`` is off by at most ``distinct_error``, the rank of each of the ``quantiles`` (least, quarters, largest) by at most
    ``rank_error`` rows, the counts in ``top`` (value, count) by at most ``top_error``; the first two with a chance of 99 %.
    """
    merged = merge_sketches(sketches, by)
    has = F.kll_sketch_get_n_double("kll") > 0
    quantiles = F.when(has, F.kll_sketch_get_quantile_double("kll", F.array(*[F.lit(q) for q in QUANTILES])))
    top = F.filter(F.call_function("approx_top_k_estimate", F.col("items"), F.lit(TOP + 1)), lambda x: x["item"].isNotNull())
    distinct = F.hll_sketch_estimate("hll")
    return merged.select(
        *by, "column", "n", "missing", distinct.alias("distinct"), F.ceil(distinct * F.lit(DISTINCT_BOUND)).alias("distinct_error"),
        quantiles.alias("quantiles"), F.ceil(F.col("n") * F.lit(RANK_BOUND)).alias("rank_error"),
        F.slice(top, 1, TOP).alias("top"), F.ceil((F.col("n") + F.col("missing")) * F.lit(TOP_BOUND)).alias("top_error"))


def sketch_errors(df: DataFrame, approx: DataFrame) -> DataFrame:
    """``(column, n, missing, distinct_within, ranks_within, top_within)``: the estimates against exact counts of ``df``."""
    told = {c: k for c, k in df.dtypes}
    columns = [r["column"] for r in approx.select("column").collect()]
    values = [F.struct(F.lit(c).alias("column"), (no_nan(F.col(f"`{c}`")) if told[c] in ("double", "float") else F.col(f"`{c}`")).cast(
        "string").alias("value")) for c in columns]
    counts = df.select(F.inline(F.array(*values))).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    joined = counts.join(approx, "column")
    number = F.expr("try_cast(value AS double)")
    below = [F.sum(F.when(number < F.col("quantiles")[i], F.col("c")).otherwise(0)).alias(f"b{i}") for i in range(len(QUANTILES))]
    upto = [F.sum(F.when(number <= F.col("quantiles")[i], F.col("c")).otherwise(0)).alias(f"u{i}") for i in range(len(QUANTILES))]
    named = F.get(F.filter("top", lambda x: x["item"] == F.col("value")), F.lit(0))["count"]
    facts = joined.groupBy("column").agg(
        F.count(F.lit(1)).alias("exact"), F.max(F.abs(named - F.col("c"))).alias("off"), *below, *upto)
    rows = approx.join(facts, "column", "left")
    ranks = F.lit(True)
    for i, q in enumerate(QUANTILES):
        place = F.col("n") * F.lit(q)
        ranks = ranks & (F.col(f"b{i}") <= place + F.col("rank_error")) & (F.col(f"u{i}") >= place - F.col("rank_error"))
    return rows.select(
        "column", "n", "missing", (F.abs(F.col("distinct") - F.coalesce("exact", F.lit(0))) <= F.col("distinct_error")).alias("distinct_within"),
        F.when(F.col("quantiles").isNotNull(), ranks).alias("ranks_within"),
        (F.coalesce("off", F.lit(0)) <= F.col("top_error")).alias("top_within"))
