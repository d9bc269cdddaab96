"""New columns: products, date parts, bins, ratios, text lengths, declared extras."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.quantiles import bin_right_closed, edge_array
from quarrylens.functions.ranks import running_totals, same_keys, sequence_index
from quarrylens.functions.scalars import safe_div


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2,
               interaction_only: bool = False) -> DataFrame:
    """All products up to ``degree``, named like ``a^2`` and ``a b``."""
    choose = combinations if interaction_only else combinations_with_replacement
    new = {}
    for d in range(2, degree + 1):
        for term in choose(columns, d):
            powers = Counter(term)
            name = " ".join(c if k == 1 else f"{c}^{k}" for c, k in powers.items())
            product = F.col(term[0]).cast("double")
            for c in term[1:]:
                product = product * F.col(c)
            new[name] = product
    return df.withColumns(new) if new else df


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """Year, month, day, weekday (Monday 0), quarter, weekend flag; hour if any time part is set."""
    d = F.col(column)
    new = {
        f"{column}_year": F.year(d), f"{column}_month": F.month(d), f"{column}_day": F.dayofmonth(d),
        f"{column}_dow": F.weekday(d), f"{column}_quarter": F.quarter(d),
        f"{column}_is_weekend": F.coalesce((F.weekday(d) >= 5).cast("int"), F.lit(0)),
    }
    timed = df.agg(F.max((F.hour(d) != 0) | (F.minute(d) != 0)).alias("t")).first()["t"]
    if timed:
        new[f"{column}_hour"] = F.hour(d)
    return df.withColumns(new)


def _binned(df: DataFrame, column: str, edges: Column, labels: Sequence[str] | None) -> DataFrame:
    rows = df.withColumn("_edges", edges)
    at = bin_right_closed(F.col(column).cast("double"), F.col("_edges"))
    rows = rows.withColumn(f"{column}_bin", at)
    b = F.col(f"{column}_bin")
    rows = rows.withColumns({f"{column}_lo": F.get("_edges", b - 1), f"{column}_hi": F.get("_edges", b)})
    if labels:
        rows = rows.withColumn(f"{column}_label", F.get(F.array(*[F.lit(x) for x in labels]), b - 1))
    return rows.drop("_edges")


def bin_quantile(df: DataFrame, column: str, bins: int = 5, labels: Sequence[str] | None = None) -> DataFrame:
    """Equal-frequency, right-closed bins; repeated edges are merged."""
    return _binned(df, column, edge_array(df, column, bins).scalar(), labels)


def bin_uniform(df: DataFrame, column: str, bins: int = 5, labels: Sequence[str] | None = None) -> DataFrame:
    """Equal-width, right-closed bins over the observed range."""
    x = F.col(column).cast("double")
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    edges = span.select(F.array(*[lo + i * (hi - lo) / bins for i in range(bins)], hi))
    return _binned(df, column, edges.scalar(), labels)


def ratio(df: DataFrame, numerator: str, denominator: str, name: str | None = None) -> DataFrame:
    """Quotient, NULL where the denominator is 0 or the result is not finite."""
    q = safe_div(F.col(numerator).cast("double"), F.col(denominator).cast("double"))
    finite = F.when(~F.isnan(q) & (F.abs(q) != float("inf")), q)
    return df.withColumn(name or f"{numerator}_over_{denominator}", finite)


def text_length(df: DataFrame, column: str) -> DataFrame:
    """Characters, whitespace-separated words and characters per word (0 without words)."""
    text = F.coalesce(F.col(column), F.lit(""))
    chars, words = F.length(text), F.regexp_count(text, F.lit(r"(?U)\S+"))
    return df.withColumns({
        f"{column}_char_count": chars, f"{column}_word_count": words,
        f"{column}_avg_word_len": safe_div(chars, words, 0.0)})


def days_between(start: Column | str, end: Column | str) -> Column:
    """Whole 24-hour days from ``start`` to ``end``, rounded down."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000)).cast("bigint")


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``{c}_missing`` = 1 where the value is NULL."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def interpolate_linear(df: DataFrame, column: str, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Fill gaps on a straight line over row positions; edges take the nearest known value."""
    from quarrylens.operators.sequence import fill

    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_index").alias("i"), F.col(column).cast("double").alias("v")))
    rows = sequence_index(df, order_by, by).withColumns({"_prev": known, "_next": known})
    rows = fill(rows, ["_prev"], ["_index"], True, by)
    rows = fill(rows, ["_next"], ["_index"], False, by)
    a, b, i = F.col("_prev"), F.col("_next"), F.col("_index")
    line = a.v + (b.v - a.v) * safe_div(i - a.i, b.i - a.i, 0.0)
    value = F.coalesce(F.col(column).cast("double"), line, a.v)
    return rows.select(*[value.alias(c) if c == column else F.col(c) for c in df.columns])


def velocity(df: DataFrame, entity: str, ts: str, amount: str, windows_hours: Sequence[int] = (1, 24)) -> DataFrame:
    """Events and amount of the same entity in the preceding hours (current row included).

    Time is cut into slices of the length of the window, so a window is the end of one slice and the beginning of the next.
    Both come from running totals per entity and slice; the moments where windows begin are merged into the stream as
    rows of no weight.  Running totals are carried over range buckets, so one entity may hold the whole table.  Rows without a
    time count the rows of their entity without one; the sum of missing amounts is missing.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    out = df.withColumn("_us", F.timestamp_diff("MICROSECOND", epoch, F.col(ts)))
    zero = F.lit(0)
    moments = out.groupBy(entity, "_us").agg(
        F.count(F.lit(1)).alias("n"), F.count(amount).alias("m"), F.coalesce(F.sum(amount), zero).alias("s"))
    names = []
    for h in windows_hours:
        span = h * 3_600_000_000
        own = F.floor(F.col("_us") / F.lit(span))
        starts = moments.select(entity, (F.col("_us") - span).alias("_us"), *[
            zero.cast(kind).alias(c) for c, kind in moments.dtypes[2:]], (own - 1).alias("_slice"))
        stream = moments.withColumn("_slice", own).unionByName(starts.where("_us IS NOT NULL")).groupBy(entity, "_us", "_slice").agg(
            *[F.sum(c).alias(c) for c in ("n", "m", "s")])
        told = running_totals(stream, "_us", ["n", "m", "s"], [entity, "_slice"])
        begun = told.select(entity, "_us", *[(F.col(f"{c}_before") + F.col(c)).alias(f"_{c}") for c in ("n", "m", "s")])
        ended = told.select(entity, F.col("_us").alias("_start"), *[
            (F.col(f"{c}_total") - F.col(f"{c}_before")).alias(f"_p{c}") for c in ("n", "m", "s")])
        both = same_keys(same_keys(out, begun, [entity, "_us"]).withColumn("_start", F.col("_us") - span), ended.where(
            "_start IS NOT NULL"), [entity, "_start"], "left")
        parts = {c: F.col(f"_{c}") + F.coalesce(f"_p{c}", zero) for c in ("n", "m", "s")}
        n, s = f"{amount}_count_{h}h", f"{amount}_sum_{h}h"
        out = both.withColumns({n: parts["n"], s: F.when(parts["m"] > 0, parts["s"])}).drop(
            "_start", *[f"{p}{c}" for p in ("_", "_p") for c in ("n", "m", "s")])
        names += [n, s]
    return out.select(*df.columns, *names)
