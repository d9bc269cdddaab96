"""Column profiles and data-quality findings as long tables (one row per column or finding)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.quantiles import melt, quantiles, quantiles_of_counts, widen
from quarrylens.functions.ranks import running_totals, value_counts
from quarrylens.functions.scalars import (
    no_nan,
    numeric_columns,
    one_row,
    safe_div,
    sample_kurtosis,
    sample_skew,
    string_columns,
)
from quarrylens.session import cut_lineage

# Date layouts accepted when a string column is tested for dates, with the
# shape a value must have before it is parsed (parsing misses are slow).
DATE_FORMATS = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
}


def missing(c: str, df: DataFrame) -> Column:
    """True where a value is NULL (or NaN in a floating column)."""
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


def _rows_from(stats: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Turn a one-row aggregate with ``{column}|{field}`` names into one row per column."""
    packed = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"`{c}|{f}`").alias(f) for f in fields],
        )
        for c in columns
    ]
    return stats.select(F.inline(F.array(*packed)))


def text_melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns rendered as strings in ``(keep..., column, value)`` rows."""
    wide = df.select(*keep, *[F.when(~missing(c, df), F.col(c).cast("string")).alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), "column", "value")


def unique_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct non-null values per column, pre-aggregated before the shuffle by column."""
    # 128 bits of hash stand for a value, so that long texts are not shuffled
    pair = F.when(F.col("value").isNotNull(), F.struct(
        F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), F.col("value")).alias("b")))
    counts = value_counts(text_melt(df, columns).withColumn("value", pair), "value", ["column"])
    seen = counts.groupBy("column").agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("unique"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(seen, "column", "left").select(
        "column", F.coalesce("unique", F.lit(0)).alias("unique")
    )


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, missing, unique, moments, quartiles, shape and most frequent value per column.

    Works on unpivoted rows: a handful of aggregates per column key instead of one very
    wide aggregate, and one value-count table for distinct counts, quartiles and tops.
    """
    columns = list(columns or df.columns)
    nums = [c for c in columns if c in set(numeric_columns(df))]
    others = [c for c in columns if c not in nums]
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    fields = ["count", "mean", "std", "min", "max", "skew", "kurtosis", "zeros", "negatives", "unique",
              "q25", "median", "q75", "top", "top_freq"]
    distinct = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("unique")
    parts = []
    if nums:
        x = F.col("value")
        rows = melt(df, nums).withColumn("value", no_nan(x)).where(x.isNotNull())
        moments = rows.groupBy("column").agg(
            F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
            F.max(x).alias("max"), sample_skew(x).alias("skew"), sample_kurtosis(x).alias("kurtosis"),
            F.count(F.when(x == 0, 1)).alias("zeros"), F.count(F.when(x < 0, 1)).alias("negatives"))
        counts = value_counts(rows, "value", ["column"])
        named = {"q25": 0.25, "median": 0.5, "q75": 0.75}
        quart = widen(
            quantiles_of_counts(counts, "value", [0.25, 0.5, 0.75], ["column"]), named, ["column"])
        parts.append(
            moments.join(unique_counts(df, nums), "column").join(quart, "column")
            .withColumns({"top": F.lit(None).cast("string"), "top_freq": F.lit(None).cast("bigint")}))
    if others:
        counts = value_counts(text_melt(df, others), "value", ["column"])
        best = counts.groupBy("column").agg(
            distinct, F.sum("n").alias("count"),
            F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("_b"))
        empty = {f: F.lit(None).cast("double") for f in fields if f in (
            "mean", "std", "min", "max", "skew", "kurtosis", "q25", "median", "q75")}
        parts.append(best.withColumns({
            **empty, "zeros": F.lit(0).cast("bigint"), "negatives": F.lit(0).cast("bigint"),
            "top": F.col("_b.value"), "top_freq": -F.col("_b.neg")}))
    found = parts[0].select("column", *fields)
    for p in parts[1:]:
        found = found.unionByName(p.select("column", *fields))
    dtypes = dict(df.dtypes)
    names = df.sparkSession.createDataFrame([(c, dtypes[c]) for c in columns], "column string, dtype string")
    t = names.join(found, "column", "left").withColumn("_n", n)
    for f in ("count", "zeros", "negatives", "unique"):
        t = t.withColumn(f, F.coalesce(f, F.lit(0)))
    lost = F.col("_n") - F.col("count")
    return t.select(
        "column", "dtype", "count", lost.alias("missing"),
        F.coalesce(safe_div(lost * 100, F.col("_n")), F.lit(0.0)).alias("missing_pct"), *fields[1:])


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column (ties by value)."""
    counts = value_counts(text_melt(df, columns), "value", ["column"])
    w = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def parse_date(c: str, formats: Mapping[str, str] = DATE_FORMATS) -> Column:
    """First layout that parses, else NULL."""
    return F.coalesce(*[
        F.when(F.col(c).rlike(shape), F.try_to_timestamp(F.col(c), F.lit(f))) for f, shape in formats.items()])


def detect_column_types(df: DataFrame, unique: DataFrame | None = None) -> DataFrame:
    """Semantic type per column: numeric, categorical, datetime, text, boolean or id.

    ``unique`` may bring distinct counts (``column``, ``unique``) that are already known.
    """
    if unique is None:
        unique = unique_counts(df, df.columns)
    strings = string_columns(df)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in strings:
        aggs += [
            F.avg(F.length(c)).alias(f"{c}|avg_len"),
            F.count(c).alias(f"{c}|filled"),
            F.count(parse_date(c)).alias(f"{c}|dates"),
        ]
    shape = df.agg(*aggs)
    rows = []
    for f in df.schema.fields:
        c, kind = f.name, f.dataType
        is_str = c in strings
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kind.simpleString()).alias("dtype"),
                F.lit(isinstance(kind, T.BooleanType)).alias("is_bool"),
                F.lit(isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))).alias("is_time"),
                F.lit(isinstance(kind, T.NumericType)).alias("is_num"),
                F.lit(isinstance(kind, T.IntegralType)).alias("is_int"),
                F.col("_n").alias("n"),
                (F.col(f"`{c}|avg_len`") if is_str else F.lit(0.0)).alias("avg_len"),
                (F.col(f"`{c}|filled`") if is_str else F.lit(0)).cast("bigint").alias("filled"),
                (F.col(f"`{c}|dates`") if is_str else F.lit(0)).cast("bigint").alias("dates"),
            )
        )
    facts = shape.select(F.inline(F.array(*rows))).join(unique.select("column", "unique"), "column")
    u, n = F.col("unique"), F.col("n")
    semantic = (
        F.when(F.col("is_bool"), "boolean")
        .when(F.col("is_time"), "datetime")
        .when((F.col("filled") > 0) & (F.col("dates") == F.col("filled")), "datetime")
        .when(F.col("is_num") & (u <= 2), "boolean")
        .when(F.col("is_int") & (u == n), "id")
        .when(F.col("is_num") & (u <= 20) & (u / F.greatest(n, F.lit(1)) < 0.05), "categorical")
        .when(F.col("is_num"), "numeric")
        .when((u > 0.9 * n) & (n > 10) & (F.col("avg_len") < 30), "id")
        .when(F.col("avg_len") > 50, "text")
        .otherwise("categorical")
    )
    label = (
        F.when(u <= 1, "constant").when(u == 2, "binary").when(u <= 10, "low")
        .when(u <= 50, "medium").when(u > 0.9 * n, "unique").otherwise("high")
    )
    return facts.select(
        "column", "dtype", semantic.alias("semantic_type"), "unique", label.alias("cardinality")
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing count and share per column plus the whole-table figures on every row."""
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & ~missing(c, df)
    totals = df.agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(complete, 1).otherwise(0)).alias("_complete"),
        *[F.sum(F.when(missing(c, df), 1).otherwise(0)).alias(f"{c}|missing") for c in df.columns],
    )
    n = F.greatest(F.col("_n"), F.lit(1))
    total = sum((F.col(f"`{c}|missing`") for c in df.columns), F.lit(0))
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"`{c}|missing`").alias("missing"),
            (F.col(f"`{c}|missing`") / n * 100).alias("missing_pct"),
            total.alias("total_missing"),
            (F.col("_n") * len(df.columns)).alias("total_cells"),
            (total / (n * len(df.columns)) * 100).alias("overall_pct"),
            F.col("_complete").alias("complete_rows"),
            (F.col("_complete") / n * 100).alias("complete_rows_pct"),
        )
        for c in df.columns
    ]
    return totals.select(F.inline(F.array(*rows)))


def profile_warnings(df: DataFrame, stats: DataFrame | None = None, types: DataFrame | None = None,
                     gaps: DataFrame | None = None) -> DataFrame:
    """High missing share, constants, wide categoricals, strong skew, few complete rows."""
    stats = cut_lineage(column_stats(df)) if stats is None else stats
    types = detect_column_types(df, stats) if types is None else types
    gaps = missing_summary(df) if gaps is None else gaps
    facts = stats.join(types.select("column", "semantic_type"), "column")
    m, u, s = F.col("missing_pct"), F.col("unique"), F.col("skew")

    def finding(cond: Column, kind: str, severity: str, value: Column) -> Column:
        return F.when(
            cond,
            F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
                     value.cast("double").alias("value")),
        )

    checks = F.array(
        finding(m > 50, "high_missing", "high", m),
        finding((m > 15) & (m <= 50), "moderate_missing", "medium", m),
        finding((u <= 1) & (F.col("count") > 0), "constant", "high", u),
        finding((F.col("semantic_type") == "categorical") & (u > 100), "high_cardinality", "medium", u),
        finding(F.abs(s) > 2, "high_skew", "low", s),
    )
    per_column = facts.select(
        "column", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("f")
    ).select("column", "f.type", "f.severity", "f.value")
    low = (
        gaps.select("complete_rows_pct").limit(1)
        .where(F.col("complete_rows_pct") < 50)
        .select(F.lit(None).cast("string").alias("column"), F.lit("low_completeness").alias("type"),
                F.lit("high").alias("severity"), F.col("complete_rows_pct").alias("value"))
    )
    return per_column.unionByName(low)


def outlier_fences(df: DataFrame, columns: Sequence[str], method: str = "iqr") -> DataFrame:
    """One row of ``{column}_lo`` / ``{column}_hi`` bounds."""
    if method == "iqr":
        q = quantiles(melt(df, columns), "value", [0.25, 0.75], ["column"])
        pick = lambda c, p: F.max(
            F.when((F.col("column") == c) & (F.col("prob") == F.lit(p)), F.col("quantile"))
        )
        out = []
        for c in columns:
            q1, q3 = pick(c, 0.25), pick(c, 0.75)
            out += [(q1 - 1.5 * (q3 - q1)).alias(f"{c}_lo"), (q3 + 1.5 * (q3 - q1)).alias(f"{c}_hi")]
        return q.agg(*out)
    if method == "zscore":
        out = []
        for c in columns:
            x = no_nan(F.col(c).cast("double"))
            mu, sd = F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0))
            out += [(mu - 3 * sd).alias(f"{c}_lo"), (mu + 3 * sd).alias(f"{c}_hi")]
        return df.agg(*out)
    raise ValueError(f"unknown outlier method: {method}")


def detect_outliers(df: DataFrame, columns: Sequence[str], method: str = "iqr") -> DataFrame:
    """Bounds, count and share of values outside them, per column."""
    rows = df.withColumn("_f", one_row(outlier_fences(df, columns, method)))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        lo, hi = F.col(f"_f.`{c}_lo`"), F.col(f"_f.`{c}_hi`")
        aggs += [
            F.sum(F.when(~missing(c, df) & ((F.col(c) < lo) | (F.col(c) > hi)), 1).otherwise(0)).alias(f"{c}|count"),
            F.first(lo).alias(f"{c}|lower_bound"),
            F.first(hi).alias(f"{c}|upper_bound"),
        ]
    found = rows.agg(*aggs)
    packed = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"`{c}|count`").alias("count"),
            (F.col(f"`{c}|count`") / F.greatest(F.col("_n"), F.lit(1)) * 100).alias("percentage"),
            F.col(f"`{c}|lower_bound`").alias("lower_bound"),
            F.col(f"`{c}|upper_bound`").alias("upper_bound"),
        )
        for c in columns
    ]
    return found.select(F.inline(F.array(*packed)))


def detect_duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier identical row: count and share."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("count"),
        (safe_div(F.sum(F.col("_n") - 1), F.sum("_n"), 0.0) * 100).alias("percentage"),
    )


def quality_issues(df: DataFrame) -> DataFrame:
    """Missing values, duplicate rows and IQR outliers graded low / medium / high."""
    cols = ["type", "column", "count", "percentage", "severity"]
    p = F.col("percentage")
    gaps = (
        missing_summary(df).where(F.col("missing") > 0)
        .select(F.lit("missing_values").alias("type"), "column", F.col("missing").alias("count"),
                F.col("missing_pct").alias("percentage"))
        .withColumn("severity", F.when(p > 30, "high").when(p > 10, "medium").otherwise("low"))
    )
    dups = (
        detect_duplicates(df).where(F.col("count") > 0)
        .withColumn("type", F.lit("duplicates"))
        .withColumn("column", F.lit(None).cast("string"))
        .withColumn("severity", F.when(p < 10, "medium").otherwise("high"))
    )
    out = gaps.select(cols).unionByName(dups.select(cols))
    nums = numeric_columns(df)
    if nums:
        outl = (
            detect_outliers(df, nums).where(F.col("count") > 0)
            .withColumn("type", F.lit("outliers"))
            .withColumn("severity", F.when(p > 10, "high").when(p > 3, "medium").otherwise("low"))
        )
        out = out.unionByName(outl.select(cols))
    return out


def infer_problem_type(df: DataFrame, target: str) -> DataFrame:
    """classification for strings or few distinct values (<=20 and <5 %), else regression."""
    is_text = isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType))
    counts = value_counts(df.select(F.col(target).alias("_t")), "_t")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    facts = counts.agg(F.count(F.lit(1)).alias("unique")).withColumn("n", n.scalar())
    few = (F.col("unique") <= 20) & (F.col("unique") / F.greatest(F.col("n"), F.lit(1)) < 0.05)
    return facts.select(
        F.lit(target).alias("target"), "unique", "n",
        F.when(F.lit(is_text) | few, "classification").otherwise("regression").alias("problem_type"),
    )


def profile(df: DataFrame) -> DataFrame:
    """Shape, types, statistics, gaps, strongest correlations and warnings in one long table."""
    from quarrylens.operators.correlation import correlation_matrix

    def long(rows: DataFrame, section: str, item: Column, metrics: Sequence[str]) -> DataFrame:
        packed = F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value"))
            for m in metrics
        ])
        return rows.select(
            F.lit(section).alias("section"), item.alias("item"), F.explode(packed).alias("m")
        ).select("section", "item", "m.metric", "m.value").where(F.col("value").isNotNull())

    # one small row per column: computed once, then shared by all sections
    stats = cut_lineage(column_stats(df))
    types = cut_lineage(detect_column_types(df, stats))
    gaps = cut_lineage(missing_summary(df))
    shape = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
    parts = [
        long(shape, "shape", F.lit("table"), ["rows", "columns"]),
        long(types, "type", F.col("column"), ["dtype", "semantic_type", "cardinality"]),
        long(stats, "stats", F.col("column"),
             ["count", "missing", "missing_pct", "unique", "mean", "std", "min", "q25", "median",
              "q75", "max", "skew", "kurtosis", "zeros", "negatives", "top", "top_freq"]),
        long(gaps, "missing", F.col("column"),
             ["missing", "missing_pct", "total_missing", "overall_pct", "complete_rows_pct"]),
        long(profile_warnings(df, stats, types, gaps), "warning", F.coalesce("column", F.lit("table")),
             ["type", "severity", "value"]),
    ]
    nums = numeric_columns(df)
    if len(nums) >= 2:
        pairs = (
            correlation_matrix(df, nums).where(F.col("col1") < F.col("col2"))
            .orderBy(F.desc(F.abs("r")), "col1", "col2").limit(20)
        )
        parts.append(long(pairs, "correlation", F.concat_ws(" x ", "col1", "col2"), ["r"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def order_statistics(df: DataFrame, value: str, named: dict) -> DataFrame:
    """One row of exact order statistics; ``named`` maps a name to ``f(total) -> 0-based index``."""
    ranked = running_totals(value_counts(df, value), value, ["n"])
    first, after = F.col("n_before"), F.col("n_before") + F.col("n")
    return ranked.agg(*[
        F.max(F.when((first <= f(F.col("n_total"))) & (f(F.col("n_total")) < after), F.col(value))).alias(k)
        for k, f in named.items()
    ])
