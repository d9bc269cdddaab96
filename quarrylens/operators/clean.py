"""Cleaning: names, strings, types, dates, missing values, outliers and duplicates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.quantiles import melt, quantiles
from quarrylens.functions.ranks import value_counts
from quarrylens.functions.scalars import no_nan, numeric_columns, one_row, string_columns
from quarrylens.operators.profile import order_statistics, outlier_fences, parse_date

# Fixed value: what a string must contain before a column is tried as dates.
DATE_HINT = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"


def tidy_name(name: str) -> str:
    """Lower case, separators to underscores, other symbols dropped."""
    name = re.sub(r"[\s\-]+", "_", name.strip().lower())
    return re.sub(r"\W", "", name) or "unnamed"


def unique_names(names: Sequence[str]) -> list[str]:
    """Number repeated names: c, c_1, c_2 ..., skipping names that are taken."""
    taken, given, out = set(names), set(), []
    for n in names:
        new, i = n, 0
        while new in given or (i and new in taken):
            i += 1
            new = f"{n}_{i}"
        given.add(new)
        out.append(new)
    return out


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[tidy_name(c) for c in df.columns])


def dedupe_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def strip_and_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Trim white space in string columns and turn empty strings into NULL."""
    columns = string_columns(df) if columns is None else columns
    trimmed = {c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("")) for c in columns}
    return df.withColumns(trimmed) if trimmed else df


def _rates(df: DataFrame, tests: Mapping[str, Column]) -> dict[str, tuple[int, int]]:
    """Non-null count and hits per column, from one aggregation."""
    aggs = []
    for c, hit in tests.items():
        aggs += [F.count(c).alias(f"{c}|n"), F.count(F.when(hit, 1)).alias(f"{c}|hit")]
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    return {c: (row[f"{c}|n"], row[f"{c}|hit"]) for c in tests}


def to_numeric_columns(df: DataFrame, columns: Sequence[str] | None = None,
                       threshold: float = 0.8) -> DataFrame:
    """String columns of which at least ``threshold`` of the non-nulls convert become doubles."""
    columns = string_columns(df) if columns is None else list(columns)
    rates = _rates(df, {c: F.col(c).try_cast("double").isNotNull() for c in columns})
    change = {c: F.col(c).try_cast("double") for c, (n, hit) in rates.items()
              if n and hit / n >= threshold}
    return df.withColumns(change) if change else df


def value_kind(c: str) -> Column:
    """int, float or str, judged by the text of a value."""
    return (
        F.when(F.col(c).rlike(r"^\s*[+-]?\d+\s*$"), "int")
        .when(F.col(c).try_cast("double").isNotNull(), "float")
        .when(F.col(c).isNotNull(), "str")
    )


def fix_mixed_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numbers win where they dominate a mixed string column (the rest becomes NULL)."""
    columns = string_columns(df) if columns is None else list(columns)
    aggs = [F.count(F.when(value_kind(c) == k, 1)).alias(f"{c}|{k}")
            for c in columns for k in ("int", "float", "str")]
    if not aggs:
        return df
    row = df.agg(*aggs).first()
    change = {}
    for c in columns:
        found = {k: row[f"{c}|{k}"] for k in ("int", "float", "str")}
        if sum(1 for v in found.values() if v) <= 1:
            continue
        winner = max(found, key=lambda k: found[k])
        if winner in ("int", "float"):
            change[c] = F.col(c).try_cast("double")
    return df.withColumns(change) if change else df


def parse_dates(df: DataFrame, columns: Sequence[str] | None = None, hint: bool = False) -> DataFrame:
    """Columns of which at least half parse become timestamps.

    With ``hint`` a column must first look like dates in half of its values.
    """
    columns = string_columns(df) if columns is None else list(columns)
    if hint:
        looks = _rates(df, {c: F.col(c).rlike(DATE_HINT) for c in columns})
        columns = [c for c in columns if looks[c][0] and looks[c][1] >= 0.5 * looks[c][0]]
    if not columns:
        return df
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(c).alias(f"{c}|n") for c in columns],
                 *[F.count(parse_date(c)).alias(f"{c}|hit") for c in columns]).first()
    change = {}
    for c in columns:
        base = row[f"{c}|n"] if hint else row["_n"]
        if base and row[f"{c}|hit"] / base >= 0.5:
            change[c] = parse_date(c)
    return df.withColumns(change) if change else df


def sanitize(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All cleaning steps in order; returns the table and the list of changes made."""
    issues: list[tuple[str, str | None]] = []
    named = clean_column_names(df)
    if named.columns != df.columns:
        issues.append(("column_rename", None))
    unique = dedupe_column_names(named)
    issues += [("duplicate_column_renamed", new)
               for old, new in zip(named.columns, unique.columns) if old != new]
    texts = string_columns(unique)
    if texts:
        row = unique.agg(*[
            F.count(F.when(F.col(c).rlike(r"^\s|\s$"), 1)).alias(f"{c}|pad") for c in texts
        ], *[F.count(F.when(F.trim(c) == "", 1)).alias(f"{c}|empty") for c in texts]).first()
        for c in texts:
            if row[f"{c}|pad"]:
                issues.append(("whitespace_stripped", c))
            if row[f"{c}|empty"]:
                issues.append(("empty_to_null", c))
    out = strip_and_null(unique)
    for kind, step in (("numeric_conversion", to_numeric_columns),
                       ("mixed_types_fixed", fix_mixed_types),
                       ("date_parsed", lambda d: parse_dates(d, hint=True))):
        before = dict(out.dtypes)
        out = step(out)
        issues += [(kind, c) for c, t in out.dtypes if before[c] != t]
    log = df.sparkSession.createDataFrame(
        [(i, k, c) for i, (k, c) in enumerate(issues)], "step int, type string, column string"
    )
    return out, log


def handle_missing(df: DataFrame, strategy: Mapping[str, str],
                   order_by: Sequence[str] = ()) -> DataFrame:
    """Per-column strategy: mean, median, mode, zero, constant:v, drop_rows, knn,
    forward_fill or backward_fill (the fills need ``order_by``)."""
    from quarrylens.operators.impute import fill_values, impute_knn
    from quarrylens.operators.sequence import fill

    simple = {c: s for c, s in strategy.items() if s in ("mean", "median", "mode")}
    out = fill_values(df, simple) if simple else df
    for c, s in strategy.items():
        if s == "zero":
            out = out.withColumn(c, F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)))
        elif s.startswith("constant:"):
            out = out.withColumn(
                c, F.coalesce(c, F.lit(s.split(":", 1)[1]).cast(df.schema[c].dataType)))
        elif s == "drop_rows":
            out = out.dropna(subset=[c])
        elif s in ("forward_fill", "backward_fill"):
            out = fill(out, [c], order_by, forward=s == "forward_fill")
        elif s == "knn":
            out = impute_knn(out, numeric_columns(df), [c], key=order_by[-1])
        elif s not in ("mean", "median", "mode"):
            raise ValueError(f"unknown strategy {s!r} for column {c!r}")
    return out


def handle_outliers(df: DataFrame, column: str, method: str, *, detection: str = "iqr",
                    limits: tuple[float, float] = (0.05, 0.05)) -> DataFrame:
    """clip to the IQR fences, remove rows outside them, or winsorize both tails; NaN is a missing value and becomes NULL."""
    if dict(df.dtypes)[column] in ("double", "float"):
        df = df.withColumn(column, no_nan(F.col(column)))
    x = F.col(column)
    if method == "winsorize":
        low, high = limits
        bounds = order_statistics(df, column, {
            "lo": lambda n: F.floor(F.lit(low) * n),
            "hi": lambda n: n - 1 - F.floor(F.lit(high) * n),
        })
        lo, hi = F.col("_b.lo"), F.col("_b.hi")
        rows = df.withColumn("_b", one_row(bounds))
        return rows.withColumn(
            column, F.when(x < lo, lo).when(x > hi, hi).otherwise(x)).drop("_b")
    rows = df.withColumn("_f", one_row(outlier_fences(df, [column], detection)))
    lo, hi = F.col(f"_f.`{column}_lo`"), F.col(f"_f.`{column}_hi`")
    if method == "clip":
        return rows.withColumn(
            column, F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))).drop("_f")
    if method == "remove":
        return rows.where(~F.coalesce((x < lo) | (x > hi), F.lit(False))).drop("_f")
    raise ValueError(f"unknown outlier method: {method}")


def remove_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                      keep: str | bool = "first", order_by: Sequence[str] = ()) -> DataFrame:
    """Keep the first / last row per key in ``order_by`` order, or (``keep=False``) no repeats.

    Aggregates instead of ranking, so a key with a third of all rows is reduced map-side.
    """
    keys = list(subset or df.columns)
    rest = [c for c in df.columns if c not in keys]
    if keep is False:
        out = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
        return out.where(F.col("_n") == 1).select(*df.columns)
    if not rest:
        return df.dropDuplicates(keys)
    if not order_by:
        raise ValueError("order_by is needed to say which duplicate comes first")
    pick = F.min_by if keep == "first" else F.max_by
    chosen = pick(F.struct(*rest), F.struct(*order_by)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, "_row.*").select(*df.columns)


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column (the smallest one on ties), values compared as stored."""
    parts = None
    for c in columns:
        counts = value_counts(df.select(F.col(c).alias("value")), "value")
        best = counts.agg(
            F.min(F.struct((-F.col("n")).alias("k"), F.col("value"))).alias("b")
        ).select(F.lit(c).alias("column"), F.col("b.value").cast("string").alias("value"),
                 (-F.col("b.k")).alias("n"))
        parts = best if parts is None else parts.unionByName(best)
    return parts


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return quantiles(melt(df, columns), "value", [0.5], ["column"]).select(
        "column", F.col("quantile").alias("median"))


