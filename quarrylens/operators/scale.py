"""Scaling and power transforms."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.quantiles import melt, quantiles
from quarrylens.functions.scalars import no_nan, one_row


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns])
    rows = df.withColumn("_s", one_row(stats))
    new = {}
    for c in columns:
        sd = F.col(f"_s.`{c}`.s")
        new[c] = (F.col(c) - F.col(f"_s.`{c}`.m")) / F.when(sd > 0, sd).otherwise(1.0)
    return rows.withColumns(new).drop("_s")


def minmax_scale(df: DataFrame, columns: Sequence[str], to: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    stats = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns])
    rows = df.withColumn("_s", one_row(stats))
    new = {}
    for c in columns:
        lo, span = F.col(f"_s.`{c}`.lo"), F.col(f"_s.`{c}`.hi") - F.col(f"_s.`{c}`.lo")
        unit = (F.col(c) - lo) / F.when(span > 0, span).otherwise(1)
        new[c] = unit * (to[1] - to[0]) + to[0]
    return rows.withColumns(new).drop("_s")


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / interquartile range, a zero range counting as 1."""
    q = quantiles(melt(df, columns), "value", [0.25, 0.5, 0.75], ["column"])
    pick = lambda c, p: F.max(F.when((F.col("column") == c) & (F.col("prob") == F.lit(p)), F.col("quantile")))
    stats = q.agg(*[F.struct(pick(c, 0.5).alias("m"), (pick(c, 0.75) - pick(c, 0.25)).alias("r")).alias(c)
                    for c in columns])
    rows = df.withColumn("_s", one_row(stats))
    new = {}
    for c in columns:
        iqr = F.col(f"_s.`{c}`.r")
        new[c] = (F.col(c) - F.col(f"_s.`{c}`.m")) / F.when(iqr != 0, iqr).otherwise(1.0)
    return rows.withColumns(new).drop("_s")


def normalize(df: DataFrame, columns: Sequence[str], norm: str = "l2") -> DataFrame:
    """Scale each row's vector of ``columns`` to unit l1, l2 or max norm."""
    xs = [F.col(c).cast("double") for c in columns]
    if norm == "l1":
        size = sum((F.abs(x) for x in xs[1:]), F.abs(xs[0]))
    elif norm == "l2":
        size = F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))
    elif norm == "max":
        size = F.greatest(*[F.abs(x) for x in xs], F.lit(0.0))
    else:
        raise ValueError(f"unknown norm: {norm}")
    rows = df.withColumn("_norm", size)
    return rows.withColumns({c: x / F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(1.0)
                             for c, x in zip(columns, xs)}).drop("_norm")


def log_transform(df: DataFrame, columns: Sequence[str], base: str = "natural") -> DataFrame:
    fn = {"natural": F.log1p, "log2": lambda c: F.log2(F.col(c) + 1), "log10": lambda c: F.log10(F.col(c) + 1)}
    return df.withColumns({c: fn.get(base, F.log1p)(c) for c in columns})


def sqrt_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Square root, negatives clipped to 0."""
    return df.withColumns({
        c: F.when(F.col(c).isNotNull(), F.sqrt(F.greatest(F.col(c).cast("double"), F.lit(0.0)))) for c in columns})


def power_transform(df: DataFrame, columns: Sequence[str], power: float = 2) -> DataFrame:
    return df.withColumns({c: F.pow(c, F.lit(float(power))) for c in columns})


#: Range of lambda, points of a grid; the second grid lies between the neighbours of the best point of the first.
LAMBDAS, GRID = (-5.0, 5.0), 41


def _known_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(c, x)``: number of the column and value, NULL and NaN left out."""
    cells = [F.struct(F.lit(i).alias("c"), no_nan(F.col(f"`{c}`").cast("double")).alias("x")) for i, c in enumerate(columns)]
    return df.select(F.inline(F.array(*cells))).where("x IS NOT NULL")


def _best_lambdas(values: DataFrame, k: int, likelihood) -> list[float | None]:
    """Lambda of greatest likelihood for each of ``k`` columns, from two aggregations over (column, grid point).

    ``likelihood`` makes the aggregate of ``x`` and ``lam``.  The top of the second grid is where the polynomial through the five
    points around its best one has its own; NULL for columns without values.
    """
    grids = [np.linspace(*LAMBDAS, GRID)] * k
    for turn in range(2):
        table = F.array(*[F.array(*[F.lit(float(g)) for g in grid]) for grid in grids])
        spread = values.select("*", F.posexplode(F.get(table, F.col("c"))).alias("at", "lam"))
        scores = [np.full(GRID, -np.inf) for _ in range(k)]
        found = [False] * k
        for row in spread.groupBy("c", "at").agg(likelihood.alias("l")).collect():
            found[row["c"]] = True
            if row["l"] is not None and np.isfinite(row["l"]):
                scores[row["c"]][row["at"]] = row["l"]
        best = [int(np.argmax(s)) for s in scores]
        if turn == 0:
            grids = [np.linspace(g[max(0, b - 1)], g[min(GRID - 1, b + 1)], GRID) for g, b in zip(grids, best)]
    out: list[float | None] = []
    for grid, score, b, seen in zip(grids, scores, best, found):
        near = slice(min(max(0, b - 2), GRID - 5), min(max(0, b - 2), GRID - 5) + 5)
        top = float(grid[b])
        if np.isfinite(score[near]).all():
            step = grid[1] - grid[0]
            curve = np.polynomial.Polynomial(np.polynomial.polynomial.polyfit((grid[near] - grid[b]) / step, score[near] - score[b], 4))
            tops = [float(z.real) for z in curve.deriv().roots() if abs(z.imag) < 1e-9 and abs(z.real) <= 1]
            if tops:
                top += step * max(tops, key=curve)
        out.append(float(top) if seen else None)
    return out


def _box_cox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam


def box_cox_lambdas(df: DataFrame, columns: Sequence[str]) -> list[tuple[float, float] | None]:
    """Maximum-likelihood lambda of each column and the shift that makes it positive; None for columns without values.

    Three jobs for any number of columns: the ends of their ranges, and two grids.
    """
    columns = list(columns)
    ends = {r["c"]: (r["lo"], r["hi"]) for r in _known_values(df, columns).groupBy("c").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    shifts, middles = [], []
    for i in range(len(columns)):
        low, high = ends.get(i, (1.0, 1.0))
        shifts.append(0.0 if low > 0 else abs(float(low)) + 1.0)
        middles.append((math.log(low + shifts[-1]) + math.log(high + shifts[-1])) / 2)  # keeps the powers in range
    each = lambda numbers: F.get(F.array(*[F.lit(s) for s in numbers]), F.col("c"))
    moved = F.log(F.col("x") + each(shifts)) - each(middles)
    # The logarithm of the variance of x^lam / lam, less the part 2 (lam - 1) mean(log x), which belongs to the likelihood.
    power = F.when(F.abs("lam") < 1e-12, F.col("u")).otherwise(F.exp(F.col("u") * F.col("lam")) / F.col("lam"))
    likelihood = -F.log(F.var_pop(power)) / 2 + F.first("lam") * F.avg("u")
    lambdas = _best_lambdas(_known_values(df, columns).select("c", moved.alias("u")), len(columns), likelihood)
    return [None if lam is None else (lam, shift) for lam, shift in zip(lambdas, shifts)]


def box_cox_lambda(df: DataFrame, column: str) -> tuple[float, float] | None:
    return box_cox_lambdas(df, [column])[0]


def box_cox(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns without any value stay as they are."""
    found = zip(columns, box_cox_lambdas(df, columns))
    return df.withColumns({c: _box_cox(F.col(c) + f[1], f[0]) for c, f in found if f})


def _yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(F.when(x < 0, down))


def yeo_johnson_lambdas(df: DataFrame, columns: Sequence[str]) -> list[float | None]:
    """Maximum-likelihood lambda of each column, NaN missing; None for columns without values.  Two jobs for all columns."""
    x, lam = F.col("x"), F.col("lam")
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    bent = F.when(x >= 0, up).otherwise(down)
    likelihood = -F.log(F.var_pop(bent)) / 2 + (F.first("lam") - 1) * F.avg(F.signum(x) * F.log1p(F.abs(x)))
    return _best_lambdas(_known_values(df, columns), len(columns), likelihood)


def yeo_johnson_lambda(df: DataFrame, column: str) -> float | None:
    return yeo_johnson_lambdas(df, [column])[0]


def yeo_johnson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns without any value stay as they are."""
    found = zip(columns, yeo_johnson_lambdas(df, columns))
    return df.withColumns({c: _yeo_johnson(F.col(c).cast("double"), f) for c, f in found if f is not None})


def power_transform_lambdas(df: DataFrame, columns: Sequence[str], method: str = "yeo_johnson") -> DataFrame:
    """``(column, n, lambda, shift, log_likelihood)`` of the chosen transforms; the likelihood is that of the chosen lambda."""
    columns = list(columns)
    if method == "box_cox":
        chosen = [f or (None, 0.0) for f in box_cox_lambdas(df, columns)]
    else:
        chosen = [(f, 0.0) for f in yeo_johnson_lambdas(df, columns)]
    rows = df.sparkSession.createDataFrame([(i, c, *f) for i, (c, f) in enumerate(zip(columns, chosen))],
                                           "c int, column string, lambda double, shift double")
    cells = []
    for i, (c, (lam, shift)) in enumerate(zip(columns, chosen)):
        x = no_nan(F.col(f"`{c}`").cast("double")) + shift
        if lam is not None:
            y = _box_cox(x, lam) if method == "box_cox" else _yeo_johnson(x, lam)
            bend = F.log(x) if method == "box_cox" else F.signum(x) * F.log1p(F.abs(x))
            cells.append(F.struct(F.lit(i).alias("c"), y.alias("y"), ((lam - 1) * bend).alias("b")))
    facts = df.select(F.inline(F.array(*cells))).groupBy("c").agg(
        F.count("y").alias("n"), (-F.count("y") / 2 * F.log(F.var_pop("y")) + F.sum("b")).alias("log_likelihood"))
    return rows.join(facts, "c", "left").select("column", "n", "lambda", "shift", "log_likelihood")
