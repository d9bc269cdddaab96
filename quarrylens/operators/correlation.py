"""Correlation matrices and multicollinearity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import dist
from quarrylens.functions.ranks import running_totals
from quarrylens.functions.scalars import no_nan, numeric_columns, one_row
from quarrylens.session import cut_lineage


def pair_columns(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


def _long_pairs(stats: DataFrame, pairs, fields=("r", "n")) -> DataFrame:
    packed = [
        F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"),
                 *[F.col(f"`{i}|{f}`").alias(f) for f in fields])
        for i, (a, b) in enumerate(pairs)
    ]
    return stats.select(F.inline(F.array(*packed)))


def _both_ways(long: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle to the full matrix with a unit diagonal."""
    flipped = long.select(F.col("col2").alias("col1"), F.col("col1").alias("col2"), "r")
    ones = long.sparkSession.createDataFrame([(c, c, 1.0) for c in columns],
                                             "col1 string, col2 string, r double")
    return long.select("col1", "col2", "r").unionByName(flipped).unionByName(ones)


def pearson_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson r and pair count for all ``pairs`` in one pass (pairwise complete, NaN is missing).

    Each task sums cross products of Arrow batches as matrices, whatever the number of pairs.
    """
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    k = len(columns)
    known_only = df.select(*[no_nan(F.col(c).cast("double")).alias(c) for c in columns])
    means = known_only.agg(*[F.avg(c).alias(c) for c in columns])
    centred = known_only.withColumn("_m", one_row(means)).select(
        *[(F.col(c) - F.col(f"_m.`{c}`")).alias(c) for c in columns])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((4, k, k))
        for batch in batches:
            x = batch.to_numpy(dtype="float64", na_value=np.nan)
            known = ~np.isnan(x)
            x, w = np.where(known, x, 0.0), known.astype("float64")
            sums += np.stack([w.T @ w, x.T @ w, (x * x).T @ w, x.T @ x])
        i, j = np.triu_indices(k, 1)
        yield pd.DataFrame({
            "i": i.astype("int32"), "j": j.astype("int32"), "n": sums[0][i, j], "sx": sums[1][i, j], "sy": sums[1][j, i],
            "sxx": sums[2][i, j], "syy": sums[2][j, i], "sxy": sums[3][i, j]})

    parts = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    t = centred.mapInPandas(products, "i int, j int, " + ", ".join(f"{p} double" for p in parts)).groupBy("i", "j").agg(
        *[F.sum(p).alias(p) for p in parts])
    n = F.nullif(F.col("n"), F.lit(0.0))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    r = F.when((vx > 0) & (vy > 0), (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
    at = {c: i for i, c in enumerate(columns)}
    wanted = df.sparkSession.createDataFrame(
        [(min(at[a], at[b]), max(at[a], at[b]), a, b) for a, b in pairs], "i int, j int, col1 string, col2 string")
    return wanted.join(t, ["i", "j"], "left").select("col1", "col2", r.alias("r"), F.col("n").cast("bigint").alias("n"))


def _pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return (
        df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    )


def _ranked_side(pairs: DataFrame, side: str) -> DataFrame:
    totals = pairs.groupBy(side).agg(F.sum("n").alias("n"))
    ranked = running_totals(totals, side, ["n"])
    return ranked.select(side, (F.col("n_before") + (F.col("n") + 1) / 2).alias(f"r{side}"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns, from counted value pairs joined to mid-ranks."""
    pairs = _pair_counts(df, a, b)
    ranked = pairs.join(_ranked_side(pairs, "x"), "x").join(_ranked_side(pairs, "y"), "y")
    n, w = F.sum("n"), F.col("n")
    mx, my = F.sum(w * F.col("rx")) / n, F.sum(w * F.col("ry")) / n
    sxy = F.sum(w * F.col("rx") * F.col("ry")) / n - mx * my
    sxx = F.sum(w * F.col("rx") * F.col("rx")) / n - mx * mx
    syy = F.sum(w * F.col("ry") * F.col("ry")) / n - my * my
    return ranked.agg(
        F.when((sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy)).alias("r"), n.alias("n")
    ).select(F.lit(a).alias("col1"), F.lit(b).alias("col2"), "r", "n")


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col1, col2, r, n)`` of all pairs of columns, pairwise complete, from one ranking of the unpivoted table.

    A column is ranked once over all its values, and once more for each other column with gaps, over the rows where both
    are known.  All these rankings are one running total; the ranks go back to their rows as one array, and the products
    of all pairs are one pass over these.
    """
    columns = list(columns)
    known = lambda c: no_nan(F.col(f"`{c}`").cast("double"))
    rows = cut_lineage(df.select(F.monotonically_increasing_id().alias("_row"), *[known(c).alias(f"c{i}") for i, c in enumerate(columns)]))
    missing = rows.agg(*[F.count(F.when(F.col(f"c{i}").isNull(), 1)).alias(f"c{i}") for i in range(len(columns))]).first()
    gaps = [i for i in range(len(columns)) if missing[f"c{i}"]]
    slots = {s: at for at, s in enumerate((i, g) for i in range(len(columns)) for g in (-1, *gaps) if g != i)}
    cells = F.array(*[
        F.struct(F.lit(at).alias("slot"), (F.col(f"c{i}") if g < 0 else F.when(F.col(f"c{g}").isNotNull(), F.col(f"c{i}"))).alias("v"))
        for (i, g), at in slots.items()])
    long = rows.select("_row", F.inline(F.filter(cells, lambda c: c["v"].isNotNull())))
    counted = running_totals(long.groupBy("slot", "v").agg(F.count(F.lit(1)).alias("n")), "v", ["n"], ["slot"])
    ranks = cut_lineage(counted.select("slot", "v", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank")))
    back = long.join(ranks, ["slot", "v"]).groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "rank"))).alias("m"))
    wide = cut_lineage(back.select(*[F.col("m")[at].alias(f"s{at}") for at in slots.values()]))
    with_gaps = set(gaps)
    name = lambda i, j: f"s{slots[i, j if j in with_gaps else -1]}"
    asked = [(name(i, j), name(j, i), columns[i], columns[j]) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    names = df.sparkSession.createDataFrame(asked, "s1 string, s2 string, a string, b string")
    found = pearson_pairs(wide, [a[:2] for a in asked]).withColumnsRenamed({"col1": "s1", "col2": "s2"})
    return names.join(found, ["s1", "s2"]).select(F.col("a").alias("col1"), F.col("b").alias("col2"), "r", "n")


def dominance_counts(rows: DataFrame, time: str, score: str, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs (i, j) with ``time_i < time_j`` split by how their scores compare, exactly (``decimal``), per ``by``.

    ``rows`` holds weighted distinct points; ``left`` / ``right`` are the weights a
    point carries as the earlier / later member.  Each unordered pair of times first
    differs at exactly one bit of their dense index, so every pair is met once: at
    that bit, inside the shared prefix.  Per prefix only running totals over the
    score are needed - no pair is ever materialised.
    """
    by = list(by)
    times = rows.select(*by, time).distinct().withColumn("_one", F.lit(1))
    index = running_totals(times, time, ["_one"], by).select(
        *by, time, F.col("_one_before").cast("long").alias("_t"), F.col("_one_total").alias("_nt"))
    coded = rows.join(index, [*by, time])
    levels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.col("_nt").cast("double"))).cast("int") - 1, F.lit(0)))
    spread = coded.select(*by, score, left, right, "_t", F.explode(levels).alias("_level"))
    prefix = F.expr("shiftright(_t, _level + 1)")
    late = F.expr("shiftright(_t, _level) & 1") == 1
    cells = spread.groupBy(*by, "_level", prefix.alias("_prefix"), score).agg(
        F.sum(F.when(late, F.lit(0)).otherwise(F.col(left))).cast("bigint").alias("_l"),
        F.sum(F.when(late, F.col(right)).otherwise(F.lit(0))).cast("bigint").alias("_r"),
    )
    ranked = running_totals(cells, score, ["_r"], [*by, "_level", "_prefix"])
    whole = lambda c: c.cast("decimal(19,0)")
    pairs = lambda c: F.coalesce(F.sum((whole(F.col("_l")) * whole(c)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return ranked.groupBy(*by).agg(
        pairs(F.col("_r_before")).alias("later_lower"),
        pairs(F.col("_r_total") - F.col("_r_before") - F.col("_r")).alias("later_higher"),
        pairs(F.col("_r")).alias("later_tied"))


def kendall_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(col1, col2, r, n)``: Kendall tau-b of all ``pairs`` over all pairs of rows, in one plan."""
    value = lambda c: no_nan(F.col(f"`{c}`").cast("double"))
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), value(a).alias("x"), value(b).alias("y")) for i, (a, b) in enumerate(pairs)])
    counted = cut_lineage(df.select(F.inline(cells)).where("x IS NOT NULL AND y IS NOT NULL").groupBy("pair", "x", "y").agg(
        F.count(F.lit(1)).alias("n")))
    dom = dominance_counts(counted.withColumn("n2", F.col("n")), "x", "y", "n", "n2", ["pair"])

    def ties(side: str, name: str) -> DataFrame:
        return counted.groupBy("pair", side).agg(F.sum("n").cast("double").alias("c")).groupBy("pair").agg(
            F.sum(F.col("c") * (F.col("c") - 1) / 2).alias(name))

    total = counted.groupBy("pair").agg(F.sum("n").alias("n"))
    facts = total.join(dom, "pair").join(ties("x", "tx"), "pair").join(ties("y", "ty"), "pair")
    n0 = F.col("n").cast("double") * (F.col("n") - 1) / 2
    denom = F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty")))
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, col1 string, col2 string")
    tau = F.when(denom > 0, (F.col("later_higher") - F.col("later_lower")).cast("double") / denom)
    return names.join(facts, "pair", "left").select("col1", "col2", tau.alias("r"), "n")


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall tau-b of two columns over all pairs of rows."""
    return kendall_pairs(df, [(a, b)])


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson"
) -> DataFrame:
    """Full matrix as rows ``(col1, col2, r)``; pearson, spearman or kendall, each from one plan for all pairs."""
    columns = list(columns or numeric_columns(df))
    pairs = pair_columns(columns)
    if not pairs:
        return df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "col1 string, col2 string, r double")
    found = {"pearson": lambda: pearson_pairs(df, pairs), "spearman": lambda: spearman_matrix(df, columns),
             "kendall": lambda: kendall_pairs(df, pairs)}[method]()
    return _both_ways(found, columns)


def high_pairs(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Each pair once whose absolute correlation exceeds ``threshold``."""
    return matrix.where((F.col("col1") < F.col("col2")) & (F.abs("r") > threshold))


def correlation_test(df: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    """Coefficient, t-based p-value, strength and direction for one pair."""
    stats = pearson_pairs(df, [(a, b)]) if method == "pearson" else spearman(df, a, b)
    r, n = F.col("r"), F.col("n")
    t = r * F.sqrt((n - 2) / F.greatest(F.lit(1e-300), 1 - r * r))
    size = F.abs(r)
    return stats.withColumn("p_value", dist.t_p(t, n - 2)).withColumn(
        "strength",
        F.when(size >= 0.8, "very strong").when(size >= 0.6, "strong").when(size >= 0.4, "moderate")
        .when(size >= 0.2, "weak").otherwise("negligible"),
    ).withColumn("direction", F.when(r >= 0, "positive").otherwise("negative"))


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation per column: diagonal of the inverse correlation matrix.

    The k x k matrix comes from one Spark aggregation; only k*k numbers reach the driver.
    """
    columns = list(columns)
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    m = np.eye(len(columns))
    at = {c: i for i, c in enumerate(columns)}
    for row in pearson_pairs(clean, pair_columns(columns)).collect():
        r = row["r"] if row["r"] is not None else 0.0
        m[at[row["col1"]], at[row["col2"]]] = m[at[row["col2"]], at[row["col1"]]] = r
    if np.linalg.matrix_rank(m, tol=1e-10) < len(columns):
        scores = [float("inf")] * len(columns)
    else:
        scores = [float(v) for v in np.diag(np.linalg.inv(m))]
    return df.sparkSession.createDataFrame(
        [(c, s, s > 10) for c, s in zip(columns, scores)],
        "column string, vif double, high boolean",
    )
