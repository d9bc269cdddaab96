"""Exact, repeatable samples and splits of any size, with no global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions.ranks import same_keys, sequence_index
from quarrylens.session import cut_lineage


#: Leading bits of a hash by which rows are counted; only the rows of one such part of a stratum are ranked for a cut.
PART_BITS = 12


def _shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Add the hash ``_h`` of the key, which sets the order, and ``_part``, the range of hashes it lies in."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_part", F.shiftright("_h", 64 - PART_BITS))


def _parts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per stratum and part: the rows ``_before`` it and all ``_rows`` of the stratum."""
    whole = W.partitionBy(*(by or [F.lit(0)]))
    ahead = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        *by, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_rows"))


def _with_stratum(df: DataFrame, strata: DataFrame, name: str, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach the one row per stratum; it is broadcast, for a shuffle by stratum would put each class into one task."""
    return same_keys(df, F.broadcast(strata), by, how) if by else df.withColumn(name, strata.select(name).scalar())


def _rows(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def _cuts(df: DataFrame, key: str, seed: int, quota, by: Sequence[str] = ()) -> DataFrame:
    """Per stratum, the last (hash, key) that belongs to its first ``quota(rows)`` rows in hash order.

    Rows are counted by ranges of the hash; only those of the range in which a stratum's quota ends are ranked, equal keys as one.
    """
    by = list(by)
    keys = _shuffled(df.select(*dict.fromkeys([*by, key])), key, seed)
    last = _parts(keys, by).where(F.col("_before") < quota(F.col("_rows"))).groupBy(*by).agg(
        F.max(F.struct("_part", "_before", "_rows")).alias("_last"))
    near = _with_stratum(keys, last, "_last", by).where(F.col("_part") == F.col("_last._part"))
    counts = near.select(*by, "_h", F.col(key).alias("_k"), "_last").groupBy(*by, "_h", "_k").agg(
        F.count(F.lit(1)).alias("_n"), F.first("_last").alias("_last"))
    ahead = W.partitionBy(*(by or [F.lit(0)])).orderBy("_h", "_k").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("_last._before") + F.coalesce(F.sum("_n").over(ahead), F.lit(0))
    inside = counts.withColumn("_first", first).where(F.col("_first") < quota(F.col("_last._rows")))
    return inside.groupBy(*by).agg(F.max(F.struct("_h", "_k")).alias("_cut"))


def _within(df: DataFrame, cuts: DataFrame, key: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_in``: whether a row lies at or before the cut of its stratum."""
    rows = _with_stratum(_shuffled(df, key, seed), cuts, "_cut", list(by), "left")
    return rows.withColumn("_in", F.coalesce(F.struct("_h", F.col(key).alias("_k")) <= F.col("_cut"), F.lit(False)))


def sample_random(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), chosen by the hash order of a unique ``key``."""
    cuts = _cuts(df, key, seed, lambda rows: F.lit(n))
    return _within(df, cuts, key, seed).where("_in").select(*df.columns)


def sample_stratified(df: DataFrame, n: int, target: str, key: str, seed: int = 42) -> DataFrame:
    """About ``n`` rows in class proportion (each class gets its rounded quota, at least one)."""
    all_rows = _rows(df)
    cuts = _cuts(df, key, seed, lambda rows: F.greatest(F.round(F.lit(float(n)) * rows / all_rows), F.lit(1.0)), [target])
    return _within(df, cuts, key, seed, [target]).where("_in").select(*df.columns)


def sample_systematic(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """Every max(N//n, 1)-th row in ``order_by`` order, the first ``n`` of them."""
    ranked = sequence_index(df, order_by, total="_n")
    step = F.greatest(F.floor(F.col("_n") / F.lit(n)), F.lit(1))
    hit = (F.pmod("_index", step) == 0) & (F.floor(F.col("_index") / step) < n)
    return ranked.where(hit).select(*df.columns)


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, stratify: str | None = None,
                     seed: int = 42, name: str = "split") -> DataFrame:
    """Add ``split`` = train / test, exact share per stratum.

    The cuts, one row per stratum, are found at once, so that reading the split again costs one scan.
    """
    by = [stratify] if stratify else []
    cuts = cut_lineage(_cuts(df, key, seed, lambda rows: F.round(F.lit(test_size) * rows), by))
    return _within(df, cuts, key, seed, by).select(*df.columns, F.when(F.col("_in"), "test").otherwise("train").alias(name))


def fold_ids(df: DataFrame, key: str, folds: int = 5, stratify: str | None = None,
             seed: int = 42, name: str = "fold") -> DataFrame:
    """Add a 0-based fold number; folds differ by at most one row per stratum."""
    group = F.struct(*([stratify] if stratify else []), "_part")  # not null, so rows are shuffled once for window and join
    rows = _shuffled(df, key, seed).withColumn("_s", group)
    offsets = _parts(rows, [stratify] if stratify else []).select(group.alias("_s"), "_before")
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("_s").orderBy("_h", key))).join(offsets, "_s")
    return ranked.select(*df.columns, F.pmod(F.col("_before") + F.col("_r") - 1, F.lit(folds)).cast("int").alias(name))


def top_k(df: DataFrame, order_by: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows: per-task top-k, then a merge of those."""
    return df.orderBy(*order_by).limit(k)


def data_query(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], limit: int = 20) -> DataFrame:
    """Up to five named columns of the first ``limit`` rows in ``order_by`` order."""
    known = [c for c in columns if c in df.columns][:5] or df.columns[:5]
    return df.orderBy(*order_by).limit(limit).select(*known)
