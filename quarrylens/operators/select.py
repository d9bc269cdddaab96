"""Feature selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.scalars import numeric_columns


def column_variances(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Population variance per numeric column, NULL counted as 0."""
    columns = list(columns or numeric_columns(df))
    stats = df.agg(*[F.var_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in columns])
    return stats.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("variance")) for c in columns])))


def drop_low_variance(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    nums = numeric_columns(df)
    if not nums:
        return df
    low = [r["column"] for r in column_variances(df, nums).where(F.col("variance") <= threshold).collect()]
    return df.drop(*low)


def importances(df: DataFrame, target: str, trees: int = 100, depth: int = 5, seed: int = 42, classes: int = 20,
                problem: str | None = None) -> DataFrame:
    """Random-forest importance per numeric feature.

    ``problem`` is classification or regression; where it is not named, a target of at most ``classes`` values is a class.
    """
    features = [c for c in numeric_columns(df) if c != target]
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(
        df.fillna(0, subset=features).where(F.col(target).isNotNull()))
    few = problem == "classification" if problem else df.agg(F.count_distinct(target)).first()[0] <= classes
    if few:
        rows = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc").fit(
            rows.withColumn(target, F.col(target).cast("string"))).transform(
            rows.withColumn(target, F.col(target).cast("string")))
        est = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="_label")
    else:
        rows = rows.withColumn("_label", F.col(target).cast("double"))
        est = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, labelCol="_label")
    found = est.fit(rows.select("features", "_label")).featureImportances.toArray()
    return df.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(features, found)], "feature string, importance double")


def select_by_importance(df: DataFrame, target: str, top_n: int = 20, **forest) -> DataFrame:
    """Keep the ``top_n`` most important numeric features, the target and all other columns."""
    ranked = importances(df, target, **forest).orderBy(F.desc("importance"), "feature").limit(top_n)
    best = [r["feature"] for r in ranked.collect()]
    rest = [c for c in df.columns if c not in numeric_columns(df) and c != target]
    return df.select(*best, target, *rest)
