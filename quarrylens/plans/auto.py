"""Profile, clean, encode, scale, train, evaluate and rank in one call.

Everything learned (fill values, encodings, scales) comes from the training rows
only; the same transformations are then applied to the test rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.quantiles import melt, quantiles
from quarrylens.functions.scalars import numeric_columns, string_columns
from quarrylens.operators.metrics import rank_models
from quarrylens.operators.profile import detect_column_types, missing_summary
from quarrylens.operators.sampling import train_test_split
from quarrylens.plans import models as L
from quarrylens.session import cut_lineage

#: Defaults of the preparation: categories up to which a column is one-hot or target encoded (frequency beyond), weight of the
#: overall mean in a target encoding, share of gaps in percent above which a column is dropped.
ONE_HOT_LIMIT = 10
TARGET_LIMIT = 50
SMOOTHING = 10
DROP_MISSING_PCT = 50.0


@dataclass
class AutoResult:
    """Ranked results table, fitted models and the feature preparation."""

    results: DataFrame
    models: dict[str, PipelineModel]
    features: list[str]
    prepare: object
    dropped: list[str] = field(default_factory=list)


def category_table(train: DataFrame, cats: Sequence[str], target: str, classes: Sequence[str] | None) -> DataFrame:
    """``column, value, n, s`` of every category from one aggregation: rows, and sums of the target.

    ``s`` holds the sum of a numeric target, or the rows of each of ``classes`` but the first.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cats])
    rows = train.select(F.explode(cells).alias("cell"), F.col(target).alias("y")).select("cell.*", "y").where("value IS NOT NULL")
    parts = [F.col("y").cast("double")] if classes is None else [(F.col("y").cast("string") == k).cast("double") for k in classes[1:]]
    return rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(p) for p in parts]).alias("s"))


def learn_preparation(train: DataFrame, target: str, key: str, problem: str, one_hot_limit: int = ONE_HOT_LIMIT,
                      target_limit: int = TARGET_LIMIT, drop_missing_pct: float = DROP_MISSING_PCT):
    """Learn fills, encodings and robust scales on ``train``; returns (function, features, dropped).

    A text column of at most ``one_hot_limit`` categories becomes indicators, one of at most ``target_limit`` the smoothed mean
    of the target (of each class but the first), any other the frequency of its value.  Values not seen in training get
    the overall mean, or frequency 0.
    """
    facts = {r["column"]: r for r in missing_summary(train).collect()}
    kinds = {r["column"]: r["semantic_type"] for r in detect_column_types(train.drop(target)).collect()}
    dropped = [c for c, r in facts.items() if c not in (key, target) and r["missing_pct"] > drop_missing_pct]
    dropped += [c for c, k in kinds.items() if k in ("id", "text", "datetime") and c != key and c not in dropped]
    kept = [c for c in train.columns if c not in (key, target) and c not in dropped]
    nums = [c for c in kept if c in numeric_columns(train)]
    cats = [c for c in kept if c in string_columns(train)]
    scales = {}
    if nums:
        for r in quantiles(melt(train, nums), "value", [0.25, 0.5, 0.75], ["column"]).collect():
            scales.setdefault(r["column"], {})[r["prob"]] = r["quantile"]
    tables, one_hot, unseen, width = {}, {}, {}, {}
    if cats:
        classes = None
        if problem == "classification":
            classes = [r[0] for r in train.select(F.col(target).cast("string").alias("y")).distinct().orderBy("y").collect()]
        found = cut_lineage(category_table(train, cats, target, classes))
        sums = F.array(*[F.sum(F.col("s")[i]) for i in range(1 if classes is None else len(classes) - 1)])
        sizes = {r["column"]: r for r in found.groupBy("column").agg(
            F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), sums.alias("s")).collect()}
        few = [c for c in cats if c in sizes and sizes[c]["k"] <= one_hot_limit]
        for r in found.where(F.col("column").isin(few)).select("column", "value").collect():
            one_hot.setdefault(r["column"], []).append(r["value"])
        one_hot = {c: sorted(one_hot[c]) for c in few}
        for c in cats:
            if c in few or c not in sizes:
                continue
            n = sizes[c]["n"]
            if sizes[c]["k"] <= target_limit:
                unseen[c] = [s / n for s in sizes[c]["s"]]
                code = F.array(*[(F.col("s")[i] + SMOOTHING * m) / (F.col("n") + SMOOTHING) for i, m in enumerate(unseen[c])])
            else:
                unseen[c] = [0.0]
                code = F.array(F.col("n") / F.lit(float(n)))
            width[c] = len(unseen[c])
            tables[c] = found.where(F.col("column") == c).select(F.col("value").alias("_k"), code.alias("_v"))
    encoded = {c: [f"{c}_encoded" if width[c] == 1 else f"{c}_encoded_{i + 1}" for i in range(width[c])] for c in tables}
    features = [f"{c}_scaled" for c in nums] + [f"{c}_{i}" for c in one_hot for i in range(1, len(one_hot[c]))] + [
        name for c in tables for name in encoded[c]]

    def prepare(df: DataFrame) -> DataFrame:
        out = df
        for c, table in tables.items():
            table = F.broadcast(table) if sizes[c]["k"] <= target_limit else table  # few categories: a shuffle by them is lopsided
            out = out.join(table, out[c] == table["_k"], "left").withColumns({
                name: F.coalesce(F.col("_v")[i], F.lit(unseen[c][i])) for i, name in enumerate(encoded[c])}).drop("_k", "_v")
        cols = [F.col(key), F.col(target)]
        for c in nums:
            q = scales.get(c, {})
            mid = q.get(0.5, 0.0)
            spread = (q.get(0.75, 0.0) - q.get(0.25, 0.0)) or 1.0
            cols.append(((F.coalesce(F.col(c).cast("double"), F.lit(mid)) - mid) / spread).alias(f"{c}_scaled"))
        for c, values in one_hot.items():
            cols += [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}_{i}") for i, v in enumerate(values) if i]
        cols += [F.col(name) for c in tables for name in encoded[c]]
        return out.select(*cols)

    return prepare, features, dropped


def auto_pipeline(df: DataFrame, target: str, key: str, algorithms: Sequence[str] | None = None,
                  test_size: float = 0.2) -> AutoResult:
    """Train the given (or default) algorithms and rank them on held-out rows."""
    rows = df.where(F.col(target).isNotNull())
    problem = L.problem_type(rows, target)
    algorithms = list(algorithms or (["logistic_regression", "random_forest", "gradient_boosting"] if problem == "classification"
                                     else ["linear_regression", "random_forest", "gradient_boosting"]))
    split = train_test_split(rows, key, test_size, target if problem == "classification" else None).persist()
    fit_rows = test_rows = None
    try:
        train, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
        prepare, features, dropped = learn_preparation(train, target, key, problem)
        fit_rows, test_rows = prepare(train).persist(), prepare(test).persist()
        models, out = {}, []
        for name in algorithms:
            models[name] = L.train(fit_rows, features, target, name, problem=problem)
            scored = L.score(test_rows, models[name], features, [target])
            out.append(L.evaluate(scored, target, problem).withColumn("model", F.lit(name)).collect()[0].asDict())
    finally:
        for held in (fit_rows, test_rows, split):
            if held is not None:
                held.unpersist()
    metric = "f1" if problem == "classification" else "r2"
    names = ["model", *[k for k in out[0] if k != "model"]]
    table = df.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in out], names)
    return AutoResult(rank_models(table, metric), models, features, prepare, dropped)
