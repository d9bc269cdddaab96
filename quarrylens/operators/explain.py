"""Model explanations.

``predict`` is any function that adds a ``prediction`` column to a table of feature
columns (see ``plans.models.predictor``).  Every explanation expands rows once and
scores them in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions.scalars import one_row
from quarrylens.operators.neighbors import nearest
from quarrylens.operators.sampling import sample_random

Predict = Callable[[DataFrame], DataFrame]


def linear_contributions(df: DataFrame, key: str, coefficients: Mapping[str, float]) -> DataFrame:
    """Exact contributions of a linear model, coef x (value - mean), as long rows."""
    means = df.agg(*[F.avg(c).alias(c) for c in coefficients])
    rows = df.withColumn("_m", one_row(means))
    packed = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                 (F.lit(float(b)) * (F.col(c) - F.col(f"_m.`{c}`"))).alias("impact"))
        for c, b in coefficients.items()])
    return rows.select(key, F.inline(packed))


def shapley(df: DataFrame, predict: Predict, features: Sequence[str], key: str, background: DataFrame | None = None,
            permutations: int = 20, seed: int = 42) -> DataFrame:
    """Sampled Shapley contributions against the mean background row.

    For every (row, permutation) the features switch from background to the row's
    values one by one; a contribution is the mean change of the prediction at the
    feature's own step, so contributions add up to prediction - base exactly.
    """
    features = list(features)
    means = (background if background is not None else df).agg(*[F.avg(c).alias(c) for c in features])
    m = len(features)
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in features]).withColumn("_b", one_row(means))
    rows = rows.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    # first half: random orders; each is also walked backwards, which lowers the variance
    base_p = F.floor(F.col("_p") / 2)
    order = F.transform(F.array_sort(F.array(*[
        F.struct(F.xxhash64(F.lit(seed), F.col(key), base_p, F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(m)])),
        lambda s: s["i"])
    order = F.when(F.col("_p") % 2 == 1, F.reverse(order)).otherwise(order)
    rows = rows.withColumn("_order", order).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(m))))
    mixed = rows.select(
        key, "_p", "_k", F.get("_order", F.col("_k") - 1).alias("_i"),
        *[F.when(F.array_position("_order", F.lit(i)) <= F.col("_k"), F.col(c)).otherwise(F.col(f"_b.`{c}`")).alias(c)
          for i, c in enumerate(features)])
    scored = predict(mixed).select(key, "_p", "_k", "_i", "prediction")
    step = F.col("prediction") - F.lag("prediction").over(W.partitionBy(key, "_p").orderBy("_k"))
    moves = scored.select(key, "_i", step.alias("d")).where(F.col("_i").isNotNull())
    names = F.array(*[F.lit(c) for c in features])
    return moves.groupBy(key, F.get(names, F.col("_i")).alias("feature")).agg(F.avg("d").alias("impact"))


def mean_abs_impact(contributions: DataFrame, top: int = 20) -> DataFrame:
    """Features by mean absolute contribution."""
    t = contributions.groupBy("feature").agg(F.avg(F.abs("impact")).alias("mean_abs"))
    return t.orderBy(F.desc("mean_abs"), "feature").limit(top)


def adverse_action(contributions: DataFrame, key: str, top: int = 4) -> DataFrame:
    """Strongest contributions per row as reason codes AA01, AA02 ..."""
    w = W.partitionBy(key).orderBy(F.desc(F.abs(F.col("impact"))), "feature")
    t = contributions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return t.withColumns({
        "reason_code": F.format_string("AA%02d", "rank"),
        "direction": F.when(F.col("impact") > 0, "adverse").otherwise("favorable")})


def _grid(df: DataFrame, feature: str, points: int) -> Column:
    """Evenly spaced values over the observed range, as an array (one small subquery)."""
    lo, hi = F.min(F.col(feature).cast("double")), F.max(F.col(feature).cast("double"))
    return df.agg(F.array(*[lo + (hi - lo) * (i / (points - 1)) for i in range(points)])).scalar()


def pdp(df: DataFrame, predict: Predict, feature: str, points: int = 50) -> DataFrame:
    """Average prediction with ``feature`` set to each grid value, over all rows."""
    rows = df.withColumn("_g", _grid(df, feature, points))
    spread = rows.select(*[c for c in df.columns if c != feature], F.posexplode("_g").alias("_i", feature))
    scored = predict(spread)
    return scored.groupBy(F.col("_i").alias("point"), F.col(feature).alias("value")).agg(
        F.avg("prediction").alias("prediction"))


def ice(df: DataFrame, predict: Predict, feature: str, key: str, lines: int = 50, points: int = 50) -> DataFrame:
    """Prediction curve of ``lines`` sampled rows over the grid."""
    rows = sample_random(df, lines, key).withColumn("_g", _grid(df, feature, points))
    spread = rows.select(*[c for c in df.columns if c != feature], F.posexplode("_g").alias("point", feature))
    return predict(spread).select(key, "point", F.col(feature).alias("value"), "prediction")


def pdp_2d(df: DataFrame, predict: Predict, a: str, b: str, features: Sequence[str], points: int = 25) -> DataFrame:
    """Prediction of the mean row over a grid of two features."""
    mean = df.agg(*[F.avg(c).alias(c) for c in features if c not in (a, b)], F.count(F.lit(1)).alias("_n"))
    rows = mean.withColumns({"_ga": _grid(df, a, points), "_gb": _grid(df, b, points)}).drop("_n")
    rest = [c for c in features if c not in (a, b)]
    spread = rows.select(*rest, "_gb", F.explode("_ga").alias(a)).select(*rest, a, F.explode("_gb").alias(b))
    return predict(spread).select(F.col(a).alias("a"), F.col(b).alias("b"), "prediction")


def what_if(df: DataFrame, predict: Predict, changes: Mapping[str, float], key: str) -> DataFrame:
    """Prediction of every row before and after setting the changed features."""
    known = {c: v for c, v in changes.items() if c in df.columns}
    both = df.select(*[F.array(F.col(c), F.lit(known[c]).cast(df.schema[c].dataType)).alias(c) if c in known else F.col(c)
                       for c in df.columns], F.explode(F.array(F.lit(0), F.lit(1))).alias("_w"))
    picked = both.select("_w", *[F.get(c, F.col("_w")).alias(c) if c in known else F.col(c) for c in df.columns])
    t = predict(picked).groupBy(key).agg(
        F.max(F.when(F.col("_w") == 0, F.col("prediction"))).alias("baseline_pred"),
        F.max(F.when(F.col("_w") == 1, F.col("prediction"))).alias("modified_pred"))
    return t.withColumn("delta", F.col("modified_pred") - F.col("baseline_pred"))


def what_if_sweep(df: DataFrame, predict: Predict, feature: str, values: Sequence[float], key: str) -> DataFrame:
    """Prediction of every row at each listed value of one feature."""
    grid = F.array(*[F.lit(v).cast(df.schema[feature].dataType) for v in values])
    spread = df.select(*[c for c in df.columns if c != feature], F.explode(grid).alias(feature))
    return predict(spread).select(key, F.col(feature).alias("value"), "prediction")


def counterfactual(instances: DataFrame, candidates: DataFrame, features: Sequence[str], key: str,
                   prediction: str = "prediction", k: int = 3, vary: Sequence[str] | None = None,
                   regression: bool = False) -> DataFrame:
    """Nearest rows with another prediction and the features that differ, in long form.

    For regression "another" means a change above max(10 %, half a standard deviation).
    """
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (vary or features)])
    q = instances.select(key, F.col(prediction).cast("double").alias("pred"), vec.alias("_v"))
    c = candidates.select(F.col(key).alias("cf_key"), F.col(prediction).cast("double").alias("pred"), vec.alias("_v"))
    if regression:
        sd = candidates.agg(F.stddev_pop(prediction)).scalar()
        q = q.withColumn("_margin", F.greatest(0.1 * F.abs("pred"), 0.5 * sd))
        found = nearest(q, c, query_key=key, item_key="cf_key", vector="_v", k=k, apart=("pred", "_margin"))
    else:
        found = nearest(q, c, query_key=key, item_key="cf_key", vector="_v", k=k, differ_on="pred")
    before = instances.select(key, F.col(prediction).cast("double").alias("original_pred"),
                              *[F.col(f).cast("double").alias(f"_o{i}") for i, f in enumerate(features)])
    after = candidates.select(F.col(key).alias("cf_key"), F.col(prediction).cast("double").alias("new_pred"),
                              *[F.col(f).cast("double").alias(f"_c{i}") for i, f in enumerate(features)])
    wide = found.join(before, key).join(after, "cf_key")
    changes = F.filter(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"_o{i}").alias("original"), F.col(f"_c{i}").alias("counterfactual"))
        for i, f in enumerate(features)]),
        lambda s: ~s["original"].eqNullSafe(s["counterfactual"])
        & F.coalesce(F.abs(s["original"] - s["counterfactual"]) > 1e-9, F.lit(True)))
    return wide.select(key, "cf_key", "rank", "distance", "original_pred", "new_pred", F.inline_outer(changes))
