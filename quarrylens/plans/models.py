"""Training, validation, tuning and batch scoring with Spark ML."""

from __future__ import annotations

import itertools
import json
import math
import random
from collections import Counter
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import MinMaxScaler, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.scalars import one_row
from quarrylens.operators.metrics import classification_metrics, regression_metrics
from quarrylens.operators.profile import infer_problem_type
from quarrylens.operators.sampling import fold_ids
from quarrylens.session import cut_lineage

CLASSIFIERS: Mapping[str, Callable] = {
    "logistic_regression": lambda **p: C.LogisticRegression(**p),
    "random_forest": lambda **p: C.RandomForestClassifier(**{"seed": 42, **p}),
    "gradient_boosting": lambda **p: C.GBTClassifier(**{"seed": 42, **p}),
    "linear_svc": lambda **p: C.LinearSVC(**p),
    "decision_tree": lambda **p: C.DecisionTreeClassifier(**{"seed": 42, **p}),
    "naive_bayes": lambda **p: C.NaiveBayes(**{"modelType": "gaussian", **p}),
    "mlp": lambda **p: C.MultilayerPerceptronClassifier(**{"seed": 42, **p}),
}
REGRESSORS: Mapping[str, Callable] = {
    "linear_regression": lambda **p: R.LinearRegression(**p),
    "ridge": lambda **p: R.LinearRegression(**{"regParam": 1.0, "elasticNetParam": 0.0, **p}),
    "lasso": lambda **p: R.LinearRegression(**{"regParam": 1.0, "elasticNetParam": 1.0, **p}),
    "random_forest": lambda **p: R.RandomForestRegressor(**{"seed": 42, **p}),
    "gradient_boosting": lambda **p: R.GBTRegressor(**{"seed": 42, **p}),
    "decision_tree": lambda **p: R.DecisionTreeRegressor(**{"seed": 42, **p}),
}
BINARY_ONLY = ("gradient_boosting", "linear_svc")


def problem_type(df: DataFrame, label: str) -> str:
    return infer_problem_type(df, label).first()["problem_type"]


def estimator(algorithm: str, problem: str, params: Mapping | None = None, classes: int = 2, n_features: int = 0):
    """Spark ML estimator of a named algorithm; binary-only ones become one-vs-rest."""
    table = CLASSIFIERS if problem == "classification" else REGRESSORS
    if algorithm not in table:
        raise ValueError(f"unknown {problem} algorithm: {algorithm}")
    params = dict(params or {})
    if algorithm == "mlp":
        params.setdefault("layers", [n_features, max(4, n_features), classes])
    est = table[algorithm](**params)
    if problem == "classification" and algorithm in BINARY_ONLY and classes > 2:
        return C.OneVsRest(classifier=est)
    return est


def pipeline(df: DataFrame, features: Sequence[str], label: str, algorithm: str, problem: str,
             params: Mapping | None = None) -> Pipeline:
    """Assemble features, index a class label, add the estimator."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")]
    classes = 2
    if problem == "classification":
        classes = df.where(F.col(label).isNotNull()).select(label).distinct().count()
        stages.append(StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip"))
        target = "label_index"
    else:
        target = label
    est = estimator(algorithm, problem, params, classes, len(features))
    return Pipeline(stages=[*stages, est.setLabelCol(target).setFeaturesCol("features")])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, weight)``: rows of each class and the weight that makes all classes count alike; the mean weight is one."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    facts = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    return counts.withColumn("_f", one_row(facts)).select(
        label, "n", (F.col("_f.rows") / (F.col("_f.classes") * F.col("n"))).alias("weight"))


def tree_thresholds(rows: DataFrame, features: Sequence[str], n: int, bins: int, seed: int) -> list[list[float]]:
    """Where Spark's trees may split each feature: it draws these rows of the ``n`` and cuts their values at these places."""
    bins = min(bins, n)
    share = min(1.0, max(bins * bins, 10000) / n)
    spark, values = rows.sparkSession, rows.select([F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    drawn = DataFrame(spark._jsparkSession.createDataFrame(
        values._jdf.javaRDD().sample(False, share, draw), values._jdf.schema()), spark).collect()
    return [_thresholds([r[i] for r in drawn], share * n, bins - 1) for i in range(len(features))]


def _thresholds(drawn: Sequence[float], expected: float, most: int) -> list[float]:
    """Cuts between the values drawn: all if there are at most ``most``, else about equally many rows apart.

    Of ``expected`` rows, those that are not among the ones drawn with another value count as zeros.
    """
    counts = Counter(v for v in drawn if v != 0.0)
    others = sum(counts.values())
    if not others:
        return []
    if expected - others > 2.0 ** -52 * others * 100:
        counts[0.0] = expected - others
    values = sorted(counts)
    middle = [(a + b) / 2 for a, b in itertools.pairwise(values)]
    if len(middle) <= most:
        return middle
    step = expected / (most + 1)
    out, seen, goal = [], counts[values[0]], step
    for cut, value in zip(middle, values[1:]):
        before, seen = seen, seen + counts[value]
        if abs(before - goal) < abs(seen - goal):
            out.append(cut)
            goal += step
    return out


def _fits_cells(rows: DataFrame, features: Sequence[str], problem: str, params: Mapping | None) -> bool:
    """Whether rows of equal bins may be one weighted row: single rows are neither drawn, counted nor marked, the loss is smooth."""
    est = estimator("gradient_boosting", problem, params)
    smooth = problem == "classification" or est.getLossType() == "squared"
    plain = not any(est.isSet(c) for c in ("weightCol", "validationIndicatorCol"))
    kinds = {f.name: f.dataType for f in rows.schema}
    return smooth and plain and est.getSubsamplingRate() == 1.0 and est.getMinInstancesPerNode() == 1 and all(
        isinstance(kinds.get(c), (T.NumericType, T.BooleanType)) for c in features)


def _boosted(rows: DataFrame, features: Sequence[str], label: str, problem: str, params: Mapping | None) -> PipelineModel | None:
    """Boosted trees from one weighted row per cell, the rows that no tree can tell apart; null where this saves little.

    A tree sees only the bin of a feature, and all rows of a bin of each feature get the same prediction.  So the counts of a
    cell's classes, or the number, mean and variance of its labels (kept by two labels, one to each side of the mean), give the
    sums that all rows would give to each split and leaf, while the rounds pass over cells.  Few rows to a cell are not worth
    other last digits of these sums, which settle ties.
    """
    est, n = estimator("gradient_boosting", problem, params), rows.count()
    if not n:
        return None
    cuts = tree_thresholds(rows, features, n, est.getMaxBins(), est.getSeed())
    name = lambda c: "`" + c.replace("`", "``") + "`"
    bin_of = lambda c, at: "CASE " + " ".join(
        f"WHEN CAST({name(c)} AS DOUBLE) <= CAST('{t!r}' AS DOUBLE) THEN {i}.0D" for i, t in enumerate(at, 1)) + f" ELSE {len(at) + 1}.0D END"
    bins = [f"_bin_{i}" for i in range(len(features))]
    to_bins = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"{bin_of(c, at) if at else '1.0D'} AS {b}" for c, at, b in zip(features, cuts, bins)) + " FROM __THIS__")
    binned, weight = to_bins.transform(rows), "_weight"
    if problem == "classification":
        cells = binned.groupBy(*bins, label).agg(F.count(F.lit(1)).cast("double").alias(weight))
    else:
        facts = binned.groupBy(*bins).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg(label).alias("_m"),
                                          F.stddev_pop(label).alias("_s"))
        sides = F.array(*[F.struct((F.col("_m") + side * F.col("_s")).alias(label), (F.col("_n") / 2).alias(weight))
                          for side in (-1, 1)])
        whole = F.array(F.struct(F.col("_m").alias(label), F.col("_n").alias(weight)))
        cells = facts.select(*bins, F.inline(F.when(F.col("_s") > 0, sides).otherwise(whole)))
    cells = cut_lineage(cells)
    many = cells.count()
    if 2 * many > n:
        return None
    plan = pipeline(cells, bins, label, "gradient_boosting", problem, params)
    last = plan.getStages()[-1].setWeightCol(weight)
    trees = last.getClassifier() if isinstance(last, C.OneVsRest) else last
    trees.setMaxBins(max(est.getMaxBins(), math.isqrt(many) + 1))  # so that all cells are drawn, and all bins are found
    return PipelineModel([to_bins, *plan.fit(cells).stages])


def train(df: DataFrame, features: Sequence[str], label: str, algorithm: str, params: Mapping | None = None,
          problem: str | None = None, balanced: bool = False) -> PipelineModel:
    """Fit one algorithm on the rows with a label and complete features.

    ``balanced`` weighs the rows of each class so that all classes count alike (estimators with a weight column).
    """
    problem = problem or problem_type(df, label)
    rows = df.select(*features, F.col(label).cast("double" if problem == "regression" else "string").alias(label)).dropna()
    if algorithm == "gradient_boosting" and not balanced and _fits_cells(rows, features, problem, params):
        model = _boosted(rows, features, label, problem, params)
        if model is not None:
            return model
    plan = pipeline(rows, features, label, algorithm, problem, params)
    if balanced:
        weight = "_weight"
        plan.getStages()[-1].setWeightCol(weight)
        weights = class_weights(rows, label).select(F.col(label).alias("_class"), F.col("weight").alias(weight))
        rows = rows.join(weights, rows[label] == F.col("_class")).drop("_class")
    return plan.fit(rows)


def _labels(model: PipelineModel) -> list[str] | None:
    for s in model.stages:
        if hasattr(s, "labels"):
            return list(s.labels)
    return None


def score(df: DataFrame, model: PipelineModel, features: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """Batch scoring: ``prediction`` (original label for classes) and ``score`` (last class)."""
    lacking = [f for f in features if f not in df.columns]
    if lacking:
        raise ValueError(f"missing feature columns: {lacking}")
    keep = list(df.columns if keep is None else keep)
    out = df
    for s in model.stages:
        if isinstance(s, Transformer) and not hasattr(s, "labels"):
            out = s.transform(out)
    labels = _labels(model)
    cols = [F.col(c) for c in keep]
    if labels:
        names = F.array(*[F.lit(x) for x in labels])
        cols.append(F.get(names, F.col("prediction").cast("int")).alias("prediction"))
        if "probability" in out.columns:
            p = vector_to_array("probability")
            cols.append(F.get(p, F.size(p) - 1).alias("score"))
        elif "rawPrediction" in out.columns:
            p = vector_to_array("rawPrediction")
            cols.append(F.get(p, F.size(p) - 1).alias("score"))
    else:
        cols.append(F.col("prediction"))
    return out.select(*cols)


def predictor(model: PipelineModel, features: Sequence[str], use_score: bool = True) -> Callable[[DataFrame], DataFrame]:
    """``predict`` function for the explanation operators (class probability where there is one)."""
    def predict(rows: DataFrame) -> DataFrame:
        keep = list(rows.columns)
        out = score(rows, model, features, keep)
        if use_score and "score" in out.columns:
            return out.withColumn("prediction", F.col("score")).drop("score")
        return out.withColumn("prediction", F.col("prediction").cast("double"))

    return predict


def evaluate(scored: DataFrame, label: str, problem: str, by: Sequence[str] = ()) -> DataFrame:
    if problem == "regression":
        return regression_metrics(scored, label, "prediction", by)
    rows = scored.withColumn("_y", F.col(label).cast("string"))
    return classification_metrics(rows, "_y", "prediction", None, by, average="weighted")


def _folds(df: DataFrame, features: Sequence[str], label: str, key: str, folds: int, problem: str) -> DataFrame:
    """Complete rows with their fold, cached; the key has done its work and is left out."""
    cut = fold_ids(df.select(*dict.fromkeys([key, *features, label])).dropna(), key, folds,
                   label if problem == "classification" else None)
    return cut.select(*dict.fromkeys([*features, label]), "fold").persist()


def _fold_scores(cut: DataFrame, features: Sequence[str], label: str, name: str, folds: int, params: Mapping | None,
                 problem: str) -> list[tuple[str, int, float]]:
    metric, out = "f1" if problem == "classification" else "r2", []
    for f in range(folds):
        model = train(cut.where(F.col("fold") != f), features, label, name, params, problem)
        scored = score(cut.where(F.col("fold") == f), model, features)
        out.append((name, f, float(evaluate(scored, label, problem).first()[metric])))
    return out


_SCORES = "model string, fold int, score double"


def cross_validate(df: DataFrame, features: Sequence[str], label: str, algorithms: Sequence[str], key: str,
                   folds: int = 5, params: Mapping[str, Mapping] | None = None, problem: str | None = None) -> DataFrame:
    """Fold scores (weighted F1 or R2) as rows ``(model, fold, score)``.

    Each fold is one distributed fit; the folds are cut once and cached.
    """
    problem = problem or problem_type(df, label)
    cut, out = _folds(df, features, label, key, folds, problem), []
    try:
        for name in algorithms:
            out += _fold_scores(cut, features, label, name, folds, (params or {}).get(name), problem)
    finally:
        cut.unpersist()
    return df.sparkSession.createDataFrame(out, _SCORES)


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
                                       F.count(F.lit(1)).alias("folds"))


def tune(df: DataFrame, features: Sequence[str], label: str, algorithm: str, grid: Mapping[str, Sequence], key: str,
         folds: int = 3, n_random: int | None = None, seed: int = 42, problem: str | None = None) -> DataFrame:
    """Grid search, or a random part of the grid, by cross-validation: one row per setting.

    All settings share the folds, which are cut once and cached.
    """
    names = list(grid)
    settings = [dict(zip(names, v)) for v in itertools.product(*grid.values())]
    if n_random is not None and n_random < len(settings):
        settings = random.Random(seed).sample(settings, n_random)
    problem = problem or problem_type(df, label)
    cut, rows = _folds(df, features, label, key, folds, problem), []
    try:
        for s in settings:
            scores = _fold_scores(cut, features, label, algorithm, folds, s, problem)
            t = cv_summary(df.sparkSession.createDataFrame(scores, _SCORES)).first()
            rows.append((algorithm, json.dumps(s, sort_keys=True), t["mean"], t["std"]))
    finally:
        cut.unpersist()
    out = df.sparkSession.createDataFrame(rows, "model string, params string, score double, std double")
    return out.orderBy(F.desc("score"), "params")


CANDIDATES = {
    "classification": ("logistic_regression", "decision_tree", "random_forest", "gradient_boosting"),
    "regression": ("linear_regression", "decision_tree", "random_forest", "gradient_boosting"),
}


def automl(df: DataFrame, features: Sequence[str], label: str, key: str, algorithms: Sequence[str] | None = None,
           problem: str | None = None, folds: int = 3) -> DataFrame:
    """Cross-validated scores of all candidate algorithms, best first."""
    problem = problem or problem_type(df, label)
    scores = cross_validate(df, features, label, list(algorithms or CANDIDATES[problem]), key, folds, None, problem)
    return cv_summary(scores).orderBy(F.desc("mean"), "model")


def feature_importance(model: PipelineModel, features: Sequence[str]):
    """Importances of trees or mean absolute coefficients, as a list of pairs."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        values = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(last, "coefficients"):
        values = abs(last.coefficients.toArray())
    else:
        raise ValueError("the model exposes no importances")
    return sorted(zip(features, map(float, values)), key=lambda t: (-t[1], t[0]))


def save_model(model: PipelineModel, path: str, metadata: Mapping, spark) -> None:
    """Model directory plus one metadata row beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(dict(metadata), sort_keys=True),)], "metadata string").write.mode("overwrite").json(
        f"{path}/metadata")


def load_model(path: str, spark) -> tuple[PipelineModel, dict]:
    row = spark.read.schema("metadata string").json(f"{path}/metadata").first()
    return PipelineModel.load(f"{path}/model"), json.loads(row["metadata"])


# ---- clustering ------------------------------------------------------------------------

CLUSTERERS: Mapping[str, Callable] = {
    "kmeans": lambda k, **p: K.KMeans(k=k, **{"seed": 42, **p}),
    "gaussian_mixture": lambda k, **p: K.GaussianMixture(k=k, **{"seed": 42, **p}),
    "agglomerative": lambda k, **p: K.BisectingKMeans(k=k, **{"seed": 42, **p}),
}


def as_vector(df: DataFrame, features: Sequence[str], scale: bool = False) -> DataFrame:
    out = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)
    if scale:
        out = MinMaxScaler(inputCol="features", outputCol="_scaled").fit(out).transform(out).drop("features").withColumnRenamed(
            "_scaled", "features")
    return out


def cluster(df: DataFrame, features: Sequence[str], algorithm: str = "kmeans", k: int = 3, **params) -> DataFrame:
    """Add ``cluster``; the agglomerative choice is bisecting k-means."""
    rows = as_vector(df, features)
    model = CLUSTERERS[algorithm](k, **params).fit(rows)
    return model.transform(rows).select(*df.columns, F.col("prediction").alias("cluster"))


def clustering_metrics(df: DataFrame, features: Sequence[str], label: str = "cluster") -> DataFrame:
    """Silhouette, inertia, Calinski-Harabasz and Davies-Bouldin of a labelled table."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(F.col(label).alias("c"), x.alias("x"))
    dims = range(len(features))
    centres = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in dims])
    listed = centres.orderBy("c").limit(10001).collect()
    if len(listed) > 10000:
        raise ValueError("too many clusters for a centroid table")
    grand = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features])
    table = centres.agg(F.map_from_entries(F.collect_list(F.struct("c", F.array(*[f"m{i}" for i in dims]).alias("m"))))).scalar()
    sq = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    far = rows.withColumn("_t", table).withColumn("m", F.try_element_at("_t", F.col("c"))).withColumn(
        "_g", F.array(*[grand.select(c).scalar() for c in features]))
    within = far.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(sq(F.col("x"), F.col("m"))).alias("ss"),
                                  F.avg(F.sqrt(sq(F.col("x"), F.col("m")))).alias("spread"),
                                  F.first(sq(F.col("m"), F.col("_g"))).alias("between"))
    stats = {r["c"]: r for r in within.collect()}
    centre = {r["c"]: [r[f"m{i}"] for i in dims] for r in listed}
    names, n = list(stats), sum(r["n"] for r in stats.values())
    inertia = sum(r["ss"] for r in stats.values())
    between = sum(r["n"] * r["between"] for r in stats.values())
    k = len(names)
    ch = (between / (k - 1)) / (inertia / (n - k)) if k > 1 and inertia > 0 else None
    db = None
    if k > 1:
        gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(centre[a], centre[b])) ** 0.5
        db = sum(max((stats[a]["spread"] + stats[b]["spread"]) / gap(a, b) for b in names if b != a and gap(a, b) > 0)
                 for a in names) / k
    sil = ClusteringEvaluator(predictionCol="c").evaluate(
        as_vector(df.withColumn("c", F.col(label).cast("int")), features)) if k > 1 else None
    return df.sparkSession.createDataFrame(
        [(k, sil, float(inertia), ch, db)],
        "clusters int, silhouette double, inertia double, calinski_harabasz double, davies_bouldin double")

