"""Model plans, clustering, plan shapes and the registered queries."""

import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarrylens.functions.quantiles import quantiles
from quarrylens.functions.ranks import mid_ranks
from quarrylens.operators import explain as X
from quarrylens.operators import sequence as Q
from quarrylens.operators import survival as V
from quarrylens.plans import models as L
from quarrylens.plans.auto import auto_pipeline
from quarrylens.plans.density import dbscan
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 300
    x, z = rng.normal(size=n), rng.normal(size=n)
    return spark.createDataFrame(pd.DataFrame({
        "id": np.arange(n), "x": x, "z": z, "cls": np.where(x + 0.3 * rng.normal(size=n) > 0, "yes", "no"),
        "y": 3 * x - z + 0.1 * rng.normal(size=n), "city": rng.choice(list("abcd"), n)})).persist()


@pytest.mark.parametrize("algorithm", sorted(L.CLASSIFIERS))
def test_classifiers_learn(table, algorithm):
    params = {"numTrees": 5} if algorithm == "random_forest" else {"maxIter": 5} if algorithm == "gradient_boosting" else None
    model = L.train(table, ["x", "z"], "cls", algorithm, params, "classification")
    scored = L.score(table, model, ["x", "z"], ["id", "cls"])
    assert L.evaluate(scored, "cls", "classification").first()["accuracy"] > 0.85
    assert set(scored.columns) >= {"id", "cls", "prediction"}


@pytest.mark.parametrize("algorithm", ["linear_regression", "decision_tree"])
def test_regressors_learn(table, algorithm):
    model = L.train(table, ["x", "z"], "y", algorithm, problem="regression")
    assert L.evaluate(L.score(table, model, ["x", "z"]), "y", "regression").first()["r2"] > 0.8


def test_multiclass_boosting_goes_one_vs_rest(table):
    rows = table.withColumn("c3", F.when(F.col("x") > 0.5, "c").when(F.col("x") > -0.5, "b").otherwise("a"))
    model = L.train(rows, ["x"], "c3", "linear_svc", {"maxIter": 10}, "classification")
    assert L.score(rows, model, ["x"], ["c3"]).select("prediction").distinct().count() >= 2


def test_save_load_and_missing_feature(spark, table, tmp_path):
    model = L.train(table, ["x", "z"], "y", "linear_regression", problem="regression")
    L.save_model(model, str(tmp_path / "m"), {"features": ["x", "z"]}, spark)
    again, meta = L.load_model(str(tmp_path / "m"), spark)
    assert meta == {"features": ["x", "z"]}
    a, b = (L.score(table, m, ["x", "z"], ["id"]).orderBy("id").toPandas() for m in (model, again))
    assert np.allclose(a.prediction, b.prediction)
    with pytest.raises(ValueError, match="missing feature"):
        L.score(table.drop("x"), model, ["x", "z"])


def test_explanations_of_a_fitted_model(table):
    model = L.train(table, ["x", "z"], "y", "linear_regression", problem="regression")
    predict = L.predictor(model, ["x", "z"])
    phi = X.shapley(table.where("id < 5").select("id", "x", "z"), predict, ["x", "z"], "id", table, permutations=2)
    coef = dict(zip(["x", "z"], model.stages[-1].coefficients))
    exact = X.linear_contributions(table.select("id", "x", "z"), "id", coef).where("id < 5")
    both = phi.join(exact.withColumnRenamed("impact", "w"), ["id", "feature"]).collect()
    assert len(both) == 10 and all(r["impact"] == pytest.approx(r["w"], abs=1e-6) for r in both)
    curve = X.pdp(table.select("x", "z"), predict, "x", 5).orderBy("point").toPandas()
    assert np.allclose(np.diff(curve.prediction) / np.diff(curve.value), coef["x"])


def test_auto_pipeline_ranks_models(table):
    res = auto_pipeline(table, "cls", "id", ["logistic_regression", "decision_tree"])
    rows = res.results.orderBy("rank").collect()
    assert rows[0]["rank"] == 1 and rows[0]["f1"] >= rows[1]["f1"] > 0.8 and "city_1" in res.features


def test_cross_validation_and_tuning(table):
    cv = L.cross_validate(table, ["x", "z"], "y", ["linear_regression"], "id", 3, problem="regression")
    assert cv.count() == 3 and L.cv_summary(cv).first()["mean"] > 0.9
    best = L.tune(table, ["x", "z"], "y", "lasso", {"regParam": [0.01, 5.0]}, "id", 2, problem="regression").first()
    assert best["params"] == '{"regParam": 0.01}'


def test_balanced_training_finds_the_rare_class(spark):
    rng = np.random.default_rng(4)
    n = 600
    rare = np.arange(n) % 20 == 0
    x = rng.normal(size=n) + 1.2 * rare
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": rng.normal(size=n), "c": np.where(rare, "rare", "usual")}))
    found = []
    for balanced in (False, True):
        model = L.train(df, ["x", "z"], "c", "logistic_regression", None, "classification", balanced)
        found.append(L.score(df, model, ["x", "z"], ["c"]).where("c = 'rare' AND prediction = 'rare'").count())
    assert found[0] < found[1] and found[1] > 15
    weights = {r["c"]: r["weight"] for r in L.class_weights(df, "c").collect()}
    assert weights["rare"] == pytest.approx(10) and weights["usual"] == pytest.approx(600 / (2 * 570))


def brute_dbscan(p, eps, m):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)) <= eps
    core = d.sum(axis=1) >= m
    label, nxt = np.full(len(p), -1), 0
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], nxt
            while todo:
                j = todo.pop()
                for k in np.where(d[j] & core & (label < 0))[0]:
                    label[k] = nxt
                    todo.append(k)
            nxt += 1
    return core, label, d


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_dbscan_matches_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    p = np.concatenate([rng.normal(c, 0.25, size=(60, dims)) for c in (0, 2, 3)] + [rng.uniform(-2, 6, size=(30, dims))]).round(3)
    eps, m = 0.3 * dims, 5
    core, label, d = brute_dbscan(p, eps, m)
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame(pd.DataFrame(p, columns=names).assign(id=np.arange(len(p))))
    got = dbscan(df, names, "id", eps, m).toPandas().sort_values("id").cluster
    for c in set(label[core]):
        assert got[core & (label == c)].nunique() == 1
    assert got[core].nunique() == len(set(label[core]))
    reach = (d & core[None, :]).any(axis=1)
    assert (got.notna().to_numpy() == reach).all()


@pytest.mark.parametrize("gap, clusters", [(0.99, 1), (1.01, 2)])
def test_dbscan_of_dense_cells_that_nearly_touch(spark, gap, clusters):
    """Two dense cells whose only close points are one pair: found without comparing all points of both."""
    rng = np.random.default_rng(3)
    left, right = rng.uniform(0, 0.6, (600, 2)), rng.uniform(0, 0.6, (600, 2))
    left[:, 0] = left[:, 0] * 0.5
    right[:, 0] = right[:, 0] * 0.5 + 1.3
    left[0], right[0] = (0.3, 0.3), (0.3 + gap, 0.3)
    p = np.concatenate([left, right, right[:50]])
    core, label, _ = brute_dbscan(p, 1.0, 5)
    df = spark.createDataFrame(pd.DataFrame(p, columns=["x", "y"]).assign(id=np.arange(len(p))))
    got = dbscan(df, ["x", "y"], "id", 1.0, 5).toPandas().sort_values("id").cluster.to_numpy()
    assert len(set(label[core])) == clusters
    assert len(set(got[core])) == clusters and all(len(set(got[core & (label == c)])) == 1 for c in set(label[core]))


def single_partition_rows(df) -> list[float]:
    """Row counts of all shuffles into one task in the executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [float(m) for m in re.findall(r"rowCount=([\d.E+]+)\)[^\n]*\n[^\n]*Exchange SinglePartition", plan)]


def test_no_single_task_sees_the_raw_rows(spark):
    n = 20000
    df = spark.range(n).select("id", (F.col("id") % 3 == 0).cast("int").alias("hot"), F.rand(1).alias("x"), F.lit(1).alias("event")).cache()
    for out in (quantiles(df, "x", [0.1, 0.5]), mid_ranks(df, "x"), Q.lag_features(df, "x", [1], ["id"]),
                Q.fill(df, ["x"], ["id"]), Q.running(df, {"s": F.col("x")}, ["id"], ["hot"]), V.kaplan_meier(df, "x", "event")):
        assert all(rows <= 200 for rows in single_partition_rows(out))


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["read_parquet"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,400000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_entry_and_names(spark):
    assert entry.entry(spark).columns[0] == "o_custkey"
    assert set(entry.oracle_sql()) <= set(entry.queries())


SAMPLE = ("rfm_segments_b", "column_stats", "kaplan_meier_groups", "rolling_features_by", "drift_numeric", "gini", "charlson",
          "concordance_index", "nemenyi", "counterfactual", "remove_duplicates_first", "psi_bins_b", "velocity_hot", "tfidf_terms",
          "profile_approx", "correlation_matrix_spearman", "correlation_matrix_kendall", "log_rank_groups", "log_rank_many",
          "power_transform_likelihood", "stream_classify_intent", "stream_clinical_flags", "file_manifest_formats", "domain_metrics",
          "cohort_matrix", "vintage_matrix", "vector_search", "knn_predict", "funnel", "validation_checks", "fisher_exact")
#: The queries compared by default: the ones above and every tenth of the others; ORACLE_ALL=1 compares all.
COMPARED = sorted({*SAMPLE, *sorted(n for n in entry.oracle_sql() if not re.match(r"op\d|pipeline", n))[::10]})


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ORACLE_ALL") else COMPARED)
def test_query_equals_sql(spark, name):
    ok, note = compare(spark, connect(SMALL), name, SMALL)
    assert ok, note


def test_tune_cuts_the_folds_once(spark, monkeypatch):
    calls, cut = [], L.fold_ids
    monkeypatch.setattr(L, "fold_ids", lambda *a, **k: calls.append(1) or cut(*a, **k))
    df = spark.range(90).selectExpr("id", "id * 1.0 AS x", "id * 2.0 + id % 3 AS y")
    out = L.tune(df, ["x"], "y", "ridge", {"regParam": [0.1, 1.0]}, "id", problem="regression").collect()
    assert len(calls) == 1 and len(out) == 2 and all(r["score"] > 0.99 for r in out)


def test_fits_that_keep_blocks_get_no_second_copy(spark, monkeypatch):
    """Nothing is stored beside the blocks of the fit; trees still read split rows from disk."""
    from quarrylens.plans import models, queries_models, registry

    seen, train = [], models.train

    def spied(df, *args, **kwargs):
        seen.append(spark._jsparkSession.sharedState().cacheManager().isEmpty())
        return train(df, *args, **kwargs)

    monkeypatch.setattr(queries_models.L, "train", spied)
    spark.catalog.clearCache()
    for name in ("logistic_regression", "decision_tree"):
        assert registry.QUERIES[f"train_classification_{name}"](spark, "/root/testdata/sf0.001").count() == 1
    assert seen == [True, False]


@pytest.mark.parametrize("problem, label", [("regression", "y"), ("classification", "two"), ("classification", "three")])
def test_boosting_passes_over_cells_and_gives_the_trees_of_all_rows(spark, monkeypatch, problem, label):
    """The fit gets the cells of bins, weighted; the predictions are those of a fit on the rows themselves."""
    n = 13000  # more than Spark draws for its thresholds
    rng = np.random.default_rng(8)
    x, z = rng.integers(-30, 30, n) / 2.0, rng.normal(size=n).round(2)
    z[:40], x[40:80] = np.nan, np.nan
    y = np.where(x > 3, 2.0, 0.0) + np.abs(z) + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({
        "id": np.arange(n), "x": x, "z": z, "flag": rng.integers(0, 2, n), "y": y, "two": np.where(y > 1.2, "high", "low"),
        "three": np.where(y > 2, "c", np.where(y > 1, "b", "a"))})).repartition(3, "id").persist()
    features, params = ["x", "z", "flag"], {"maxIter": 3}
    rows = df.select(*features, F.col(label)).dropna()
    whole = L.pipeline(rows, features, label, "gradient_boosting", problem, params).fit(rows)
    seen, fit = [], L.Pipeline.fit
    monkeypatch.setattr(L.Pipeline, "fit", lambda self, data, *a: seen.append(data.count()) or fit(self, data, *a))
    cells = L.train(df, features, label, "gradient_boosting", params, problem)
    assert len(seen) == 1 and seen[0] <= 32 * 32 * 2 * 3 < rows.count()
    old, new = (L.score(df, m, features, ["id", label]).orderBy("id").toPandas() for m in (whole, cells))
    if problem == "regression":
        assert np.allclose(old.prediction, new.prediction)
    else:
        assert (old.prediction == new.prediction).all() and np.allclose(old.get("score", 0), new.get("score", 0))
    assert [c for c, _ in L.feature_importance(cells, features)][0] == "x" if label == "y" else True
    df.unpersist()


def test_boosting_that_draws_rows_fits_the_rows(spark, monkeypatch):
    df = spark.range(200).selectExpr("id % 2 * 1.0D AS x", "id % 2 * 2.0D + id % 3 AS y")
    seen, fit = [], L.Pipeline.fit
    monkeypatch.setattr(L.Pipeline, "fit", lambda self, data, *a: seen.append(data.count()) or fit(self, data, *a))
    for params in ({"subsamplingRate": 0.5}, {"minInstancesPerNode": 2}, {"lossType": "absolute"}, {}):
        L.train(df, ["x"], "y", "gradient_boosting", {"maxIter": 2, **params}, "regression")
    assert seen == [200, 200, 200, 4]


def test_boosting_over_cells_as_many_as_rows_fits_the_rows(spark, monkeypatch):
    df = spark.range(300).selectExpr("id * 37 % 300 * 1.0D AS x", "id * 1.0D AS z", "id % 7 * 1.0D AS y")
    seen, fit = [], L.Pipeline.fit
    monkeypatch.setattr(L.Pipeline, "fit", lambda self, data, *a: seen.append(data.columns) or fit(self, data, *a))
    L.train(df, ["x", "z"], "y", "gradient_boosting", {"maxIter": 2}, "regression")
    assert seen == [["x", "z", "y"]]
