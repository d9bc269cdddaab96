"""Model metrics, comparison, training, scoring and explanation over the sample tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from quarrylens.operators import bootstrap as S
from quarrylens.operators import charts as G
from quarrylens.operators import compare as C
from quarrylens.operators import explain as X
from quarrylens.operators import metrics as M
from quarrylens.operators import neighbors as N
from quarrylens.operators.sampling import train_test_split
from quarrylens.plans import models as L
from quarrylens.plans.auto import auto_pipeline
from quarrylens.plans.queries_domain import _RANKED, _SCORED, scored
from quarrylens.plans.registry import query, r, tidy
from quarrylens.session import cut_lineage

# ---- metrics ---------------------------------------------------------------------------


@query("confusion", f"""WITH {_SCORED} SELECT label, prediction, count(*) AS "count", {r('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct FROM scored GROUP BY 1, 2""")
def _(t):
    return tidy(M.confusion(scored(t), "label", "prediction"))


_CLS = f"""WITH {_SCORED}, x AS (SELECT sum((prediction = 1 AND label = 1)::INTEGER)::DOUBLE AS tp, sum((prediction = 0 AND label = 0)::INTEGER)::DOUBLE AS tn,
    sum((prediction = 1 AND label = 0)::INTEGER)::DOUBLE AS fp, sum((prediction = 0 AND label = 1)::INTEGER)::DOUBLE AS fn FROM scored), {_RANKED}"""


@query("classification_metrics", f"""{_CLS}, a AS (SELECT sum(p * ((nq - fp) + q / 2)) / any_value(np * nq) AS auc FROM k)
    SELECT 2::BIGINT AS classes, (tp + tn + fp + fn)::BIGINT AS n, {r('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy, {r('tp / (tp + fp)')} AS precision, {r('tp / (tp + fn)')} AS recall,
      {r('2 * tp / (2 * tp + fp + fn)')} AS f1, {r('auc')} AS auc FROM x, a""")
def _(t):
    return tidy(M.classification_metrics(scored(t), "label", "prediction", "score"))


_WEIGHTED = """p AS (SELECT CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS pr, l_returnflag AS y FROM lineitem),
    c AS (SELECT y AS k, count(*)::DOUBLE AS s, sum((pr = y)::INTEGER)::DOUBLE AS h FROM p GROUP BY 1), d AS (SELECT pr AS k, count(*)::DOUBLE AS m FROM p GROUP BY 1),
    e AS (SELECT s, h, h / m AS pc, h / s AS rc FROM c JOIN d USING (k))"""


@query("classification_metrics_multiclass", f"""WITH {_WEIGHTED} SELECT count(*) AS classes, sum(s)::BIGINT AS n, {r('sum(h) / sum(s)')} AS accuracy, {r('sum(pc * s) / sum(s)')} AS precision,
    {r('sum(rc * s) / sum(s)')} AS recall, {r('sum(2 * pc * rc / (pc + rc) * s) / sum(s)')} AS f1 FROM e""")
def _(t):
    pred = F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R")
    return tidy(M.classification_metrics(t.lineitem.withColumn("pred", pred), "l_returnflag", "pred"))


_P = "2000 * l_quantity + 100"


@query("regression_metrics", f"""WITH s AS (SELECT l_returnflag, l_extendedprice AS y, {_P} AS p FROM lineitem)
    SELECT l_returnflag, count(*) AS n, {r('avg((y - p) ** 2)', 2)} AS mse, {r('sqrt(avg((y - p) ** 2))', 4)} AS rmse, {r('avg(abs(y - p))', 4)} AS mae, {r('1 - avg((y - p) ** 2) / var_pop(y)')} AS r2,
      {r('avg(abs((y - p) / y)) * 100')} AS mape, {r('sqrt(avg((y - p) ** 2) / var_pop(y))')} AS rmse_ratio FROM s GROUP BY 1""")
def _(t):
    rows = t.lineitem.withColumn("p", 2000 * F.col("l_quantity") + 100)
    return tidy(M.regression_metrics(rows, "l_extendedprice", "p", ["l_returnflag"]), mse=2, rmse=4, mae=4)


_MODELS = """preds AS (SELECT 'm' || k AS model, l_extendedprice AS y, 1900 * l_quantity + k * 500 * l_linenumber AS p FROM lineitem, range(4) g(k))"""


def predictions(t):
    rows = t.lineitem.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    return rows.select(F.concat(F.lit("m"), "k").alias("model"), F.col("l_extendedprice").alias("y"),
                       (1900 * F.col("l_quantity") + F.col("k") * 500 * F.col("l_linenumber")).alias("p"), "l_orderkey")


@query("rank_models", f"""WITH {_MODELS}, x AS (SELECT model, 1 - avg((y - p) ** 2) / var_pop(y) AS r2 FROM preds GROUP BY 1)
    SELECT model, {r('r2')} AS r2, (row_number() OVER (ORDER BY r2 DESC, model))::INTEGER AS rank FROM x""")
def _(t):
    return tidy(M.rank_models(M.regression_metrics(predictions(t), "y", "p", ["model"]), "r2").select("model", "r2", "rank"))


@query("best_model", f"""WITH {_MODELS}, x AS (SELECT model, 1 - avg((y - p) ** 2) / var_pop(y) AS r2 FROM preds GROUP BY 1) SELECT model, {r('r2')} AS r2 FROM x ORDER BY x.r2 DESC, model LIMIT 1""")
def _(t):
    return tidy(M.best_model(M.regression_metrics(predictions(t), "y", "p", ["model"]), "r2").select("model", "r2"))


@query("validation_checks", f"""{_CLS}, a AS (SELECT sum(p * ((nq - fp) + q / 2)) / any_value(np * nq) AS auc FROM k), m AS (SELECT (tp + tn) / (tp + tn + fp + fn) AS acc, auc FROM x, a)
    SELECT 'non_constant' AS "check", NULL::DOUBLE AS value, NULL::DOUBLE AS "limit", TRUE AS passed
    UNION ALL SELECT 'feature_count', 3.0, 3.0, TRUE UNION ALL SELECT 'min_accuracy', {r('acc')}, 0.5, acc >= 0.5 FROM m
    UNION ALL SELECT 'min_auc', {r('auc')}, 0.65, auc >= 0.65 FROM m""")
def _(t):
    return tidy(M.validation_checks(scored(t), "label", "prediction", "score", "classification", "finance", features=(3, 3)))


@query("validate_model", f"""{_CLS}, a AS (SELECT sum(p * ((nq - fp) + q / 2)) / any_value(np * nq) AS auc FROM k),
    f AS (SELECT ((tp + tn) / (tp + tn + fp + fn) < 0.5)::INTEGER + (auc < 0.6)::INTEGER AS bad FROM x, a)
    SELECT (3 - bad)::BIGINT AS passed, bad::BIGINT AS failed, 0::BIGINT AS skipped, CASE WHEN bad = 0 THEN 'deploy' ELSE 'review' END AS recommendation FROM f""")
def _(t):
    return M.validate_model(M.validation_checks(scored(t), "label", "prediction", "score", "classification"))


@query("prediction_stability", "SELECT 0.0::DOUBLE AS max_variance, TRUE AS is_stable FROM lineitem LIMIT 1")
def _(t):
    """A fitted model scores the table three times."""
    rows = _rows(t)
    model = L.train(rows, _F, "l_extendedprice", "decision_tree", problem="regression")
    runs = L.score(rows, model, _F, ["row"])
    for _ in range(2):
        runs = runs.unionByName(L.score(rows, model, _F, ["row"]))
    return M.prediction_stability(runs, "row", "prediction")


# ---- bootstrap and comparison ----------------------------------------------------------


@query("bootstrap_ci")
def _(t):
    return tidy(S.bootstrap_ci(scored(t), "label", "prediction", "f1", "doc_id"))


@query("bootstrap_ci_bca")
def _(t):
    return tidy(S.bootstrap_ci(scored(t), "label", "prediction", "accuracy", "doc_id", method="bca"))


@query("bootstrap_compare")
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", F.lit(250000.0).alias("a"), (F.lit(240000.0) + F.col("o_custkey")).alias("b"))
    return tidy(S.bootstrap_compare(rows, "o_totalprice", "a", "b", "mae", "o_orderkey"), 3)


@query("bootstrap_multi_metric")
def _(t):
    return tidy(S.bootstrap_multi_metric(scored(t), "label", "prediction", ["accuracy", "precision", "recall", "f1"], "doc_id"))


# fold scores: R2 of four simple models per experiment (return flag) and fold (line number)
_FOLDS = """f AS (SELECT l_returnflag AS experiment, 'm' || k AS model, l_linenumber AS fold, 1 - avg((l_extendedprice - (1900 + 60 * k) * l_quantity) ** 2) / var_pop(l_extendedprice) AS score
    FROM lineitem, range(4) g(k) GROUP BY 1, 2, 3)"""


def fold_scores(t):
    rows = t.lineitem.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    e = F.col("l_extendedprice") - (1900 + 60 * F.col("k")) * F.col("l_quantity")
    return rows.groupBy(F.col("l_returnflag").alias("experiment"), F.concat(F.lit("m"), "k").alias("model"), F.col("l_linenumber").alias("fold")).agg(
        (1 - F.avg(e * e) / F.var_pop("l_extendedprice")).alias("score"))


@query("paired_ttest", f"""WITH {_FOLDS}, p AS (SELECT experiment, fold, max(score) FILTER (WHERE model = 'm0') - max(score) FILTER (WHERE model = 'm1') AS d FROM f GROUP BY 1, 2)
    SELECT experiment, count(*) AS n, {r('avg(d)')} AS mean_diff, {r('avg(d) / (stddev_samp(d) / sqrt(count(*)))', 3)} AS statistic FROM p GROUP BY 1""")
def _(t):
    return tidy(C.paired_ttest(fold_scores(t), "m0", "m1", ["experiment"]).select("experiment", "n", "mean_diff", "statistic"), statistic=3)


@query("mcnemar", f"""WITH {_SCORED}, c AS (SELECT (prediction = label) AS a, ((CASE WHEN score > 0.3 THEN 1 ELSE 0 END) = label) AS b FROM scored),
    x AS (SELECT count(*) FILTER (WHERE a AND b) AS n11, count(*) FILTER (WHERE a AND NOT b) AS n10, count(*) FILTER (WHERE NOT a AND b) AS n01, count(*) FILTER (WHERE NOT a AND NOT b) AS n00 FROM c)
    SELECT *, {r('CASE WHEN n10 + n01 = 0 THEN 0 WHEN n10 + n01 < 25 THEN n10 ELSE (abs(n10 - n01) - 1) ** 2 * 1.0 / (n10 + n01) END')} AS statistic FROM x""")
def _(t):
    rows = scored(t).withColumn("other", F.when(F.col("score") > 0.3, 1).otherwise(0))
    return tidy(C.mcnemar(rows, "label", "prediction", "other").drop("p_value", "significant"))


@query("wilcoxon_signed_rank", f"""WITH {_FOLDS}, p AS (SELECT experiment, fold, round(max(score) FILTER (WHERE model = 'm0') - max(score) FILTER (WHERE model = 'm2'), 12) AS d FROM f GROUP BY 1, 2),
    k AS (SELECT experiment, d, rank() OVER (PARTITION BY experiment ORDER BY abs(d)) AS rk FROM p WHERE d <> 0)
    SELECT experiment, count(*) AS n, coalesce(sum(rk) FILTER (WHERE d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(rk) FILTER (WHERE d < 0), 0)::DOUBLE AS w_minus,
      least(coalesce(sum(rk) FILTER (WHERE d > 0), 0), coalesce(sum(rk) FILTER (WHERE d < 0), 0))::DOUBLE AS statistic FROM k GROUP BY 1""")
def _(t):
    return tidy(C.wilcoxon_signed_rank(fold_scores(t), "m0", "m2", ["experiment"]).drop("p_value", "significant"))


_MR = "mr AS (SELECT experiment, model, avg(rk) AS mean_rank, count(*) AS folds FROM (SELECT *, rank() OVER (PARTITION BY experiment, fold ORDER BY score DESC) AS rk FROM f) GROUP BY 1, 2)"


@query("friedman", f"""WITH {_FOLDS}, {_MR} SELECT experiment, count(*)::INTEGER AS models, max(folds)::INTEGER AS folds,
    {r('12.0 / (max(folds) * count(*) * (count(*) + 1)) * sum((mean_rank * folds) ** 2) - 3 * max(folds) * (count(*) + 1)')} AS statistic, arg_min(model, mean_rank) AS best_model FROM mr GROUP BY 1""")
def _(t):
    return tidy(C.friedman(fold_scores(t), ["experiment"]).drop("p_value", "significant"))


@query("nemenyi", f"""WITH {_FOLDS}, {_MR} SELECT a.experiment, a.model AS model_a, b.model AS model_b, {r('a.mean_rank')} AS mean_rank_a, {r('b.mean_rank')} AS mean_rank_b,
    {r('2.569 * sqrt(4 * 5 / (6.0 * a.folds))')} AS critical_difference, {r('abs(a.mean_rank - b.mean_rank)')} AS rank_diff,
    abs(a.mean_rank - b.mean_rank) > 2.569 * sqrt(4 * 5 / (6.0 * a.folds)) AS significant FROM mr a JOIN mr b ON a.experiment = b.experiment AND a.model < b.model""")
def _(t):
    return tidy(C.nemenyi(fold_scores(t), ["experiment"]))


@query("compare_models")
def _(t):
    runs = fold_scores(t).withColumn("fold", F.concat_ws("-", "experiment", "fold"))
    return tidy(C.compare_models(runs.drop("experiment")))


# ---- training, validation, scoring -----------------------------------------------------

_F = ["l_quantity", "l_discount", "l_tax"]


def _rows(t):
    """Line items with a unique row key and a two-class label tied to the features."""
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_F, "l_extendedprice").alias("row")
    big = F.when(F.col("l_extendedprice") > 50000, "high").otherwise("low").alias("size")
    return t.lineitem.select(key, *_F, "l_extendedprice", big)


#: Classifiers that keep the rows in blocks of their own while they fit; a copy of the split beside these is only more disk.
_KEEP_BLOCKS = ("linear_svc", "logistic_regression", "mlp")


def _held_out(t, label, algorithm, problem):
    """Metrics on a fifth of the rows that the fit has not seen.

    Split rows wait on disk, memory is left to the fit; where the fit keeps them itself, they are split again for each scan.
    """
    cut = train_test_split(_rows(t), "row", stratify=label if problem == "classification" else None).select(*_F, label, "split")
    kept = algorithm not in _KEEP_BLOCKS
    if kept:
        cut.persist(StorageLevel.DISK_ONLY)
    try:
        model = L.train(cut.where("split = 'train'"), _F, label, algorithm, problem=problem)
        return tidy(cut_lineage(L.evaluate(L.score(cut.where("split = 'test'"), model, _F), label, problem)), 3)
    finally:
        if kept:
            cut.unpersist()


def _register_training():
    for problem, table, label in (("classification", L.CLASSIFIERS, "size"), ("regression", L.REGRESSORS, "l_extendedprice")):
        for algorithm in table:
            query(f"train_{problem}_{algorithm}")(
                lambda t, a=algorithm, p=problem, y=label: _held_out(t, y, a, p))


_register_training()


@query("train_classification")
def _(t):
    return _held_out(t, "size", "logistic_regression", "classification")


@query("train_regression")
def _(t):
    return _held_out(t, "l_extendedprice", "linear_regression", "regression")


@query("linear_fit", f"""SELECT 'l_quantity' AS feature, {r('regr_slope(l_extendedprice, l_quantity)', 3)} AS coefficient, {r('regr_intercept(l_extendedprice, l_quantity)', 3)} AS intercept FROM lineitem""")
def _(t):
    """The fit of one feature in closed form."""
    last = L.train(_rows(t), ["l_quantity"], "l_extendedprice", "linear_regression", problem="regression").stages[-1]
    out = t.spark.createDataFrame([("l_quantity", float(last.coefficients[0]), float(last.intercept))], "feature string, coefficient double, intercept double")
    return tidy(out, 3)


@query("train_clustering")
def _(t):
    out = L.cluster(_rows(t), ["l_quantity", "l_discount"], "kmeans", 3)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))


@query("class_weights", f"""SELECT l_returnflag, count(*) AS n, {r('(SELECT count(*) FROM lineitem) * 1.0 / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*))')} AS weight
    FROM lineitem GROUP BY 1""")
def _(t):
    return tidy(L.class_weights(t.lineitem, "l_returnflag"))


@query("train_gaussian_mixture")
def _(t):
    out = L.cluster(_rows(t), ["l_quantity", "l_discount"], "gaussian_mixture", 3)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))


@query("train_bisecting_kmeans")
def _(t):
    out = L.cluster(_rows(t), ["l_quantity", "l_discount"], "agglomerative", 4)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))


@query("clustering_metrics")
def _(t):
    out = L.cluster(t.customer, ["c_acctbal", "c_nationkey"], "kmeans", 3)
    return tidy(L.clustering_metrics(out, ["c_acctbal", "c_nationkey"]), 3)


@query("dbscan")
def _(t):
    from quarrylens.plans.density import dbscan

    pts = t.customer.select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_nationkey") / 2.0).alias("y"))
    out = dbscan(pts, ["x", "y"], "c_custkey", eps=0.35, min_points=6)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))


@query("knn_predict", f"""WITH d AS (SELECT q.vec_id AS q, i.label, list_sum(list_transform(list_zip(q.embedding, i.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS d, i.vec_id AS i
      FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, i) <= 5),
    v AS (SELECT q, label, count(*) AS votes FROM k GROUP BY 1, 2)
    SELECT q AS vec_id, label AS prediction, votes FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY votes DESC, label) = 1""")
def _(t):
    rows = t.embeddings.withColumn("self", F.col("vec_id"))
    return N.knn_predict(rows.withColumnRenamed("vec_id", "item"), rows, query_key="vec_id", item_key="item", vector="embedding",
                         label="label", differ_on="self")


@query("cross_validate")
def _(t):
    return tidy(L.cross_validate(_rows(t), _F, "l_extendedprice", ["linear_regression"], "row", problem="regression"), 3)


@query("tune")
def _(t):
    return tidy(L.tune(_rows(t), _F, "l_extendedprice", "ridge", {"regParam": [0.1, 1.0, 10.0, 100.0]}, "row", problem="regression"), 3)


@query("tune_random")
def _(t):
    """Four of nine settings, drawn at random."""
    grid = {"regParam": [0.1, 1.0, 10.0], "elasticNetParam": [0.0, 0.5, 1.0]}
    return tidy(L.tune(_rows(t), _F, "l_extendedprice", "ridge", grid, "row", n_random=4, problem="regression"), 3)


@query("automl")
def _(t):
    return tidy(L.automl(t.customer.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_custkey"], "c_acctbal",
                         "c_custkey"), 3)


@query("feature_importance")
def _(t):
    rows = _rows(t)
    model = L.train(rows, _F, "l_extendedprice", "decision_tree", problem="regression")
    return tidy(t.spark.createDataFrame(L.feature_importance(model, _F), "feature string, importance double"), 4)


@query("score")
def _(t):
    rows = _rows(t)
    model = L.train(rows, _F, "size", "logistic_regression", problem="classification")
    return tidy(L.score(rows, model, _F, ["row"]), 3)


@query("auto_pipeline")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_totalprice", "o_orderpriority", "c_mktsegment", "c_acctbal", "o_orderstatus")
    return tidy(auto_pipeline(rows, "o_totalprice", "o_orderkey").results, 3)


@query("auto_pipeline_classes")
def _(t):
    """Three classes; brands are target encoded for each class but the first."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax").alias("row"), "l_returnflag", "p_brand",
        "p_type", "l_quantity", "l_discount", "p_retailprice")
    return tidy(auto_pipeline(rows, "l_returnflag", "row", ["logistic_regression", "decision_tree"]).results, 3)


# ---- explanation: a fixed linear scorer stands for the model where SQL checks the result ----

_W = {"l_quantity": 1500.0, "l_discount": -2000.0, "l_tax": 300.0}
_LIN = "1500 * l_quantity - 2000 * l_discount + 300 * l_tax"


def linear(rows):
    return rows.withColumn("prediction", 1500 * F.col("l_quantity") - 2000 * F.col("l_discount") + 300 * F.col("l_tax"))


_CONTRIB = """m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS x FROM supp),
    c AS (SELECT s_suppkey, 'l_quantity' AS feature, l_quantity AS value, 1500 * (l_quantity - q) AS impact FROM supp, m UNION ALL SELECT s_suppkey, 'l_discount', l_discount, -2000 * (l_discount - d) FROM supp, m
      UNION ALL SELECT s_suppkey, 'l_tax', l_tax, 300 * (l_tax - x) FROM supp, m)"""
_SUPP = "supp AS (SELECT l_suppkey AS s_suppkey, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM lineitem GROUP BY 1)"


def suppliers(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(*[F.avg(c).alias(c) for c in _F])


@query("linear_contributions", f"WITH {_SUPP}, {_CONTRIB} SELECT s_suppkey, feature, {r('value')} AS value, {r('impact', 4)} AS impact FROM c")
def _(t):
    return tidy(X.linear_contributions(suppliers(t), "s_suppkey", _W), impact=4)


@query("shapley", f"WITH {_SUPP}, {_CONTRIB} SELECT s_suppkey, feature, {r('impact', 4)} AS impact FROM c")
def _(t):
    return tidy(X.shapley(suppliers(t), linear, _F, "s_suppkey"), 4)


@query("shap_summary", f"WITH {_SUPP}, {_CONTRIB} SELECT feature, {r('avg(abs(impact))', 4)} AS mean_abs FROM c GROUP BY 1")
def _(t):
    return tidy(X.mean_abs_impact(X.linear_contributions(suppliers(t), "s_suppkey", _W)), 4)


@query("shap_force", f"""WITH {_SUPP}, {_CONTRIB} SELECT s_suppkey, feature, {r('impact', 4)} AS impact,
    (row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(c.impact) DESC, feature))::INTEGER AS rank, {r('sum(c.impact) OVER (PARTITION BY s_suppkey)', 4)} AS total_impact FROM c""")
def _(t):
    return tidy(G.waterfall(X.linear_contributions(suppliers(t), "s_suppkey", _W), "s_suppkey"), 4)


@query("chart_importance", f"""WITH {_SUPP}, {_CONTRIB}, i AS (SELECT feature, avg(abs(impact)) AS importance FROM c GROUP BY 1)
    SELECT feature, {r('importance', 4)} AS importance, (row_number() OVER (ORDER BY importance DESC, feature))::INTEGER AS rank, 100.0::DOUBLE AS top3_share FROM i""")
def _(t):
    table = X.mean_abs_impact(X.linear_contributions(suppliers(t), "s_suppkey", _W)).withColumnRenamed("mean_abs", "importance")
    return tidy(G.importance(table), 4)


@query("adverse_action", f"""WITH {_SUPP}, {_CONTRIB}, k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(impact) DESC, feature) AS rank FROM c)
    SELECT s_suppkey, feature, {r('value')} AS value, {r('impact', 4)} AS impact, rank::INTEGER AS rank, printf('AA%02d', rank) AS reason_code, CASE WHEN impact > 0 THEN 'adverse' ELSE 'favorable' END AS direction FROM k WHERE rank <= 4""")
def _(t):
    return tidy(X.adverse_action(X.linear_contributions(suppliers(t), "s_suppkey", _W), "s_suppkey"), impact=4)


@query("pdp", f"""WITH g AS (SELECT i AS point, min(l_quantity) + (max(l_quantity) - min(l_quantity)) * (i / 49.0) AS value FROM lineitem, range(50) z(i) GROUP BY i),
    m AS (SELECT avg(-2000 * l_discount + 300 * l_tax) AS rest FROM lineitem) SELECT point::INTEGER AS point, {r('value')} AS value, {r('1500 * value + rest', 4)} AS prediction FROM g, m""")
def _(t):
    return tidy(X.pdp(t.lineitem.select(*_F), linear, "l_quantity"), prediction=4)


@query("ice")
def _(t):
    return tidy(X.ice(t.lineitem.select(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row"), *_F), linear, "l_quantity", "row"), 4)


@query("pdp_2d", f"""WITH l AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_discount) AS d0, max(l_discount) AS d1, avg(l_tax) AS x FROM lineitem)
    SELECT {r('q0 + (q1 - q0) * (i / 24.0)')} AS a, {r('d0 + (d1 - d0) * (j / 24.0)')} AS b, {r('1500 * (q0 + (q1 - q0) * (i / 24.0)) - 2000 * (d0 + (d1 - d0) * (j / 24.0)) + 300 * x', 4)} AS prediction FROM l, range(25) z(i), range(25) w(j)""")
def _(t):
    return tidy(X.pdp_2d(t.lineitem.select(*_F), linear, "l_quantity", "l_discount", _F), prediction=4)


@query("what_if", f"""WITH {_SUPP} SELECT s_suppkey, {r(_LIN, 4)} AS baseline_pred, {r('1500 * 40 - 2000 * l_discount + 300 * l_tax', 4)} AS modified_pred, {r('1500 * (40 - l_quantity)', 4)} AS delta FROM supp""")
def _(t):
    return tidy(X.what_if(suppliers(t), linear, {"l_quantity": 40.0, "nope": 1.0}, "s_suppkey"), 4)


@query("what_if_sweep", f"""WITH {_SUPP} SELECT s_suppkey, v::DOUBLE AS value, {r('1500 * v - 2000 * l_discount + 300 * l_tax', 4)} AS prediction FROM supp, (VALUES (10), (20), (30)) z(v)""")
def _(t):
    return tidy(X.what_if_sweep(suppliers(t), linear, "l_quantity", [10.0, 20.0, 30.0], "s_suppkey"), 4)


_CF = """d AS (SELECT q.c_custkey AS k, i.c_custkey AS j, abs(q.c_acctbal - i.c_acctbal) AS d, q.{p} AS op, i.{p} AS np, q.c_acctbal AS ov, i.c_acctbal AS nv FROM cust q JOIN cust i ON {cond}),
    n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, j) AS rank FROM d QUALIFY rank <= 3)
    SELECT k AS c_custkey, j AS cf_key, rank::INTEGER AS rank, {d} AS distance, op::DOUBLE AS original_pred, np::DOUBLE AS new_pred, 'c_acctbal' AS feature, {o} AS original, {c} AS counterfactual FROM n"""


@query("counterfactual", "WITH cust AS (SELECT c_custkey, c_acctbal, c_nationkey % 3 AS p FROM customer), "
       + _CF.format(p="p", cond="q.p <> i.p", d=r("d", 4), o=r("ov", 4), c=r("nv", 4)))
def _(t):
    rows = t.customer.select("c_custkey", "c_acctbal", (F.col("c_nationkey") % 3).alias("prediction"))
    return tidy(X.counterfactual(rows, rows, ["c_acctbal"], "c_custkey"), 4)


@query("counterfactual_regression", "WITH cust AS (SELECT c_custkey, c_acctbal, c_nationkey * 10.0 + 5 AS p FROM customer), "
       + _CF.format(p="p", cond="abs(q.p - i.p) > greatest(0.1 * abs(q.p), 0.5 * (SELECT stddev_pop(p) FROM cust))", d=r("d", 4), o=r("ov", 4), c=r("nv", 4)))
def _(t):
    rows = t.customer.select("c_custkey", "c_acctbal", (F.col("c_nationkey") * 10.0 + 5).alias("prediction"))
    return tidy(X.counterfactual(rows, rows, ["c_acctbal"], "c_custkey", regression=True), 4)


_SEARCH = """WITH d AS (SELECT q.vec_id AS query, i.vec_id AS item, 1 - list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS d FROM embeddings q JOIN embeddings i ON {cond})
    SELECT query, item, {d} AS distance, (row_number() OVER (PARTITION BY query ORDER BY d, item))::INTEGER AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, item) <= 5"""


def search(t, where=None):
    q = t.embeddings.select(F.col("vec_id").alias("query"), "embedding")
    return N.vector_search(q, t.embeddings.withColumnRenamed("vec_id", "item"), query_key="query", item_key="item", where=where)


@query("vector_search", _SEARCH.format(cond="TRUE", d=r("d")))
def _(t):
    return tidy(search(t))


@query("vector_search_filtered", _SEARCH.format(cond="i.label < 8", d=r("d")))
def _(t):
    return tidy(search(t, "label < 8"))


@query("vector_search_share", "SELECT count(*) * count(*) AS pairs, TRUE AS below_a_tenth FROM embeddings")
def _(t):
    found = N.refined_share(t.embeddings, t.embeddings, vector="embedding", k=5, metric="cosine")
    return found.select("pairs", (F.col("share") < 0.1).alias("below_a_tenth"))
