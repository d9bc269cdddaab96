"""Operators on small literal tables."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylens.operators import bootstrap as B
from quarrylens.operators import clean, create, ecommerce, edge_cases, encode, finance, health, impute, joins, neighbors, sampling, scale, sketches, text
from quarrylens.operators import explain as X
from quarrylens.operators import operations as O
from quarrylens.operators import profile as P
from quarrylens.operators import drift as D


def test_charlson_literal_scores(spark):
    rows = [(1, "I50,E11,N18"), (2, "J44,M05"), (3, "C78,B20"), (4, None), (5, "I10,Z00")]
    got = health.charlson(spark.createDataFrame(rows, "id int, icd string"), "icd").orderBy("id").collect()
    assert [r["charlson_score"] for r in got] == [4, 2, 14, 0, 0]


def test_column_names():
    assert clean.tidy_name("  First-Name (x) ") == "first_name_x" and clean.tidy_name("%%") == "unnamed"
    assert clean.unique_names(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]


def test_sanitize_lists_its_changes(spark):
    df = spark.createDataFrame([(" 1", "x ", "2024-01-02"), ("2", "", "2024-01-03"), ("3", "y", "oops")], ["A b", "C", "When"])
    out, log = clean.sanitize(df)
    assert out.columns == ["a_b", "c", "when"] and dict(out.dtypes)["a_b"] == "double" and dict(out.dtypes)["when"] == "timestamp"
    assert {r["type"] for r in log.collect()} == {"column_rename", "whitespace_stripped", "empty_to_null", "numeric_conversion", "date_parsed"}
    assert [r["c"] for r in out.orderBy("a_b").collect()] == ["x", None, "y"]


def test_parse_date_shapes(spark):
    vals = ["2024-02-03", "2/13/2024", "13/2/2024", "2024/2/3", "02-13-2024", "nope", None]
    got = spark.createDataFrame([(v,) for v in vals], "d string").select(F.date_format(P.parse_date("d"), "yyyy-MM-dd").alias("x")).collect()
    assert [r["x"] for r in got] == ["2024-02-03", "2024-02-13", "2024-02-13", "2024-02-03", "2024-02-13", None, None]


def test_column_stats_against_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.normal(size=200).round(2), "s": rng.choice(list("abc"), 200), "i": rng.integers(-3, 9, 200)})
    pdf.loc[::9, "x"] = np.nan
    got = P.column_stats(spark.createDataFrame(pdf)).toPandas().set_index("column")
    for c in ("x", "i"):
        want = pdf[c].describe()
        assert got.loc[c, ["mean", "std", "min", "q25", "median", "q75", "max"]].astype(float).tolist() == pytest.approx(
            [want[k] for k in ("mean", "std", "min", "25%", "50%", "75%", "max")])
        assert got.loc[c, "skew"] == pytest.approx(pdf[c].skew()) and got.loc[c, "kurtosis"] == pytest.approx(pdf[c].kurt())
    assert got.loc["x", "missing"] == pdf.x.isna().sum() and got.loc["s", "top_freq"] == pdf.s.value_counts().max()


def test_empty_and_all_null_columns(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    got = P.column_stats(df).toPandas().set_index("column")
    assert got["count"].tolist() == [0, 0] and got["missing_pct"].tolist() == [100.0, 100.0] and got["unique"].tolist() == [0, 0]
    assert {r["type"] for r in edge_cases.edge_cases(df, "x").collect()} >= {"single_class", "constant_column", "too_few_rows"}


def test_edge_cases_are_sorted_by_severity(spark):
    df = spark.createDataFrame([(i, float(i % 2), float(i % 2) * 3, "k") for i in range(40)], "row_id int, y double, copy double, c string")
    sev = [r["severity"] for r in edge_cases.edge_cases(df, "y").collect()]
    assert sev == sorted(sev, key=["critical", "warning", "info"].index) and sev[0] == "critical"


def test_compare_schemas(spark):
    left, right = spark.range(1).selectExpr("id k", "1 a", "'x' s"), spark.range(1).selectExpr("id k", "1.5D a", "2 b")
    got = {r["column"]: r["status"] for r in joins.compare_schemas(left, right).collect()}
    assert got == {"k": "shared", "a": "type_mismatch", "s": "left_only", "b": "right_only"}


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(1000).withColumn("c", (F.col("id") % 10 == 0).cast("int"))
    one = {r["id"] for r in sampling.sample_random(df, 100, "id").collect()}
    two = {r["id"] for r in sampling.sample_random(df.repartition(7), 100, "id").collect()}
    assert len(one) == 100 and one == two
    strat = sampling.sample_stratified(df, 200, "c", "id").groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in strat} == {0: 180, 1: 20}
    split = sampling.train_test_split(df, "id", 0.25, "c").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"test": 250, "train": 750}


def test_encoders_keep_nulls(spark):
    df = spark.createDataFrame([("b", 1), ("a", 0), (None, 1), ("b", 0)], "c string, y int")
    assert [tuple(r) for r in encode.one_hot(df, ["c"]).collect()] == [(1, 1), (0, 0), (1, 0), (0, 1)]
    assert sorted(r["c"] for r in encode.label_encode(df, ["c"]).collect()) == [-1, 0, 1, 1]
    assert sum(r["c"] is None for r in encode.target_encode(df, ["c"], "y").collect()) == 1
    with pytest.raises(ValueError):
        encode.one_hot(df.withColumn("c", F.expr("uuid()")), ["c"], max_categories=2)


def test_box_cox_and_yeo_johnson_lambda(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"x": np.exp(rng.normal(size=3000))}))
    lam, shift = scale.box_cox_lambda(df, "x")
    assert abs(lam) < 0.05 and shift == 0.0
    y = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=3000)}))
    assert abs(scale.yeo_johnson_lambda(y, "x") - 1) < 0.1


def test_splits_are_cut_by_hash_order_without_a_shuffle_by_class(spark):
    """Quotas end at the right row, with null and repeated keys and classes; reading the split moves no rows."""
    rows = [(i if i % 11 else None, "abc"[i % 3] if i % 7 else None) for i in range(1000)] + [(5, "c")] * 30
    df = spark.createDataFrame(rows, "id int, c string")
    split = sampling.train_test_split(df, "id", 0.3, "c")
    assert "Exchange hashpartitioning" not in split._jdf.queryExecution().executedPlan().toString()
    hashed = [(r["c"], r["h"], r["id"] if r["id"] is not None else -1) for r in df.select("c", "id", F.xxhash64(F.lit(42), "id").alias("h")).collect()]
    want = 0
    for c in (None, "a", "b", "c"):
        mine = sorted((h, i) for k, h, i in hashed if k == c)
        want += sum(x <= mine[int(len(mine) * 0.3 + 0.5) - 1] for x in mine)
    assert split.where("split = 'test'").count() == want and split.count() == len(rows)
    plain = spark.range(500).select(F.col("id").cast("int").alias("id"))
    ranks = {i: n for n, (_, i) in enumerate(sorted((r["h"], r["id"]) for r in plain.select("id", F.xxhash64(F.lit(42), "id").alias("h")).collect()))}
    assert all(r["fold"] == ranks[r["id"]] % 3 for r in sampling.fold_ids(plain, "id", 3).collect())


def test_impute_knn_small(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 2.0, 20.0), (3, 2.1, None), (4, 9.0, 90.0)], "id int, a double, b double")
    got = {r["id"]: r["b"] for r in impute.impute_knn(df, ["a", "b"], ["b"], key="id", k=2).collect()}
    assert got[3] == pytest.approx(15.0)


def test_boxes_of_one_value_bound_the_others():
    """Where all items near a query are like it, they are not met, and the next ones that differ bound the search."""
    x = np.arange(40.0)[:, None]
    items = pd.DataFrame({"g": ["a"] * 20 + ["b"] * 20, "p": np.arange(40.0)})
    sets = [np.arange(i, i + 10) for i in range(0, 40, 10)]
    ask = pd.DataFrame({"g": ["a", "b"], "p": [2.0, 38.0], "margin": [12.0, 12.0]})
    for how in ({"differ_on": "g", "apart": None}, {"differ_on": None, "apart": ("p", "margin")}):
        boxes = neighbors.Boxes("euclidean", 3, facts=neighbors.Boxes.facts(items, x, sets, 3, **how), **how)
        near, limit = boxes.reach(np.array([[2.0], [38.0]]), ask)
        met = (near <= limit[:, None]) & np.isfinite(near)
        first = [False, False, True, False] if how["differ_on"] else [False, True, False, False]
        assert met[0].tolist()[:3] == first[:3] and np.isfinite(limit).all() and met.sum() <= 4


def test_blocks_hold_every_place_once():
    x = np.concatenate([np.random.default_rng(3).normal(size=(500, 2)), np.zeros((300, 2))])
    blocks = neighbors.halves(np.where(np.arange(800)[:, None] % 2 == 1, np.nan, x), 64)
    assert sorted(np.concatenate(blocks).tolist()) == list(range(800)) and max(map(len, blocks)) <= 64


def test_a_block_passes_on_k_rows_per_query(spark, monkeypatch):
    """Pairs left open are measured where they are found; they are not shuffled."""
    rows = [(i, [float(i % 7), 1.0, 2.0, 3.0, float(i % 3)]) for i in range(120)]  # many equal distances
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    monkeypatch.setattr(neighbors, "ITEM_BLOCK", 60)
    q, i = neighbors._sides(df.withColumnRenamed("id", "q"), df, "v", ["q", "v"], ["id", "v"], "euclidean")
    found = neighbors.candidates(q, i, "v", "euclidean", None, None, 3, "id")
    assert found.columns == ["_q", "_i", "distance"] and found.groupBy("_q").count().agg(F.max("count")).first()[0] <= 6
    got = neighbors.nearest(df.withColumnRenamed("id", "q"), df, query_key="q", item_key="id", vector="v", k=3).where("q = 119").orderBy("rank")
    assert [r["id"] for r in got.collect()] == [14, 35, 56]


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "nan_euclidean"])
def test_nearest_equals_all_pairs(spark, monkeypatch, metric):
    """Signatures, bounds and blocks lose no neighbour: clusters, repeated vectors, a zero vector and gaps."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) * 0.3 + rng.integers(-3, 4, (300, 1))
    x[7], x[8:12] = 0.0, x[20]
    if metric == "nan_euclidean":
        x[rng.random(x.shape) < 0.2] = np.nan
    rows = [(i, [None if np.isnan(v) else float(v) for v in r], i % 3) for i, r in enumerate(x)]
    items = spark.createDataFrame(rows, "id int, v array<double>, g int")
    queries = spark.createDataFrame(rows[:40], "q int, v array<double>, g int")
    d = np.stack([neighbors.pair_distances(np.repeat(x[i:i + 1], 300, 0), x, metric) for i in range(40)])
    for differ in (None, "g"):
        want = []
        for i in range(40):
            order = sorted((float(d[i, j]), j) for j in range(300) if np.isfinite(d[i, j]) and not (differ and j % 3 == i % 3))
            want += [(i, rank + 1, round(far, 9)) for rank, (far, _) in enumerate(order[:3])]
        for block in (50_000, 20):
            monkeypatch.setattr(neighbors, "ITEM_BLOCK", block)
            monkeypatch.setattr(neighbors, "QUERY_BLOCK", 7 if block == 20 else 2000)
            found = neighbors.nearest(queries, items, query_key="q", item_key="id", vector="v", k=3, metric=metric, differ_on=differ)
            got = [(r["q"], r["rank"], round(r["distance"], 9)) for r in found.collect()]
            assert [(a, b) for a, b, _ in sorted(got)] == [(a, b) for a, b, _ in want]
            assert np.allclose([c for _, _, c in sorted(got)], [c for _, _, c in want], atol=1e-7)


@pytest.mark.parametrize("metric", ["euclidean", "nan_euclidean"])
def test_few_coordinates_are_searched_by_cells(spark, monkeypatch, metric):
    """A query meets few cells and loses no neighbour: repeated vectors, null classes, margins and gaps."""
    monkeypatch.setattr(neighbors, "CELL_ITEMS", 10)
    monkeypatch.setattr(neighbors, "CELL_SAMPLE", 4)
    monkeypatch.setattr(neighbors, "candidates", None)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 2)), 2)
    x[50:90] = x[3]
    if metric == "nan_euclidean":
        x[rng.random(x.shape) < 0.2] = np.nan
    g = [None if i % 17 == 0 else float(i // 100) for i in range(400)]
    rows = [(399 - i, [None if np.isnan(v) else float(v) for v in r], g[i], 0.5) for i, r in enumerate(x)]
    items = spark.createDataFrame(rows, "id int, v array<double>, g double, m double")
    queries = items.withColumnRenamed("id", "q")
    d = np.stack([neighbors.pair_distances(np.repeat(x[i:i + 1], 400, 0), x, metric) for i in range(400)])
    alike = lambda a, b: a is not None and b is not None and a == b
    for how in ({}, {"differ_on": "g"}, {"apart": ("g", "m")}):
        found = neighbors.nearest(queries, items, query_key="q", item_key="id", vector="v", k=3, metric=metric, **how).collect()
        want = [(399 - i, rank + 1, round(far, 9), key) for i in range(400) for rank, (far, key) in enumerate(sorted(
            (float(d[i, j]), 399 - j) for j in range(400) if np.isfinite(d[i, j]) and not (how and alike(g[i], g[j])))[:3])]
        assert sorted((r["q"], r["rank"], round(r["distance"], 9), r["id"]) for r in found) == sorted(want)
    cells = neighbors.Cells(x, 32)
    assert len(set(cells.of(x))) > 12 and np.bincount(cells.of(x)).max() < 60


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "nan_euclidean"])
def test_signatures_bound_distances(metric):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(200, 12)) @ rng.normal(size=(12, 12)))[:, :10] * np.logspace(0, 2, 10)
    x[5], x[6, :], x[:, 3] = 0.0, 1e4, 2.5
    if metric == "nan_euclidean":
        x[rng.random(x.shape) < 0.3] = np.nan
        axes, mean, spread = np.eye(10), np.nanmean(x, 0), np.nanstd(x, 0)
    else:
        unit = neighbors._unit(x) if metric == "cosine" else x
        spread, axes = np.linalg.eigh(np.cov(unit.T, bias=True))
        mean, spread = unit.mean(0), np.sqrt(np.maximum(spread, 0))
    cut = neighbors.Signatures(metric, mean, axes, spread)
    bodies, error = cut.cut(x)
    low, high = cut.bounds(x[:50], *cut.restored(bodies), error)
    d = np.stack([neighbors.pair_distances(np.repeat(x[i:i + 1], 200, 0), x, metric) for i in range(50)])
    assert (low <= d + 1e-9).all() and ((high >= d - 1e-9) | np.isinf(high)).all()
    assert len(bodies[0]) <= 12 and np.median(high[np.isfinite(high)] - low[np.isfinite(high)]) < np.median(d[np.isfinite(d)])


def test_counterfactual_neighbours_in_one_class_cells(spark):
    """Rows that must differ in a column find their neighbours although all close ones are of their own class."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.normal(size=6) + (40 if i % 2 else 0)], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, v array<double>, g int")
    got = neighbors.nearest(df.withColumnRenamed("id", "q"), df, query_key="q", item_key="id", vector="v", k=2, differ_on="g").collect()
    assert len(got) == 400 and all(r["q"] % 2 != r["id"] % 2 for r in got)


def test_rfm_falls_back_when_quintiles_coincide(spark):
    rows = [(c, f"2024-01-{d:02d} 00:00:00", 5.0) for c in range(10) for d in (1, 2)]
    df = spark.createDataFrame(rows, "c int, d string, a double").withColumn("d", F.col("d").cast("timestamp"))
    assert {r["m_score"] for r in ecommerce.rfm_segments(df, "c", "d", "a").collect()} == {3}
    got = ecommerce.rfm(df, "c", "d", "a").collect()
    assert len(got) == 10 and {r["r_score"] for r in got} == {5} and {r["f_score"] for r in got} == {1, 2, 3, 4, 5}


def test_basket_pairs_on_a_hot_basket(spark):
    rows = [(0, i) for i in range(200)] + [(b, i) for b in (1, 2) for i in (100, 101)]
    got = ecommerce.basket_pairs(spark.createDataFrame(rows, "t int, i int"), "t", "i").collect()
    assert (got[0]["item_a"], got[0]["item_b"], got[0]["count"]) == ("100", "101", 3)


def test_psi_of_equal_tables_is_zero(spark):
    df = spark.range(500).selectExpr("cast(id * id as double) as x")
    for bins in (finance.psi_bins_a, finance.psi_bins_b):
        assert finance.psi_total(bins(df, df, "x"), 0.1, 0.25).first()["psi"] == pytest.approx(0, abs=1e-12)
    r = D.drift_report(df, df.selectExpr("x + 1e9 as x")).first()
    assert r["drift_detected"] and r["statistic"] == 1.0


def test_ks_and_gini_of_perfect_scores(spark):
    df = spark.createDataFrame([(int(i >= 5), float(i)) for i in range(10)], "y int, s double")
    assert finance.ks_statistic(df, "y", "s").first()["ks_statistic"] == 1.0
    assert finance.gini(df, "y", "s").first()["gini"] == 1.0


def test_process_capability_without_variation(spark):
    r = O.process_capability(spark.createDataFrame([(2.0,)] * 5, "x double"), "x", 1, 3).first()
    assert r["cpk"] == float("inf") and r["is_capable"]


def test_velocity_window_border(spark):
    ts = ["2024-01-01 00:00:00", "2024-01-01 23:59:59", "2024-01-02 00:00:00", "2024-01-03 12:00:00"]
    df = spark.createDataFrame([(1, t, 1.0) for t in ts], "u int, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = create.velocity(df, "u", "t", "v", [24]).orderBy("t").collect()
    assert [r["v_count_24h"] for r in got] == [1, 2, 3, 1]


def test_bootstrap_is_repeatable_and_covers_the_estimate(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 400)
    pdf = pd.DataFrame({"id": np.arange(400), "y": y, "p": np.where(rng.random(400) < 0.8, y, 1 - y)})
    df = spark.createDataFrame(pdf)
    a = B.bootstrap_ci(df, "y", "p", "accuracy", "id", 300).first()
    b = B.bootstrap_ci(df.repartition(5), "y", "p", "accuracy", "id", 300).first()
    assert a["ci_lower"] < a["point_estimate"] < a["ci_upper"]
    assert (a["ci_lower"], a["std_error"]) == pytest.approx((b["ci_lower"], b["std_error"]))
    assert a["std_error"] == pytest.approx(np.sqrt(0.8 * 0.2 / 400), rel=0.25)
    bca = B.bootstrap_ci(df, "y", "p", "f1", "id", 300, method="bca").first()
    assert bca["ci_lower"] < bca["point_estimate"] < bca["ci_upper"]
    w = B.poisson_weights(rng.integers(0, 2**63, 2000).astype("uint64"), 200)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)


def test_shapley_adds_up_for_a_product_model(spark):
    predict = lambda rows: rows.withColumn("prediction", F.col("a") * F.col("b") + F.col("c"))
    df = spark.createDataFrame([(i, float(i), float(i % 3), 1.0 * i * i) for i in range(12)], "id int, a double, b double, c double")
    phi = X.shapley(df, predict, ["a", "b", "c"], "id", permutations=12).groupBy("id").agg(F.sum("impact").alias("s"))
    base = predict(df.agg(*[F.avg(c).alias(c) for c in "abc"])).first()["prediction"]
    got = phi.join(predict(df), "id").select("s", (F.col("prediction") - base).alias("w")).collect()
    assert all(r["s"] == pytest.approx(r["w"]) for r in got)


def test_yeo_johnson_ignores_nan(spark):
    rng = np.random.default_rng(11)
    x = rng.gamma(2.0, size=401)
    clean = spark.createDataFrame(pd.DataFrame({"x": x, "y": x * 3}))
    dirty = clean.union(spark.createDataFrame([(float("nan"), 1.0)], "x double, y double"))
    a, b = scale.yeo_johnson_lambda(clean, "x"), scale.yeo_johnson_lambda(dirty, "x")
    assert abs(a - b) < 1e-9 and -5 < a < 1

    def likelihood(lam):
        y = (np.power(x + 1, lam) - 1) / lam
        return -np.log(y.var()) / 2 + (lam - 1) * np.log1p(x).mean()

    grid = np.linspace(a - 0.05, a + 0.05, 2001)
    assert abs(grid[np.argmax([likelihood(g) for g in grid])] - a) < 2e-4
    told = {r["column"]: r for r in scale.power_transform_lambdas(dirty, ["x", "y"]).collect()}
    assert told["x"]["n"] == 401 and told["x"]["log_likelihood"] == pytest.approx(401 * likelihood(a), rel=1e-9)
    assert told["y"]["lambda"] != told["x"]["lambda"]


def test_box_cox_without_values_and_with_zeros(spark):
    df = spark.createDataFrame([(None, 0.0, 1e120), (None, 1.0, 1e90), (None, 5.0, 1e60), (None, 2.0, 1e75)], "a double, b double, c double")
    found = scale.box_cox_lambdas(df, ["a", "b", "c"])
    assert found[0] is None and found[1][1] == 1.0 and abs(found[2][0]) < 0.2


@pytest.mark.parametrize("hot", [False, True])
def test_velocity(spark, hot):
    rng = np.random.default_rng(12)
    rows = [(i, None if i % 37 == 0 else 0 if hot else int(rng.integers(4)), None if i % 41 == 0 else int(rng.integers(0, 200)) * 1800,
             None if i % 11 == 0 else float(i)) for i in range(400)]
    df = spark.createDataFrame([(i, e, None if s is None else datetime(2024, 1, 1) + timedelta(seconds=s), v) for i, e, s, v in rows],
                               "id int, e int, ts timestamp_ntz, v double")
    got = {r["id"]: r for r in create.velocity(df, "e", "ts", "v", [1, 24]).collect()}
    assert len(got) == 400
    for i, e, s, v in rows:
        for h in (1, 24):
            own = [w for _, f, u, w in rows if f == e and (u is None if s is None else u is not None and s - 3600 * h <= u <= s)]
            total = [w for w in own if w is not None]
            assert got[i][f"v_count_{h}h"] == len(own)
            assert got[i][f"v_sum_{h}h"] == (pytest.approx(sum(total)) if total else None)


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "The cat the CAT ünï"), (2, "the dog"), (3, None), (4, "a b")], "id int, t string")
    got = {(r["id"], r["term"]): r for r in text.tfidf_terms(df, "id", "t").collect()}
    assert set(got) == {(1, "the"), (1, "cat"), (1, "ünï"), (2, "the"), (2, "dog")}
    idf = {"the": math.log(5 / 3) + 1, "cat": math.log(5 / 2) + 1}
    assert got[1, "the"]["n"] == 2 and got[1, "the"]["df"] == 2 and got[1, "cat"]["idf"] == pytest.approx(idf["cat"])
    assert sum(r["weight"] ** 2 for k, r in got.items() if k[0] == 1) == pytest.approx(1)
    assert {k[1] for k in [(r["id"], r["term"]) for r in text.tfidf_terms(df, "id", "t", min_df=2).collect()]} == {"the"}


def test_terms_are_counted_where_their_texts_are(spark):
    rows = [(1, "the cat the"), (1, "cat"), (None, "the dog"), (None, "dog"), (2, "")]
    counted = text.term_counts(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    executed = counted._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") == 1 and executed.index("Generate") < executed.index("Exchange")
    assert {(r["id"], r["term"], r["n"]) for r in counted.collect()} == {
        (1, "the", 2), (1, "cat", 2), (None, "the", 1), (None, "dog", 2)}


def test_sketches_of_parts_are_sketches_of_all(spark):
    rows = [(i % 4, float(i % 500), None if i % 3 == 0 else f"g{i % 7}", float("nan") if i % 10 == 0 else float(i), None) for i in range(8000)]
    df = spark.createDataFrame(rows, "p int, a double, b string, c double, d double")
    parts = sketches.column_sketches(df, by=["p"])
    assert parts.count() == 16
    told = sketches.profile_approx(parts)
    got = {r["column"]: r for r in told.collect()}
    assert got["a"]["missing"] == 0 and got["c"]["missing"] == 800 and got["d"]["n"] == 0 and got["d"]["distinct"] == 0
    assert got["b"]["quantiles"] is None and got["d"]["quantiles"] is None and {x["item"] for x in got["b"]["top"]} == {f"g{i}" for i in range(7)}
    assert got["a"]["quantiles"][0] == 0.0 and got["a"]["quantiles"][-1] == 499.0
    for r in sketches.sketch_errors(df, told).collect():
        assert r["distinct_within"] and r["top_within"] and r["ranks_within"] in (True, None)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("case", ["plain", "far", "tiny", "outlier", "repeats", "infinite", "one direction"])
def test_products_in_single_precision_lose_no_neighbour(monkeypatch, metric, case):
    """Bounds hold whatever the size and the place of the vectors; ties go to the first item."""
    for name, n in (("AT_ONCE", 30), ("FIRST_ITEMS", 20), ("MOST_ITEMS", 70)):
        monkeypatch.setattr(neighbors, name, n)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(333, 9))
    x = {"plain": x, "far": x + 1e6, "tiny": x * 1e-200, "repeats": x.round(0), "one direction": x * 0.01 + 3}.get(case, x)
    if case in ("outlier", "infinite"):
        x[5], x[6, 2] = (1e9, -1e25) if case == "outlier" else (np.inf, np.nan)
    q, group = x[:70], np.arange(333) % 3
    d = np.stack([neighbors.pair_distances(np.repeat(q[i:i + 1], 333, 0), x, metric) for i in range(70)])
    for k, barred in ((1, None), (4, lambda a, b: a == b), (4, lambda a, b: group[a] == group[b]), (4, lambda a, b: a > -1)):
        with np.errstate(all="ignore"):
            who, what, far, measured = neighbors.nearest_places(q, x, k, metric, barred)
        want = []
        for i in range(70):
            free = [j for j in range(333) if np.isfinite(d[i, j]) and not (barred and barred(np.array([i]), np.array([j]))[0])]
            want += [(i, j, d[i, j]) for j in sorted(free, key=lambda j: (d[i, j], j))[:k]]
        assert sorted(zip(who, what, far)) == sorted(want)
        if case in ("plain", "one direction") and k == 1:
            assert measured < 0.1 * d.size


def test_whole_vectors_need_no_signatures(spark, monkeypatch):
    """All pairs are bounded by products; no pass over the items for axes, and vectors of many coordinates come in smaller blocks."""
    monkeypatch.setattr(neighbors, "signatures_of", None)
    monkeypatch.setattr(neighbors, "BLOCK_VALUES", 6 * 50)
    rng = np.random.default_rng(13)
    x = rng.normal(size=(200, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 4) for i, r in enumerate(x)], "id int, v array<double>, g int")
    got = neighbors.knn_predict(df, df.withColumnRenamed("id", "q").withColumn("id", F.col("q")), query_key="q", item_key="id", vector="v",
                                label="g", k=3, differ_on="id").collect()
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for r in got:
        votes = np.bincount(np.argsort(d[r["q"]], kind="stable")[:3] % 4)
        assert (r["prediction"], r["votes"]) == (votes.argmax(), votes.max())
    assert len(got) == 200
