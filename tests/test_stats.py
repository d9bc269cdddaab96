"""Tests, correlations and survival against brute force on small tables."""

import numpy as np
import pandas as pd
import pytest

from quarrylens.functions import dist
from quarrylens.operators import compare as C
from quarrylens.operators import correlation as K
from quarrylens.operators import stats_tests as T
from quarrylens.operators import survival as V


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(5)
    n = 160
    return pd.DataFrame({
        "id": np.arange(n), "a": rng.integers(0, 12, n).astype(float), "b": rng.normal(size=n).round(1),
        "g": np.where(rng.random(n) < 0.4, "x", "y"), "days": rng.integers(1, 25, n).astype(float),
        "event": (rng.random(n) < 0.7).astype(int), "z1": rng.normal(size=n).round(3), "z2": rng.integers(0, 2, n).astype(float)})


def test_shapiro_published_value():
    w, p = T.shapiro_values(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert w == pytest.approx(0.7888, abs=1e-3) and p == pytest.approx(0.0067, abs=5e-4)


def test_shapiro_on_normal_and_skewed_columns(spark, pdf):
    rows = pdf.assign(skewed=np.exp(2 * pdf.z1))
    got = {r["column"]: r for r in T.shapiro_wilk(spark.createDataFrame(rows), ["z1", "skewed"], "id").collect()}
    assert got["z1"]["is_normal"] and not got["skewed"]["is_normal"]


def test_welch_and_interval(spark, pdf):
    r = T.t_test_independent(spark.createDataFrame(pdf), "b", "g").first()
    x, y = pdf[pdf.g == "x"].b, pdf[pdf.g == "y"].b
    se = np.sqrt(x.var() / len(x) + y.var() / len(y))
    assert r["statistic"] == pytest.approx((x.mean() - y.mean()) / se)
    assert r["ci_lower"] < x.mean() - y.mean() < r["ci_upper"] and 0 <= r["p_value"] <= 1


def test_t_test_needs_two_groups(spark, pdf):
    with pytest.raises(Exception, match="exactly two groups"):
        T.t_test_independent(spark.createDataFrame(pdf.assign(g="x")), "b", "g").collect()


def test_paired_all_zero(spark):
    r = T.t_test_paired(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "a double, b double"), "a", "b").first()
    assert (r["statistic"], r["p_value"], r["effect_size"]) == (0.0, 1.0, 0.0)


def test_mann_whitney_small_exact(spark):
    df = spark.createDataFrame([(float(v), g) for g, vs in {"a": [1, 2, 3], "b": [4, 5, 6]}.items() for v in vs], "x double, g string")
    r = T.mann_whitney_u(df, "x", "g").first()
    assert r["statistic"] == 0 and r["p_value"] == pytest.approx(0.1) and r["effect_size"] == 1.0


def test_kendall_and_spearman_match_pandas_formulas(spark, pdf):
    df = spark.createDataFrame(pdf)
    conc = 0.0
    for i in range(len(pdf)):
        conc += (np.sign(pdf.a[i] - pdf.a) * np.sign(pdf.b[i] - pdf.b)).sum()
    n0 = len(pdf) * (len(pdf) - 1)
    ties = lambda s: (s.value_counts() * (s.value_counts() - 1)).sum()
    want = conc / np.sqrt((n0 - ties(pdf.a)) * (n0 - ties(pdf.b)))
    assert K.kendall(df, "a", "b").first()["r"] == pytest.approx(want)
    assert K.spearman(df, "a", "b").first()["r"] == pytest.approx(pdf.a.rank().corr(pdf.b.rank()))


def test_correlation_matrix_with_gaps_in_both_routes(spark, pdf):
    rows = pdf[["a", "b", "z1", "z2", "days", "event"]].copy()
    rows.loc[::7, "a"] = None
    rows.loc[::5, "b"] = None
    want = rows.corr()
    for cols in (["a", "b", "z1"], list(rows.columns)):
        got = K.correlation_matrix(spark.createDataFrame(rows.astype("float64")), cols).toPandas()
        for r in got.itertuples():
            assert r.r == pytest.approx(want.loc[r.col1, r.col2], abs=1e-9)


def test_vif_of_a_copied_column_is_infinite(spark, pdf):
    got = {r["column"]: r["vif"] for r in K.vif(spark.createDataFrame(pdf.assign(c=pdf.a * 2)), ["a", "b", "c"]).collect()}
    assert got["a"] == float("inf")


def test_concordance_matches_brute_force(spark, pdf):
    con = dis = tie = 0
    for i in pdf.itertuples():
        if i.event:
            later = pdf[pdf.days > i.days]
            con, dis, tie = con + (later.a < i.a).sum(), dis + (later.a > i.a).sum(), tie + (later.a == i.a).sum()
    r = V.concordance_index(spark.createDataFrame(pdf), "days", "a", "event").first()
    assert (r["n_concordant"], r["n_discordant"], r["n_tied"]) == (con, dis, tie)


def test_kaplan_meier_never_rises_and_matches_steps(spark, pdf):
    curve = V.kaplan_meier(spark.createDataFrame(pdf), "days", "event").toPandas().sort_values("time")
    s, want = 1.0, {0.0: 1.0}
    for t in sorted(pdf.days.unique()):
        s *= 1 - pdf[(pdf.days == t)].event.sum() / (pdf.days >= t).sum()
        want[t] = s
    assert (curve.survival.diff().dropna() <= 1e-12).all()
    assert np.allclose(curve.survival, [want[t] for t in curve.time])


def efron_fit(pdf, cols):
    """Plain Newton fit of the Efron partial likelihood, row by row."""
    x, beta = pdf[cols].to_numpy(), np.zeros(len(cols))
    for _ in range(50):
        grad, hess = np.zeros(len(cols)), np.zeros((len(cols),) * 2)
        w = np.exp(x @ beta)
        for t in sorted(pdf[pdf.event == 1].days.unique()):
            risk, dead = (pdf.days >= t).to_numpy(), ((pdf.days == t) & (pdf.event == 1)).to_numpy()
            d = dead.sum()
            grad += x[dead].sum(axis=0)
            for k in range(d):
                ww = np.where(risk, w, 0) - k / d * np.where(dead, w, 0)
                s0, s1 = ww.sum(), ww @ x
                grad -= s1 / s0
                hess += (x.T * ww) @ x / s0 - np.outer(s1, s1) / s0**2
        beta = beta + np.linalg.solve(hess, grad)
    return beta, np.sqrt(np.diag(np.linalg.inv(hess)))


def test_cox_matches_plain_newton(spark, pdf):
    got = V.cox_ph(spark.createDataFrame(pdf), "days", "event", ["z1", "z2"]).toPandas().set_index("covariate")
    beta, se = efron_fit(pdf, ["z1", "z2"])
    assert np.allclose(got.loc[["z1", "z2"], "coef"], beta, atol=1e-6)
    assert np.allclose(got.loc[["z1", "z2"], "se"], se, atol=1e-6)


def test_log_rank_of_equal_groups_is_small(spark, pdf):
    same = pd.concat([pdf.assign(h="p"), pdf.assign(h="q")])
    r = V.log_rank(spark.createDataFrame(same), "days", "event", "h").first()
    assert r["statistic"] == pytest.approx(0, abs=1e-9) and r["p_value"] == pytest.approx(1, abs=1e-6)
    three = pd.concat([same, pdf.assign(h="r")])
    assert V.log_rank(spark.createDataFrame(three), "days", "event", "h").first()["dof"] == 2


def test_model_comparison_p_values(spark):
    folds = [(m, f, s) for m, ss in {"a": [0.9, 0.8, 0.85, 0.95, 0.9], "b": [0.7, 0.72, 0.8, 0.92, 0.6], "c": [0.5, 0.6, 0.55, 0.5, 0.52]}.items()
             for f, s in enumerate(ss)]
    df = spark.createDataFrame(folds, "model string, fold int, score double")
    w = C.wilcoxon_signed_rank(df, "a", "b").first()
    assert w["statistic"] == 0 and w["p_value"] == pytest.approx(0.0625)
    fr = C.friedman(df).first()
    assert fr["statistic"] == pytest.approx(10.0) and fr["p_value"] == pytest.approx(np.exp(-5), rel=1e-6) and fr["best_model"] == "a"
    ne = C.nemenyi(df).toPandas()
    assert len(ne) == 3 and ne.critical_difference.iloc[0] == pytest.approx(2.343 * np.sqrt(12 / 30))
    assert C.compare_models(df.where("model <> 'c'")).first()["test"] == "paired_ttest"


def test_mcnemar_exact_branch(spark):
    rows = [(1, 1, 0)] * 5 + [(1, 0, 1)] * 1 + [(1, 1, 1)] * 10
    r = C.mcnemar(spark.createDataFrame(rows, "y int, a int, b int"), "y", "a", "b").first()
    assert (r["n10"], r["n01"]) == (5, 1) and r["p_value"] == pytest.approx(0.21875)


def test_spearman_matrix_is_pairwise_complete(spark):
    rng = np.random.default_rng(3)
    x = pd.DataFrame(rng.integers(0, 12, (300, 4)).astype(float), columns=list("abcd"))
    x["b"] += x["a"]
    x.loc[rng.random(300) < 0.2, "b"] = np.nan
    x.loc[rng.random(300) < 0.1, "d"] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x.to_numpy()], "a double, b double, c double, d double")
    for method in ("spearman", "kendall"):
        want = x.corr(method=method) if method == "spearman" else None
        for r in K.correlation_matrix(df, method=method).collect():
            if want is not None:
                assert r["r"] == pytest.approx(want.loc[r["col1"], r["col2"]], abs=1e-9)
    one = {(r["col1"], r["col2"]): r["r"] for r in K.correlation_matrix(df, method="kendall").collect()}
    for a, b in (("a", "b"), ("b", "d")):
        both = x[[a, b]].dropna().to_numpy()
        s = sum(np.sign(p[0] - q[0]) * np.sign(p[1] - q[1]) for i, p in enumerate(both) for q in both[:i])
        n0 = len(both) * (len(both) - 1) / 2
        ties = [sum(c * (c - 1) / 2 for c in np.unique(both[:, k], return_counts=True)[1]) for k in (0, 1)]
        assert one[a, b] == pytest.approx(s / np.sqrt((n0 - ties[0]) * (n0 - ties[1])), abs=1e-9)


def test_pair_counts_are_exact_beyond_doubles(spark):
    df = spark.createDataFrame([(1.0, 1.0, 3_000_000_001, 3_000_000_001), (2.0, 2.0, 3_000_000_007, 3_000_000_007)],
                               "t double, s double, l bigint, r bigint")
    got = K.dominance_counts(df, "t", "s", "l", "r").first()
    assert int(got["later_higher"]) == 3_000_000_001 * 3_000_000_007


def slow_log_rank(t, e, g):
    labels = sorted(set(g))
    k = len(labels)
    gap, cov = np.zeros(k), np.zeros((k, k))
    for time in np.unique(t[e == 1]):
        risk = np.array([np.sum((t >= time) & (g == x)) for x in labels], float)
        dead = np.array([np.sum((t == time) & (g == x) & (e == 1)) for x in labels], float)
        n, d = risk.sum(), dead.sum()
        gap += dead - d * risk / n
        if n > 1:
            p = risk / n
            cov += d * (n - d) / (n - 1) * (np.diag(p) - np.outer(p, p))
    return gap[:-1] @ np.linalg.pinv(cov[:-1, :-1]) @ gap[:-1]


@pytest.mark.parametrize("k, cells", [(200, 1 << 20), (7, 64)])
def test_log_rank_of_many_groups(spark, monkeypatch, k, cells):
    rng = np.random.default_rng(k)
    n = 1500
    g = np.array([f"g{x}" for x in np.concatenate([np.arange(k), rng.integers(0, k, n - k)])])
    t, e = np.ceil(rng.exponential(200, n)), rng.integers(0, 2, n)
    monkeypatch.setattr(V, "RISK_CELLS", cells)
    got = V.log_rank(spark.createDataFrame(pd.DataFrame({"t": t, "e": e, "g": g})), "t", "e", "g").first()
    assert got["dof"] == k - 1 and got["statistic"] == pytest.approx(slow_log_rank(t, e, g), rel=1e-6)


def test_fisher_equals_enumeration_and_is_fast():
    import math
    import time

    def slow(a, b, c, d):
        n, row, col = a + b + c + d, a + b, a + c
        p = {k: math.comb(row, k) * math.comb(n - row, col - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
        return sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)) / math.comb(n, col)

    rng = np.random.default_rng(5)
    tables = [tuple(int(v) for v in rng.integers(0, 30, 4)) for _ in range(300)] + [(0, 0, 0, 0), (5, 0, 0, 5), (0, 7, 0, 9), (3, 3, 3, 3), (1, 0, 0, 0)]
    for t in tables:
        assert dist.hypergeom_two_sided(*t) == pytest.approx(slow(*t), rel=1e-6), t
    start = time.perf_counter()
    p = dist.hypergeom_two_sided(500_600, 499_400, 499_500, 500_500)
    assert time.perf_counter() - start < 0.05 and 0 < p < 1
    assert dist.hypergeom_two_sided(1_000_000, 0, 0, 1_000_000) < 1e-300


def test_studentized_range_agrees_with_the_table():
    for alpha, table in C.NEMENYI_Q.items():
        for k, q in table.items():
            assert dist.studentized_range_quantile(k, alpha) / np.sqrt(2) == pytest.approx(q, abs=1e-3)
    assert dist.studentized_range_quantile(12, 0.05) / np.sqrt(2) == pytest.approx(3.268, abs=2e-3)
