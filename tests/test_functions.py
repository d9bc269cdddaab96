"""Distributed ranks, quantiles and p-values against numpy / pandas / published values."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylens.functions import dist
from quarrylens.functions.quantiles import bin_right_closed, edge_array, quantiles
from quarrylens.functions.ranks import dense_index, mid_ranks, running_totals, sequence_index
from quarrylens.functions.scalars import normal_cdf_expr
from quarrylens.operators import sequence as Q


def hot_frame(n=3000, seed=3):
    """A third of all rows share one key and one value."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 40, n).astype(str))
    x = np.where(rng.random(n) < 0.34, 7.0, rng.normal(size=n).round(2))
    return pd.DataFrame({"id": np.arange(n), "k": key, "x": x})


def test_mid_ranks_match_pandas_for_any_partitioning(spark):
    pdf = hot_frame()
    want = pdf.x.rank().groupby(pdf.x).first()
    for parts in (1, 8):
        got = mid_ranks(spark.createDataFrame(pdf).repartition(parts), "x").toPandas().set_index("x").mid_rank
        assert (got.sort_index() - want).abs().max() == 0


def test_running_totals_per_group(spark):
    pdf = hot_frame().groupby(["k", "x"]).size().reset_index(name="n")
    got = running_totals(spark.createDataFrame(pdf), "x", ["n"], ["k"]).toPandas().sort_values(["k", "x"])
    want = pdf.sort_values(["k", "x"]).groupby("k").n.cumsum().to_numpy()
    assert (got.n_before + got.n).tolist() == want.tolist()
    assert (got.groupby("k").n.sum() == got.groupby("k").n_total.first()).all()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: round(v, 3)), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["prob"]: r["quantile"] for r in quantiles(df, "x", [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(values, p), abs=1e-6)


def test_sequence_index_covers_every_position_of_a_hot_group(spark):
    pdf = hot_frame()
    got = sequence_index(spark.createDataFrame(pdf), ["x", "id"], ["k"], total="n", descending=["x"]).toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values(["x", "id"], ascending=[False, True])
        assert g._index.tolist() == list(range(len(g))) and (g.n == len(g)).all()


def test_dense_index_of_strings(spark):
    got = dense_index(spark.createDataFrame([(c,) for c in ["b", "a", "c", "a", None]], "s string"), "s").collect()
    assert {r["s"]: r["code"] for r in got} == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize("block", [2, 7, 1 << 16])
def test_lag_and_rolling_do_not_depend_on_block_size(spark, block):
    pdf = hot_frame(400)
    df = spark.createDataFrame(pdf)
    got = Q.lag_features(df, "x", [1, 3], ["id"], by=["k"], block_rows=block).toPandas().sort_values("id")
    for lag in (1, 3):
        want = pdf.groupby("k").x.shift(lag)
        assert got[f"x_lag_{lag}"].fillna(-99).tolist() == want.fillna(-99).tolist()
    got = Q.rolling_features(df, "x", [4], ["id"], ["mean"], block_rows=block).toPandas().sort_values("id")
    assert np.allclose(got.x_rolling_4_mean, pdf.x.rolling(4, min_periods=1).mean())


def test_fill_carries_values_over_long_gaps(spark):
    pdf = hot_frame(500)
    pdf.loc[(pdf.id % 97 != 0), "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    fwd = Q.fill(df, ["x"], ["id"]).toPandas().sort_values("id").x.tolist()
    back = Q.fill(df, ["x"], ["id"], forward=False).toPandas().sort_values("id").x
    assert fwd == pdf.x.ffill().tolist()
    assert back.fillna(-1).tolist() == pdf.x.bfill().fillna(-1).tolist()


def test_running_sum(spark):
    pdf = hot_frame(500)
    got = Q.running(spark.createDataFrame(pdf), {"s": F.col("x")}, ["id"], ["k"]).toPandas().sort_values("id")
    assert np.allclose(got.s, pdf.groupby("k").x.cumsum())


def test_quantile_bins_match_pandas_qcut(spark):
    pdf = hot_frame(800)
    want = pd.qcut(pdf.x, 5, labels=False, duplicates="drop") + 1
    df = spark.createDataFrame(pdf)
    got = df.withColumn("e", edge_array(df, "x", 5).scalar()).withColumn("b", bin_right_closed(F.col("x"), F.col("e")))
    assert got.toPandas().sort_values("id").b.tolist() == want.tolist()


@pytest.mark.parametrize("value,want", [
    (dist.t_two_sided(2.228139, 10), 0.05), (dist.chi2_sf(3.841459, 1), 0.05), (dist.f_sf(4.102821, 2, 10), 0.05),
    (dist.norm_two_sided(1.959964), 0.05), (dist.t_ppf(0.975, 10), 2.228139), (dist.norm_ppf(0.975), 1.959964),
    (dist.hypergeom_two_sided(8, 2, 1, 5), 0.034965), (dist.binom_two_sided(3, 15), 0.035156),
    (dist.rank_sum_exact_two_sided(0, 3, 3), 0.1), (dist.signed_rank_exact_two_sided(0, 5), 0.0625),
    (dist.chi2_sf(30.0, 5), 1.474e-05), (dist.t_two_sided(0.0, 5), 1.0)])
def test_distribution_functions(value, want):
    assert value == pytest.approx(want, rel=1e-3)


def test_kolmogorov_limits():
    assert dist.kolmogorov_sf(0.0, 50) == 1.0
    assert dist.kolmogorov_sf(1.36 / np.sqrt(1e8), 1e8) == pytest.approx(0.05, abs=1e-3)


def test_normal_cdf_expression(spark):
    z = [-9.0, -3.0, -0.5, 0.0, 1.0, 2.5, 8.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", normal_cdf_expr(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(dist.norm_cdf(r["z"]), rel=1e-9, abs=1e-18)
