"""Blocked scans and exact quantiles against plain loops, with one key holding most of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorgate.operators import quantiles, scan


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(1)
    n = 1200
    key = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 6, n))
    t = rng.permutation(n * 3)[:n]
    v = np.where(rng.random(n) < 0.2, np.nan, rng.normal(0, 2, n).round(2))
    return pd.DataFrame({"k": key, "t": t, "v": v}).sort_values(["k", "t"]).reset_index(drop=True)


def frame(spark, pdf):
    d = spark.createDataFrame(pdf).repartition(5)
    return d.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def back(df, out):
    return df.select("k", "t", out).toPandas().sort_values(["k", "t"])[out].to_numpy(float)



def test_running_sum(spark, skewed):
    block = F.floor(F.col("t") / 100).cast("long")
    d = scan.running_sum(frame(spark, skewed), ["k"], ["t"], "v", "s", block)
    assert np.allclose(back(d, "s"), skewed.fillna(0).groupby("k").v.cumsum())


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("inclusive", [True, False])
def test_carry(spark, skewed, forward, inclusive):
    block = F.floor(F.col("t") / 50).cast("long")
    d = scan.carry(frame(spark, skewed), ["k"], ["t"], "v", "c", block, inclusive, forward)
    g = skewed.groupby("k").v
    want = g.ffill() if forward else g.bfill()
    if not inclusive:
        want = want.groupby(skewed.k).shift(1 if forward else -1)
    assert np.array_equal(back(d, "c"), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("decay", [0.85, 0.5, 0.99])
def test_decayed_sum(spark, skewed, bounded, decay):
    d = scan.decayed_sum(frame(spark, skewed), ["k"], "t", "v", decay, "s", bounded)
    want = []
    for _, g in skewed.groupby("k"):
        s, last = 0.0, None
        for t, v in zip(g.t, g.v):
            s = s * decay ** (t - last if last is not None else 0) + (0.0 if np.isnan(v) else v)
            last = t
            want.append(s)
    assert np.allclose(back(d, "s"), want, rtol=1e-9, atol=1e-9)


def test_halo_sees_whole_frames(spark, skewed):
    from pyspark.sql import Window as W

    d = scan.with_halo(frame(spark, skewed), "t", 64, 30, 20)
    w = W.partitionBy("k", "_blk").orderBy("t").rangeBetween(-30, 20)
    d = d.withColumn("n", F.count("v").over(w)).filter("_core")
    want = [((g := skewed[skewed.k == k]).t.between(t - 30, t + 20) & g.v.notna()).sum() for k, t in zip(skewed.k, skewed.t)]
    assert (back(d, "n") == want).all()


@pytest.mark.parametrize("q", [[0.0, 0.5, 1.0], [0.1, 0.33, 0.9]])
def test_exact_quantiles(spark, skewed, q):
    d = quantiles.exact_quantiles(frame(spark, skewed), ["k"], {"v": F.col("v"), "t": F.col("t")}, q).toPandas().sort_values("k")
    for c in ("v", "t"):
        want = skewed.groupby("k")[c].quantile(q).unstack()
        got = d[[f"{c}_p{round(x * 100):02d}" for x in q]].to_numpy()
        assert np.allclose(got, want.to_numpy())


@pytest.mark.parametrize("kind", ["wide", "offset", "narrow"])
def test_value_ranges_are_ordered_and_even(spark, kind):
    rng = np.random.default_rng(3)
    x = {"wide": np.concatenate([-np.logspace(-12, 9, 4000), np.logspace(-12, 9, 4000)]), "offset": rng.uniform(293.0, 293.5, 8000), "narrow": 1 + 1e-9 * rng.normal(size=8000)}[kind]
    d = quantiles.value_ranges(spark.createDataFrame(pd.DataFrame({"x": x})), [], "x", "r").toPandas().sort_values("x")
    assert (np.diff(d.r) >= 0).all() and d.r.value_counts(normalize=True).max() < 2 / quantiles.RANGES
