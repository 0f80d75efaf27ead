"""Drawn timelines: no side of a join that grows with the hours is held whole, and sweeps read one copy of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorgate.operators import backtest as bt
from sensorgate.operators import detectors as det


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pool(spark):
    return spark.range(5000).select(F.col("id").alias("pool_idx"), F.sin("id").alias("z"))


@pytest.fixture(scope="module")
def trials(spark):
    return spark.range(5).select(F.col("id").alias("trial"))


@pytest.mark.parametrize("draw", [bt.resample, bt.contiguous_slice])
def test_draws_are_never_the_side_that_is_broadcast(trials, pool, draw):
    d = draw(trials, pool, "trial", 100)
    assert "BuildLeft" not in plan_of(d)
    assert d.count() == 500


def test_large_pool_is_not_broadcast(trials, pool, monkeypatch):
    monkeypatch.setattr(bt, "SMALL_POOL", 10)
    d = bt.resample(trials, pool, "trial", 100)
    assert "BroadcastHashJoin" not in plan_of(d)
    assert d.count() == 500


@pytest.mark.parametrize("draw", [bt.resample, bt.contiguous_slice])
def test_draws_from_a_large_pool_are_dealt_out_in_parts_that_grow_with_them(trials, pool, monkeypatch, draw):
    small = {(r["trial"], r["t"]): r["z"] for r in draw(trials, pool, "trial", 100).collect()}
    monkeypatch.setattr(bt, "SMALL_POOL", 10)
    monkeypatch.setattr(bt, "ROWS_PER_TASK", 20)
    d = draw(trials, pool, "trial", 100)
    assert d.rdd.getNumPartitions() == bt.parts_for(trials, 100) == 25
    assert {(r["trial"], r["t"]): r["z"] for r in d.collect()} == small


def test_hours_of_events_are_not_broadcast(trials, pool):
    d = bt.resample(trials, pool, "trial", 240)
    d = bt.add_slot_events(d, bt.plan_slots(trials, "trial", 240), "trial", "z", F.lit(1.0))
    assert "LeftOuter, BuildRight" not in plan_of(d)


def test_draws_of_the_bootstrap_are_not_broadcast(trials):
    o = trials.withColumns({"idx": F.col("trial"), "x": F.lit(1)})
    b = bt.bootstrap(o, "idx", ["x"], lambda d: d, 50)
    assert "BuildLeft" not in plan_of(b)
    assert b.agg(F.sum("x")).first()[0] == 250


def test_partitions_grow_with_the_trials(spark):
    few, many = spark.range(10), spark.range(100_000)
    assert bt.parts_for(few, 240) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bt.parts_for(many, 240) == 12


def test_gate_delays_equal_the_gate_on_each_injection(spark, trials, pool):
    d = bt.resample(bt.plan_events(trials, "trial", 240), pool, "trial", 240)
    d = d.withColumn("z", F.when(F.col("t") != 77, F.col("z")))  # a missing score
    sizes = [1.5, 3.0]
    got = det.gate_delays(d, ["trial"], "t", "z", "a0", "a1", "size double", [det.Injection((m,), m) for m in sizes], close=3.94, two_sided=False)
    got = {(r["trial"], r["size"]): r["delay"] for r in got.collect()}
    e = bt.add_events(d.withColumn("size", F.explode(F.array(*[F.lit(m) for m in sizes]))), "z", F.col("size"), 0.0)
    e = det.gate(e.withColumn("i", F.col("t").cast("long")), ["trial", "size"], "i", "z", close=3.94, two_sided=False)
    want = {(r["trial"], r["size"]): r["delay"] for r in bt.first_hit(e, ["trial", "size"], "closed").collect()}
    assert got == want
    assert any(v is not None for v in got.values())


def test_sweeps_do_not_shuffle_drawn_hours(spark, trials, pool):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = bt.resample(bt.plan_events(trials, "trial", 240), pool, "trial", 240)
    on = det.onset_hours(d, ["trial"], "t", "z", {"static": 0.9, "gate": 2.0}, n)
    assert "Generate" in (text := plan_of(on))
    assert "hashpartitioning" not in text.split("Generate")[0]  # nothing is dealt out above the drawn hours
    assert on.count() == 10


def test_onset_hours_equal_the_onsets_of_each_row(spark, trials, pool):
    d = bt.resample(trials, pool, "trial", 240)
    got = det.onset_hours(d, ["trial"], "t", "z", {"static": 0.9}).select("trial", F.explode("hours").alias("t"))
    want = det.static_onsets(d, ["trial"], "t", "z", 0.9).filter("onset").select("trial", "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_spiked_baseline_equals_the_gated_baseline_of_each_run(spark, trials, pool):
    d = bt.resample(trials, pool, "trial", 240).withColumn("sgn", F.when(F.col("trial") % 2 == 0, 1.0).otherwise(-1.0))
    got = det.spiked_baseline(d, ["trial"], "t", "z", "sgn", 0.1, 0.5, 0.3, [12], 8.0, 80, 239, 120)
    got = {(r["trial"], r["gated"]): r["shift"] for r in got.collect()}
    spike = (F.col("t") >= 80) & (F.col("t") < 239) & ((F.col("t") - 80) % 12 == 0)
    x = d.withColumns({"x": F.col("z") + F.when(spike, F.col("sgn") * 8.0).otherwise(0.0), "m": F.lit(0.1), "c": F.lit(0.5), "s": F.lit(0.3)})
    for gated in (True, False):
        b = det.gated_baseline(x.withColumn("g", F.lit(gated)), ["trial", "sgn"], "t", "x", "m", "c", "s", "g").filter("t >= 120")
        for r in b.groupBy("trial").agg((F.avg((F.col("mu") - 0.1) * F.col("sgn")) / 8).alias("f")).collect():
            assert got[r["trial"], gated] == pytest.approx(r["f"])


def test_cuts_of_value_ranges_are_drawn_once(spark):
    from sensorgate.operators.quantiles import value_ranges

    d = value_ranges(spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("x")), ["k"], "x", "r")
    assert "percentile_approx" not in plan_of(d)
    assert d.groupBy("k").agg(F.count_distinct("r")).collect()


def test_quantiles_of_stored_rows_equal_the_others(spark):
    """Offsets, heavy ties, small groups, missing numbers; and ranges that miss their rank."""
    from sensorgate.operators import quantiles

    r = np.random.default_rng(4)
    rows = [(0, float(v)) for v in r.normal(300, 0.01, 3000)] + [(1, float(v)) for v in r.integers(0, 3, 2000)] + [(2, 5.0), (3, None), (3, float("nan"))]
    d = spark.createDataFrame(rows, "k int, x double")
    qs, cols = [0.0, 0.025, 0.5, 0.975, 1.0], {"": F.col("x"), "twice": F.col("x") * 2}
    by = lambda df: sorted((x["k"], x["_f"], x["_q"], round(x["_val"], 9)) for x in df.collect())
    want = by(quantiles.quantiles_long(d, ["k"], cols, qs))
    assert by(quantiles.stored_quantiles_long(d, ["k"], cols, qs)) == want and len(want) == 30


def test_both_settings_of_the_baseline_share_one_copy_of_the_timelines(spark, trials, pool):
    d = bt.resample(trials, pool, "trial", 240).withColumns({"m": F.lit(0.1), "c": F.lit(0.5), "s": F.lit(0.3)})
    both = det.gated_baseline(d, ["trial"], "t", "z", "m", "c", "s", [True, False])
    assert plan_of(both).count("MapInPandas") == 1
    for gated in (True, False):
        one = det.gated_baseline(d.withColumn("g", F.lit(gated)), ["trial"], "t", "z", "m", "c", "s", "g")
        assert sorted(map(tuple, both.filter(F.col("gated") == gated).drop("gated").collect())) == sorted(map(tuple, one.collect()))


def test_alarm_hours_equal_the_gate_and_the_limit_of_each_row(spark, trials, pool):
    d = bt.resample(trials, pool, "trial", 240).withColumn("z", F.col("z") * 3)
    got = det.alarm_hours(d, ["trial"], "t", {"z": 2.5})
    assert "Window" not in plan_of(got)
    got = {(r["trial"], r["gated"]): list(r["_at"]) for r in got.collect()}
    rows = det.gate(d.withColumn("i", F.col("t").cast("long")), ["trial"], "i", "z").collect()
    for k in range(5):
        assert got[k, True] == sorted(r["t"] for r in rows if r["trial"] == k and r["closed"])
        assert got[k, False] == sorted(r["t"] for r in rows if r["trial"] == k and abs(r["z"]) > 2.5)
