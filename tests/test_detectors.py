"""Gate and detectors against plain state loops, and streams against batch over several micro-batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorgate.operators import detectors as det
from sensorgate.operators import timeseries as ts
from sensorgate.streaming import stateful as st


def gate_loop(r, close=6.0):
    p, on, out = 0.0, False, []
    for x in r:
        p = 0.85 * p + (0.0 if np.isnan(x) else min(max(0.0, abs(x) - 1.0), 2.0))
        on = p > 2.0 if on else p >= close
        out.append((p, on))
    return np.array([o[0] for o in out]), np.array([o[1] for o in out])


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    rows = []
    for e in range(3):
        v = rng.normal(0, 1.4, 600)
        v[200:230] += 3
        v[rng.random(600) < 0.1] = np.nan
        rows.append(pd.DataFrame({"entity": e, "hr": np.arange(600) + 1000 * e, "v": v}))
    return pd.concat(rows, ignore_index=True)


def frame(spark, pdf):
    return spark.createDataFrame(pdf).repartition(4).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize("bounded", [True, False])
def test_gate_equals_loop(spark, series, bounded):
    d = det.gate(frame(spark, series), ["entity"], "hr", "v", bounded=bounded).toPandas().sort_values(["entity", "hr"])
    for e, g in series.groupby("entity"):
        p, on = gate_loop(g.v)
        got = d[d.entity == e]
        assert np.allclose(got.persistence, p, atol=1e-9)
        assert (got.closed.to_numpy() == on).all()
    assert d.closed.any() and not d.closed.all()


@pytest.mark.parametrize("bounded", [True, False])
def test_missing_hours_leak_like_empty_hours(spark, series, bounded):
    full = det.gate(frame(spark, series), ["entity"], "hr", "v", bounded=bounded).filter("v is not null")
    sparse = det.gate(frame(spark, series).filter("v is not null"), ["entity"], "hr", "v", bounded=bounded)
    a, b = (x.toPandas().sort_values(["entity", "hr"]) for x in (full, sparse))
    assert np.allclose(a.persistence, b.persistence)
    assert (a.closed.to_numpy() == b.closed.to_numpy()).all()


def test_spike_never_closes_and_level_does(spark):
    v = np.zeros(240)
    v[50] = 30.0
    v[120:156] = 3.0
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "t": np.arange(240), "v": v}))
    closed = det.gate(d, ["k"], "t", "v").toPandas().sort_values("t").closed.to_numpy()
    assert not closed[:120].any() and closed[123:156].all()


@pytest.mark.parametrize("level,closes", [(1.89, False), (1.91, True)])
def test_constant_level_limit(spark, level, closes):
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "t": np.arange(400), "v": level}))
    assert det.gate(d, ["k"], "t", "v").filter("closed").isEmpty() != closes


def scalar_folds(z, h):
    g = s = mean = cum = low = 0.0
    n, out = 0, []
    for v in z:
        g = 0.7 * g + 0.3 * v
        s = max(0.0, s + v - 0.5)
        n += 1
        mean += (v - mean) / n
        cum += v - mean - 0.1
        low = min(low, cum)
        fire = (g > h, s > h, cum - low > h)
        g, s = (0.0 if fire[0] else g), (0.0 if fire[1] else s)
        if fire[2]:
            n, mean, cum, low = 0, 0.0, 0.0, 0.0
        out.append(fire)
    return np.array(out)


@pytest.mark.parametrize("h", [0.9, 2.3])
def test_reset_detectors(spark, series, h):
    names = ["ewma", "cusum", "page_hinkley"]
    d = det.fold_onsets(frame(spark, series), ["entity"], "hr", "v", dict.fromkeys(names, h)).toPandas().sort_values(["entity", "hr"])
    for e, g in series.groupby("entity"):
        want = scalar_folds(g.v.fillna(0), h)
        assert (d[d.entity == e][[f"on_{n}" for n in names]].to_numpy(bool) == want).all()
        assert want.any()


def test_grid_counts_equal_single_runs(series):
    z, grid = series.v.fillna(0).to_numpy()[:600], np.linspace(0.5, 15, 60)
    for f in det.DETECTORS.values():
        many = f(z[:, None], grid[None, :]).sum(axis=0)[0]
        assert (many == [f(z[:, None], np.array([[h]])).sum() for h in grid]).all()


def test_timelines_of_unequal_length_and_split_batches(spark, monkeypatch):
    monkeypatch.setattr(det, "BLOCK_ROWS", 50)
    r = np.random.default_rng(5)
    rows = pd.concat([pd.DataFrame({"k": k, "t": np.arange(n), "v": r.normal(1, 1, n)}) for k, n in enumerate([3, 170, 40, 1, 90, 60])])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = det.onset_counts(spark.createDataFrame(rows), ["k"], "t", "v", det.DETECTORS, [0.7, 2.5]).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for (k, n, h), g in got.groupby(["k", "detector", "h"]):
        v = rows[rows.k == k].v.to_numpy()[:, None]
        assert g.n_onsets.tolist() == [det.DETECTORS[n](v, np.array([[h]])).sum()]
    assert len(got) == 6 * 6 * 2


def test_window_form_of_shift_detector(spark, series):
    d = frame(spark, series.fillna(0.0))
    got = det.window_shift_onsets(d, ["entity"], "hr", "v", 2.0).toPandas().sort_values(["entity", "hr"])
    for e, g in series.fillna(0.0).groupby("entity"):
        want = det.DETECTORS["adwin"](g.v.to_numpy()[:, None], np.array([[2.0]]))[:, 0, 0]
        assert (got[got.entity == e].onset.to_numpy() == want).all()


def feed(spark, tmp_path, pdf, make, parts=5, delay="4000 days"):
    """Rows arrive in several files in random order, one file per micro-batch."""
    src, rng = str(tmp_path / "in"), np.random.default_rng(5)
    pdf = pdf.assign(hr=pdf.hr + 480_000)  # the epoch itself is the first watermark
    for part in np.array_split(rng.permutation(len(pdf)), parts):
        rows = frame(spark, pdf.iloc[part]).withColumn("ts", F.timestamp_seconds(F.col("hr").cast("long") * 3600))
        rows.coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = st.run_to_end(stream, "ts", delay, make, str(tmp_path / "out")).toPandas()
    return out.assign(hr=out.hr - 480_000)


def test_gate_stream_equals_batch(spark, series, tmp_path):
    rows = series[series.v.notna()]
    got = feed(spark, tmp_path, rows, lambda s: st.gate_stream(s, ["entity"], "hr", "v")).sort_values(["entity", "hr"])
    want = det.gate(frame(spark, rows), ["entity"], "hr", "v").toPandas().sort_values(["entity", "hr"])
    assert np.allclose(got.persistence, want.persistence)
    assert (got.closed.to_numpy(bool) == want.closed.to_numpy()).all()


def test_ewma_stream_equals_batch(spark, series, tmp_path):
    rows = series[series.v.notna()].assign(hod=lambda d: d.hr % 24)
    got = feed(spark, tmp_path, rows, lambda s: st.hour_ewma_stream(s, ["entity", "hod"], "hr", "v")).sort_values(["entity", "hr"])
    want = ts.causal_hour_ewma(frame(spark, rows), ["entity"], "hr", "v", "p").toPandas().sort_values(["entity", "hr"])
    assert np.allclose(got.prediction.astype(float), want.p, equal_nan=True)


def test_hour_ewma_loop(spark, series):
    got = ts.causal_hour_ewma(frame(spark, series), ["entity"], "hr", "v", "p").toPandas().sort_values(["entity", "hr"])
    state, want = {}, []
    for e, t, v in zip(got.entity, got.hr, got.v):
        k = (e, t % 24)
        want.append(state.get(k, np.nan))
        state[k] = 0.8 * state[k] + 0.2 * v if k in state else v
    assert np.allclose(got.p, want, equal_nan=True)


def test_detector_stream_equals_batch(spark, series, tmp_path):
    h = {"ewma": 0.9, "cusum": 2.3, "page_hinkley": 3.1}
    rows = series.fillna(0.0)
    got = feed(spark, tmp_path, rows, lambda s: st.reset_detectors_stream(s, ["entity"], "hr", "v", h)).sort_values(["entity", "hr"])
    want = det.fold_onsets(frame(spark, rows), ["entity"], "hr", "v", h).toPandas().sort_values(["entity", "hr"])
    for n in h:
        assert (got[f"on_{n}"].to_numpy(bool) == want[f"on_{n}"].to_numpy(bool)).all()
