"""Linear models against direct matrix algebra, and small fixtures of parsers, arrays and sources."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorgate.functions import arrays as ar
from sensorgate.functions import parse
from sensorgate.functions.exprs import clean_nan, int_div, mix
from sensorgate.operators import aggregate as ag
from sensorgate.operators import align
from sensorgate.operators import backtest as bt
from sensorgate.operators import detectors as det
from sensorgate.operators import normalize as nz
from sensorgate.sources import readers as io


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 3))
    return base @ rng.normal(size=(3, 8)) + 0.4 * rng.normal(size=(400, 8)) + np.arange(8)


@pytest.fixture(scope="module")
def vectors(spark, data):
    return spark.createDataFrame(pd.DataFrame({"i": range(len(data)), "v": list(data)})).repartition(4)


def test_moments(vectors, data):
    m = nz.moments(vectors, ["v"])
    assert np.allclose(m.mean, data.mean(0)) and np.allclose(m.cov, np.cov(data.T, bias=True))


def test_pair_sums_with_missing(spark, data):
    x = data[:, :3].copy()
    x[::5, 0], x[::7, 2] = np.nan, np.nan
    d = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    got = nz.corr_long(nz.pair_sums(d, list("abc"), shift=[0.0, 1.0, 2.0])).toPandas().pivot(index="i", columns="j", values="r")
    assert np.allclose(got, pd.DataFrame(x).corr())


def test_pca(vectors, data):
    p = nz.Pca.fit(nz.moments(vectors, ["v"]), k=3)
    x = data - data.mean(0)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(p.variance, s[:3] ** 2 / (len(x) - 1))
    z = np.stack(p.transform(vectors, "v", "z", whiten=True).orderBy("i").toPandas().z)
    assert np.allclose(np.cov(z.T), np.eye(3), atol=1e-8)
    err = p.reconstruction_error(vectors, "v", "e").orderBy("i").toPandas().e
    assert np.allclose(err, ((x - x @ vt[:3].T @ vt[:3]) ** 2).sum(1))


def test_shrunk_distance(vectors, data):
    model = nz.ShrunkDistance.fit(vectors, "v")
    x = data - data.mean(0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / n**2 / p, d2)
    assert np.isclose(model.shrinkage, b2 / d2)
    prec = np.linalg.inv((1 - b2 / d2) * s + b2 / d2 * mu * np.eye(p))
    got = model.transform(vectors, "v", "d").orderBy("i").toPandas().d
    assert np.allclose(got, np.sqrt(np.einsum("ij,jk,ik->i", x, prec, x)))


def test_coherence(vectors, data):
    c = nz.Coherence.fit(nz.moments(vectors, ["v"]), split=4, k=3)
    d = c.transform(vectors, "v").toPandas()
    assert np.isclose(np.corrcoef(d.cu, d.cw)[0, 1], c.r, atol=1e-6)
    z = (data - data.mean(0)) / data.std(0)

    def pcs(b):
        return b @ np.linalg.svd(b, full_matrices=False)[2][:3].T

    qa, qv = (np.linalg.qr(pcs(b))[0] for b in (z[:, :4], z[:, 4:]))
    assert np.isclose(c.r, np.linalg.svd(qa.T @ qv)[1][0], atol=1e-6)


def test_pruning_drops_missing_and_tied():
    var = {"a": 3.0, "b": 2.0, "c": 1.0, "dead": 0.0, "lost": 0.5}
    corr = {("b", "a"): 0.95, ("c", "a"): 0.1, ("lost", "a"): None}
    assert nz.prune_correlated(var, corr, 0.9) == ["a", "c"]


def test_canonical_replicates_are_fitted_anew(spark):
    """Every shuffle and bootstrap sample against components and decompositions of its own rows."""
    g = np.random.default_rng(12)
    x = g.normal(size=(90, 7))
    x[:, 4] += 0.8 * x[:, 0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    m = nz.moments(df, ["v"])
    d = bt.row_index(nz.block_scores(df, "v", m, 4, 3), [], ["id"], "idx").select("idx", "u", "w")

    def direct(a, b):
        a, b = (np.linalg.qr(z - z.mean(0))[0] for z in (a, b))
        return np.linalg.svd(a.T @ b)[1][0]

    def components(z):
        z = (z - z.mean(0)) / z.std(0)
        return z @ np.linalg.svd(z, full_matrices=False)[2][:3].T

    u, w = components(x[:, :4]), components(x[:, 4:])
    reps = [(k, r) for k in range(90) for r in range(4)]
    draws = {(r.k, r.rep): (r.h, r.at) for r in spark.createDataFrame(reps, "k long, rep int").select("k", "rep", mix("k", "rep", 5).alias("h"), (mix("rep", "k", 6) % 90).alias("at")).collect()}
    null = {r.rep: r.r for r in nz.canonical_r(bt.shuffled_pairs(d, "idx", "u", "w", 4, 5), ["rep"], "u", "w", (3, 3)).collect()}
    boot = {r.rep: r.r for r in nz.canonical_r(bt.drawn_pairs(d, "idx", "u", "w", 4, 6), ["rep"], "u", "w", (3, 3)).collect()}
    for rep in range(4):
        order = sorted(range(90), key=lambda k: (draws[k, rep][0], k))
        assert np.isclose(null[rep], direct(u, components(x[order][:, 4:])))
        at = [draws[k, rep][1] for k in range(90)]
        assert np.isclose(boot[rep], direct(u[at], w[at]))
    row = bt.canonical_test(df, ["id"], "v", 4, 3, 40, 5).first()
    assert np.isclose(row.r, direct(u, w)) and 1 / 41 <= row.p_value <= 0.2 and row.lo < row.r < row.hi


def test_gram_state_merges_blocks_and_steps(spark, monkeypatch):
    """Several blocks of features, more tasks than one step takes, missing values, and an empty table."""
    monkeypatch.setattr(nz, "FAN_IN", 3)
    monkeypatch.setattr(nz, "BLOCK", 64)
    x = np.random.default_rng(6).normal(size=(200, 20)) + 300
    x[:, 7] = 5.0
    x[::9, 3] = np.nan
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(10)
    full = x[~np.isnan(x).any(axis=1)]
    m = nz.moments(df, ["v"])
    assert m.n == len(full) and np.allclose(m.mean, full.mean(axis=0)) and np.allclose(m.cov, np.cov(full.T, bias=True), atol=1e-9)
    var, r = nz.correlations(df, ["v"])
    want = pd.DataFrame(x).corr().to_numpy()
    want[7], want[:, 7] = np.nan, np.nan
    assert np.allclose(var, pd.DataFrame(x).var(), atol=1e-9) and np.allclose(r, want, equal_nan=True)
    assert len(nz.gram_state(df, ["v"], np.zeros(20), complete=True).collect()) == 20
    assert 7 not in nz.prune_features(var, r, 0.9)
    var, r = nz.correlations(df.where("false"), ["v"])
    assert len(var) == 0 and nz.prune_features(var, r, 0.9) == []


def test_band_match_brute_force(spark):
    rng = np.random.default_rng(9)
    ev = pd.DataFrame({"e": range(60), "norm": np.r_[rng.uniform(0.5, 5, 57), 40.0, 0.01, 11.0], "expected": rng.normal(size=60)})
    pool = pd.DataFrame({"pool_id": range(500), "pool_norm": np.r_[rng.uniform(0.5, 5, 496), 10.9, 11.1, 11.0, 12.0], "w": rng.normal(size=500).round(1)})
    got = align.farthest_in_band(spark.createDataFrame(ev), spark.createDataFrame(pool), "e").toPandas().set_index("e")
    for r in ev.itertuples():
        gap = (pool.pool_norm - r.norm).abs()
        cand = pool[gap < 0.15 * r.norm + 1e-9]
        wide = len(cand) < 5
        if wide:
            cand = pool.assign(g=gap).sort_values(["g", "pool_id"]).head(20)
        far = (cand.w - r.expected).abs()
        assert np.isclose(got.loc[r.e, "far"], far.max()) and got.loc[r.e, "widened"] == wide
        assert got.loc[r.e, "pool_id"] == cand[np.isclose(far, far.max(), atol=1e-12)].pool_id.min()


def test_dates_in_text(spark):
    rows = [(1, "Oct18-20"), (2, "13, 14, 15 Aug"), (3, "Nov28-Dec1"), (4, "31 July - 2 Aug"), (5, "Room 8 audio 31 Feb"), (6, "no date 12")]
    d = parse.dates_in_text(spark.createDataFrame(rows, "k int, s string"), ["k"], "s", F.lit(2025))
    got = {}
    for r in d.collect():
        got.setdefault(r.k, set()).add((r.date.month, r.date.day))
    assert got == {1: {(10, 18), (10, 20)}, 2: {(8, 13), (8, 14), (8, 15)}, 3: {(11, 28), (12, 1)}, 4: {(7, 31), (8, 2)}}


def test_recording_start(spark):
    rows = [("x.WAV", "ZOOM F6    20250706082750"), ("S4A27290_20250729_122930.wav", ""), ("250608_001_0029.WAV", ""), ("y.wav", "2025-07-0608:27:50")]
    d = spark.createDataFrame(rows, "f string, h string").select(parse.recording_start("f", "h", F.lit("2020-01-01 00:00:00")).alias("r"))
    got = [(str(x.r.start), x.r.ts_source) for x in d.collect()]
    assert got == [
        ("2025-07-06 08:27:50", "metadata"),
        ("2025-07-29 12:29:30", "filename"),
        ("2025-06-08 00:00:00", "filedate"),
        ("2025-07-06 08:27:50", "metadata"),
    ]


def test_folder_date(spark):
    rows = [("/d/July 2024/19 sep/a.jpg",), ("/d/Aug 19/a.jpg",), ("/d/24Sep/x/a.jpg",), ("/d/31 Feb/a.jpg",), ("/d/take 3/a.jpg",)]
    got = [r.d for r in spark.createDataFrame(rows, "p string").select(parse.folder_date("p").alias("d")).collect()]
    assert got == [dt.date(2024, 9, 19), dt.date(2025, 8, 19), dt.date(2025, 9, 24), None, None]


def test_warm_frame(spark):
    rng = np.random.default_rng(0)
    frame = 22 + rng.normal(0, 1, (120, 160))
    for i in range(8):
        frame[10 + 12 * i : 18 + 12 * i, 20:40] = 33 + rng.normal(0, 1.5, (8, 20))
    frame[12:14, 22:24] = 37
    d = spark.createDataFrame(pd.DataFrame({"a": [frame.ravel()]})).select(ar.masked_features()("a").alias("m")).select("m.*").first()
    assert 24 < d.otsu < 30 and d.t_mean > d.rest_median and 0 < d.hot_frac < 1 and d.mask_ok


def test_partials_merge(spark):
    x = np.random.default_rng(2).normal(size=(30, 64))
    d = spark.createDataFrame(pd.DataFrame({"h": 1, "f": np.arange(30) % 2, "v": list(x)}))
    parts = ag.vector_partials(d, ["h", "f"], "v")
    once, twice = ag.merge_partials(parts, ["h"]).toPandas(), ag.merge_partials(parts.union(parts), ["h"]).toPandas()
    a, b = once.sort_values("dim"), twice.sort_values("dim")
    assert np.allclose(a["mean"], x.mean(0)) and np.allclose(a["std"], x.std(0)) and np.allclose(a["mean"], b["mean"])
    assert (b.n.to_numpy() == 2 * a.n.to_numpy()).all()
    wide = ag.widen(ag.merge_partials(parts, ["h"]), ["h"], ["mean", "std"], 64)
    assert len(wide.columns) == 129 and np.isclose(wide.first()["mel63_std"], x[:, 63].std())


def test_auc_ties(spark):
    rng = np.random.default_rng(4)
    s, y = rng.integers(-5, 5, 300), rng.integers(0, 2, 300)
    got = bt.roc_auc(spark.createDataFrame(pd.DataFrame({"s": s, "y": y})), [], "s", "y").first().auc
    pos, neg = s[y == 1][:, None], s[y == 0][None, :]
    assert np.isclose(got, ((pos > neg) + 0.5 * (pos == neg)).mean())


def test_sources(spark, tmp_path):
    assert io.find_time_column(["a", "my_date", "hour"]) == "hour" and io.find_time_column(["a", "my_date"]) == "my_date"
    assert io.find_value_column(["rh_am", "temp_max", "temp_day_mean"], ["temp"]) == "temp_day_mean"
    with pytest.raises(FileNotFoundError):
        io.read_existing(spark, [str(tmp_path / "none")], "a int")
    (tmp_path / "sub").mkdir()
    for n in ("a.wav", "._b.wav", "sub/c.WAV", "d.txt"):
        (tmp_path / n).write_text("x")
    files = io.media_files(io.list_files(spark, str(tmp_path)), ["wav"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["a.wav", "c.WAV"]


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_moments_with_missing_values_and_offset(spark, offset):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)) @ np.array([[1.0, 0.7, 0.0], [0.0, 0.7, 0.2], [0.0, 0.0, 1.0]]) + offset
    x[::2, 1] = np.nan
    d = spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).repartition(4)
    for frame in (d, clean_nan(d)):
        m, want = nz.moments(frame, ["a", "b", "c"]), x[1::2]
        assert m.n == 200 and np.allclose(m.mean, want.mean(0), rtol=1e-12, atol=1e-9) and np.allclose(m.cov, np.cov(want.T, bias=True), rtol=1e-5)
        got = {(r.i, r.j): r for r in nz.corr_long(nz.pair_sums(frame, ["a", "b", "c"])).collect()}
        for i in range(3):
            for j in range(3):
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                assert got[i, j].n == both.sum() and np.isclose(got[i, j].r, np.corrcoef(x[both, i], x[both, j])[0, 1], atol=1e-6)


def test_readers_turn_nan_into_null(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 4.0), (3, 2.0)], "k int, v double").write.parquet(f"{tmp_path}/t.parquet")
    d = io.read_table(spark, str(tmp_path), "t")
    assert d.filter("v IS NULL").count() == 1 and d.agg(F.avg("v"), F.percentile("v", F.lit(0.5))).first() == (3.0, 3.0)


def test_floor_division_before_1970(spark):
    d = spark.range(-50, 50).select("id", int_div("id", 24).alias("q")).collect()
    assert all(r.q == r.id // 24 for r in d)


def test_slice_of_a_short_pool_wraps(spark):
    pool = spark.range(100).select(F.col("id").alias("pool_idx"), F.col("id").alias("v"))
    trials = spark.range(5).select(F.col("id").alias("trial"))
    got = bt.contiguous_slice(trials, pool, "trial", 240).toPandas().sort_values(["trial", "t"])
    assert got.groupby("trial").size().tolist() == [240] * 5
    for _, g in got.groupby("trial"):
        assert (np.diff(g.v) % 100 == 1).all()


def test_short_segment_has_no_seasonal_model(spark):
    d = spark.createDataFrame([("a", t, float(t % 7)) for t in range(30)] + [("b", t, float(np.sin(t * np.pi / 12)) + 0.01 * t) for t in range(96)], "k string, t long, v double")
    got = det.forecast_residuals(d, ["k"], "t", "v").toPandas()
    seasonal = got[got.model == "seasonal"]
    assert seasonal[seasonal.k == "a"].resid.isna().all() and len(seasonal[seasonal.k == "a"]) == 30
    assert seasonal[seasonal.k == "b"].resid.astype(float).abs()[-24:].mean() < 0.3 and got[got.model == "local_trend"].resid.notna().all()
