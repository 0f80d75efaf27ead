"""Every model through one interface: fit, transform, save and load, alone and in a pipeline, with missing vectors."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from sensorgate.operators import detectors as det
from sensorgate.operators import normalize as nz
from sensorgate.operators.estimators import BlockCoherence, BlockCoherenceModel, CalibratedGate, CalibratedGateModel, CovarianceDistance, CovarianceDistanceModel, PrincipalComponents, PrincipalComponentsModel


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 3)) @ rng.normal(size=(3, 6)) + 0.3 * rng.normal(size=(120, 6))
    data = [(i, [float(a) for a in v], "kept") for i, v in enumerate(x)]
    data += [(900, None, "kept"), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], "kept"), (902, [float("nan")] * 6, "kept"), (903, [float("inf")] * 6, "kept")]
    return spark.createDataFrame(data, "i long, v array<double>, distance string").repartition(3).cache()


def same(a, b, outs):
    a, b = (d.orderBy("i").select("i", *outs).toPandas() for d in (a, b))
    assert list(a.i) == list(b.i)
    for c in outs:
        for p, q in zip(a[c], b[c], strict=True):
            assert (p is None and q is None) or np.allclose(np.array(p, float), np.array(q, float), equal_nan=True)


@pytest.mark.parametrize(
    ("estimator", "kind", "outs", "direct"),
    [
        (PrincipalComponents(inputCol="v", outputCol="z", k=2, whiten=True), PrincipalComponentsModel, ["z"], lambda d: nz.Pca.fit(nz.moments(d, ["v"]), k=2).transform(d, "v", "z", whiten=True)),
        (PrincipalComponents(inputCol="v", outputCol="e", share=0.9, error=True), PrincipalComponentsModel, ["e"], lambda d: nz.Pca.fit(nz.moments(d, ["v"]), share=0.9).reconstruction_error(d, "v", "e")),
        (CovarianceDistance(inputCol="v"), CovarianceDistanceModel, ["distance"], lambda d: nz.ShrunkDistance.fit(d, "v").transform(d, "v", "distance")),
        (BlockCoherence(inputCol="v", split=3, k=2), BlockCoherenceModel, ["cu", "cw", "na", "nv"], lambda d: nz.Coherence.fit(nz.moments(d, ["v"]), 3, 2).transform(d, "v")),
    ],
)
def test_array_models(rows, tmp_path, estimator, kind, outs, direct):
    model = estimator.fit(rows)
    got = model.transform(rows)
    assert got.count() == 124 and "_vector" not in got.columns
    assert got.filter(F.col("i") >= 900).filter(" OR ".join(f"{c} IS NOT NULL" for c in outs)).count() == 0
    same(got.filter("i < 900"), direct(rows.filter("i < 900")), outs)
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    model.write().overwrite().save(path)
    back = kind.load(path)
    assert back.uid == model.uid and back.getInputCol() == "v"
    same(got, back.transform(rows), outs)
    estimator.write().overwrite().save(str(tmp_path / "estimator"))
    assert type(estimator).load(str(tmp_path / "estimator")).extractParamMap().keys() == estimator.extractParamMap().keys()
    with pytest.raises(ValueError, match="no complete row"):
        estimator.fit(rows.filter("i = 900"))


def test_gate_model(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(k, t, float(rng.normal() + (6 if 60 <= t < 90 else 0))) for k in ("a", "b") for t in range(120)]
    d = spark.createDataFrame([*data, ("a", 200, None), ("new", 1, 3.0)], "entity string, hr long, s double")
    clean = d.filter("hr < 60 AND entity <> 'new'")
    model = CalibratedGate(inputCol="s").fit(clean)
    got = model.transform(d)
    assert got.count() == 242 and not {"_scale", "_deadband"} & set(got.columns)
    p = det.calibrate_gate(clean, ["entity"], "s")
    want = det.gate(d.join(p, "entity"), ["entity"], "hr", "s", scale=F.col("scale"), deadband=F.col("deadband"))
    key = ["entity", "hr", "closed"]
    assert sorted(map(tuple, got.filter("entity <> 'new'").select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert got.filter("closed AND hr BETWEEN 60 AND 90").count() > 0 and got.filter("entity = 'new' AND closed").count() == 0
    model.save(str(tmp_path / "gate"))
    again = CalibratedGateModel.load(str(tmp_path / "gate")).transform(d)
    assert sorted(map(tuple, again.select(key).collect())) == sorted(map(tuple, got.select(key).collect()))


def test_models_in_a_pipeline(rows, tmp_path):
    line = Pipeline(stages=[PrincipalComponents(inputCol="v", outputCol="z", k=3), CovarianceDistance(inputCol="z", outputCol="far")])
    model = line.fit(rows)
    model.save(str(tmp_path / "line"))
    same(model.transform(rows), PipelineModel.load(str(tmp_path / "line")).transform(rows), ["z", "far"])
