"""Fitted models behind one interface: parameters, ``fit``, ``transform``, ``save`` and ``load`` as in ``pyspark.ml``.

An estimator learns on clean rows and gives a model; both are stages of a ``Pipeline``. A model is stored as its
parameters and one Parquet table: a row of numbers for each array (as many as features squared, whatever the rows), or,
for the gate, a row for each key. Scoring maps over Arrow batches or, for the gate, joins the keys.

Defined cases: rows whose vector is null, or holds a null or a number that is not finite, are left out of ``fit`` and get
null results from ``transform``; a table without a complete row raises ValueError in ``fit``; repeated rows count as often
as they occur; columns named like the results are replaced. All vectors of a table have one length. Keys that the gate has not seen
when it was fitted keep their rows, and their gate stays open.
"""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgate.operators import detectors as det
from sensorgate.operators import normalize as nz


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model._state(self.sparkSession).write.parquet(f"{path}/state")


class _Reader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind()
        model._resetUid(about["uid"])
        DefaultParamsReader.getAndSetParams(model, about)
        model._restore(self.sparkSession.read.parquet(f"{path}/state"))
        return model


class _StoredModel(Model, MLReadable, MLWritable):
    """A model with a table as its state."""

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _ArrayModel(_StoredModel):
    """A model that is a record of arrays and numbers, kept as ``fitted``."""

    record: type
    fitted = None

    def _state(self, spark) -> DataFrame:
        rows = [(n, list(np.shape(v)), [float(x) for x in np.ravel(v)]) for n, v in vars(self.fitted).items()]
        return spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").coalesce(1)

    def _restore(self, state: DataFrame) -> None:
        parts = {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in state.collect()}
        numbers = self.record.__annotations__
        self.fitted = self.record(**{n: v if numbers[n] == "np.ndarray" else {"int": int, "float": float}[numbers[n]](v) for n, v in parts.items()})

    def _scored(self, df: DataFrame, outs: list[str], score) -> DataFrame:
        """``score(frame, vector)`` for complete vectors, nulls in ``outs`` for others."""
        vector = self.getInputCol()
        d = df.drop(*[c for c in outs if c != vector])
        whole = complete(vector)
        zeros = F.array_repeat(F.lit(0.0), len(self.fitted.mean))
        d = d.withColumns({"_whole": whole, "_vector": F.when(whole, F.col(vector).cast("array<double>")).otherwise(zeros)})
        d = score(d, "_vector")
        return d.withColumns({c: F.when(F.col("_whole"), F.col(c)) for c in outs}).drop("_whole", "_vector")


def complete(vector: str):
    """True where a vector has all its numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & sound, F.lit(False))


class _Fits(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """An estimator whose model takes over its parameters."""

    def _model(self, model, fitted):
        model.fitted = fitted
        return self._copyValues(model)

    def _clean(self, df: DataFrame) -> DataFrame:
        vector = self.getInputCol()
        return df.select(vector).filter(complete(vector))


class _PcaParams(HasInputCol, HasOutputCol):
    k = Param(Params._dummy(), "k", "number of components; the share decides where it is 0", TypeConverters.toInt)
    share = Param(Params._dummy(), "share", "share of the variance that the components hold", TypeConverters.toFloat)
    whiten = Param(Params._dummy(), "whiten", "components of unit variance", TypeConverters.toBoolean)
    error = Param(Params._dummy(), "error", "give the squared error of the reconstruction, not the components", TypeConverters.toBoolean)

    def _begin(self, given: dict) -> None:
        self._setDefault(outputCol="components", k=0, share=0.95, whiten=False, error=False)
        self._set(**given)


class PrincipalComponentsModel(_ArrayModel, _PcaParams):
    record = nz.Pca

    def __init__(self):
        super().__init__()
        self._begin({})

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        if self.getOrDefault("error"):
            return self._scored(df, [out], lambda d, v: self.fitted.reconstruction_error(d, v, out))
        return self._scored(df, [out], lambda d, v: self.fitted.transform(d, v, out, self.getOrDefault("whiten")))


class PrincipalComponents(_Fits, _PcaParams):
    """Components of a vector column, or what they leave unexplained."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, k=None, share=None, whiten=None, error=None):
        super().__init__()
        self._begin(self._input_kwargs)

    def _fit(self, df: DataFrame) -> PrincipalComponentsModel:
        k = self.getOrDefault("k")
        fitted = nz.Pca.fit(nz.moments(self._clean(df), [self.getInputCol()]), k=k or None, share=None if k else self.getOrDefault("share"))
        return self._model(PrincipalComponentsModel(), fitted)


class _DistanceParams(HasInputCol, HasOutputCol):
    squared = Param(Params._dummy(), "squared", "give the square of the distance", TypeConverters.toBoolean)

    def _begin(self, given: dict) -> None:
        self._setDefault(outputCol="distance", squared=False)
        self._set(**given)


class CovarianceDistanceModel(_ArrayModel, _DistanceParams):
    record = nz.ShrunkDistance

    def __init__(self):
        super().__init__()
        self._begin({})

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        return self._scored(df, [out], lambda d, v: self.fitted.transform(d, v, out, self.getOrDefault("squared")))


class CovarianceDistance(_Fits, _DistanceParams):
    """Distance from the mean under a shrunk covariance."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, squared=None):
        super().__init__()
        self._begin(self._input_kwargs)

    def _fit(self, df: DataFrame) -> CovarianceDistanceModel:
        return self._model(CovarianceDistanceModel(), nz.ShrunkDistance.fit(self._clean(df), self.getInputCol()))


class _CoherenceParams(HasInputCol):
    split = Param(Params._dummy(), "split", "length of the first block of the vector", TypeConverters.toInt)
    k = Param(Params._dummy(), "k", "principal components of each block", TypeConverters.toInt)

    def _begin(self, given: dict) -> None:
        self._setDefault(k=5)
        self._set(**given)


class BlockCoherenceModel(_ArrayModel, _CoherenceParams):
    record = nz.Coherence

    def __init__(self):
        super().__init__()
        self._begin({})

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._scored(df, ["cu", "cw", "na", "nv"], self.fitted.transform)


class BlockCoherence(_Fits, _CoherenceParams):
    """First canonical pair of two blocks of a vector: variates ``cu, cw`` and the norms ``na, nv`` of the blocks."""

    @keyword_only
    def __init__(self, *, inputCol=None, split=None, k=None):
        super().__init__()
        self._begin(self._input_kwargs)

    def _fit(self, df: DataFrame) -> BlockCoherenceModel:
        m = nz.moments(self._clean(df), [self.getInputCol()])
        return self._model(BlockCoherenceModel(), nz.Coherence.fit(m, self.getOrDefault("split"), self.getOrDefault("k")))


class _GateParams(HasInputCol):
    keyCols = Param(Params._dummy(), "keyCols", "columns that name a series", TypeConverters.toListString)
    positionCol = Param(Params._dummy(), "positionCol", "whole number that orders a series", TypeConverters.toString)

    def _begin(self, given: dict) -> None:
        self._setDefault(keyCols=["entity"], positionCol="hr")
        self._set(**given)


class CalibratedGateModel(_StoredModel, _GateParams):
    """``fitted`` is a table of keys with ``scale, deadband, q95``."""

    fitted = None

    def __init__(self):
        super().__init__()
        self._begin({})

    def _state(self, spark) -> DataFrame:
        return self.fitted

    def _restore(self, state: DataFrame) -> None:
        self.fitted = state

    def _transform(self, df: DataFrame) -> DataFrame:
        keys, outs = self.getOrDefault("keyCols"), ["persistence", "closed", "trust"]
        d = df.drop(*outs, "_scale", "_deadband")
        d = d.join(self.fitted.select(*keys, F.col("scale").alias("_scale"), F.col("deadband").alias("_deadband")), keys, "left")
        d = det.gate(d, keys, self.getOrDefault("positionCol"), self.getInputCol(), scale=F.col("_scale"), deadband=F.col("_deadband"))
        return d.drop("_scale", "_deadband")


class CalibratedGate(_Fits, _GateParams):
    """Persistence gate with the scale and deadband of each key taken from a clean stream."""

    @keyword_only
    def __init__(self, *, inputCol=None, keyCols=None, positionCol=None):
        super().__init__()
        self._begin(self._input_kwargs)

    def _fit(self, df: DataFrame) -> CalibratedGateModel:
        score = self.getInputCol()
        clean = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        return self._model(CalibratedGateModel(), det.calibrate_gate(clean, self.getOrDefault("keyCols"), score))
