"""Descriptors of spectra and frames stored as arrays."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorgate.functions.exprs import as_col, decibel_power


def array_sum(a, f=lambda x: x) -> Column:
    return F.aggregate(as_col(a), F.lit(0.0), lambda acc, x: acc + f(x.cast("double")))


def l2_norm(a) -> Column:
    return F.sqrt(array_sum(a, lambda x: x * x))


def fraction_where(a, pred) -> Column:
    return F.size(F.filter(as_col(a), pred)) / F.size(as_col(a))


def clip_flag(a, level: float, share: float) -> Column:
    """Share of samples beyond ``level`` in size is above ``share``."""
    return fraction_where(a, lambda x: F.abs(x) > level) > share


def band_gain(freqs, notches, reduces, notch_width: float, reduce_width: float, reduce_gain: float) -> Column:
    """Per-bin multiplier: 0 near a notch tone, at most ``reduce_gain`` near a reduced tone, else 1."""

    def near(f, centres, width):
        return reduce(lambda a, b: a | b, [f.between(c - width, c + width) for c in centres], F.lit(False))

    def gain(f):
        soft = F.when(near(f, reduces, reduce_width), F.lit(min(1.0, reduce_gain))).otherwise(F.lit(1.0))
        return F.when(near(f, notches, notch_width), F.lit(0.0)).otherwise(soft)

    return F.transform(as_col(freqs), gain)


def spectral_centroid(power, freqs, gain=None) -> Column:
    """Amplitude-weighted mean frequency of a power spectrum, optionally after a gain mask."""
    p = as_col(power)
    if gain is not None:
        p = F.zip_with(p, as_col(gain), lambda x, g: x * g)
    amp = F.transform(p, lambda x: F.sqrt(x))
    weighted = F.zip_with(amp, as_col(freqs), lambda a, f: a * f)
    return array_sum(weighted) / (array_sum(amp) + F.lit(1e-10))


def band_fraction(power, freqs, lo: float, hi: float) -> Column:
    inside = F.zip_with(as_col(power), as_col(freqs), lambda p, f: F.when((f >= lo) & (f < hi), p).otherwise(F.lit(0.0)))
    return array_sum(inside) / (array_sum(power) + F.lit(1e-10))


def total_energy_db(power) -> Column:
    return decibel_power(array_sum(power))


def spectral_flux(current, previous) -> Column:
    """Root of the summed squared rises between two amplitude spectra; 0 when there is no previous one."""
    rise = F.zip_with(as_col(current), as_col(previous), lambda a, b: F.pow(F.greatest(a - b, F.lit(0.0)), F.lit(2.0)))
    return F.coalesce(F.sqrt(array_sum(rise)), F.lit(0.0))


def _best_cut(values: np.ndarray, bins: int) -> float:
    """Histogram cut with the largest between-class variance; first bin on equal variance."""
    v = values[np.isfinite(values)]
    if v.size == 0:
        return np.nan
    lo, hi = v.min(), v.max()
    width = (hi - lo) / bins if hi > lo else 1.0 / bins
    start = lo if hi > lo else lo - 0.5
    k = np.minimum(((v - start) / width).astype(np.int64), bins - 1)
    n = np.bincount(k, minlength=bins).astype(float)
    centre = start + (np.arange(bins) + 0.5) * width
    w, m = n.cumsum() / n.sum(), (n * centre).cumsum() / n.sum()
    spread = (m[-1] * w - m) ** 2 / np.where(w * (1 - w) == 0, 1e-12, w * (1 - w))
    return float(centre[int(spread.argmax())])


@F.pandas_udf(T.DoubleType())
def otsu_cut(frames: pd.Series) -> pd.Series:
    """Otsu threshold of each array (256 equal bins between its smallest and largest value)."""
    return frames.map(lambda a: _best_cut(np.asarray(a, float), 256)).astype(float)


MASKED_FIELDS = (
    "otsu double, mask_frac double, n_mask int, t_mean double, t_p10 double, t_p90 double, t_max double, "
    "t_std double, hot_frac double, rest_median double, mask_ok boolean"
)


def masked_features(hot: float = 34.0, least: int = 10):
    """Arrow UDF array -> struct of features of the part above its Otsu cut and of the rest."""

    def one(a):
        a = np.asarray(a, float)
        cut = _best_cut(a, 256)
        warm, rest = a[a > cut], a[~(a > cut)]
        frac = warm.size / a.size if a.size else np.nan
        row = [cut, frac, warm.size] + [None] * 6
        if warm.size >= least:
            p10, p90 = np.percentile(warm, [10, 90])
            row[3:] = [warm.mean(), p10, p90, warm.max(), warm.std(), float((warm > hot).mean())]
        return [*row, float(np.median(rest)) if rest.size else None, bool(0.02 < frac < 0.95)]

    names = [p.split()[0] for p in MASKED_FIELDS.split(", ")]

    @F.pandas_udf(MASKED_FIELDS)
    def features(frames: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(a) for a in frames], columns=names)

    return features


def grouped_otsu(df: DataFrame, keys, value, bins: int = 256) -> DataFrame:
    """Otsu threshold of a column per group of any size: bin counts combine map-side, windows see bins only."""
    keys = list(keys)
    d = df.select(*keys, as_col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    edge = d.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    edge = edge.withColumn("_start", F.when(F.col("_hi") > F.col("_lo"), F.col("_lo")).otherwise(F.col("_lo") - 0.5))
    edge = edge.withColumn(
        "_width", F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0)) / bins
    )
    d = d.join(edge, keys)
    k = F.least(F.floor((F.col("_x") - F.col("_start")) / F.col("_width")).cast("int"), F.lit(bins - 1))
    b = d.groupBy(*keys, "_start", "_width", k.alias("_k")).agg(F.count("*").alias("_n"))
    b = b.withColumn("_c", F.col("_start") + (F.col("_k") + 0.5) * F.col("_width"))
    whole, upto = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("_n").over(whole)
    b = b.withColumn("_w", F.sum("_n").over(upto) / total)
    b = b.withColumn("_m", F.sum(F.col("_n") * F.col("_c")).over(upto) / total)
    b = b.withColumn("_mt", F.sum(F.col("_n") * F.col("_c")).over(whole) / total)
    den = F.col("_w") * (1 - F.col("_w"))
    b = b.withColumn("_s", F.pow(F.col("_mt") * F.col("_w") - F.col("_m"), F.lit(2.0)) / F.when(den == 0, 1e-12).otherwise(den))
    return b.groupBy(*keys).agg(
        F.max_by("_c", F.struct(F.col("_s"), -F.col("_k"))).alias("threshold"), F.sum("_n").alias("n_values")
    )


def value_histogram(a, bins: int, top: float) -> Column:
    """Share of array values per equal bin of ``0..top``; values outside are clipped into the end bins."""
    arr = as_col(a)
    label = F.transform(
        arr, lambda x: F.least(F.floor(F.greatest(F.least(x, F.lit(top)), F.lit(0.0)) * bins / top).cast("int"), F.lit(bins - 1))
    )
    return F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda b: F.size(F.filter(label, lambda k: k == b)) / F.greatest(F.size(arr), F.lit(1)),
    )


def grid_cells(a, width: int, grid: int) -> Column:
    """Array of (mean, population std) per cell of a ``grid`` x ``grid`` split of a row-major matrix.

    Rows and columns past the last whole cell are left out. Stays inside the row: no shuffle.
    """
    arr = as_col(a)
    tall = F.floor(F.floor(F.size(arr) / width) / grid).cast("int")
    wide = F.lit(width // grid)

    def one(c):
        gi, gj = F.floor(c / grid), c % grid
        vals = F.filter(
            arr, lambda _, i: (F.floor(F.floor(i / width) / tall) == gi) & (F.floor((i % width) / wide) == gj)
        )
        n = F.size(vals)
        mean = array_sum(vals) / n
        return F.struct(mean.alias("mean"), F.sqrt(array_sum(vals, lambda x: (x - mean) * (x - mean)) / n).alias("std"))

    return F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), one)
