"""Robust scaling, detrending, correlation, covariance, PCA, distance and cross-modal models.

Moments of p features are one pass of matrix sums: a task gives one row of arrays for each feature, Spark merges them by
blocks of features, and p such rows reach the driver, where they are decomposed. Scoring maps over Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorgate.functions.exprs import as_col, clip, safe_div
from sensorgate.operators.quantiles import exact_quantiles
from sensorgate.session import cut_lineage

MAD_TO_STD = 1.4826


def medians(df: DataFrame, keys, cols: dict, bounded: bool) -> DataFrame:
    """Exact medians per group; ``bounded`` groups (one row per hour) fit one aggregation buffer."""
    if bounded:
        return df.groupBy(*keys).agg(*[F.percentile(as_col(c).cast("double"), F.lit(0.5)).alias(n) for n, c in cols.items()])
    d = exact_quantiles(df, keys, cols, [0.5], [""])
    return d.withColumnsRenamed({f"{n}_": n for n in cols})


def attach(df: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """Group statistics back on the rows; a single global row comes in as scalar subqueries."""
    if keys:
        return df.join(stats, list(keys), "left")
    row = stats.select(F.struct(*stats.columns)).scalar()  # one subquery for all of them
    return df.withColumn("_st", row).select(*df.columns, "_st.*")


def robust_stats(df: DataFrame, keys, cols, bounded: bool = True) -> DataFrame:
    """Median ``med_<c>`` and unscaled median absolute deviation ``mad_<c>`` per group."""
    keys, cols = list(keys), list(cols)
    med = medians(df, keys, {f"med_{c}": F.col(c) for c in cols}, bounded)
    if not bounded:
        med = cut_lineage(med)  # one small row per group, read twice: do not pass over the raw rows again
    dev = attach(df.select(*keys, *cols), med, keys)
    mad = medians(dev, keys, {f"mad_{c}": F.abs(F.col(c) - F.col(f"med_{c}")) for c in cols}, bounded)
    return attach(med, mad, keys)


def with_robust_stats(df: DataFrame, keys, cols, bounded: bool = True) -> DataFrame:
    """Rows with ``med_<c>`` and ``mad_<c>`` of their group.

    Bounded groups need one shuffle and two window passes, and no join of the table with itself.
    """
    keys, cols = list(keys), list(cols)
    if not (bounded and keys):
        return attach(df, robust_stats(df, keys, cols, bounded), keys)
    w = W.partitionBy(*keys)
    d = df.withColumns({f"med_{c}": F.percentile(c, F.lit(0.5)).over(w) for c in cols})
    return d.withColumns({f"mad_{c}": F.percentile(F.abs(F.col(c) - F.col(f"med_{c}")), F.lit(0.5)).over(w) for c in cols})


def robust_scale(mad, floor: float = 1e-6):
    """Robust standard deviation from a MAD, never below ``floor``; 1 when there was no value."""
    return F.coalesce(F.greatest(as_col(mad) * MAD_TO_STD, F.lit(floor)), F.lit(1.0))


def robust_z(df: DataFrame, keys, cols, guard: str = "max", bounded: bool = True) -> DataFrame:
    """Columns ``z_<c>``; the scale is kept away from zero by a maximum or by adding 1e-9."""
    d = with_robust_stats(df, keys, cols, bounded)
    for c in cols:
        s = F.col(f"mad_{c}") * MAD_TO_STD
        s = F.greatest(s, F.lit(1e-9)) if guard == "max" else s + F.lit(1e-9)
        d = d.withColumn(f"z_{c}", (F.col(c) - F.col(f"med_{c}")) / s)
    return d.drop(*[f"{p}_{c}" for c in cols for p in ("med", "mad")])


def robust_standardize_long(df: DataFrame, keys, value: str, out: str, limit: float | None = None, bounded: bool = False):
    """Feature-wise robust standardising of a long table; a feature with no spread keeps scale 1."""
    d = with_robust_stats(df, keys, [value], bounded)
    mad = F.col(f"mad_{value}")
    z = (F.col(value) - F.col(f"med_{value}")) / F.when(mad < 1e-9, F.lit(1.0)).otherwise(mad * MAD_TO_STD)
    return d.withColumn(out, z if limit is None else clip(z, -limit, limit)).drop(f"med_{value}", f"mad_{value}")


def mean_z(df: DataFrame, keys, cols) -> DataFrame:
    """z by mean and sample std, and their mean as a fused index."""
    keys = list(keys)
    st = df.groupBy(*keys).agg(
        *[f(F.col(c)).alias(f"{p}_{c}") for c in cols for p, f in (("mu", F.avg), ("sd", F.stddev_samp))]
    )
    d = attach(df, st, keys)
    d = d.withColumns({f"z_{c}": (F.col(c) - F.col(f"mu_{c}")) / (F.col(f"sd_{c}") + F.lit(1e-9)) for c in cols})
    total = sum((F.col(f"z_{c}") for c in cols), F.lit(0.0))
    return d.withColumn("fused_index", total / len(list(cols))).drop(*[f"{p}_{c}" for c in cols for p in ("mu", "sd")])


def detrend_linear(df: DataFrame, keys, x: str, cols) -> DataFrame:
    """Columns ``dt_<c>``: residual of a least-squares line in ``x``."""
    keys = list(keys)
    fit = df.groupBy(*keys).agg(
        *[f(F.col(c), F.col(x)).alias(f"{p}_{c}") for c in cols for p, f in (("sl", F.regr_slope), ("ic", F.regr_intercept))]
    )
    d = attach(df, fit, keys)
    d = d.withColumns({f"dt_{c}": F.col(c) - (F.col(f"ic_{c}") + F.col(f"sl_{c}") * F.col(x)) for c in cols})
    return d.drop(*[f"{p}_{c}" for c in cols for p in ("sl", "ic")])


def paired_corr(df: DataFrame, keys, a: str, b: str, least: int = 3) -> DataFrame:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    n = F.count_if(both)
    return df.groupBy(*keys).agg(
        F.when(n >= least, F.corr(F.when(both, F.col(a)), F.when(both, F.col(b)))).alias("r"), n.alias("n")
    )


def _matrix(pdf: pd.DataFrame, cols) -> np.ndarray:
    if len(cols) == 1 and pdf[cols[0]].map(np.ndim).max() == 1:
        return np.stack(pdf[cols[0]].to_numpy()).astype(float)
    return pdf[list(cols)].to_numpy(float)


def typical(df: DataFrame, cols, rows: int = 32) -> np.ndarray:
    """Medians of a few rows: a number inside the range of each feature, 0 where none of the rows has one."""
    sample = df.select(*cols).limit(rows).toPandas()
    if not len(sample):
        return np.zeros(1)
    x = _matrix(sample, list(cols))
    x = np.where(np.isfinite(x), x, np.nan)
    some = ~np.isnan(x).all(axis=0)
    out = np.zeros(x.shape[1])
    out[some] = np.nanmedian(x[:, some], axis=0)
    return out


GRAM = "i int, n array<double>, sx array<double>, sxx array<double>, sxy array<double>"
FAN_IN = 256  # states that one step of a merge takes
BLOCK = 1 << 13  # numbers of each kind in a block of features, so that a merge holds FAN_IN of them


def gram_state(df: DataFrame, cols, shift, complete: bool = False) -> DataFrame:
    """Mergeable second moments, one row of arrays for each feature: ``i, n, sx, sxx, sxy``.

    Pairwise: position j of the arrays holds the rows in which features i and j are known, and sums over them of feature
    i, its square and the product. With ``complete`` only rows without a missing feature count, and as all pairs then
    share n, a row holds ``n`` and ``sx`` once, no ``sxx``, and products from feature i on (the upper triangle). Sums are
    of differences from ``shift``. Each task gives one state; states are merged by blocks of features in two steps of
    bounded size, so neither a merge nor the driver ever sees a row for each pair.
    """
    cols, shift = list(cols), np.asarray(shift, float)
    size = max(1, BLOCK // len(shift))

    def partial(batches):
        total = None
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf, cols) - shift
            if complete:
                x = x[np.isfinite(x).all(axis=1)]
                part = [np.full(len(shift), float(len(x))), x.sum(axis=0), x.T @ x]
            else:
                known = np.isfinite(x).astype(float)
                x = np.where(known > 0, x, 0.0)
                part = [known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x]
            total = part if total is None else [t + q for t, q in zip(total, part, strict=True)]
        if total is None:
            return
        task, features = TaskContext.get().partitionId(), np.arange(len(shift))
        rows = {"task": task, "i": features}
        if complete:
            n, sx, xy = total
            rows |= {"n": list(n[:, None]), "sx": list(sx[:, None]), "sxx": [[]] * len(features), "sxy": [xy[i, i:] for i in features]}
        else:
            rows |= {name: list(m) for name, m in zip(("n", "sx", "sxx", "sxy"), total, strict=True)}
        yield pd.DataFrame(rows)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(i, *(np.sum(np.stack(list(g[c])), axis=0) for c in ("n", "sx", "sxx", "sxy"))) for i, g in pdf.groupby("i")]
        return pd.DataFrame(out, columns=["i", "n", "sx", "sxx", "sxy"]).assign(task=pdf["task"].iloc[0])[["task", "i", "n", "sx", "sxx", "sxy"]]

    rows = df.select(*cols).where(F.col(cols[0]).isNotNull()) if len(cols) == 1 else df.select(*cols)
    states = rows.mapInPandas(partial, f"task int, {GRAM}")
    block = F.floor(F.col("i") / size).alias("block")
    near = states.groupBy(block, F.floor(F.col("task") / FAN_IN).alias("step")).applyInPandas(merge, f"task int, {GRAM}")
    return near.groupBy(block).applyInPandas(merge, f"task int, {GRAM}").drop("task")


def pair_sums(df: DataFrame, cols, shift=None) -> DataFrame:
    """Pairwise-complete sums of all feature pairs: rows (i, j, n, sx, sxx, sxy) with x feature i where j is known.

    ``cols`` are numeric columns or one array column. Sums are of differences from ``shift`` (one number per feature;
    medians of a few rows if not given), so that large offsets do not cost precision.
    """
    state = gram_state(df, cols, typical(df, list(cols)) if shift is None else shift)
    pairs = state.select("i", F.posexplode(F.arrays_zip("n", "sx", "sxx", "sxy")).alias("j", "s"))
    return pairs.select("i", "j", "s.n", "s.sx", "s.sxx", "s.sxy")


def corr_long(sums: DataFrame) -> DataFrame:
    """Rows (i, j, r, n) from pair sums; r is NULL when a feature does not vary."""
    other = sums.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    d = sums.join(other, ["i", "j"])
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    r = F.when((vx > 0) & (vy > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))
    return d.select("i", "j", r.alias("r"), n.cast("long").alias("n"))


@dataclass
class Moments:
    n: float
    mean: np.ndarray
    cov: np.ndarray  # population covariance


def moments(df: DataFrame, cols) -> Moments:
    """Mean and covariance of complete rows; one row of arrays for each feature is collected."""
    shift = typical(df, cols)
    rows = gram_state(df, cols, shift, complete=True).collect()
    n = rows[0]["n"][0] if rows else 0
    if not n:
        raise ValueError("no complete row")
    p = len(shift)
    s, xy = np.zeros(p), np.zeros((p, p))
    for r in rows:
        i = r["i"]
        s[i] = r["sx"][0]
        xy[i, i:] = xy[i:, i] = r["sxy"]
    return Moments(n, shift + s / n, xy / n - np.outer(s / n, s / n))


def correlations(df: DataFrame, cols) -> tuple[np.ndarray, np.ndarray]:
    """Variances (n - 1) and pairwise-complete correlations of all features; NaN where a feature does not vary.

    One row of arrays for each feature reaches the driver.
    """
    rows = sorted(gram_state(df, cols, typical(df, list(cols))).collect(), key=lambda r: r["i"])
    if not rows:
        return np.zeros(0), np.zeros((0, 0))
    n, sx, sxx, sxy = (np.array([r[c] for r in rows]).reshape(len(rows), -1) for c in ("n", "sx", "sxx", "sxy"))
    spread = np.maximum(n * sxx - sx**2, 0.0)  # of feature i where j is known
    with np.errstate(invalid="ignore", divide="ignore"):
        variance = np.diag(spread) / (np.diag(n) * (np.diag(n) - 1))
        r = np.where((spread > 0) & (spread.T > 0), (n * sxy - sx * sx.T) / np.sqrt(spread * spread.T), np.nan)
    return variance, r


def _fixed_sign(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest loading made positive, so that results do not depend on the solver."""
    k = np.abs(vectors).argmax(axis=0)
    return vectors * np.sign(vectors[k, np.arange(vectors.shape[1])])


@dataclass
class Pca:
    mean: np.ndarray
    components: np.ndarray  # p x k
    variance: np.ndarray  # sample variance of each component

    @staticmethod
    def fit(m: Moments, k: int | None = None, share: float | None = None) -> "Pca":
        val, vec = np.linalg.eigh(m.cov)
        val, vec = np.maximum(val[::-1], 0.0), vec[:, ::-1]
        if share is not None:
            k = int(np.searchsorted(np.cumsum(val) / val.sum(), share, side="right")) + 1
        vec = _fixed_sign(vec[:, :k])
        return Pca(m.mean, vec, val[:k] * m.n / (m.n - 1))

    def transform(self, df: DataFrame, vector: str, out: str, whiten: bool = False) -> DataFrame:
        mean, comp = self.mean, self.components / np.sqrt(self.variance) if whiten else self.components

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            return pd.Series(list((np.stack(v.to_numpy()) - mean) @ comp))

        return df.withColumn(out, project(vector))

    def reconstruction_error(self, df: DataFrame, vector: str, out: str) -> DataFrame:
        mean, comp = self.mean, self.components

        @F.pandas_udf("double")
        def error(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()) - mean
            return pd.Series(((x - (x @ comp) @ comp.T) ** 2).sum(axis=1))

        return df.withColumn(out, error(vector))


@dataclass
class ShrunkDistance:
    """Mahalanobis distance under a covariance shrunk towards a scaled identity (Ledoit and Wolf 2004)."""

    mean: np.ndarray
    precision: np.ndarray
    shrinkage: float
    target: float  # variance of the identity that the covariance is drawn to

    @staticmethod
    def fit(df: DataFrame, vector: str) -> "ShrunkDistance":
        m = moments(df, [vector])
        p, centre = len(m.mean), m.mean

        @F.pandas_udf("double")
        def fourth(v: pd.Series) -> pd.Series:
            return pd.Series((((np.stack(v.to_numpy()) - centre) ** 2).sum(axis=1)) ** 2)

        spread4 = df.select(fourth(vector).alias("q")).agg(F.sum("q")).first()[0]
        mu, dot = np.trace(m.cov) / p, (m.cov**2).sum()
        distance = (dot - p * mu**2) / p
        noise = (spread4 / m.n - dot) / (p * m.n)
        s = 0.0 if distance == 0 else min(noise, distance) / distance
        return ShrunkDistance(centre, np.linalg.inv((1 - s) * m.cov + s * mu * np.eye(p)), s, float(mu))

    def transform(self, df: DataFrame, vector: str, out: str, squared: bool = False) -> DataFrame:
        mean, prec = self.mean, self.precision

        @F.pandas_udf("double")
        def distance(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()) - mean
            d2 = np.maximum(np.einsum("ij,jk,ik->i", x, prec, x), 0.0)
            return pd.Series(d2 if squared else np.sqrt(d2))

        return df.withColumn(out, distance(vector))


def white_blocks(m: Moments, split: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scales of all features, and maps of each standardised block to its first k principal components with unit variance."""
    std = np.sqrt(np.diag(m.cov)) + 1e-9
    c = m.cov / np.outer(std, std)

    def white(block):
        val, vec = np.linalg.eigh(block)
        val, vec = val[::-1][:k], vec[:, ::-1][:, :k]
        return vec / np.sqrt(np.maximum(val, 1e-12))

    return std, white(c[:split, :split]), white(c[split:, split:])


def block_scores(df: DataFrame, vector: str, m: Moments, split: int, k: int, u: str = "u", w: str = "w") -> DataFrame:
    """Arrays ``u`` and ``w``: unit-variance principal components of the two blocks of a vector."""
    mean, (std, ra, rv) = m.mean, white_blocks(m, split, k)

    @F.pandas_udf(f"{u} array<double>, {w} array<double>")
    def project(v: pd.Series) -> pd.DataFrame:
        x = (np.stack(v.to_numpy()).astype(float) - mean) / std
        return pd.DataFrame({u: list(x[:, :split] @ ra), w: list(x[:, split:] @ rv)})

    return df.withColumn("_p", project(vector)).select(*df.columns, "_p.*")


def canonical_r(df: DataFrame, keys, u: str, w: str, sizes: tuple[int, int]) -> DataFrame:
    """First canonical correlation ``r`` of two arrays per group: sums of products in one pass, then small matrices in the tasks."""
    keys, (a, b) = list(keys), sizes
    x = [F.col(u)[i] for i in range(a)] + [F.col(w)[i] for i in range(b)]
    first = [F.sum(c) for c in x]
    second = [F.sum(x[i] * x[j]) for i in range(a + b) for j in range(i, a + b)]
    sums = df.groupBy(*keys).agg(F.count("*").cast("double").alias("_n"), F.array(*first).alias("_s"), F.array(*second).alias("_q"))

    @F.pandas_udf("double")
    def largest(n: pd.Series, s: pd.Series, q: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype=float)
        n, s = n.to_numpy()[:, None], np.stack(s.to_numpy())
        i, j = np.triu_indices(a + b)
        c = np.empty((len(n), a + b, a + b))
        c[:, i, j] = c[:, j, i] = np.stack(q.to_numpy()) / n
        c -= (s / n)[:, :, None] * (s / n)[:, None, :]

        def white(block):
            val, vec = np.linalg.eigh(block)
            # A direction that does not vary in this group correlates with nothing.
            return vec * np.where(val > 1e-12, 1 / np.sqrt(np.maximum(val, 1e-12)), 0.0)[:, None, :]

        cross = white(c[:, :a, :a]).transpose(0, 2, 1) @ c[:, :a, a:] @ white(c[:, a:, a:])
        return pd.Series(np.linalg.svd(cross, compute_uv=False)[:, 0])

    return sums.select(*keys, largest("_n", "_s", "_q").alias("r"))


@dataclass
class Coherence:
    """First canonical pair between two blocks of a vector, after standardising and k principal components each."""

    mean: np.ndarray
    std: np.ndarray
    wa: np.ndarray
    wv: np.ndarray
    split: int
    r: float

    @staticmethod
    def fit(m: Moments, split: int, k: int = 5) -> "Coherence":
        std, ra, rv = white_blocks(m, split, k)
        c = m.cov / np.outer(std, std)
        left, sv, right = np.linalg.svd(ra.T @ c[:split, split:] @ rv)
        wa, wv = ra @ left[:, 0], rv @ right[0]
        sign = np.sign(wa[np.abs(wa).argmax()])
        return Coherence(m.mean, std, wa * sign, wv * sign, split, float(sv[0]))

    def transform(self, df: DataFrame, vector: str) -> DataFrame:
        """Adds canonical variates ``cu`` and ``cw`` and block norms ``na`` and ``nv``."""
        mean, std, wa, wv, split = self.mean, self.std, self.wa, self.wv, self.split

        @F.pandas_udf("cu double, cw double, na double, nv double")
        def project(v: pd.Series) -> pd.DataFrame:
            raw = np.stack(v.to_numpy()).astype(float)
            x = (raw - mean) / std
            a, b = raw[:, :split], raw[:, split:]
            return pd.DataFrame(
                {"cu": x[:, :split] @ wa, "cw": x[:, split:] @ wv, "na": np.linalg.norm(a, axis=1), "nv": np.linalg.norm(b, axis=1)}
            )

        return df.withColumn("_p", project(vector)).select(*df.columns, "_p.*")


def discordance(df: DataFrame, keys, u: str, w: str, bounded: bool = False) -> DataFrame:
    """Distance of w from its clean line on u in robust units: columns ``slope``, ``disc`` and ``disc_z``.

    Both variates are robust z-scores already.
    """
    keys = list(keys)
    if bounded and keys:
        d = df.withColumn("slope", F.regr_slope(w, u).over(W.partitionBy(*keys)))
    else:
        d = attach(df, df.groupBy(*keys).agg(F.regr_slope(w, u).alias("slope")), keys)
    d = d.withColumn("disc", F.col(w) - F.col("slope") * F.col(u))
    return robust_z(d, keys, ["disc"], guard="add", bounded=bounded).withColumnRenamed("z_disc", "disc_z")


def core_distance(df: DataFrame, keys, x: str, y: str, out: str, inner: float = 0.9, bounded: bool = True) -> DataFrame:
    """2-D Mahalanobis distance from zero, covariance taken from rows with radius below its ``inner`` quantile."""
    keys = list(keys)
    d = df.withColumn("_rad", F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)))
    if bounded and keys:
        whole = W.partitionBy(*keys)
        d = d.withColumn("_cut", F.percentile("_rad", F.lit(inner)).over(whole))
        a, b = (F.when(F.col("_rad") < F.col("_cut"), F.col(c)) for c in (x, y))
        d = d.withColumns({n: F.covar_samp(p, q).over(whole) for n, p, q in (("_sxx", a, a), ("_sxy", a, b), ("_syy", b, b))})
    else:
        cut = exact_quantiles(d, keys, {"": F.col("_rad")}, [inner], ["_cut"])
        d = attach(d, cut, keys)
        core = d.filter(F.col("_rad") < F.col("_cut"))
        pairs = (("_sxx", x, x), ("_sxy", x, y), ("_syy", y, y))
        d = attach(d, core.groupBy(*keys).agg(*[F.covar_samp(p, q).alias(n) for n, p, q in pairs]), keys)
    det = F.col("_sxx") * F.col("_syy") - F.col("_sxy") * F.col("_sxy")
    q = (
        F.col("_syy") * F.col(x) * F.col(x) - F.col("_sxy") * F.col(x) * F.col(y) * 2.0 + F.col("_sxx") * F.col(y) * F.col(y)
    )
    return d.withColumn(out, F.sqrt(safe_div(q, det))).drop("_rad", "_cut", "_sxx", "_sxy", "_syy")


def prune_features(variance: np.ndarray, corr: np.ndarray, limit: float) -> list[int]:
    """Keep features from the largest variance down unless tied to a kept one; a missing correlation drops too.

    Runs on the driver over the p x p summary, p being the number of features. Equal variances go by position.
    """
    free = np.nan_to_num(variance) > 0
    kept = []
    for i in np.argsort(-np.where(free, variance, 0.0), kind="stable"):
        if free[i]:
            kept.append(int(i))
            free &= np.abs(corr[i]) <= limit
    return kept


def prune_correlated(variances: dict, corr: dict, limit: float) -> list[str]:
    """``prune_features`` for named features and pairs of names; equal variances go by name."""
    names = sorted(variances)
    var = np.array([variances[n] or 0.0 for n in names], float)
    pairs = [[corr.get((a, b), corr.get((b, a))) for b in names] for a in names]
    return [names[i] for i in prune_features(var, np.array(pairs, float), limit)]


def best_partner(corr: DataFrame, modality) -> DataFrame:
    """Strongest partner of another modality for each feature of a long correlation table (f, g, r).

    ``modality`` maps a column to its label.
    """
    d = corr.filter(modality(F.col("f")) != modality(F.col("g"))).filter(F.col("r").isNotNull())
    best = d.groupBy("f").agg(F.max(F.struct(F.abs(F.col("r")).alias("a"), (-F.col("g")).alias("neg"))).alias("_b"))
    return best.select("f", (-F.col("_b.neg")).alias("partner"), F.col("_b.a").alias("abs_r"))


def split_by_time(df: DataFrame, keys, time: str, shares) -> DataFrame:
    """Column ``part``: 0, 1, ... for consecutive shares of each key's rows in time order (whole-number cuts)."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(time)) - 1
    n = F.count("*").over(W.partitionBy(*keys))
    d = df.withColumns({"_rn": rn, "_n": n})
    part, acc = F.lit(0), 0.0
    for s in shares[:-1]:
        acc = round(acc + s, 10)
        part = part + F.when(F.col("_rn") >= F.floor(F.col("_n") * acc), 1).otherwise(0)
    return d.withColumn("part", part).drop("_rn", "_n")
