"""Normalisation, distance, PCA, coherence and feature selection."""

import numpy as np
from pyspark.sql import functions as F

from sensorgate.functions.exprs import rnd
from sensorgate.operators import aggregate as ag
from sensorgate.operators import estimators as est
from sensorgate.operators import normalize as nz
from sensorgate.plans.common import EV, FLOW, MERGED, ORACLES, R, Tables, query
from sensorgate.plans.rollups import rounded
from sensorgate.session import cut_lineage, scratch_path
from sensorgate.plans.series import DAILY_SQL, daily_readings

E = ["entity"]


@query(
    "n01_robust_scale",
    f"""WITH {EV}, m AS (SELECT event_type, median(value) AS med FROM ev GROUP BY 1)
    SELECT event_type, {R('any_value(med)')} AS med, {R('greatest(1.4826 * median(abs(value - med)), 1e-6)')} AS scale FROM ev JOIN m USING (event_type) GROUP BY 1""",
)
def robust_scale(t):
    """Raw readings, so the groups are of any size."""
    st = nz.robust_stats(t.events, ["event_type"], ["value"], bounded=False)
    return st.select("event_type", rnd("med_value").alias("med"), rnd(nz.robust_scale("mad_value")).alias("scale"))


Z_SQL = """m AS (SELECT entity, median(v) AS med FROM flow GROUP BY 1), s AS (SELECT entity, any_value(med) AS med, median(abs(v - med)) * 1.4826 AS mad FROM flow JOIN m USING (entity) GROUP BY 1)"""


@query("n02_robust_z", f"WITH {FLOW}, {Z_SQL} SELECT entity, hr, {R('(v - med) / greatest(mad, 1e-9)')} AS z_max, {R('(v - med) / (mad + 1e-9)')} AS z_add FROM flow JOIN s USING (entity)")
def robust_z(t):
    a = nz.robust_z(t.flow, E, ["v"], "max").withColumnRenamed("z_v", "z_max")
    d = nz.robust_z(a, E, ["v"], "add")
    return d.select("entity", "hr", rnd("z_max").alias("z_max"), rnd("z_v").alias("z_add"))


VEC_SQL = "x AS (SELECT vec_id, label, CAST(unnest(range(0, 64)) AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query(
    "n03_robust_standardize",
    f"""WITH {VEC_SQL}, m AS (SELECT dim, median(x) AS med FROM x GROUP BY 1), s AS (SELECT dim, any_value(med) AS med, median(abs(x - med)) AS mad FROM x JOIN m USING (dim) GROUP BY 1)
    SELECT vec_id, dim, {R('least(greatest((x - med) / CASE WHEN mad < 1e-9 THEN 1 ELSE 1.4826 * mad END, -5), 5)', 5)} AS z FROM x JOIN s USING (dim)""",
)
def robust_standardize(t):
    d = ag.vector_long(t.embeddings, ["vec_id"], "embedding")
    d = nz.robust_standardize_long(d, ["dim"], "x", "z", limit=5.0)
    return d.select("vec_id", "dim", rnd("z", 5).alias("z"))


@query(
    "n04_mean_z_fused_index",
    f"""WITH {MERGED}, b AS (SELECT * FROM merged WHERE aud_level IS NOT NULL AND vid_flow IS NOT NULL),
    z AS (SELECT entity, hr, (aud_level - avg(aud_level) OVER w) / (stddev_samp(aud_level) OVER w + 1e-9) AS za, (vid_flow - avg(vid_flow) OVER w) / (stddev_samp(vid_flow) OVER w + 1e-9) AS zv
      FROM b WINDOW w AS (PARTITION BY entity)) SELECT entity, hr, {R('za')} AS z_aud_level, {R('zv')} AS z_vid_flow, {R('(za + zv) / 2')} AS fused_index FROM z""",
)
def mean_z(t):
    d = nz.mean_z(t.merged.dropna(subset=["aud_level", "vid_flow"]), E, ["aud_level", "vid_flow"])
    return rounded(d.select("entity", "hr", "z_aud_level", "z_vid_flow", "fused_index"))


@query(
    "n05_linear_detrend",
    f"""WITH {DAILY_SQL}, y AS (SELECT room, day, CAST(day - min(day) OVER (PARTITION BY room) AS INTEGER) AS di, temp_am_max_c AS a, rh_pm_pct AS b FROM dl),
    f AS (SELECT room, regr_slope(a, di) AS sa, regr_intercept(a, di) AS ia, regr_slope(b, di) AS sb, regr_intercept(b, di) AS ib FROM y GROUP BY room)
    SELECT room, day, {R('a - (ia + sa * di)')} AS dt_temp, {R('b - (ib + sb * di)')} AS dt_rh FROM y JOIN f USING (room)""",
)
def detrend(t):
    d = daily_readings(t)
    d = nz.attach(d, d.groupBy("room").agg(F.min("day").alias("d0")), ["room"])
    d = d.withColumn("di", F.datediff("day", "d0"))
    d = nz.detrend_linear(d, ["room"], "di", ["temp_am_max_c", "rh_pm_pct"])
    return d.select("room", "day", rnd("dt_temp_am_max_c").alias("dt_temp"), rnd("dt_rh_pm_pct").alias("dt_rh"))


@query("n06_pca_whitened")
def pca(t):
    m = nz.moments(t.embeddings, ["embedding"])
    d = nz.Pca.fit(m, k=3).transform(t.embeddings.select("vec_id", "embedding"), "embedding", "pc", whiten=True)
    return d.select("vec_id", *[rnd(F.col("pc")[i]).alias(f"pc{i}") for i in range(3)])


@query("n06_whitened_covariance", f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {R('CAST(i = j AS INTEGER)::DOUBLE', 5)} AS cov FROM range(3) a(i), range(3) b(j)")
def whitened_covariance(t):
    """Whitened components have the identity as their covariance, which SQL knows without an eigenvector."""
    m = nz.moments(t.embeddings, ["embedding"])
    d = nz.Pca.fit(m, k=3).transform(t.embeddings.select("embedding"), "embedding", "pc", whiten=True)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("pc")[i].alias("x"), F.col("pc")[j].alias("y")) for i in range(3) for j in range(3)]))
    return d.select(pairs.alias("p")).groupBy("p.i", "p.j").agg(rnd(F.covar_samp("p.x", "p.y"), 5).alias("cov"))


@query("n07_pca_reconstruction_error")
def reconstruction(t):
    m = nz.moments(t.embeddings, ["embedding"])
    d = nz.Pca.fit(m, share=0.95).reconstruction_error(t.embeddings.select("vec_id", "embedding"), "embedding", "err")
    return d.select("vec_id", rnd("err").alias("err"))


TWO_SQL = """x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
    m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS sa, var_pop(b) AS sb, covar_pop(a, b) AS sc FROM x)"""


def two(t: Tables):
    return t.embeddings.select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("v"))


@query(
    "n07_reconstruction_error_2d",
    f"""WITH {TWO_SQL}, l AS (SELECT *, (sa + sb) / 2 - sqrt(pow((sa - sb) / 2, 2) + sc * sc) AS low FROM m),
    d AS (SELECT vec_id, a - ma AS a, b - mb AS b, sc AS u, low - sa AS v FROM x, l)
    SELECT vec_id, {R('pow(a * u + b * v, 2) / (u * u + v * v)')} AS err FROM d""",
)
def reconstruction_2d(t):
    """What the first of two components leaves is the part along the other one, which SQL has in closed form."""
    d = two(t)
    return nz.Pca.fit(nz.moments(d, ["v"]), k=1).reconstruction_error(d, "v", "err").select("vec_id", rnd("err").alias("err"))


@query(
    "n07_reconstruction_error_sum",
    f"""WITH {VEC_SQL}, m AS (SELECT a.dim AS i, b.dim AS j, covar_pop(a.x, b.x) AS c FROM x a JOIN x b USING (vec_id) GROUP BY ALL)
    SELECT (SELECT count(*) FROM embeddings) AS n, {R('sum(c) FILTER (i = j)', 5)} AS spread, {R('sum(c * c)', 5)} AS square, {R('0.0', 5)} AS gap FROM m""",
)
def reconstruction_sum(t):
    """The spectrum of all dimensions: variances add up to the trace, their squares to the squared entries of the covariance,
    and the mean error of the 95 % model is the variance that its components leave (``gap`` is the difference)."""
    m = nz.moments(t.embeddings, ["embedding"])
    model, whole = nz.Pca.fit(m, share=0.95), nz.Pca.fit(m, k=len(m.mean))
    scale = (m.n - 1) / m.n
    val = whole.variance * scale
    d = model.reconstruction_error(t.embeddings.select("embedding"), "embedding", "err")
    left = float(val[len(model.variance) :].sum())
    return d.agg(
        F.count("*").alias("n"), rnd(F.lit(float(val.sum())), 5).alias("spread"), rnd(F.lit(float((val**2).sum())), 5).alias("square"), rnd(F.avg("err") - left, 5).alias("gap")
    )


@query("n08_shrunk_mahalanobis")
def shrunk(t):
    d = t.embeddings.select("vec_id", "embedding")
    return nz.ShrunkDistance.fit(d, "embedding").transform(d, "embedding", "distance").select("vec_id", rnd("distance").alias("distance"))


@query(
    "n08_shrinkage",
    f"""WITH {VEC_SQL}, c AS (SELECT a.dim AS i, b.dim AS j, covar_pop(a.x, b.x) AS c FROM x a JOIN x b USING (vec_id) GROUP BY ALL),
    e AS (SELECT dim, avg(x) AS mean FROM x GROUP BY dim), q AS (SELECT vec_id, sum(pow(x - mean, 2)) AS d FROM x JOIN e USING (dim) GROUP BY vec_id),
    f AS (SELECT count(*) AS n, sum(d * d) AS fourth FROM q), s AS (SELECT sum(c * c) AS dot, sum(c) FILTER (i = j) / 64 AS mu FROM c),
    r AS (SELECT n, mu, (dot - 64 * mu * mu) / 64 AS dist, (fourth / n - dot) / (64 * n) AS noise FROM f, s)
    SELECT n, {R('mu')} AS target, {R('CASE WHEN dist = 0 THEN 0 ELSE least(noise, dist) / dist END')} AS shrinkage FROM r""",
)
def shrinkage(t):
    """Target and strength of the shrinkage over all 64 dimensions."""
    d = t.embeddings.select("embedding")
    model = nz.ShrunkDistance.fit(d, "embedding")
    return d.agg(F.count("*").alias("n"), rnd(F.lit(model.target)).alias("target"), rnd(F.lit(float(model.shrinkage))).alias("shrinkage"))


@query(
    "n08_shrunk_mahalanobis_2d",
    f"""WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
    m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS sa, var_pop(b) AS sb, covar_pop(a, b) AS sc FROM x),
    q AS (SELECT sum(pow(pow(a - ma, 2) + pow(b - mb, 2), 2)) AS q FROM x, m),
    p AS (SELECT *, (sa + sb) / 2 AS mu, sa * sa + sb * sb + 2 * sc * sc AS dot FROM m, q),
    r AS (SELECT *, (dot - 2 * mu * mu) / 2 AS dist, (q / n - dot) / (2 * n) AS noise FROM p),
    s AS (SELECT *, least(noise, dist) / dist AS k FROM r),
    c AS (SELECT *, (1 - k) * sa + k * mu AS ca, (1 - k) * sb + k * mu AS cb, (1 - k) * sc AS cc FROM s)
    SELECT vec_id, {R('sqrt((cb * (a - ma) * (a - ma) - 2 * cc * (a - ma) * (b - mb) + ca * (b - mb) * (b - mb)) / (ca * cb - cc * cc))')} AS distance FROM x, c""",
)
def shrunk_2d(t):
    d = two(t)
    return nz.ShrunkDistance.fit(d, "v").transform(d, "v", "distance").select("vec_id", rnd("distance").alias("distance"))


def reloaded(t: Tables, model):
    """The model as another job would have it: stored in the shared folder and read back."""
    path = scratch_path(t.spark, "model")
    model.save(path)
    return type(model).load(path)


@query("n08_stored_model", ORACLES["n08_shrunk_mahalanobis_2d"])
def stored_distance(t):
    d = two(t)
    model = reloaded(t, est.CovarianceDistance(inputCol="v").fit(d))
    return model.transform(d).select("vec_id", rnd("distance").alias("distance"))


@query("n07_stored_model", ORACLES["n07_reconstruction_error_2d"])
def stored_reconstruction(t):
    d = two(t)
    model = reloaded(t, est.PrincipalComponents(inputCol="v", outputCol="err", k=1, error=True).fit(d))
    return model.transform(d).select("vec_id", rnd("err").alias("err"))


BOTH = """b AS (SELECT entity, hr, aud_level, vid_flow FROM merged WHERE aud_level IS NOT NULL AND vid_flow IS NOT NULL AND hr % 24 >= 6 AND hr % 24 < 18),
bm AS (SELECT entity, median(aud_level) AS ma, median(vid_flow) AS mv FROM b GROUP BY 1),
bs AS (SELECT entity, any_value(ma) AS ma, any_value(mv) AS mv, greatest(median(abs(aud_level - ma)) * 1.4826, 1e-9) AS sa, greatest(median(abs(vid_flow - mv)) * 1.4826, 1e-9) AS sv FROM b JOIN bm USING (entity) GROUP BY 1),
bz AS (SELECT entity, hr, (aud_level - ma) / sa AS za, (vid_flow - mv) / sv AS zv FROM b JOIN bs USING (entity)),
bc AS (SELECT entity, quantile_cont(sqrt(za * za + zv * zv), 0.9) AS cut FROM bz GROUP BY 1),
bv AS (SELECT entity, covar_samp(za, za) AS aa, covar_samp(za, zv) AS av, covar_samp(zv, zv) AS vv FROM bz JOIN bc USING (entity) WHERE sqrt(za * za + zv * zv) < cut GROUP BY 1),
mh AS (SELECT entity, hr, za, zv, sqrt((vv * za * za - 2 * av * za * zv + aa * zv * zv) / nullif(aa * vv - av * av, 0)) AS maha FROM bz LEFT JOIN bv USING (entity))"""


def joint(t: Tables):
    """Daytime hours with both modalities: robust z of each and their joint distance."""
    d = t.merged.dropna(subset=["aud_level", "vid_flow"]).filter((F.col("hr") % 24).between(6, 17))
    d = nz.robust_z(d, E, ["aud_level", "vid_flow"]).withColumnsRenamed({"z_aud_level": "za", "z_vid_flow": "zv"})
    return nz.core_distance(d, E, "za", "zv", "maha").select("entity", "hr", "za", "zv", "maha")


@query("n09_core_mahalanobis_2d", f"WITH {MERGED}, {BOTH} SELECT entity, hr, {R('za')} AS za, {R('zv')} AS zv, {R('maha')} AS maha FROM mh")
def core_mahalanobis(t):
    return rounded(joint(t))


def coherence_scores(t: Tables):
    """Canonical variates of the two halves of the vectors, as robust z-scores, with their discordance."""
    d = t.embeddings.select("vec_id", "label", "embedding")
    model = nz.Coherence.fit(nz.moments(d, ["embedding"]), split=32)
    d = cut_lineage(model.transform(d, "embedding").drop("embedding"))
    d = cut_lineage(nz.robust_z(d, [], ["cu", "cw", "na", "nv"], guard="add", bounded=False))
    return model, nz.discordance(d, [], "z_cu", "z_cw")


C4_SQL = ", ".join(f"corr(e[{i + 1}], e[{j + 1}]) AS r{i}{j}" for i in range(4) for j in range(i + 1, 4))
# First canonical correlation of features (0, 1) with (2, 3): its square is the larger root of a quadratic.
CANON_SQL = """(SELECT *, (1 - r01 * r01) * (1 - r23 * r23) AS d, pow(r02 * r13 - r03 * r12, 2) AS de,
      (r02 - r01 * r12) * (r02 - r23 * r03) + (r03 - r01 * r13) * (r03 - r23 * r02) + (r12 - r01 * r02) * (r12 - r23 * r13) + (r13 - r01 * r03) * (r13 - r23 * r12) AS tr FROM {0})"""
ROOT_SQL = "sqrt((tr / d + sqrt(greatest(pow(tr / d, 2) - 4 * de / d, 0))) / 2)"


@query(
    "n10_canonical_r",
    f"""WITH c AS (SELECT {C4_SQL}, count(*) AS n FROM (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings))
    SELECT n, {R(ROOT_SQL, 5)} AS r FROM {CANON_SQL.format('c')}""",
)
def canonical_r(t):
    """Two features against two: the squared correlation is the larger root of a quadratic, which SQL solves."""
    d = t.embeddings.select(F.slice("embedding", 1, 4).alias("v"))
    model = nz.Coherence.fit(nz.moments(d, ["v"]), split=2, k=2)
    return d.agg(F.count("*").alias("n"), rnd(F.lit(model.r), 5).alias("r"))


@query("n10_stored_model", ORACLES["n10_canonical_r"])
def stored_coherence(t):
    d = t.embeddings.select(F.slice("embedding", 1, 4).alias("v"))
    model = reloaded(t, est.BlockCoherence(inputCol="v", split=2, k=2).fit(d))
    return model.transform(d).agg(F.count("*").alias("n"), rnd(F.corr("cu", "cw"), 5).alias("r"))


@query("n10_canonical_discordance")
def canonical(t):
    _, d = coherence_scores(t)
    return rounded(d.select("vec_id", "z_cu", "z_cw", "slope", "disc", "disc_z"))


def dim_corr(t: Tables):
    return nz.corr_long(nz.pair_sums(t.embeddings, ["embedding"]))


@query(
    "a17_correlation_matrix_wide",
    f"WITH {VEC_SQL} SELECT a.dim AS i, b.dim AS j, {R('corr(a.x, b.x)', 5)} AS r, count(*) AS n FROM x a JOIN x b USING (vec_id) GROUP BY ALL",
)
def corr_wide(t):
    return rounded(dim_corr(t), 5)


@query(
    "n11_greedy_pruning",
    f"""WITH RECURSIVE {VEC_SQL}, m AS (SELECT a.dim AS i, b.dim AS j, corr(a.x, b.x) AS r FROM x a JOIN x b USING (vec_id) GROUP BY ALL),
    v AS (SELECT dim, var_samp(x) AS var FROM x GROUP BY dim), cf AS (SELECT i AS dim, coalesce(list(j) FILTER (i <> j AND coalesce(abs(r) > 0.12, true)), []) AS bad FROM m GROUP BY i),
    od AS (SELECT CAST(dim AS INTEGER) AS dim, var, CAST(bad AS INTEGER[]) AS bad, row_number() OVER (ORDER BY var DESC, dim) AS k FROM v JOIN cf USING (dim) WHERE var > 0),
    g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS kept UNION ALL
      SELECT od.k, CASE WHEN list_has_any(g.kept, od.bad) THEN g.kept ELSE list_append(g.kept, od.dim) END FROM g JOIN od ON od.k = g.k + 1)
    SELECT dim, CAST(list_position(kept, dim) - 1 AS INTEGER) AS rank, {R('var')} AS variance FROM od, (SELECT kept FROM g ORDER BY k DESC LIMIT 1) WHERE list_contains(kept, dim)""",
)
def pruning(t):
    """Both the variances and the correlations come from one pass; the greedy walk sees one array for each feature."""
    var, corr = nz.correlations(t.embeddings, ["embedding"])
    rows = [(i, rank, float(np.round(var[i], 6))) for rank, i in enumerate(nz.prune_features(var, corr, 0.12))]
    return t.spark.createDataFrame(rows, "dim int, rank int, variance double")


@query(
    "n12_best_cross_partner",
    f"""WITH {VEC_SQL}, c AS (SELECT a.dim AS f, b.dim AS g, corr(a.x, b.x) AS r FROM x a JOIN x b USING (vec_id) WHERE (a.dim < 32) <> (b.dim < 32) GROUP BY ALL),
    k AS (SELECT f, g, abs(r) AS a, row_number() OVER (PARTITION BY f ORDER BY abs(r) DESC, g) AS rk FROM c)
    SELECT f, g AS partner, {R('a', 5)} AS abs_r FROM k WHERE rk = 1""",
)
def best_partner(t):
    c = dim_corr(t).withColumnsRenamed({"i": "f", "j": "g"})
    return rounded(nz.best_partner(c, lambda x: x < 32), 5)


@query(
    "n12_strongest_pairs",
    f"""WITH {VEC_SQL}, c AS (SELECT a.dim AS f, b.dim AS g, corr(a.x, b.x) AS r FROM x a JOIN x b USING (vec_id) WHERE a.dim < 32 AND b.dim >= 32 GROUP BY ALL)
    SELECT f, g, {R('abs(r)', 5)} AS abs_r FROM c ORDER BY abs(r) DESC, f, g LIMIT 10""",
)
def strongest_pairs(t):
    c = dim_corr(t).filter((F.col("i") < 32) & (F.col("j") >= 32))
    d = c.select(F.col("i").alias("f"), F.col("j").alias("g"), F.abs("r").alias("abs_r")).orderBy(F.desc("abs_r"), "f", "g").limit(10)
    return rounded(d, 5)
