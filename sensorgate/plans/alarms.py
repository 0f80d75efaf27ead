"""Persistence gate and sequential detectors on the hourly signal."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorgate.functions.exprs import rnd
from sensorgate.operators import detectors as det
from sensorgate.operators import normalize as nz
from sensorgate.operators import timeseries as ts
from sensorgate.operators.align import stack
from sensorgate.operators.estimators import CalibratedGate, CalibratedGateModel
from sensorgate.plans.common import FLOW, GRID, MERGED, ORACLES, R, Tables, query
from sensorgate.plans.models import BOTH, Z_SQL, joint
from sensorgate.plans.rollups import rounded
from sensorgate.plans.series import ADJ_SQL, MED_FRAME, interp_sql, profile_sql, slow_fast_sql
from sensorgate.session import scratch_path

E = ["entity"]

# Gate recursion as SQL: energy table e(keys, i, e) with i = 0, 1, ... per key.


def gate_sql(src: str, keys: str, close: str = "6.0", name: str = "gt") -> str:
    on = " AND ".join(f"s.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""{name} AS (SELECT {keys}, i, e AS p, e >= {close} AS closed FROM {src} WHERE i = 0
      UNION ALL SELECT {ks}, s.i, 0.85 * g.p + s.e, CASE WHEN g.closed THEN 0.85 * g.p + s.e > 2.0 ELSE 0.85 * g.p + s.e >= {close.replace('h', 's.h')} END
      FROM {name} g JOIN {src} s ON {on} AND s.i = g.i + 1)"""


def energy(expr: str) -> str:
    return f"least(greatest(coalesce({expr}, 0), 0), 2.0)"


TRUST = "CASE WHEN closed THEN 0 ELSE 1 - least(greatest((p - 2.0) / 4.0, 0), 1) END"

RESID_SQL = f"""{slow_fast_sql('b')}, sm AS (SELECT entity, median(fast_residual) AS med FROM sf GROUP BY 1),
sc AS (SELECT entity, coalesce(greatest(1.4826 * median(abs(fast_residual - med)), 1e-6), 1.0) AS scale FROM sf JOIN sm USING (entity) GROUP BY 1),
en AS (SELECT entity, hr, v, trend, diurnal, fast_residual, row_number() OVER (PARTITION BY entity ORDER BY hr) - 1 AS i, {energy('abs(fast_residual) / scale - 1')} AS e FROM sf JOIN sc USING (entity))"""


def residuals(t: Tables):
    """Complete hourly grid with its fast residual and the robust scale of that residual."""
    d = ts.slow_fast(t.flow, E, "hr", "v", variant="b")
    return nz.with_robust_stats(d, E, ["fast_residual"]).withColumn("scale", nz.robust_scale("mad_fast_residual"))


@query(
    "flagship_gate",
    f"""WITH RECURSIVE {RESID_SQL}, {gate_sql('en', 'entity')}
    SELECT entity, hr, {R('v')} AS v, {R('trend')} AS trend, {R('diurnal')} AS diurnal, {R('fast_residual')} AS fast_residual, {R('p')} AS persistence, {R(TRUST)} AS trust, closed
    FROM gt JOIN en USING (entity, i)""",
)
def flagship(t):
    d = det.gate(residuals(t), E, "hr", "fast_residual", scale=F.col("scale"))
    return rounded(d.select("entity", "hr", "v", "trend", "diurnal", "fast_residual", "persistence", "trust", "closed"))


@query("g01_persistence_gate", f"WITH RECURSIVE {RESID_SQL}, {gate_sql('en', 'entity')} SELECT entity, hr, {R('p')} AS persistence, {R(TRUST)} AS trust, closed FROM gt JOIN en USING (entity, i)")
def persistence_gate(t):
    d = det.gate(residuals(t), E, "hr", "fast_residual", scale=F.col("scale"))
    return rounded(d.select("entity", "hr", "persistence", "trust", "closed"))


@query(
    "g01_gate_skip_policy",
    f"""WITH RECURSIVE {RESID_SQL}, es AS (SELECT entity, hr, row_number() OVER (PARTITION BY entity ORDER BY hr) - 1 AS i, e FROM en WHERE fast_residual IS NOT NULL), {gate_sql('es', 'entity')}
    SELECT entity, hr, {R('p')} AS persistence, closed FROM gt JOIN es USING (entity, i)""",
)
def gate_skip(t):
    """Hours without a residual are dropped and the rows closed up: the position is a row number."""
    d = residuals(t).filter(F.col("fast_residual").isNotNull())
    d = d.withColumn("i", (F.row_number().over(ts.by_key(E, "hr")) - 1).cast("long"))
    d = det.gate(d, E, "i", "fast_residual", scale=F.col("scale"))
    return rounded(d.select("entity", "hr", "persistence", "closed"))


ZROWS = f"{Z_SQL}, z AS (SELECT entity, hr, (v - med) / (mad + 1e-9) AS z, row_number() OVER (PARTITION BY entity ORDER BY hr) - 1 AS i FROM flow JOIN s USING (entity))"


def z_rows(t: Tables):
    """Signed robust z of the signal, rows numbered per room."""
    d = nz.robust_z(t.flow, E, ["v"], guard="add").withColumnRenamed("z_v", "z")
    return d.withColumn("i", (F.row_number().over(ts.by_key(E, "hr")) - 1).cast("long"))


ONSET = "AND NOT coalesce(lag({0}) OVER (PARTITION BY entity ORDER BY hr), false)"


@query(
    "g02_gate_onsets",
    f"""WITH RECURSIVE {FLOW}, {ZROWS}, en AS (SELECT entity, hr, i, {energy('z - 1')} AS e FROM z), {gate_sql('en', 'entity', '3.94')}
    SELECT entity, hr, closed, closed {ONSET.format('closed')} AS onset FROM gt JOIN en USING (entity, i)""",
)
def gate_onsets(t):
    return det.gate_onsets(z_rows(t), E, "i", "z", 3.94).select("entity", "hr", "closed", "onset")


@query(
    "g03_gate_calibration",
    f"""WITH {FLOW}, q AS (SELECT entity, median(v) AS m, quantile_cont(v, 0.95) AS q95 FROM flow GROUP BY 1),
    c AS (SELECT entity, any_value(q95) AS q95, greatest(median(abs(v - m)) * 1.4826, 1e-9) AS scale FROM flow JOIN q USING (entity) GROUP BY 1)
    SELECT entity, {R('scale')} AS scale, {R('q95 / scale')} AS deadband, {R('q95')} AS q95 FROM c""",
)
def calibration(t):
    return rounded(det.calibrate_gate(t.flow, E, "v"))


@query("g03_stored_model", ORACLES["g03_gate_calibration"])
def stored_calibration(t):
    """The same numbers from a fitted gate that was stored and read back."""
    path = scratch_path(t.spark, "model")
    CalibratedGate(inputCol="v").fit(t.flow).save(path)
    return rounded(CalibratedGateModel.load(path).fitted.select("entity", "scale", "deadband", "q95"))


def sqrt_gate_sql(src: str, score: str, keys: str = "entity") -> str:
    """Clean median and scale of the root score (never negative here), gate on the root less its median."""
    return f"""qm AS (SELECT {keys}, median(sqrt({score})) AS med FROM {src} GROUP BY {keys}),
    qs AS (SELECT {keys}, any_value(med) AS med, greatest(1.4826 * median(abs(sqrt({score}) - med)), 1e-6) AS scale FROM {src} JOIN qm USING ({keys}) GROUP BY {keys}),
    qe AS (SELECT {keys}, hr, row_number() OVER (PARTITION BY {keys} ORDER BY hr) - 1 AS i, {energy(f'abs(sqrt({score}) - med) / scale - 1')} AS e FROM {src} JOIN qs USING ({keys}))"""


def sqrt_gate(d, keys, score: str, prefix: str = ""):
    d = d.withColumn("_root", F.when(F.col(score).isNotNull(), F.sqrt(F.greatest(F.col(score), F.lit(0.0)))))
    d = nz.with_robust_stats(d, keys, ["_root"])
    d = d.withColumn("row_no", (F.row_number().over(ts.by_key(keys, "hr")) - 1).cast("long"))
    return det.gate(d, keys, "row_no", F.col("_root") - F.col("med__root"), scale=nz.robust_scale("mad__root"), prefix=prefix)


@query(
    "g04_root_score_gate",
    f"""WITH RECURSIVE {MERGED}, {BOTH}, {sqrt_gate_sql('mh', 'maha')}, {gate_sql('qe', 'entity')} SELECT entity, hr, {R('p')} AS persistence, closed FROM gt JOIN qe USING (entity, i)""",
)
def root_score_gate(t):
    return rounded(sqrt_gate(joint(t), E, "maha").select("entity", "hr", "persistence", "closed"))


LONG_SQL = f"""{BOTH}, lg AS (SELECT entity, 'audio' AS modality, hr, abs(za) AS s FROM mh UNION ALL SELECT entity, 'video', hr, abs(zv) FROM mh),
qm AS (SELECT entity, modality, median(sqrt(s)) AS med FROM lg GROUP BY ALL),
qs AS (SELECT entity, modality, any_value(med) AS med, greatest(1.4826 * median(abs(sqrt(s) - med)), 1e-6) AS scale FROM lg JOIN qm USING (entity, modality) GROUP BY ALL),
qe AS (SELECT entity, modality, hr, row_number() OVER (PARTITION BY entity, modality ORDER BY hr) - 1 AS i, {energy('abs(sqrt(s) - med) / scale - 1')} AS e FROM lg JOIN qs USING (entity, modality))"""


@query(
    "g05_or_fusion",
    f"""WITH RECURSIVE {MERGED}, {LONG_SQL}, {gate_sql('qe', 'entity, modality')} SELECT entity, hr, bool_or(closed) AS fused FROM gt JOIN qe USING (entity, modality, i) GROUP BY ALL""",
)
def or_fusion(t):
    d = joint(t).withColumns({"audio": F.abs("za"), "video": F.abs("zv")}).unpivot(["entity", "hr"], ["audio", "video"], "modality", "s")
    d = sqrt_gate(d, ["entity", "modality"], "s")
    return d.groupBy("entity", "hr").agg(F.bool_or("closed").alias("fused"))


@query("g06_static_threshold", f"WITH {FLOW}, {ZROWS}, l AS (SELECT entity, hr, z > 2.2 AS l FROM z) SELECT entity, hr, l {ONSET.format('l')} AS onset FROM l")
def static(t):
    return det.static_onsets(z_rows(t), E, "hr", "z", 2.2).select("entity", "hr", "onset")


def fold_sql(name: str, start: str, step: str) -> str:
    """State columns a, b, c, d and the alarm f; ``{v}`` is the score of the row."""
    return f"""{name} AS (SELECT entity, i, {start} FROM z WHERE i = 0 UNION ALL SELECT s.entity, s.i, {step} FROM {name} g JOIN z s ON s.entity = g.entity AND s.i = g.i + 1)"""


EWMA_SQL = fold_sql("ew", "CASE WHEN 0.3 * z > 1.3 THEN 0 ELSE 0.3 * z END AS a, 0.3 * z > 1.3 AS f", "CASE WHEN 0.7 * g.a + 0.3 * s.z > 1.3 THEN 0 ELSE 0.7 * g.a + 0.3 * s.z END, 0.7 * g.a + 0.3 * s.z > 1.3")
CUSUM_SQL = fold_sql("cu", "CASE WHEN greatest(0, z - 0.5) > 5.1 THEN 0 ELSE greatest(0, z - 0.5) END AS a, greatest(0, z - 0.5) > 5.1 AS f", "CASE WHEN greatest(0, g.a + s.z - 0.5) > 5.1 THEN 0 ELSE greatest(0, g.a + s.z - 0.5) END, greatest(0, g.a + s.z - 0.5) > 5.1")
PH_H = 6.3
PH_SQL = f"""ph0 AS (SELECT entity, i, 1.0::DOUBLE AS n, z AS mean, -0.1::DOUBLE AS cum, -0.1::DOUBLE AS low, false AS f FROM z WHERE i = 0),
ph AS (SELECT * FROM ph0 UNION ALL SELECT entity, i, CASE WHEN hit THEN 0 ELSE n END, CASE WHEN hit THEN 0 ELSE mean END, CASE WHEN hit THEN 0 ELSE cum END, CASE WHEN hit THEN 0 ELSE low END, hit FROM
  (SELECT *, cum - low > {PH_H} AS hit FROM (SELECT *, least(low0, cum) AS low FROM (SELECT *, cum0 + z - mean - 0.1 AS cum FROM
    (SELECT s.entity, s.i, s.z, g.n + 1 AS n, g.mean + (s.z - g.mean) / (g.n + 1) AS mean, g.cum AS cum0, g.low AS low0 FROM ph g JOIN z s ON s.entity = g.entity AND s.i = g.i + 1)))))"""


@query("g07_ewma_reset", f"WITH RECURSIVE {FLOW}, {ZROWS}, {EWMA_SQL} SELECT entity, hr, f AS onset FROM ew JOIN z USING (entity, i)")
def ewma(t):
    return det.fold_onsets(z_rows(t), E, "hr", "z", {"ewma": 1.3}).select("entity", "hr", F.col("on_ewma").alias("onset"))


@query("g08_cusum_reset", f"WITH RECURSIVE {FLOW}, {ZROWS}, {CUSUM_SQL} SELECT entity, hr, f AS onset FROM cu JOIN z USING (entity, i)")
def cusum(t):
    return det.fold_onsets(z_rows(t), E, "hr", "z", {"cusum": 5.1}).select("entity", "hr", F.col("on_cusum").alias("onset"))


@query(
    "g09_cusum_running",
    f"""WITH {FLOW}, {ZROWS}, c AS (SELECT entity, hr, sum(z - 0.5) OVER (PARTITION BY entity ORDER BY hr) AS c FROM z)
    SELECT entity, hr, {R('c - least(0, min(c) OVER (PARTITION BY entity ORDER BY hr))')} AS cusum FROM c""",
)
def cusum_running(t):
    return det.cusum_running(z_rows(t), E, "hr", "z", "cusum").select("entity", "hr", rnd("cusum").alias("cusum"))


@query("g10_page_hinkley", f"WITH RECURSIVE {FLOW}, {ZROWS}, {PH_SQL} SELECT entity, hr, f AS onset FROM ph JOIN z USING (entity, i)")
def page_hinkley(t):
    return det.fold_onsets(z_rows(t), E, "hr", "z", {"page_hinkley": PH_H}).select("entity", "hr", F.col("on_page_hinkley").alias("onset"))


@query(
    "g11_adjacent_window_test",
    f"WITH {FLOW}, a AS ({ADJ_SQL}), l AS (SELECT entity, hr, coalesce(z > 1.7, false) AS l FROM a) SELECT entity, hr, l {ONSET.format('l')} AS onset FROM l",
)
def window_shift(t):
    return det.window_shift_onsets(t.flow, E, "hr", "v", 1.7).select("entity", "hr", "onset")


@query(
    "g12_sigma_flags",
    f"""WITH {FLOW}, x AS (SELECT entity, hr, (v - avg(v) OVER w) / (stddev_samp(v) OVER w + 1e-9) AS z FROM flow WINDOW w AS (PARTITION BY entity)) SELECT entity, hr, {R('z')} AS z, abs(z) > 3 AS flag FROM x""",
)
def sigma_flags(t):
    return det.sigma_flags(t.flow, E, "v").select("entity", "hr", rnd("z").alias("z"), "flag")


@query(
    "g13_quantile_threshold",
    f"""WITH {FLOW}, q AS (SELECT entity, quantile_cont(v, 0.95) AS a, quantile_cont(v, 0.99) AS b, quantile_cont(v, 0.999) AS c FROM flow GROUP BY 1)
    SELECT entity, hr, v > a AS over_p95, v > b AS over_p99, v > c AS over_p999 FROM flow JOIN q USING (entity)""",
)
def quantile_threshold(t):
    q = t.flow.groupBy("entity").agg(F.percentile("v", F.array(*[F.lit(x) for x in (0.95, 0.99, 0.999)])).alias("q"))
    d = nz.attach(t.flow, q, E)
    return d.select("entity", "hr", *[(F.col("v") > F.col("q")[i]).alias(n) for i, n in enumerate(("over_p95", "over_p99", "over_p999"))])


CHAN_SQL = f"""{BOTH}, sl AS (SELECT entity, CASE WHEN var_pop(za) > 0 THEN regr_slope(zv, za) END AS b FROM mh GROUP BY 1), dc AS (SELECT entity, hr, za, zv, zv - b * za AS disc FROM mh JOIN sl USING (entity)),
dm AS (SELECT entity, median(disc) AS dmed FROM dc GROUP BY 1), ds AS (SELECT entity, any_value(dmed) AS dmed, median(abs(disc - dmed)) * 1.4826 + 1e-9 AS dmad FROM dc JOIN dm USING (entity) GROUP BY 1),
ch AS (SELECT entity, hr, greatest(za, zv) AS age, abs(disc - dmed) / dmad AS coherence, greatest(greatest(za, zv), abs(disc - dmed) / dmad) AS coupled FROM dc JOIN ds USING (entity))"""


def channels(t: Tables):
    """Magnitude, coherence and coupled score of each daytime hour."""
    d = nz.discordance(joint(t), E, "za", "zv", bounded=True)
    age, coh = F.greatest("za", "zv"), F.abs("disc_z")
    return d.select("entity", "hr", age.alias("age"), coh.alias("coherence"), F.greatest(age, coh).alias("coupled"))


@query("g14_score_channels", f"WITH {MERGED}, {CHAN_SQL} SELECT entity, hr, {R('age')} AS age, {R('coherence')} AS coherence, {R('coupled')} AS coupled FROM ch")
def score_channels(t):
    return rounded(channels(t))


@query(
    "g16_cause_attribution",
    f"""WITH {MERGED}, {CHAN_SQL}, m AS (SELECT entity, hr // 24 AS dy, max(age) / 2.5 AS a, max(coherence) / 3.1 AS c FROM ch GROUP BY ALL)
    SELECT entity, dy, {R('a')} AS age_evidence, {R('c')} AS coherence_evidence, CASE WHEN a > c THEN 'magnitude' ELSE 'incoherence' END AS cause FROM m""",
)
def cause_attribution(t):
    """Each day of a room is an event; each channel is measured against its own alarm threshold."""
    return rounded(attribute(channels(t).withColumn("dy", F.expr("hr div 24")), ["entity", "dy"], 2.5, 3.1))


def attribute(d, keys, age_h, coherence_h):
    d = d.groupBy(*keys).agg((F.max("age") / age_h).alias("age_evidence"), (F.max("coherence") / coherence_h).alias("coherence_evidence"))
    return d.withColumn("cause", F.when(F.col("age_evidence") > F.col("coherence_evidence"), F.lit("magnitude")).otherwise(F.lit("incoherence")))


JM_SQL = f"""{BOTH}, cr AS (SELECT entity, quantile_cont(maha, 0.9) AS cut FROM mh GROUP BY 1), co AS (SELECT mh.* FROM mh JOIN cr USING (entity) WHERE maha < cut),
st AS (SELECT entity, 'joint' AS stream, maha AS s FROM co UNION ALL SELECT entity, 'marginal', abs(zv) FROM co UNION ALL SELECT entity, 'marginal', abs(za) FROM co),
sq AS (SELECT entity, stream, median(s) AS m, quantile_cont(s, 0.95) AS q95 FROM st GROUP BY ALL),
sp AS (SELECT entity, stream, any_value(q95) AS q95, greatest(median(abs(s - m)) * 1.4826, 1e-9) AS scale FROM st JOIN sq USING (entity, stream) GROUP BY ALL),
lv AS (SELECT entity, 'joint' AS name, 'joint' AS stream, hr, maha AS s FROM mh UNION ALL SELECT entity, 'video', 'marginal', hr, abs(zv) FROM mh UNION ALL SELECT entity, 'audio', 'marginal', hr, abs(za) FROM mh),
qe AS (SELECT entity, name, hr, row_number() OVER (PARTITION BY entity, name ORDER BY hr) - 1 AS i, {energy('s / scale - q95 / scale')} AS e FROM lv JOIN sp USING (entity, stream))"""


@query(
    "g18_joint_vs_marginal_gates",
    f"""WITH RECURSIVE {MERGED}, {JM_SQL}, {gate_sql('qe', 'entity, name')} SELECT entity, name, {R('avg(CAST(closed AS INTEGER))')} AS closed_share, count(*) AS n FROM gt GROUP BY ALL""",
)
def joint_vs_marginal(t):
    d = joint(t)
    whole = Window.partitionBy("entity")
    core = d.withColumn("cut", F.percentile("maha", F.lit(0.9)).over(whole)).filter(F.col("maha") < F.col("cut"))

    def streams(x):
        x = x.withColumns({"joint": F.col("maha"), "video": F.abs("zv"), "audio": F.abs("za")})
        x = x.unpivot(["entity", "hr"], ["joint", "video", "audio"], "name", "s")
        return x.withColumn("stream", F.when(F.col("name") == "joint", F.lit("joint")).otherwise(F.lit("marginal")))

    params = det.calibrate_gate(streams(core), ["entity", "stream"], "s")
    live = streams(d).join(params, ["entity", "stream"])
    live = live.withColumn("i", (F.row_number().over(ts.by_key(["entity", "name"], "hr")) - 1).cast("long"))
    g = det.gate(live, ["entity", "name"], "i", "s", scale=F.col("scale"), deadband=F.col("deadband"))
    return g.groupBy("entity", "name").agg(rnd(F.avg(F.col("closed").cast("double"))).alias("closed_share"), F.count("*").alias("n"))


def forecasts(t: Tables):
    d = ts.segments(t.flow, E, "hr", 6)
    return det.forecast_residuals(d, ["entity", "segment_id"], "hr", "v")


@query("g19_segment_forecast_residuals")
def forecast_residuals(t):
    return rounded(forecasts(t))


@query("b18_natural_flag_rate")
def natural_flag_rate(t):
    d = det.sigma_flags(forecasts(t), ["entity", "segment_id", "model"], "resid")
    return d.groupBy("entity", "segment_id", "model").agg(rnd(F.avg(F.col("flag").cast("double"))).alias("flag_rate"), F.count("*").alias("n"))
