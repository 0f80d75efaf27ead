"""End-to-end studies: injection variants, sweeps, ablations and the factorised interaction test."""

from pyspark.sql import functions as F

from sensorgate.functions.exprs import mix_sql, rnd
from sensorgate.operators import backtest as bt
from sensorgate.operators import detectors as det
from sensorgate.operators import normalize as nz
from sensorgate.operators.quantiles import exact_quantiles
from sensorgate.plans.alarms import RESID_SQL, energy, gate_sql, residuals
from sensorgate.plans.common import R, Tables, query
from sensorgate.plans.rollups import rounded
from sensorgate.plans.trials import (
    COUPLED_SQL, HOURS, PLAN_SQL, POOL_SQL, SLOT_SQL, TARGET, coupled, parts, slot_amount, timeline_sql, trials, z_pool,
)
from sensorgate.session import cut_lineage

# Tested spike and sustained sizes in residual scales, with their lengths in hours.
VARIANTS = [("spike", float(m), 1, 12) for m in (4, 6, 8, 10, 15, 20, 30)] + [("sustained", m, 36, 36) for m in (1.5, 2.0, 2.5, 3.0, 4.0, 5.0)]
VARIANT_SQL = "vr AS (SELECT kind, mag::DOUBLE AS mag, dur, win FROM (VALUES " + ", ".join(f"('{k}', {m}, {d}, {w})" for k, m, d, w in VARIANTS) + ") x(kind, mag, dur, win))"


QUIET_SQL = """pool AS (SELECT row_number() OVER (ORDER BY entity, hr) - 1 AS pool_idx, fast_residual / scale AS z FROM sf JOIN sc USING (entity) JOIN sm USING (entity) WHERE abs(fast_residual - med) < 3 * scale),
np AS (SELECT count(*) AS n FROM pool), tr AS (SELECT DISTINCT user_id AS trial FROM events)"""


@query(
    "b03_injection_variants",
    f"""WITH RECURSIVE {RESID_SQL}, {QUIET_SQL}, {timeline_sql('raw', HOURS, 11)}, {VARIANT_SQL},
    iv AS (SELECT trial, kind, mag, CAST(t AS BIGINT) AS i, {energy('abs(z + CASE WHEN t >= 80 AND t < 80 + dur THEN mag ELSE 0 END) - 1')} AS e FROM raw, vr), {gate_sql('iv', 'trial, kind, mag')},
    h AS (SELECT trial, kind, mag, min(CASE WHEN closed AND i >= 80 AND i < 80 + win THEN i - 80 END) AS delay FROM gt JOIN vr USING (kind, mag) GROUP BY ALL)
    SELECT kind, mag, {R('count(delay) / count(*)')} AS rate, CASE WHEN kind = 'sustained' THEN {R('avg(delay)')} END AS mean_latency FROM h GROUP BY kind, mag""",
)
def injection_variants(t):
    """Quiet residuals of all rooms in their own scales; all variants run over one copy of the timelines."""
    d = residuals(t).filter(F.abs(F.col("fast_residual") - F.col("med_fast_residual")) < F.col("scale") * 3)
    d = d.select("entity", "hr", (F.col("fast_residual") / F.col("scale")).alias("z"))
    pool = bt.index_pool(d, ["entity", "hr"], ["z"])
    d = bt.resample(trials(t), pool, "trial", HOURS, salt=11).withColumns({"a0": F.lit(80), "a1": F.lit(HOURS)})
    injections = [det.Injection((k, m), m, n, w) for k, m, n, w in VARIANTS]
    h = det.gate_delays(d, ["trial"], "t", "z", "a0", "a1", "kind string, mag double", injections, parts=parts(t))
    late = F.when(F.col("kind") == "sustained", rnd(F.avg("delay")))
    return h.groupBy("kind", "mag").agg(rnd(F.count("delay") / F.count("*")).alias("rate"), late.alias("mean_latency"))


DURATIONS = [6, 12, 24, 36, 48]


@query(
    "b13_duration_sweep",
    f"""WITH RECURSIVE {POOL_SQL}, {timeline_sql('raw', HOURS, 2)}, {PLAN_SQL}, du AS (SELECT CAST(unnest({DURATIONS}) AS INTEGER) AS duration),
    ev2 AS (SELECT trial, duration, CAST(t AS BIGINT) AS i, {energy('z + CASE WHEN t >= a0 AND t < a0 + duration THEN 2.5 ELSE 0 END - 1')} AS e FROM raw JOIN pe USING (trial), du), {gate_sql('ev2', 'trial, duration', '3.94')},
    h AS (SELECT trial, duration, min(CASE WHEN closed AND i >= a0 AND i < a0 + duration THEN i - a0 END) AS delay FROM gt JOIN pe USING (trial) GROUP BY ALL)
    SELECT duration, {R('count(delay) / count(*)')} AS recall, {R('avg(delay)')} AS mean_delay FROM h GROUP BY duration""",
)
def duration_sweep(t):
    d = bt.resample(bt.plan_events(trials(t), "trial", HOURS), z_pool(t), "trial", HOURS, salt=2)
    grid = [det.Injection((n,), 2.5, n, n) for n in DURATIONS]
    h = det.gate_delays(d, ["trial"], "t", "z", "a0", "a1", "duration int", grid, close=3.94, two_sided=False, parts=parts(t))
    return h.groupBy("duration").agg(rnd(F.count("delay") / F.count("*")).alias("recall"), rnd(F.avg("delay")).alias("mean_delay"))


ABLATION_SQL = f"""{RESID_SQL}, rm AS (SELECT entity, median(v) AS mv FROM sf WHERE fast_residual IS NOT NULL GROUP BY 1), rs AS (SELECT entity, any_value(mv) AS mv, greatest(1.4826 * median(abs(v - mv)), 1e-6) AS sv FROM sf JOIN rm USING (entity) WHERE fast_residual IS NOT NULL GROUP BY 1),
pool AS (SELECT row_number() OVER (ORDER BY entity, hr) - 1 AS pool_idx, (v - mv) / sv AS raw, (fast_residual - med) / scale AS detrended FROM sf JOIN rs USING (entity) JOIN sm USING (entity) JOIN sc USING (entity) WHERE fast_residual IS NOT NULL),
np AS (SELECT count(*) AS n FROM pool), tr AS (SELECT DISTINCT user_id AS trial FROM events), q9 AS (SELECT 'raw' AS representation, quantile_cont(abs(raw), 0.99) AS q FROM pool UNION ALL SELECT 'detrended', quantile_cont(abs(detrended), 0.99) FROM pool)"""


@query(
    "b13_gate_and_trend_ablation",
    f"""WITH RECURSIVE {ABLATION_SQL}, {SLOT_SQL}, rw AS (SELECT d.trial, d.t, raw, detrended FROM (SELECT trial, CAST(t AS INTEGER) AS t, {mix_sql('trial', 't', 12)} % n AS pool_idx FROM tr, range({HOURS}) r(t), np) d JOIN pool USING (pool_idx)),
    sh AS (SELECT trial, CAST(unnest(range(t0, t1)) AS INTEGER) AS t, sign * CASE WHEN kind = 'sustained' THEN 2.5 ELSE 10.0 END AS a FROM sl), sa AS (SELECT trial, t, sum(a) AS a FROM sh GROUP BY ALL),
    lg AS (SELECT trial, t, representation, CASE representation WHEN 'raw' THEN raw ELSE detrended END + coalesce(a, 0) AS z FROM rw LEFT JOIN sa USING (trial, t), (VALUES ('raw'), ('detrended')) x(representation)),
    ge AS (SELECT trial, representation, CAST(t AS BIGINT) AS i, {energy('abs(z) - 1')} AS e FROM lg), {gate_sql('ge', 'trial, representation')},
    al AS (SELECT trial, representation, true AS gated, i AS t FROM gt WHERE closed UNION ALL SELECT trial, representation, false, t FROM lg JOIN q9 USING (representation) WHERE abs(z) > q),
    oc AS (SELECT sl.trial, event, kind, x.representation, y.gated, count(al.t) > 0 AS hit FROM sl CROSS JOIN (VALUES ('raw'), ('detrended')) x(representation) CROSS JOIN (VALUES (true), (false)) y(gated)
      LEFT JOIN al ON al.trial = sl.trial AND al.representation = x.representation AND al.gated = y.gated AND al.t >= sl.t0 AND al.t < CASE WHEN kind = 'spike' THEN sl.t0 + 2 ELSE sl.t1 END GROUP BY sl.trial, event, kind, x.representation, y.gated),
    c AS (SELECT representation, gated, count(*) FILTER (kind = 'sustained' AND hit) AS tp, count(*) FILTER (kind = 'spike' AND hit) AS fp, count(*) FILTER (kind = 'sustained' AND NOT hit) AS fn FROM oc GROUP BY ALL)
    SELECT representation, gated, tp, fp, fn, {R('2 * tp / greatest(2 * tp + fp + fn, 1)')} AS f1 FROM c""",
)
def ablation(t):
    """Trend kept or removed, gate on or a 99 % threshold instead: the four rows of the ablation from one job."""
    d = residuals(t).filter(F.col("fast_residual").isNotNull())
    d = nz.with_robust_stats(d, ["entity"], ["v"])
    raw = (F.col("v") - F.col("med_v")) / nz.robust_scale("mad_v")
    d = d.select("entity", "hr", raw.alias("raw"), ((F.col("fast_residual") - F.col("med_fast_residual")) / F.col("scale")).alias("detrended"))
    pool = bt.index_pool(d, ["entity", "hr"], ["raw", "detrended"])
    kinds = ["raw", "detrended"]
    limit = exact_quantiles(pool.unpivot(["pool_idx"], kinds, "representation", "z"), ["representation"], {"": F.abs("z")}, [0.99], ["q"])
    events = bt.plan_slots(trials(t), "trial", HOURS)
    d = bt.resample(trials(t), pool, "trial", HOURS, salt=12)
    d = bt.add_slot_events(d.withColumn("add", F.lit(0.0)), events, "trial", "add", slot_amount())
    d = d.select("trial", "t", *[(F.col(k) + F.col("add")).alias(k) for k in kinds])
    limits = {r["representation"]: r["q"] for r in limit.collect()}  # one row for each representation
    hours = det.alarm_hours(d, ["trial"], "t", limits, parts(t))
    o = bt.slot_hits(events.join(hours.hint("merge"), "trial"))
    sustained = F.col("kind") == "sustained"
    c = o.groupBy("representation", "gated").agg(
        F.count_if(sustained & F.col("hit")).alias("tp"), F.count_if(~sustained & F.col("hit")).alias("fp"), F.count_if(sustained & ~F.col("hit")).alias("fn")
    )
    return bt.prf(c, "tp", "fp", "fn").select("representation", "gated", "tp", "fp", "fn", rnd("f1").alias("f1"))


CHANNELS = ["age", "coherence", "coupled"]
STEP = 11.5 / 59
INTERACTION_SQL = f"""{COUPLED_SQL}, pv AS (SELECT trial, t, 'clean' AS kind, greatest(za, zv) AS age, abs((zv - b * za) - dmed) / dmad AS coherence FROM raw, ds UNION ALL SELECT trial, t, kind, age, coherence FROM cs WHERE kind <> 'coupling_break'),
lz AS (SELECT trial, kind, 'age' AS channel, CAST(t AS BIGINT) AS i, {energy('age - 1')} AS e FROM pv UNION ALL SELECT trial, kind, 'coherence', t, {energy('coherence - 1')} FROM pv UNION ALL SELECT trial, kind, 'coupled', t, {energy('greatest(age, coherence) - 1')} FROM pv),
bp AS (SELECT trial, kind, channel, i, e AS p FROM lz WHERE i = 0 UNION ALL SELECT s.trial, s.kind, s.channel, s.i, 0.85 * g.p + s.e FROM bp g JOIN lz s ON s.trial = g.trial AND s.kind = g.kind AND s.channel = g.channel AND s.i = g.i + 1),
hg AS (SELECT CAST(k AS INTEGER) AS h_index, 0.5::DOUBLE + k * (11.5::DOUBLE / 59) AS h FROM range(60) r(k)),
cl AS (SELECT trial, channel, i, h_index, h, coalesce(last_value(CASE WHEN p >= h THEN true WHEN p <= 2.0 THEN false END IGNORE NULLS) OVER (PARTITION BY trial, channel, h_index ORDER BY i), false) AS l FROM bp, hg WHERE kind = 'clean'),
co AS (SELECT trial, channel, h_index, h, l AND NOT coalesce(lag(l) OVER (PARTITION BY trial, channel, h_index ORDER BY i), false) AS f FROM cl),
cn AS (SELECT channel, h_index, h, count(*) FILTER (f) / count(DISTINCT trial) AS m FROM co GROUP BY ALL),
hb AS (SELECT channel, h FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(abs(m - {TARGET}), 9), h_index) AS rk FROM cn) WHERE rk = 1),
lv AS (SELECT trial, kind, channel, i, coalesce(last_value(CASE WHEN p >= h THEN true WHEN p <= 2.0 THEN false END IGNORE NULLS) OVER (PARTITION BY trial, kind, channel ORDER BY i), false) AS l FROM bp JOIN hb USING (channel) WHERE kind <> 'clean'),
on_ AS (SELECT trial, kind, channel, i, l AND NOT coalesce(lag(l) OVER (PARTITION BY trial, kind, channel ORDER BY i), false) AS f FROM lv),
dt AS (SELECT trial, kind, channel, bool_or(f AND i >= a0 AND i < a1) AS d FROM on_ JOIN pe USING (trial) GROUP BY ALL)"""


@query(
    "b14_interaction_table",
    f"""WITH RECURSIVE {INTERACTION_SQL} SELECT channel, {R('any_value(h)')} AS threshold, {R("avg(CAST(d AS INTEGER)) FILTER (kind = 'concordant')")} AS recall_concordant,
    {R("avg(CAST(d AS INTEGER)) FILTER (kind = 'discordant')")} AS recall_discordant, {R('avg(CAST(d AS INTEGER))')} AS recall_mixed FROM dt JOIN hb USING (channel) GROUP BY channel""",
)
def interaction(t: Tables):
    """Gate on the magnitude, coherence and coupled channels at matched false alarms, over both kinds of event.

    Hours outside the events are the clean timelines, and the clean score of an hour is the one without injection.
    """
    d = coupled(t).withColumn("coupled", F.greatest("age", "coherence"))
    clean_coh = F.abs((F.col("zv") - F.col("b") * F.col("za")) - F.col("dmed")) / F.col("dmad")
    clean = d.filter(F.col("kind") == "concordant").withColumns({"age": F.greatest("za", "zv"), "coherence": clean_coh})
    clean = clean.withColumn("coupled", F.greatest("age", "coherence"))
    n = parts(t)
    counts = det.onset_counts(clean, ["trial"], "t", CHANNELS, ["gate"], [0.5 + i * STEP for i in range(60)], n)
    best = cut_lineage(det.matched_threshold(counts, ["score"], TARGET).select(F.col("score").alias("channel"), F.col("h").alias("threshold")))
    limits = {r["channel"]: {"gate": r["threshold"]} for r in best.collect()}  # one row for each channel

    def detected(kind: str):
        on = det.onset_hours(d.filter(F.col("kind") == kind), ["trial"], "t", None, limits, n)
        on = bt.plan_events(on.withColumnRenamed("score", "channel"), "trial", HOURS)
        inside = F.exists("hours", lambda h: (h >= F.col("a0")) & (h < F.col("a1")))
        return on.select("trial", "channel", F.lit(kind).alias("kind"), inside.cast("double").alias("d"))

    hit = detected("concordant").unionByName(detected("discordant")).join(best, "channel")
    of = lambda k: rnd(F.avg(F.when(F.col("kind") == k, F.col("d"))))
    return hit.groupBy("channel", rnd("threshold").alias("threshold")).agg(
        of("concordant").alias("recall_concordant"), of("discordant").alias("recall_discordant"), rnd(F.avg("d")).alias("recall_mixed")
    )
