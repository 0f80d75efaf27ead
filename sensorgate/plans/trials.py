"""Backtests: one timeline per monitored user, drawn from the clean hourly scores of all rooms."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorgate.functions.exprs import mix, mix_sql, rnd, safe_div
from sensorgate.operators import backtest as bt
from sensorgate.operators import detectors as det
from sensorgate.operators import normalize as nz
from sensorgate.operators import timeseries as ts
from sensorgate.operators.align import stack
from sensorgate.plans.alarms import CHAN_SQL, ZROWS, attribute, channels, energy, gate_sql, z_rows
from sensorgate.plans.common import FLOW, MERGED, R, Tables, query
from sensorgate.plans.models import BOTH, C4_SQL, CANON_SQL, ROOT_SQL, joint
from sensorgate.plans.rollups import rounded
from sensorgate.session import cut_lineage

HOURS = 240
GRID = [0.5 + i * (14.5 / 59) for i in range(60)]
TARGET = 0.3


def trials(t: Tables):
    return t.trials


def z_pool(t: Tables):
    """Numbered clean scores, written once: every trial reads them."""
    return bt.index_pool(z_rows(t), ["entity", "hr"], ["z"])


POOL_SQL = f"""{FLOW}, {ZROWS}, pool AS (SELECT row_number() OVER (ORDER BY entity, hr) - 1 AS pool_idx, z FROM z), np AS (SELECT count(*) AS n FROM pool),
tr AS (SELECT DISTINCT user_id AS trial FROM events)"""


def parts(t: Tables, length: int = HOURS) -> int:
    return bt.parts_for(trials(t), length)


def timeline_sql(name: str, length: int, salt: int) -> str:
    return f"""{name} AS (SELECT d.trial, d.t, z FROM (SELECT trial, CAST(t AS INTEGER) AS t, {mix_sql('trial', 't', salt)} % n AS pool_idx FROM tr, range({length}) r(t), np) d JOIN pool USING (pool_idx))"""


PLAN_SQL = f"""pe AS (SELECT *, CAST(a0 + 12 + {mix_sql('trial', '1', 100)} % 18 AS INTEGER) AS a1 FROM (SELECT trial, CAST(40 + {mix_sql('trial', '0', 100)} % 160 AS INTEGER) AS a0,
  [{', '.join(f"CAST(20 + {mix_sql('trial', str(2 + j), 100)} % 216 AS INTEGER)" for j in range(4))}] AS spikes FROM tr))"""
CLEAN_SQL = timeline_sql("clean", HOURS, 1)
EVENT_SQL = f"""{timeline_sql('raw', HOURS, 2)}, {PLAN_SQL}, evt AS (SELECT trial, t, z + CASE WHEN t >= a0 AND t < a1 THEN 3.0 ELSE 0 END + 6.0 * len(list_filter(spikes, lambda s: s = t)) AS z FROM raw JOIN pe USING (trial))"""


def clean_timelines(t: Tables, pool):
    return bt.resample(trials(t), pool, "trial", HOURS, salt=1)


def event_timelines(t: Tables, pool, magnitude=3.0, spike=6.0):
    d = bt.resample(bt.plan_events(trials(t), "trial", HOURS), pool, "trial", HOURS, salt=2)
    return bt.add_events(d, "z", magnitude, spike)


INJ_SQL = f"""{FLOW}, iw AS (SELECT entity, hr, v, row_number() OVER (PARTITION BY entity ORDER BY hr) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n, 3 * stddev_samp(v) OVER (PARTITION BY entity) AS a FROM flow),
ip AS (SELECT *, CAST(floor(n * 0.75::DOUBLE) AS BIGINT) AS s1, CAST(floor(n * 0.65::DOUBLE) AS BIGINT) AS s2, CAST(floor(n * 0.55::DOUBLE) AS BIGINT) AS s3, CAST(floor((n // 3) * 0.5::DOUBLE) AS BIGINT) AS c1,
  n // 3 + CAST(floor((n // 3) * 0.3::DOUBLE) AS BIGINT) AS c2, n // 3 * 2 + CAST(floor((n // 3) * 0.2::DOUBLE) AS BIGINT) AS c3 FROM iw),
inj AS (SELECT entity, hr, 'spike' AS kind, v + CASE WHEN i = s1 THEN a ELSE 0 END AS v, i = s1 AS truth FROM ip
  UNION ALL SELECT entity, hr, 'level_shift', v + CASE WHEN i >= s2 THEN a ELSE 0 END, i >= s2 AND i < s2 + 24 FROM ip
  UNION ALL SELECT entity, hr, 'trend_drift', v + CASE WHEN i >= s3 THEN a * (i - s3) / greatest(n - s3 - 1, 1) ELSE 0 END, i >= s3 AND i < s3 + 24 FROM ip
  UNION ALL SELECT entity, hr, 'combined', v + CASE WHEN i = c1 THEN a ELSE 0 END + CASE WHEN i >= c2 THEN a ELSE 0 END + CASE WHEN i >= c3 THEN a * (i - c3) / greatest(n - c3 - 1, 1) ELSE 0 END,
    i = c1 OR (i >= c2 AND i < c2 + 24) OR (i >= c3 AND i < c3 + 24) FROM ip)"""


@query("b01_series_injection", f"WITH {INJ_SQL} SELECT entity, hr, kind, {R('v')} AS v, truth FROM inj")
def series_injection(t):
    return rounded(bt.inject_series(t.flow, ["entity"], "hr", "v"))


@query("b02_bootstrap_timelines", f"WITH {POOL_SQL}, {CLEAN_SQL} SELECT trial, t, {R('z')} AS z FROM clean")
def bootstrap_timelines(t):
    return rounded(clean_timelines(t, z_pool(t)))


@query(
    "b02_contiguous_slices",
    f"""WITH {POOL_SQL} SELECT trial, CAST(t AS INTEGER) AS t, {R('z')} AS z FROM (SELECT trial, t, {mix_sql('trial', '0', 7)} % greatest(n - 240, 1) + t AS pool_idx FROM tr, range(240) r(t), np) JOIN pool USING (pool_idx)""",
)
def contiguous(t):
    return rounded(bt.contiguous_slice(trials(t), z_pool(t), "trial", HOURS, salt=7))


SLOT_SQL = f"""so AS (SELECT trial, CAST(t0 AS INTEGER) AS t0, {mix_sql('trial', 't0', 200)} AS o FROM tr, range(20, 200, 8) r(t0)),
sk AS (SELECT trial, t0, row_number() OVER (PARTITION BY trial ORDER BY o, t0) AS k FROM so),
sl AS (SELECT trial, t0, k AS event, CASE WHEN k <= 3 THEN 'sustained' ELSE 'spike' END AS kind, CAST(t0 + CASE WHEN k <= 3 THEN 12 + {mix_sql('trial', 'k', 201)} % 18 ELSE 1 END AS INTEGER) AS t1,
  CASE WHEN {mix_sql('trial', 'k', 202)} % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM sk WHERE k <= 8)"""
SLOT_SERIES = f"""{timeline_sql('raw', HOURS, 3)}, {SLOT_SQL}, sh AS (SELECT trial, CAST(unnest(range(t0, t1)) AS INTEGER) AS t, sign * CASE WHEN kind = 'sustained' THEN 2.5 ELSE 10.0 END AS a FROM sl),
sa AS (SELECT trial, t, sum(a) AS a FROM sh GROUP BY ALL), mev AS (SELECT raw.trial, raw.t, z + coalesce(a, 0) AS z FROM raw LEFT JOIN sa ON sa.trial = raw.trial AND sa.t = raw.t)"""


def slot_amount(size_sustained=2.5, size_spike=10.0):
    return F.col("sign") * F.when(F.col("kind") == "sustained", size_sustained).otherwise(size_spike)


def slot_timelines(t: Tables, pool):
    events = bt.plan_slots(trials(t), "trial", HOURS)
    d = bt.resample(trials(t), pool, "trial", HOURS, salt=3)
    return bt.add_slot_events(d, events, "trial", "z", slot_amount()), events


@query("b03_multi_event_injection", f"WITH {POOL_SQL}, {SLOT_SERIES} SELECT trial, t, {R('z')} AS z FROM mev")
def multi_event(t):
    d, _ = slot_timelines(t, z_pool(t))
    return rounded(d.select("trial", "t", "z"))


@query(
    "b03_slot_outcomes",
    f"""WITH {POOL_SQL}, {SLOT_SERIES}, al AS (SELECT trial, t FROM mev WHERE abs(z) > 3)
    SELECT sl.trial, CAST(event AS INTEGER) AS event, kind, sl.t0, sl.t1, count(al.t) > 0 AS hit, CAST(min(al.t) - sl.t0 AS INTEGER) AS delay FROM sl LEFT JOIN al ON al.trial = sl.trial AND al.t >= sl.t0
      AND al.t < CASE WHEN kind = 'spike' THEN sl.t0 + 2 ELSE sl.t1 END GROUP BY sl.trial, event, kind, sl.t0, sl.t1""",
)
def slot_outcomes(t):
    d, events = slot_timelines(t, z_pool(t))
    o = bt.slot_outcomes(d.withColumn("alarm", F.abs("z") > 3), events, ["trial"], "alarm")
    return o.select("trial", "event", "kind", "t0", "t1", "hit", "delay")


def pair_pool(t: Tables):
    return bt.index_pool(joint(t), ["entity", "hr"], ["za", "zv"])


PAIR_SQL = f"""{MERGED}, {BOTH}, pool AS (SELECT row_number() OVER (ORDER BY entity, hr) - 1 AS pool_idx, za, zv FROM mh), np AS (SELECT count(*) AS n FROM pool), tr AS (SELECT DISTINCT user_id AS trial FROM events),
raw AS (SELECT d.trial, d.t, za, zv FROM (SELECT trial, CAST(t AS INTEGER) AS t, {mix_sql('trial', 't', 4)} % n AS pool_idx FROM tr, range({HOURS}) r(t), np) d JOIN pool USING (pool_idx))"""


@query(
    "b04_modality_targeted_injection",
    f"""WITH {PAIR_SQL}, {SLOT_SQL}, sh AS (SELECT trial, CAST(unnest(range(t0, t1)) AS INTEGER) AS t, sign * CASE WHEN kind = 'sustained' THEN 2.5 ELSE 10.0 END AS a FROM sl),
    sa AS (SELECT trial, t, sum(a) AS a FROM sh GROUP BY ALL), lg AS (SELECT raw.trial, raw.t, target, seen, CASE seen WHEN 'audio' THEN za ELSE zv END + CASE WHEN target = seen THEN coalesce(a, 0) ELSE 0 END AS s
      FROM raw LEFT JOIN sa ON sa.trial = raw.trial AND sa.t = raw.t, (VALUES ('audio'), ('video')) x(target), (VALUES ('audio'), ('video')) y(seen)),
    al AS (SELECT trial, target, seen, t FROM lg WHERE abs(s) > 3),
    oc AS (SELECT sl.trial, event, kind, x.target, y.seen, count(al.t) > 0 AS hit FROM sl CROSS JOIN (VALUES ('audio'), ('video')) x(target) CROSS JOIN (VALUES ('audio'), ('video')) y(seen)
      LEFT JOIN al ON al.trial = sl.trial AND al.target = x.target AND al.seen = y.seen AND al.t >= sl.t0 AND al.t < CASE WHEN kind = 'spike' THEN sl.t0 + 2 ELSE sl.t1 END GROUP BY sl.trial, event, kind, x.target, y.seen),
    c AS (SELECT target, seen, count(*) FILTER (kind = 'sustained' AND hit) AS tp, count(*) FILTER (kind = 'spike' AND hit) AS fp, count(*) FILTER (kind = 'sustained' AND NOT hit) AS fn FROM oc GROUP BY ALL)
    SELECT target, seen, tp, fp, fn, {R('2 * tp / greatest(2 * tp + fp + fn, 1)')} AS f1 FROM c""",
)
def targeted(t):
    """Events in one modality, scored by a detector that sees one modality."""
    events = bt.plan_slots(trials(t), "trial", HOURS)
    d = bt.resample(trials(t), pair_pool(t), "trial", HOURS, salt=4)
    both = F.array(F.lit("audio"), F.lit("video"))
    d = bt.add_slot_events(d.withColumn("add", F.lit(0.0)), events, "trial", "add", slot_amount())
    d = d.unpivot(["trial", "t", "add"], ["za", "zv"], "seen", "s").withColumn("seen", F.when(F.col("seen") == "za", "audio").otherwise("video"))
    d = d.withColumn("target", F.explode(both))
    plan = events.withColumn("target", F.explode(both)).withColumn("seen", F.explode(both))
    moved = F.col("s") + F.when(F.col("target") == F.col("seen"), F.col("add")).otherwise(0.0)
    keys = ["trial", "target", "seen"]
    d = d.withColumn("alarm", F.abs(moved) > 3)
    o = bt.slot_outcomes(d, plan, keys, "alarm")
    sustained = F.col("kind") == "sustained"
    c = o.groupBy("target", "seen").agg(
        F.count_if(sustained & F.col("hit")).alias("tp"), F.count_if(~sustained & F.col("hit")).alias("fp"), F.count_if(sustained & ~F.col("hit")).alias("fn")
    )
    return bt.prf(c, "tp", "fp", "fn").select("target", "seen", "tp", "fp", "fn", rnd("f1").alias("f1"))


COUPLED_SQL = f"""{PAIR_SQL}, {PLAN_SQL}, sb AS (SELECT regr_slope(zv, za) AS b FROM pool), dd AS (SELECT zv - b * za AS disc FROM pool, sb), dm AS (SELECT median(disc) AS dmed FROM dd),
ds AS (SELECT dmed, b, (SELECT median(abs(disc - dmed)) FROM dd) * 1.4826 + 1e-9 AS dmad FROM dm, sb),
cp AS (SELECT trial, t, kind, a0, a1, b, dmed, dmad, za + CASE WHEN kind <> 'discordant' AND t >= a0 AND t < a1 THEN 2.5 ELSE 0 END AS u,
  CASE WHEN t >= a0 AND t < a1 THEN CASE kind WHEN 'concordant' THEN zv + b * 2.5 WHEN 'coupling_break' THEN zv + 2.5 ELSE b * za + dmed + 3.0 * dmad END ELSE zv END AS w
  FROM raw JOIN pe USING (trial), ds, (VALUES ('concordant'), ('discordant'), ('coupling_break')) k(kind)),
cs AS (SELECT trial, t, kind, a0, a1, u, w, greatest(u, w) AS age, abs((w - b * u) - dmed) / dmad AS coherence FROM cp)"""


def coupled(t: Tables):
    """Clean pairs, and in the span: both up along the clean line, the second off its line, or both up by the same."""
    pool = pair_pool(t)
    model = cut_lineage(pool.agg(F.regr_slope("zv", "za").alias("b")))
    disc = pool.withColumn("b", model.select("b").scalar()).withColumn("disc", F.col("zv") - F.col("b") * F.col("za"))
    st = nz.robust_stats(disc, [], ["disc"], bounded=False)
    st = cut_lineage(st.withColumn("b", model.select("b").scalar()).withColumn("dmad", F.col("mad_disc") * 1.4826 + 1e-9))
    d = bt.resample(bt.plan_events(trials(t), "trial", HOURS), pool, "trial", HOURS, salt=4)
    d = nz.attach(d, st.select("b", F.col("med_disc").alias("dmed"), "dmad"), [])
    d = d.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in ("concordant", "discordant", "coupling_break")])))
    inside, kind = (F.col("t") >= F.col("a0")) & (F.col("t") < F.col("a1")), F.col("kind")
    moved = (
        F.when(kind == "concordant", F.col("zv") + F.col("b") * 2.5)
        .when(kind == "coupling_break", F.col("zv") + 2.5)
        .otherwise(F.col("b") * F.col("za") + F.col("dmed") + F.col("dmad") * 3.0)
    )
    d = d.withColumn("u", F.col("za") + F.when(inside & (kind != "discordant"), 2.5).otherwise(0.0))
    d = d.withColumn("w", F.when(inside, moved).otherwise(F.col("zv")))
    coh = F.abs((F.col("w") - F.col("b") * F.col("u")) - F.col("dmed")) / F.col("dmad")
    return d.withColumns({"age": F.greatest("u", "w"), "coherence": coh})


@query("b05_coupling_injection", f"WITH {COUPLED_SQL} SELECT trial, t, kind, {R('u')} AS u, {R('w')} AS w, {R('age')} AS age, {R('coherence')} AS coherence FROM cs")
def coupling(t):
    return rounded(coupled(t).select("trial", "t", "kind", "u", "w", "age", "coherence"))


@query(
    "b05_cause_accuracy",
    f"""WITH {COUPLED_SQL}, m AS (SELECT trial, kind, max(age) / 2.5 > max(coherence) / 2.5 AS magnitude FROM cs WHERE t >= a0 AND t < a1 GROUP BY ALL)
    SELECT kind, {R("avg(CAST(magnitude = (kind = 'concordant') AS INTEGER))")} AS cause_accuracy, count(*) AS n FROM m GROUP BY kind""",
)
def cause_accuracy(t):
    d = coupled(t).filter((F.col("t") >= F.col("a0")) & (F.col("t") < F.col("a1")))
    d = attribute(d, ["trial", "kind"], 2.5, 2.5)
    right = (F.col("cause") == "magnitude") == (F.col("kind") == "concordant")
    return d.groupBy("kind").agg(rnd(F.avg(right.cast("double"))).alias("cause_accuracy"), F.count("*").alias("n"))


def outcome_sql(alarm: str, keys: str = "trial", name: str = "oc") -> str:
    """Per timeline outcomes of an alarm table (keys, t, f)."""
    return f"""{name}_a AS (SELECT {keys}, list(t ORDER BY t) FILTER (f) AS ats FROM {alarm} GROUP BY {keys}),
    {name} AS (SELECT {keys}, a0, len(coalesce(list_filter(ats, lambda x: x >= a0 AND x < a1), [])) > 0 AS detected, list_min(list_filter(ats, lambda x: x >= a0 AND x < a1)) - a0 AS delay,
      len(list_filter(spikes, lambda s: len(coalesce(list_filter(ats, lambda x: x >= s AND x < s + 2), [])) > 0)) AS spike_fp,
      len(coalesce(list_filter(ats, lambda x: (x < a0 OR x >= a1) AND len(list_filter(spikes, lambda s: x >= s AND x < s + 2)) = 0), [])) AS clean_fa FROM {name}_a JOIN pe USING (trial))"""


STATIC_SQL = f"""{POOL_SQL}, {EVENT_SQL}, sa AS (SELECT trial, t, z > 3.1 AND NOT coalesce(lag(z > 3.1) OVER (PARTITION BY trial ORDER BY t), false) AS f FROM evt), {outcome_sql('sa')}"""


def onset_outcomes(t: Tables, pool, limits: dict):
    """Outcomes per trial and detector: one pass over the event timelines, whose plan follows from the trial."""
    on = det.onset_hours(event_timelines(t, pool), ["trial"], "t", "z", limits, parts(t))
    return bt.hours_outcomes(bt.plan_events(on, "trial", HOURS), ["trial", "detector"], "hours")


def static_outcomes(t: Tables):
    return onset_outcomes(t, z_pool(t), {"static": 3.1}).drop("detector")


@query("b06_event_outcomes", f"WITH {STATIC_SQL} SELECT trial, detected, CAST(delay AS INTEGER) AS delay, CAST(spike_fp AS INTEGER) AS spike_fp, CAST(clean_fa AS INTEGER) AS clean_fa FROM oc")
def event_outcomes(t):
    return static_outcomes(t)


@query(
    "b07_point_scores",
    f"""WITH {INJ_SQL}, f AS (SELECT entity, kind, hr, truth, abs((v - avg(v) OVER w) / (stddev_samp(v) OVER w + 1e-9)) > 3 AS flag FROM inj WINDOW w AS (PARTITION BY entity, kind)),
    c AS (SELECT entity, kind, count(*) FILTER (flag AND truth) AS tp, count(*) FILTER (flag AND NOT truth) AS fp, count(*) FILTER (NOT flag AND truth) AS fn, min(hr) FILTER (flag AND truth) - min(hr) FILTER (truth) AS delay FROM f GROUP BY ALL),
    p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM c)
    SELECT entity, kind, tp, fp, fn, delay, {R('p')} AS precision, {R('r')} AS recall, CASE WHEN p + r > 0 THEN {R('2 * p * r / (p + r)')} END AS f1 FROM p""",
)
def point_scores(t):
    d = bt.inject_series(t.flow, ["entity"], "hr", "v")
    d = det.sigma_flags(d, ["entity", "kind"], "v")
    return rounded(bt.point_scores(d, ["entity", "kind"], "flag", "truth", "hr"))


PRF_COUNTS = "SELECT count(*) FILTER (detected) AS tp, CAST(sum(spike_fp) AS BIGINT) AS fp, count(*) FILTER (NOT detected) AS fn"


@query(
    "b08_precision_recall_f1",
    f"""WITH {STATIC_SQL}, c AS ({PRF_COUNTS} FROM oc), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
    SELECT tp, fp, fn, {R('p')} AS precision, {R('r')} AS recall, CASE WHEN p + r > 0 THEN {R('2 * p * r / (p + r)')} ELSE 0 END AS f1 FROM p""",
)
def precision_recall(t):
    o = static_outcomes(t)
    c = o.agg(F.count_if("detected").alias("tp"), F.sum("spike_fp").alias("fp"), F.count_if(~F.col("detected")).alias("fn"))
    return rounded(bt.prf(c, "tp", "fp", "fn"))


REPLICATES = 2000


def boot_sql(salt: int) -> str:
    return f"""ox AS (SELECT row_number() OVER (ORDER BY trial) - 1 AS idx, * FROM oc), nx AS (SELECT count(*) AS n FROM ox),
    dr AS (SELECT CAST(b AS INTEGER) AS b, {mix_sql('b', 'i', salt)} % n AS idx FROM range({REPLICATES}) r(b), (SELECT idx AS i FROM ox), nx)"""


def numbered(o):
    """Trials numbered from 0 for the bootstrap, written once."""
    return bt.row_index(o, [], ["trial"], "idx")


@query(
    "b09_bootstrap_interval",
    f"""WITH {STATIC_SQL}, {boot_sql(300)}, rs AS (SELECT b, sum(CAST(detected AS INTEGER)) AS tp, sum(spike_fp) AS fp, sum(1 - CAST(detected AS INTEGER)) AS fn FROM dr JOIN ox USING (idx) GROUP BY b),
    f AS (SELECT 2 * tp / (2 * tp + fp + fn) AS f1 FROM rs) SELECT {R('quantile_cont(f1, 0.025)')} AS ci_lo, {R('quantile_cont(f1, 0.975)')} AS ci_hi FROM f""",
)
def bootstrap_interval(t):
    hit = F.col("detected").cast("int")
    o = numbered(static_outcomes(t).withColumns({"tp": hit, "fn": 1 - hit, "fp": F.col("spike_fp")}))
    b = bt.bootstrap(o, "idx", ["tp", "fp", "fn"], lambda d: bt.prf(d, "tp", "fp", "fn"), REPLICATES)
    return rounded(bt.interval(b, "f1"))


PAIRED_SQL = f"""{COUPLED_SQL}, ck AS (SELECT * FROM cs WHERE kind <> 'coupling_break' AND t >= a0 AND t < a1),
oc AS (SELECT trial, count(*) FILTER (age > 4) > 0 AS a, count(*) FILTER (coherence > 4) > 0 AS c, count(*) FILTER (greatest(age, coherence) > 4) > 0 AS f FROM ck GROUP BY trial)"""


@query(
    "b10_paired_bootstrap_gain",
    f"""WITH {PAIRED_SQL}, {boot_sql(310)}, rs AS (SELECT b, avg(CAST(f AS INTEGER)) - greatest(avg(CAST(a AS INTEGER)), avg(CAST(c AS INTEGER))) AS gain FROM dr JOIN ox USING (idx) GROUP BY b)
    SELECT {R('quantile_cont(gain, 0.025)')} AS ci_lo, {R('quantile_cont(gain, 0.975)')} AS ci_hi FROM rs""",
)
def paired_gain(t):
    d = coupled(t).filter((F.col("kind") != "coupling_break") & (F.col("t") >= F.col("a0")) & (F.col("t") < F.col("a1")))
    over = lambda c: F.bool_or(c > 4).cast("int")
    o = d.groupBy("trial").agg(over(F.col("age")).alias("a"), over(F.col("coherence")).alias("c"), over(F.greatest("age", "coherence")).alias("f"))
    gain = lambda x: x.withColumn("gain", (F.col("f") - F.greatest("a", "c")) / F.col("n"))
    return rounded(bt.interval(bt.bootstrap(numbered(o), "idx", ["a", "c", "f"], gain, REPLICATES, salt=310), "gain"))


def labelled(t: Tables):
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id")


@query(
    "b11_roc_auc_average_rank",
    f"""WITH x AS (SELECT lang, n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2 AS r FROM x),
    g AS (SELECT lang, sum(CASE WHEN y = 1 THEN r END) AS rs, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM r GROUP BY lang)
    SELECT lang, CASE WHEN p * q > 0 THEN {R('(rs - p * (p + 1) / 2) / (p * q)')} END AS auc, p AS n_pos, q AS n_neg FROM g""",
)
def auc(t):
    return rounded(bt.roc_auc(labelled(t), ["lang"], "n_chars", "quality"))


@query(
    "b12_roc_auc_trapezoid",
    f"""WITH x AS (SELECT doc_id, n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT y, sum(y) OVER w AS tp, sum(1 - y) OVER w AS fp FROM x WINDOW w AS (ORDER BY s DESC, doc_id)), g AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM x)
    SELECT {R('(SELECT sum(tp) FROM c WHERE y = 0) / (p * q)')} AS auc, p AS n_pos, q AS n_neg FROM g""",
)
def auc_ordered(t):
    return rounded(bt.roc_auc_ordered(labelled(t), [], "n_chars", "quality", "doc_id"))


SWEEP = [1.5, 2.0, 2.5, 3.0, 4.0]


@query(
    "b13_magnitude_sweep",
    f"""WITH RECURSIVE {POOL_SQL}, {timeline_sql('raw', HOURS, 2)}, {PLAN_SQL}, mg AS (SELECT unnest({SWEEP}::DOUBLE[]) AS magnitude),
    evt AS (SELECT trial, magnitude, CAST(t AS BIGINT) AS i, {energy('z + CASE WHEN t >= a0 AND t < a1 THEN magnitude ELSE 0 END - 1')} AS e FROM raw JOIN pe USING (trial), mg), {gate_sql('evt', 'trial, magnitude', '3.94')},
    h AS (SELECT trial, magnitude, min(CASE WHEN closed AND i >= a0 AND i < a1 THEN i - a0 END) AS delay FROM gt JOIN pe USING (trial) GROUP BY ALL)
    SELECT magnitude, {R('count(delay) / count(*)')} AS recall, {R('avg(delay)')} AS mean_delay FROM h GROUP BY magnitude""",
)
def magnitude_sweep(t):
    """All magnitudes run over one copy of the timelines."""
    d = bt.resample(bt.plan_events(trials(t), "trial", HOURS), z_pool(t), "trial", HOURS, salt=2)
    grid = [det.Injection((m,), m) for m in SWEEP]
    h = det.gate_delays(d, ["trial"], "t", "z", "a0", "a1", "magnitude double", grid, close=3.94, two_sided=False, parts=parts(t))
    return h.groupBy("magnitude").agg(rnd(F.count("delay") / F.count("*")).alias("recall"), rnd(F.avg("delay")).alias("mean_delay"))


# Detector streams as SQL over a table (trial, t, z) with thresholds (detector, h_index, h); states hold the alarm f.


def streams_sql(src: str, th: str) -> str:
    def fold(name, det_name, a0, step):
        return f"""{name} AS (SELECT trial, t, h_index, h, CASE WHEN {a0} > h THEN 0 ELSE {a0} END AS a, {a0} > h AS f FROM {src}, {th} WHERE t = 0 AND detector = '{det_name}'
          UNION ALL SELECT trial, t, h_index, h, CASE WHEN a > h THEN 0 ELSE a END, a > h FROM (SELECT s.trial, s.t, g.h_index, g.h, {step} AS a FROM {name} g JOIN {src} s ON s.trial = g.trial AND s.t = g.t + 1))"""

    return f"""{fold('x_ew', 'ewma', '0.3 * z', '0.7 * g.a + 0.3 * s.z')}, {fold('x_cu', 'cusum', 'greatest(0, z - 0.5)', 'greatest(0, g.a + s.z - 0.5)')},
    x_ph AS (SELECT trial, t, h_index, h, 1.0::DOUBLE AS n, z AS mean, -0.1::DOUBLE AS cum, -0.1::DOUBLE AS low, false AS f FROM {src}, {th} WHERE t = 0 AND detector = 'page_hinkley'
      UNION ALL SELECT trial, t, h_index, h, CASE WHEN hit THEN 0 ELSE n END, CASE WHEN hit THEN 0 ELSE mean END, CASE WHEN hit THEN 0 ELSE cum END, CASE WHEN hit THEN 0 ELSE low END, hit FROM
      (SELECT *, cum - low > h AS hit FROM (SELECT *, least(low0, cum) AS low FROM (SELECT *, cum0 + z - mean - 0.1 AS cum FROM
        (SELECT s.trial, s.t, s.z, g.h_index, g.h, g.n + 1 AS n, g.mean + (s.z - g.mean) / (g.n + 1) AS mean, g.cum AS cum0, g.low AS low0 FROM x_ph g JOIN {src} s ON s.trial = g.trial AND s.t = g.t + 1))))),
    x_pb AS (SELECT trial, t, {energy('z - 1')} AS p FROM {src} WHERE t = 0 UNION ALL SELECT s.trial, s.t, 0.85 * g.p + {energy('s.z - 1')} FROM x_pb g JOIN {src} s ON s.trial = g.trial AND s.t = g.t + 1),
    x_gt AS (SELECT trial, t, h_index, h, last_value(CASE WHEN p >= h THEN true WHEN p <= 2.0 THEN false END IGNORE NULLS) OVER (PARTITION BY trial, h_index ORDER BY t) AS l FROM x_pb, {th} WHERE detector = 'gate'),
    x_aw AS (SELECT trial, t, CASE WHEN count(*) OVER o = 24 THEN (avg(z) OVER n - avg(z) OVER o) / (sqrt(var_pop(z) OVER n / 24 + var_pop(z) OVER o / 24) + 1e-9) END AS s FROM {src}
      WINDOW n AS (PARTITION BY trial ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY trial ORDER BY t ROWS BETWEEN 48 PRECEDING AND 25 PRECEDING)),
    x_lv AS (SELECT 'gate' AS detector, trial, t, h_index, h, coalesce(l, false) AS l FROM x_gt UNION ALL SELECT 'adwin', trial, t, h_index, h, coalesce(s > h, false) FROM x_aw, {th} WHERE detector = 'adwin'
      UNION ALL SELECT 'static', trial, t, h_index, h, z > h FROM {src}, {th} WHERE detector = 'static'),
    x_on AS (SELECT detector, trial, t, h_index, h, l AND NOT coalesce(lag(l) OVER (PARTITION BY detector, trial, h_index ORDER BY t), false) AS f FROM x_lv
      UNION ALL SELECT 'ewma', trial, t, h_index, h, f FROM x_ew UNION ALL SELECT 'cusum', trial, t, h_index, h, f FROM x_cu UNION ALL SELECT 'page_hinkley', trial, t, h_index, h, f FROM x_ph)"""


GRID_SQL = f"th AS (SELECT detector, CAST(i AS INTEGER) AS h_index, 0.5::DOUBLE + i * (14.5::DOUBLE / 59) AS h FROM range(60) r(i), (VALUES ('static'), ('ewma'), ('cusum'), ('page_hinkley'), ('adwin'), ('gate')) d(detector))"
MATCH_SQL = f"""ct AS (SELECT detector, h_index, h, trial, count(*) FILTER (f) AS n FROM x_on GROUP BY ALL), ma AS (SELECT detector, h_index, h, avg(n) AS m FROM ct GROUP BY ALL),
best AS (SELECT detector, h_index, h, m FROM (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY round(abs(m - {TARGET}), 9), h_index) AS rk FROM ma) WHERE rk = 1)"""


def matched(t: Tables, pool):
    counts = det.onset_counts(clean_timelines(t, pool), ["trial"], "t", "z", det.DETECTORS, GRID, parts(t))
    return det.matched_threshold(counts, [], TARGET)


@query(
    "g17_matched_false_alarm",
    f"""WITH RECURSIVE {POOL_SQL}, {CLEAN_SQL}, {GRID_SQL}, {streams_sql('clean', 'th')}, {MATCH_SQL} SELECT detector, h_index, {R('h')} AS h, {R('m')} AS mean_onsets FROM best""",
)
def matched_false_alarm(t):
    return rounded(matched(t, z_pool(t)))


FIXED = {"static": 4.1, "ewma": 1.6, "cusum": 7.9, "page_hinkley": 13.3, "adwin": 2.7, "gate": 3.94}
FIXED_SQL = "th AS (SELECT detector, 0 AS h_index, h::DOUBLE AS h FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in FIXED.items()) + ") d(detector, h))"


def benchmark_table(t: Tables, pool, limits: dict):
    o = onset_outcomes(t, pool, limits)
    return o.groupBy("detector").agg(
        rnd(F.avg(F.col("detected").cast("double"))).alias("recall"), rnd(F.percentile("delay", F.lit(0.5))).alias("median_delay"),
        rnd(F.avg("spike_fp")).alias("spike_fp_per_trial"), rnd(F.avg("clean_fa")).alias("clean_fa_per_trial"),
    )


TABLE_SQL = f"""SELECT detector, {R('avg(CAST(detected AS INTEGER))')} AS recall, {R('quantile_cont(delay::DOUBLE, 0.5)')} AS median_delay, {R('avg(spike_fp)')} AS spike_fp_per_trial, {R('avg(clean_fa)')} AS clean_fa_per_trial FROM oc GROUP BY detector"""


@query("b14_benchmark_fixed_thresholds", f"WITH RECURSIVE {POOL_SQL}, {EVENT_SQL}, {FIXED_SQL}, {streams_sql('evt', 'th')}, {outcome_sql('x_on', 'trial, detector')} {TABLE_SQL}")
def benchmark_fixed(t):
    return benchmark_table(t, z_pool(t), FIXED)


@query(
    "b14_benchmark_matched",
    f"""WITH RECURSIVE {POOL_SQL}, {CLEAN_SQL}, {GRID_SQL}, {streams_sql('clean', 'th')}, {MATCH_SQL}, {EVENT_SQL}, th2 AS (SELECT detector, 0 AS h_index, h FROM best),
    {streams_sql('evt', 'th2').replace('x_', 'y_')}, {outcome_sql('y_on', 'trial, detector')} SELECT k.*, {R('best.h')} AS h FROM ({TABLE_SQL}) k JOIN best USING (detector)""",
)
def benchmark_matched(t):
    """Thresholds first matched on clean timelines, then all detectors scored on the same event timelines."""
    pool = z_pool(t)
    h = cut_lineage(matched(t, pool).select("detector", "h"))
    limits = {r["detector"]: r["h"] for r in h.collect()}  # one row for each detector
    return benchmark_table(t, pool, limits).join(h.withColumn("h", rnd("h")), "detector")


def pairs_indexed(t: Tables):
    d = t.merged.dropna(subset=["aud_level", "vid_flow"]).select("entity", "hr", "aud_level", "vid_flow")
    return bt.row_index(d, [], ["entity", "hr"], "idx")


@query(
    "b15_permutation_test",
    f"""WITH {MERGED}, p AS (SELECT row_number() OVER (ORDER BY entity, hr) - 1 AS idx, aud_level AS u, vid_flow AS v FROM merged WHERE aud_level IS NOT NULL AND vid_flow IS NOT NULL),
    s AS (SELECT rep, idx AS i, v, row_number() OVER (PARTITION BY rep ORDER BY {mix_sql('idx', 'rep', 400)}, idx) - 1 AS idx FROM p, range(500) r(rep)),
    n AS (SELECT rep, corr(p.u, s.v) AS r FROM s JOIN p USING (idx) GROUP BY rep), o AS (SELECT corr(u, v) AS r FROM p)
    SELECT {R('(count(*) FILTER (n.r >= o.r) + 1) / (count(*) + 1)')} AS p_value, {R('median(n.r)')} AS null_median, {R('quantile_cont(n.r, 0.95)')} AS null_p95 FROM n, o""",
)
def permutation(t):
    d = pairs_indexed(t)
    null = bt.permutation_null(d, "idx", "aud_level", "vid_flow", 500)
    return rounded(bt.permutation_test(null, d.agg(F.corr("aud_level", "vid_flow").alias("r")), "r"))


PAIR4_SQL = C4_SQL
for k in range(1, 5):
    PAIR4_SQL = PAIR4_SQL.replace(f"e[{k}]", f"{'a' if k < 3 else 'b'}.e[{k}]")


@query(
    "b15_canonical_permutation",
    f"""WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), np AS (SELECT count(*) AS n FROM p),
    s AS (SELECT rep, idx AS i, e, row_number() OVER (PARTITION BY rep ORDER BY {mix_sql('idx', 'rep', 410)}, idx) - 1 AS idx FROM p, range(500) r(rep)),
    nc AS (SELECT rep, {PAIR4_SQL} FROM p a JOIN s b USING (idx) GROUP BY rep), nr AS (SELECT {ROOT_SQL} AS r FROM {CANON_SQL.format('nc')}),
    dr AS (SELECT rep, {mix_sql('rep', 'idx', 411)} % n AS idx FROM p, range(500) r(rep), np), bc AS (SELECT rep, {C4_SQL} FROM dr JOIN p USING (idx) GROUP BY rep), br AS (SELECT {ROOT_SQL} AS r FROM {CANON_SQL.format('bc')}),
    oc AS (SELECT {C4_SQL} FROM p), o AS (SELECT {ROOT_SQL} AS r FROM {CANON_SQL.format('oc')}), q AS (SELECT quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM br)
    SELECT {R('any_value(o.r)', 5)} AS r, {R('(count(*) FILTER (nr.r >= o.r) + 1) / (count(*) + 1)', 5)} AS p_value, {R('median(nr.r)', 5)} AS null_median, {R('quantile_cont(nr.r, 0.95)', 5)} AS null_p95,
      {R('any_value(lo)', 5)} AS lo, {R('any_value(hi)', 5)} AS hi FROM nr, o, q""",
)
def canonical_permutation(t):
    """Two features against two, with the canonical pair fitted anew for each of 500 shuffles and 500 bootstrap samples."""
    return rounded(bt.canonical_test(t.embeddings.select("vec_id", F.slice("embedding", 1, 4).alias("v")), ["vec_id"], "v", 2, 2, 500, 410), 5)


@query(
    "b16_cross_entity_transfer",
    f"""WITH {MERGED}, {BOTH}, jn AS (SELECT b.entity AS entity, p.entity AS fitted_on, hr, (aud_level - ma) / sa AS za, (vid_flow - mv) / sv AS zv, aa, av, vv FROM b
      JOIN (SELECT bs.entity, ma, mv, sa, sv, aa, av, vv FROM bs LEFT JOIN bv USING (entity)) p ON p.entity = (b.entity + 3) % 4),
    sc AS (SELECT entity, fitted_on, hr, sqrt((vv * za * za - 2 * av * za * zv + aa * zv * zv) / nullif(aa * vv - av * av, 0)) AS s FROM jn), q AS (SELECT entity, quantile_cont(s, 0.95) AS thr FROM sc GROUP BY entity)
    SELECT entity, fitted_on, hr, {R('s', 5)} AS score, s > thr AS alarm FROM sc JOIN q USING (entity)""",
)
def transfer(t):
    """Model of one room scores the next room; the threshold is calibrated on the room that is scored."""
    d = t.merged.dropna(subset=["aud_level", "vid_flow"]).filter((F.col("hr") % 24).between(6, 17)).select("entity", "hr", "aud_level", "vid_flow")
    d = cut_lineage(d)
    fit = nz.with_robust_stats(d, ["entity"], ["aud_level", "vid_flow"])
    for c, z in (("aud_level", "za"), ("vid_flow", "zv")):
        fit = fit.withColumn(f"sc_{c}", F.greatest(F.col(f"mad_{c}") * 1.4826, F.lit(1e-9)))
        fit = fit.withColumn(z, (F.col(c) - F.col(f"med_{c}")) / F.col(f"sc_{c}"))
    rad = F.sqrt(F.col("za") * F.col("za") + F.col("zv") * F.col("zv"))
    fit = fit.withColumn("core", rad < F.percentile(rad, F.lit(0.9)).over(Window.partitionBy("entity")))
    a, v = (F.when(F.col("core"), F.col(c)) for c in ("za", "zv"))
    model = fit.groupBy(F.col("entity").alias("fitted_on")).agg(
        *[F.first(c).alias(c) for c in ("med_aud_level", "med_vid_flow", "sc_aud_level", "sc_vid_flow")],
        F.covar_samp(a, a).alias("aa"), F.covar_samp(a, v).alias("av"), F.covar_samp(v, v).alias("vv"),
    )
    d = d.withColumn("fitted_on", (F.col("entity") + 3) % 4).join(model, "fitted_on")
    d = d.withColumn("x", (F.col("aud_level") - F.col("med_aud_level")) / F.col("sc_aud_level"))
    d = d.withColumn("y", (F.col("vid_flow") - F.col("med_vid_flow")) / F.col("sc_vid_flow"))
    q = F.col("vv") * F.col("x") * F.col("x") - F.col("av") * F.col("x") * F.col("y") * 2 + F.col("aa") * F.col("y") * F.col("y")
    d = d.withColumn("s", F.sqrt(safe_div(q, F.col("aa") * F.col("vv") - F.col("av") * F.col("av"))))
    thr = F.percentile("s", F.lit(0.95)).over(Window.partitionBy("entity"))
    return d.withColumn("alarm", F.col("s") > thr).select("entity", "fitted_on", "hr", rnd("s", 5).alias("score"), "alarm")


LONG_HOURS = 320
HAB_SQL = f"""{POOL_SQL}, {timeline_sql('raw', LONG_HOURS, 5)}, m0 AS (SELECT avg(z) AS mu0 FROM pool), cs AS (SELECT mu0, avg(abs(z - mu0)) AS c, stddev_pop(abs(z - mu0)) + 1e-9 AS s FROM pool, m0 GROUP BY mu0),
hb AS (SELECT trial, t, z + CASE WHEN t >= 80 AND t < 300 THEN 7.0 * CASE WHEN {mix_sql('trial', '1', 6)} % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END AS x FROM raw),
ga AS (SELECT * FROM (VALUES (true), (false)) g(gated)),
ob AS (SELECT trial, gated, t, mu0 AS mu, (abs(x - mu0) - c) / s AS score, {energy('(abs(x - mu0) - c) / s - 1')} AS p, false AS closed FROM hb, cs, ga WHERE t = 0
  UNION ALL SELECT trial, gated, t, CASE WHEN t >= 60 AND NOT (gated AND on_) THEN mu + 0.06 * (x - mu) ELSE mu END, score, p, on_ FROM
  (SELECT *, CASE WHEN was THEN p > 2.0 ELSE p >= 6.0 END AS on_ FROM (SELECT *, 0.85 * p0 + {energy('score - 1')} AS p FROM
    (SELECT h.trial, g.gated, h.t, h.x, g.mu, g.p AS p0, g.closed AS was, (abs(h.x - g.mu) - c) / s AS score FROM ob g JOIN hb h ON h.trial = g.trial AND h.t = g.t + 1, cs))))"""


def habituation(t: Tables):
    """Long sustained anomaly of either sign; baseline with and without the gate on its learning."""
    pool = z_pool(t)
    m = pool.agg(F.avg("z").alias("mu0"))
    pool_d = nz.attach(pool, m, [])
    far = F.abs(F.col("z") - F.col("mu0"))
    st = cut_lineage(pool_d.groupBy("mu0").agg(F.avg(far).alias("c"), (F.stddev_pop(far) + 1e-9).alias("s")))
    sign = F.when(mix("trial", F.lit(1), 6) % 2 == 0, 1.0).otherwise(-1.0)
    d = bt.resample(trials(t), pool, "trial", LONG_HOURS, salt=5)
    d = d.withColumn("x", F.col("z") + F.when((F.col("t") >= 80) & (F.col("t") < 300), sign * 7.0).otherwise(0.0))
    d = nz.attach(d.select("trial", "t", "x"), st, [])

    return det.gated_baseline(d, ["trial"], "t", "x", "mu0", "c", "s", [True, False], parts=parts(t, LONG_HOURS)), st


@query("g15_gated_online_baseline", f"WITH RECURSIVE {HAB_SQL} SELECT trial, gated, t, {R('score')} AS score, closed, {R('mu')} AS mu FROM ob")
def gated_online_baseline(t):
    return rounded(habituation(t)[0])


@query(
    "b17_habituation_metrics",
    f"""WITH RECURSIVE {HAB_SQL}, k AS (SELECT trial, gated, avg(CAST(score > 3 AS INTEGER)) FILTER (t >= 80 AND t < 105) AS early, avg(CAST(score > 3 AS INTEGER)) FILTER (t >= 240 AND t < 300) AS late,
      max(CASE WHEN t = 299 THEN abs(mu - (SELECT mu0 FROM m0)) END) AS drift FROM ob GROUP BY ALL)
    SELECT gated, {R('avg(early)')} AS onset_detection, {R('avg(late)')} AS late_detection, {R('quantile_cont(late, 0.025)')} AS late_lo, {R('quantile_cont(late, 0.975)')} AS late_hi, {R('avg(drift)')} AS drift FROM k GROUP BY gated""",
)
def habituation_metrics(t):
    d, st = habituation(t)
    d = d.withColumn("mu0", st.select("mu0").scalar())
    hit, hour = (F.col("score") > 3).cast("double"), F.col("t")
    k = d.groupBy("trial", "gated").agg(
        F.avg(F.when((hour >= 80) & (hour < 105), hit)).alias("early"), F.avg(F.when((hour >= 240) & (hour < 300), hit)).alias("late"),
        F.max(F.when(hour == 299, F.abs(F.col("mu") - F.col("mu0")))).alias("drift"),
    )
    return k.groupBy("gated").agg(
        rnd(F.avg("early")).alias("onset_detection"), rnd(F.avg("late")).alias("late_detection"), rnd(F.percentile("late", F.lit(0.025))).alias("late_lo"),
        rnd(F.percentile("late", F.lit(0.975))).alias("late_hi"), rnd(F.avg("drift")).alias("drift"),
    )


@query(
    "b17_drift_curve",
    f"""WITH RECURSIVE {HAB_SQL} SELECT gated, t, {R('avg(abs(mu))')} AS mean_level, {R('quantile_cont(abs(mu), 0.025)')} AS lo, {R('quantile_cont(abs(mu), 0.975)')} AS hi FROM ob GROUP BY gated, t""",
)
def drift_curve(t):
    from sensorgate.operators.aggregate import with_quantiles

    d, _ = habituation(t)
    size = F.abs("mu")
    d = with_quantiles(cut_lineage(d.select("gated", "t", "mu")), ["gated", "t"], [F.avg(size).alias("mean_level")], {"": size}, [0.025, 0.975], ["lo", "hi"], bounded=False, stored=True)
    return rounded(d.withColumnsRenamed({"_lo": "lo", "_hi": "hi"}))


SWEEP_HOURS = 480
SPIKE_EVERY = (48, 24, 16, 12, 8, 6, 4, 3)
SPIKE_SQL = f"""{POOL_SQL}, {timeline_sql('raw', SWEEP_HOURS, 8)}, m0 AS (SELECT avg(z) AS mu0 FROM pool), cs AS (SELECT mu0, avg(abs(z - mu0)) AS c, stddev_pop(abs(z - mu0)) + 1e-9 AS s FROM pool, m0 GROUP BY mu0),
sd AS (SELECT trial, t, z, CASE WHEN {mix_sql('trial', '1', 9)} % 2 = 0 THEN 1 ELSE -1 END AS sgn FROM raw),
ob AS (SELECT trial, every, gated, t, mu0 AS mu, {energy('(abs(z - mu0) - c) / s - 1')} AS p, false AS closed FROM sd, cs, (SELECT unnest({list(SPIKE_EVERY)}) AS every) e, (VALUES (true), (false)) g(gated) WHERE t = 0
  UNION ALL SELECT trial, every, gated, t, CASE WHEN t >= 60 AND NOT (gated AND on_) THEN mu + 0.06 * (x - mu) ELSE mu END, p, on_ FROM
  (SELECT *, CASE WHEN was THEN p > 2.0 ELSE p >= 6.0 END AS on_ FROM (SELECT *, 0.85 * p0 + {energy('(abs(x - mu) - c) / s - 1')} AS p FROM
    (SELECT h.trial, g.every, g.gated, h.t, h.z + CASE WHEN h.t >= 80 AND h.t < {SWEEP_HOURS - 1} AND (h.t - 80) % g.every = 0 THEN 8.0 * sgn ELSE 0 END AS x, g.mu, g.p AS p0, g.closed AS was, c, s
      FROM ob g JOIN sd h ON h.trial = g.trial AND h.t = g.t + 1, cs))))"""


@query(
    "b17_spike_frequency",
    f"""WITH RECURSIVE {SPIKE_SQL}, k AS (SELECT trial, every, gated, avg((mu - mu0) * sgn) / 8 AS f FROM ob JOIN sd USING (trial, t), m0 WHERE t >= {SWEEP_HOURS // 2} GROUP BY ALL)
    SELECT every, gated, {R('24.0 / every')} AS spikes_per_day, {R('avg(f)')} AS shift, {R('quantile_cont(f, 0.025)')} AS lo, {R('quantile_cont(f, 0.975)')} AS hi FROM k GROUP BY every, gated""",
)
def spike_frequency(t):
    """How far brief spikes, ever more of them, pull the baseline along: its mean shift in spike heights over the second half."""
    pool = z_pool(t)
    pool_d = nz.attach(pool, pool.agg(F.avg("z").alias("mu0")), [])
    far = F.abs(F.col("z") - F.col("mu0"))
    st = cut_lineage(pool_d.groupBy("mu0").agg(F.avg(far).alias("c"), (F.stddev_pop(far) + 1e-9).alias("s")))
    m = st.first()
    d = bt.resample(trials(t), pool, "trial", SWEEP_HOURS, salt=8)
    d = d.withColumn("sgn", F.when(mix("trial", F.lit(1), 9) % 2 == 0, 1.0).otherwise(-1.0))
    if m is None:
        m = {"mu0": 0.0, "c": 0.0, "s": 1.0}  # no clean score: no timelines
    k = det.spiked_baseline(
        d, ["trial"], "t", "z", "sgn", m["mu0"], m["c"], m["s"], SPIKE_EVERY, 8.0, 80, SWEEP_HOURS - 1, SWEEP_HOURS // 2, parts=parts(t, SWEEP_HOURS)
    )
    return k.groupBy("every", "gated").agg(
        rnd(F.first(F.lit(24.0) / F.col("every"))).alias("spikes_per_day"), rnd(F.avg("shift")).alias("shift"), rnd(F.percentile("shift", F.lit(0.025))).alias("lo"), rnd(F.percentile("shift", F.lit(0.975))).alias("hi")
    )


EVENT_SPAN_SQL = f"""{MERGED}, {CHAN_SQL}, dl AS (SELECT entity, hr // 24 AS dy, avg(coupled) AS m FROM ch GROUP BY ALL), pk AS (SELECT entity, arg_max(dy, m) AS dy FROM dl GROUP BY entity),
nm AS (SELECT ch.*, row_number() OVER (PARTITION BY entity ORDER BY hr) - 1 AS i, hr // 24 = pk.dy AS is_event FROM ch JOIN pk USING (entity)),
sn AS (SELECT entity, min(i) AS a0, max(i) + 1 AS a1 FROM nm WHERE is_event GROUP BY entity)"""


@query(
    "b19_real_event_scoring",
    f"""WITH RECURSIVE {EVENT_SPAN_SQL}, en AS (SELECT entity, i, {energy('coupled - 1')} AS e FROM nm), {gate_sql('en', 'entity', '2.71')},
    o AS (SELECT entity, i, closed AND NOT coalesce(lag(closed) OVER (PARTITION BY entity ORDER BY i), false) AS f FROM gt),
    h AS (SELECT o.entity, min(i) FILTER (f) AS first_hit, any_value(a0) AS a0, any_value(a1) AS a1 FROM o JOIN sn ON sn.entity = o.entity AND i >= a0 AND i < a1 GROUP BY o.entity),
    e AS (SELECT nm.entity, max(age) / 2.5 AS a, max(coherence) / 3.1 AS c FROM nm JOIN sn ON sn.entity = nm.entity AND i >= a0 AND i < a1 GROUP BY nm.entity)
    SELECT h.entity, a0, a1, first_hit IS NOT NULL AS detected, first_hit - a0 AS delay, {R('a')} AS age_evidence, {R('c')} AS coherence_evidence, CASE WHEN a > c THEN 'magnitude' ELSE 'incoherence' END AS cause FROM h JOIN e USING (entity)""",
)
def real_event(t):
    """The marked event of a room is its day of largest coupled score; its span runs from first to last marked row."""
    d = cut_lineage(channels(t))
    daily = d.groupBy("entity", F.expr("hr div 24").alias("dy")).agg(F.avg("coupled").alias("m"))
    peak = daily.groupBy("entity").agg(F.max_by("dy", "m").alias("peak"))
    d = d.join(peak, "entity").withColumn("i", (F.row_number().over(ts.by_key(["entity"], "hr")) - 1).cast("long"))
    mark = F.when(F.expr("hr div 24") == F.col("peak"), F.col("i"))
    whole = Window.partitionBy("entity")
    d = d.withColumns({"a0": F.min(mark).over(whole), "a1": F.max(mark).over(whole) + 1})
    on = det.gate_onsets(d, ["entity"], "i", "coupled", 2.71)
    inside = (F.col("i") >= F.col("a0")) & (F.col("i") < F.col("a1"))
    ev = attribute(d.filter(inside), ["entity"], 2.5, 3.1)
    hit = on.groupBy("entity").agg(F.first("a0").alias("a0"), F.first("a1").alias("a1"), F.min(F.when(F.col("onset") & inside, F.col("i"))).alias("first_hit"))
    out = hit.join(ev, "entity").withColumns({"detected": F.col("first_hit").isNotNull(), "delay": F.col("first_hit") - F.col("a0")})
    return rounded(out.drop("first_hit"))


@query(
    "b11_injection_auc",
    f"""WITH {MERGED}, {BOTH}, pm AS (SELECT entity, hr, za, zv, aa, av, vv FROM mh JOIN bv USING (entity)),
    sc AS (SELECT entity, CAST(y AS INTEGER) AS y, sqrt((vv * x * x - 2 * av * x * w + aa * w * w) / nullif(aa * vv - av * av, 0)) AS s FROM
      (SELECT entity, y, aa, av, vv, za + y * 2.0 * CASE WHEN {mix_sql('hr', 'entity', 8)} % 2 = 0 THEN 1 ELSE -1 END AS x, zv + y * 2.0 * CASE WHEN {mix_sql('hr', 'entity', 9)} % 2 = 0 THEN 1 ELSE -1 END AS w FROM pm, range(2) r(y))),
    r AS (SELECT entity, y, rank() OVER (PARTITION BY entity ORDER BY s) + (count(*) OVER (PARTITION BY entity, s) - 1) / 2 AS r FROM sc),
    g AS (SELECT entity, sum(CASE WHEN y = 1 THEN r END) AS rs, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM r GROUP BY entity) SELECT entity, {R('(rs - p * (p + 1) / 2) / (p * q)')} AS auc FROM g""",
)
def injection_auc(t):
    """Clean rows against the same rows moved by two units per feature, random sign per row and feature."""
    d = cut_lineage(joint(t))
    rad = F.sqrt(F.col("za") * F.col("za") + F.col("zv") * F.col("zv"))
    w = Window.partitionBy("entity")
    core = rad < F.percentile(rad, F.lit(0.9)).over(w)
    d = d.withColumn("core", core)
    a, v = (F.when(F.col("core"), F.col(c)) for c in ("za", "zv"))
    d = d.withColumns({n: F.covar_samp(p, q).over(w) for n, p, q in (("aa", a, a), ("av", a, v), ("vv", v, v))})
    d = d.withColumn("y", F.explode(F.array(F.lit(0), F.lit(1))))
    sign = lambda s: F.when(mix("hr", "entity", s) % 2 == 0, 1.0).otherwise(-1.0)
    d = d.withColumns({"x": F.col("za") + F.col("y") * 2.0 * sign(8), "w": F.col("zv") + F.col("y") * 2.0 * sign(9)})
    q = F.col("vv") * F.col("x") * F.col("x") - F.col("av") * F.col("x") * F.col("w") * 2 + F.col("aa") * F.col("w") * F.col("w")
    d = d.withColumn("s", F.sqrt(safe_div(q, F.col("aa") * F.col("vv") - F.col("av") * F.col("av"))))
    return rounded(bt.roc_auc(d, ["entity"], "s", "y").select("entity", "auc"))
