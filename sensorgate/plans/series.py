"""Gaps, sessions, rolling windows and the slow/fast decomposition."""

from pyspark.sql import functions as F

from sensorgate.functions.exprs import MICROS_PER_HOUR, rnd
from sensorgate.operators import timeseries as ts
from sensorgate.operators.align import complete_grid
from sensorgate.operators.ordered import row_index
from sensorgate.operators.scan import with_halo
from sensorgate.plans.common import EV, FLOW, GRID, MERGED, MODAL, R, Tables, query
from sensorgate.session import cut_lineage
from sensorgate.plans.rollups import FILES_SQL, rounded, video_files

E = ["entity"]


@query("w01_hours_since_previous", f"WITH {MODAL} SELECT entity, hr, {R('(hr - lag(hr) OVER (PARTITION BY entity ORDER BY hr)) / 1.0')} AS gap_hours FROM vid")
def since_previous(t):
    return ts.step_since_previous(t.vid, E, "hr", "gap_hours").select("entity", "hr", rnd("gap_hours").alias("gap_hours"))


@query(
    "w02_gap_list",
    f"""WITH {EV}, g AS (SELECT user_id, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap_start, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM ev)
    SELECT user_id, gap_start, {R('gap / 3600000000')} AS gap_hours FROM g WHERE gap > 7200000000""",
)
def gap_list(t):
    d = ts.gap_list(t.ev, ["user_id"], "us", 2 * MICROS_PER_HOUR)
    return d.select("user_id", "gap_start", rnd(F.col("gap") / MICROS_PER_HOUR).alias("gap_hours"))


@query(
    "w03_gap_segments",
    f"""WITH {MODAL}, g AS (SELECT entity, hr, hr - lag(hr) OVER (PARTITION BY entity ORDER BY hr) AS gap FROM vid)
    SELECT entity, hr, CAST(sum(CASE WHEN gap > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY hr) AS BIGINT) AS segment_id FROM g""",
)
def gap_segments(t):
    return ts.segments(t.vid, E, "hr", 6).select("entity", "hr", "segment_id")


RUNS_SQL = f"""{FILES_SQL}, ch AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR created IS DISTINCT FROM lag(created) OVER w THEN 1 ELSE 0 END AS c FROM fl WINDOW w AS (PARTITION BY folder ORDER BY seq)),
runs AS (SELECT *, CAST(sum(c) OVER (PARTITION BY folder ORDER BY seq) AS BIGINT) AS run FROM ch)"""


def session_rows(t: Tables):
    return ts.equal_runs(video_files(t), ["folder"], ["seq"], "created", "run")


@query("w04_equal_value_runs", f"WITH {RUNS_SQL} SELECT folder, seq, run FROM runs")
def equal_runs(t):
    return session_rows(t).select("folder", "seq", F.col("run").cast("long").alias("run"))


ROLL_SQL = f"""{RUNS_SQL}, pv AS (SELECT *, last_value(tod IGNORE NULLS) OVER (PARTITION BY folder ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt FROM runs),
rl AS (SELECT *, sum(CASE WHEN tod < pt THEN 1 ELSE 0 END) OVER (PARTITION BY folder ORDER BY seq) AS days FROM pv),
bs AS (SELECT folder, arg_min(created, seq) FILTER (created IS NOT NULL) AS base FROM fl GROUP BY folder),
st AS (SELECT rl.*, epoch_us(CAST(base AS TIMESTAMP)) + CAST(days AS BIGINT) * 86400000000 + CAST(tod * 1e6 AS BIGINT) AS start_us FROM rl JOIN bs USING (folder))"""


def started(t: Tables):
    d = ts.midnight_rollover(video_files(t), ["folder"], ["seq"], "tod", "created", "start", run="run")
    return cut_lineage(d.withColumn("start_us", F.unix_micros("start")))  # read again by each check


@query("w05_midnight_rollover", f"WITH {ROLL_SQL} SELECT folder, seq, start_us FROM st")
def rollover(t):
    return started(t).select("folder", "seq", "start_us")


CHECK_SQL = f"""{ROLL_SQL}, sv AS (SELECT *, CASE WHEN readable THEN start_us END AS t FROM st),
sp AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY folder, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM sv),
ck AS (SELECT folder, run, count(*) AS n_files, count(*) FILTER (readable) AS n_readable, count(DISTINCT created) FILTER (readable) AS unique_creation_time,
  count(*) FILTER ((t - p) / 60000000 <= 0) = 0 AS monotonic, count(t) <> count(DISTINCT t) AS duplicates, count(*) FILTER ((t - p) / 60000000 > 90) AS n_irregular_gaps,
  max((t - p) / 60000000) AS max_gap_min, arg_min(t, seq) FILTER (t IS NOT NULL) AS session_start_us, arg_max(t, seq) FILTER (t IS NOT NULL) AS session_end_us FROM sp GROUP BY ALL),
cf AS (SELECT *, (unique_creation_time = 1 AND n_readable > 1) OR n_readable <= 1 AS clock_frozen_as_expected FROM ck),
an AS (SELECT *, NOT clock_frozen_as_expected OR NOT monotonic OR duplicates OR n_irregular_gaps > 0 AS anomaly FROM cf)"""


def checked(rows):
    return ts.session_checks(rows, ["folder"], ["seq"], "run", "start", "created", "readable")


@query(
    "w06_session_checks",
    f"""WITH {CHECK_SQL} SELECT folder, run, n_files, n_readable, unique_creation_time, monotonic, duplicates, n_irregular_gaps, {R('max_gap_min')} AS max_gap_min,
    session_start_us, session_end_us, clock_frozen_as_expected, anomaly FROM an""",
)
def session_checks(t):
    d = checked(started(t)).withColumn("run", F.col("run").cast("long"))
    return d.withColumn("max_gap_min", rnd("max_gap_min"))


@query(
    "a14_folder_audit",
    f"""WITH {CHECK_SQL}, f AS (SELECT folder, count(*) FILTER (NOT readable) AS unreadable, count(*) FILTER (readable AND tod IS NULL) AS no_timecode, min(start_us) AS earliest, max(start_us) AS latest FROM st GROUP BY folder),
    a AS (SELECT folder, CAST(sum(n_files) AS BIGINT) AS n_files, count(*) AS n_sessions, count(*) FILTER (anomaly) AS n_anomalous FROM an GROUP BY folder)
    SELECT * FROM a JOIN f USING (folder) WHERE n_anomalous > 0 OR unreadable > 0 OR no_timecode > 0""",
)
def folder_audit(t):
    """Roll-up of sessions and files per folder; only folders with a problem remain."""
    ok = F.col("readable")
    rows = started(t)
    files = rows.groupBy("folder").agg(
        F.count_if(~ok).alias("unreadable"), F.count_if(ok & F.col("tod").isNull()).alias("no_timecode"), F.min("start_us").alias("earliest"), F.max("start_us").alias("latest")
    )
    sess = checked(rows).groupBy("folder").agg(F.sum("n_files").alias("n_files"), F.count("*").alias("n_sessions"), F.count_if("anomaly").alias("n_anomalous"))
    d = sess.join(files, "folder")
    return d.filter((F.col("n_anomalous") > 0) | (F.col("unreadable") > 0) | (F.col("no_timecode") > 0))


@query(
    "w07_missing_islands",
    f"""WITH {MERGED}, m AS (SELECT entity, hr, hr - row_number() OVER (PARTITION BY entity ORDER BY hr) AS g FROM merged WHERE vid_flow IS NULL)
    SELECT entity, min(hr) AS run_start, max(hr) AS run_end, count(*) AS run_hours FROM m GROUP BY entity, g HAVING count(*) >= 6""",
)
def missing_islands(t):
    return ts.islands(t.merged, E, "hr", F.col("vid_flow").isNull(), 6)


MED_FRAME = "(PARTITION BY entity ORDER BY hr RANGE BETWEEN 83 PRECEDING AND 84 FOLLOWING)"


@query(
    "w08_rolling_median_time",
    f"WITH {FLOW} SELECT entity, hr, CASE WHEN count(v) OVER {MED_FRAME} >= 3 THEN {R(f'quantile_cont(v, 0.5) OVER {MED_FRAME}')} END AS trend FROM flow",
)
def rolling_median(t):
    return ts.rolling_median_time(t.flow, E, "hr", "v", "trend", 168, 3).select("entity", "hr", rnd("trend").alias("trend"))


def interp_sql(src: str, col: str, out: str, name: str, keys: str = "entity", time: str = "hr") -> str:
    w = f"(PARTITION BY {keys} ORDER BY {time} ROWS BETWEEN"
    return f"""{name}_e AS (SELECT *, last_value(CASE WHEN {col} IS NOT NULL THEN {time} END IGNORE NULLS) OVER {w} UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
      last_value({col} IGNORE NULLS) OVER {w} UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
      first_value(CASE WHEN {col} IS NOT NULL THEN {time} END IGNORE NULLS) OVER {w} CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1,
      first_value({col} IGNORE NULLS) OVER {w} CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM {src}),
    {name} AS (SELECT * EXCLUDE (t0, v0, t1, v1), CASE WHEN {col} IS NOT NULL THEN {col} WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0
      ELSE v0 + (v1 - v0) * ({time} - t0) / (t1 - t0) END AS {out} FROM {name}_e)"""


@query("w09_time_interpolation", f"WITH {MERGED}, {interp_sql('merged', 'vid_flow', 'filled', 'ip')} SELECT entity, hr, {R('filled')} AS filled FROM ip")
def interpolation(t):
    return ts.interpolate_time(t.merged, E, "hr", "vid_flow", "filled").select("entity", "hr", rnd("filled").alias("filled"))


def profile_sql(src: str, col: str, fill: bool) -> str:
    base = f"""pg AS (SELECT entity, CAST(unnest(range(0, 24)) AS INTEGER) AS h FROM (SELECT DISTINCT entity FROM {src})),
    pm AS (SELECT pg.entity, pg.h, m FROM pg LEFT JOIN (SELECT entity, CAST(hr % 24 AS INTEGER) AS h, avg({col}) AS m FROM {src} GROUP BY ALL) x ON x.entity = pg.entity AND x.h = pg.h)"""
    if fill:
        base += ", " + interp_sql("pm", "m", "mm", "pf", time="h")
    else:
        base += ", pf AS (SELECT entity, h, m AS mm FROM pm)"
    return base + """, prof AS (SELECT entity, h AS hod, diurnal FROM (SELECT a.entity, a.h, avg(b.mm) AS diurnal FROM pf a JOIN pf b ON a.entity = b.entity AND (b.h - a.h + 25) % 24 <= 2 GROUP BY ALL))"""


@query("w10_diurnal_profile", f"WITH {FLOW}, {profile_sql('flow', 'v', True)} SELECT entity, hod, {R('diurnal')} AS diurnal FROM prof")
def diurnal(t):
    d = t.flow.withColumn("hod", (F.col("hr") % 24).cast("int"))
    return rounded(ts.diurnal_profile(d, E, "hod", "v", fill=True))


def slow_fast_sql(variant: str) -> str:
    if variant == "a":
        return f"""{FLOW}, md AS (SELECT entity, hr, v, n, CASE WHEN count(v) OVER {MED_FRAME} >= 3 THEN quantile_cont(v, 0.5) OVER {MED_FRAME} END AS tr FROM flow),
        {interp_sql('md', 'tr', 'trend', 'ti')}, dt AS (SELECT entity, hr, v, n, trend, v - trend AS det FROM ti), {profile_sql('dt', 'det', True)},
        sf AS (SELECT dt.entity, hr, v, n, trend, diurnal, trend + diurnal AS slow, v - (trend + diurnal) AS fast_residual FROM dt JOIN prof ON prof.entity = dt.entity AND prof.hod = hr % 24)"""
    return f"""{GRID}, md AS (SELECT entity, hr, v, n, CASE WHEN count(v) OVER {MED_FRAME} >= 33 THEN quantile_cont(v, 0.5) OVER {MED_FRAME} END AS trend FROM grid),
    dt AS (SELECT entity, hr, v, n, trend, v - trend AS det FROM md), {profile_sql('dt', 'det', False)},
    sf AS (SELECT dt.entity, hr, v, n, trend, diurnal, trend + diurnal AS slow, v - (trend + diurnal) AS fast_residual FROM dt JOIN prof ON prof.entity = dt.entity AND prof.hod = hr % 24)"""


SF_COLS = ", ".join(f"{R(c)} AS {c}" for c in ("v", "trend", "diurnal", "slow", "fast_residual"))


@query("w11_slow_fast_variant_a", f"WITH {slow_fast_sql('a')} SELECT entity, hr, n, {SF_COLS} FROM sf")
def slow_fast_a(t):
    return rounded(ts.slow_fast(t.flow, E, "hr", "v"))


@query("w11_slow_fast_variant_b", f"WITH {slow_fast_sql('b')} SELECT entity, hr, n, {SF_COLS}, {R('slow + fast_residual')} AS reconstructed FROM sf")
def slow_fast_b(t):
    return rounded(ts.slow_fast(t.flow, E, "hr", "v", variant="b"))


@query(
    "w12_rolling_median_rows",
    f"""WITH {FLOW} SELECT entity, hr, CASE WHEN count(v) OVER a >= 10 THEN {R('quantile_cont(v, 0.5) OVER a')} END AS base200 FROM flow
    WINDOW a AS (PARTITION BY entity ORDER BY hr ROWS BETWEEN 100 PRECEDING AND 99 FOLLOWING)""",
)
def median_rows(t):
    return ts.rolling_median_rows(t.flow, E, ["hr"], "v", "base200", 200, 10).select("entity", "hr", rnd("base200").alias("base200"))


@query(
    "w12_rolling_median_raw_frames",
    f"""WITH {EV} SELECT event_id, CASE WHEN count(value) OVER a >= 5 THEN {R('quantile_cont(value, 0.5) OVER a')} END AS base50 FROM ev
    WINDOW a AS (PARTITION BY entity ORDER BY us, event_id ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)""",
)
def median_raw(t):
    """Raw frames of one room may be any number, so they are cut in numbered blocks with borders copied over."""
    d = row_index(t.ev.select("event_id", "entity", "us", "value"), E, ["us", "event_id"], "i")
    d = with_halo(d, "i", 4096, 25, 24)
    d = ts.rolling_median_rows(d, [*E, "_blk"], ["i"], "value", "base50", 50, 5)
    return d.filter("_core").select("event_id", rnd("base50").alias("base50"))


DAILY_SQL = """dl AS (SELECT o_orderpriority AS room, CAST(o_orderdate AS DATE) AS day, min(o_totalprice) / 9973 AS temp_am_min_c, max(o_totalprice) / 9973 AS temp_am_max_c,
  avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / 9973 AS temp_pm_c, avg(CASE WHEN o_orderstatus = 'O' THEN o_custkey END) / 13 AS rh_am_pct, avg(o_custkey) / 13 AS rh_pm_pct FROM orders GROUP BY ALL)"""


def daily_readings(t: Tables):
    price, cust, status = F.col("o_totalprice"), F.col("o_custkey"), F.col("o_orderstatus")
    return t.orders.groupBy(F.col("o_orderpriority").alias("room"), F.col("o_orderdate").cast("date").alias("day")).agg(
        (F.min(price) / 9973).alias("temp_am_min_c"), (F.max(price) / 9973).alias("temp_am_max_c"), (F.avg(F.when(status == "F", price)) / 9973).alias("temp_pm_c"),
        (F.avg(F.when(status == "O", cust)) / 13).alias("rh_am_pct"), (F.avg(cust) / 13).alias("rh_pm_pct"),
    )


ENV_SQL = f"""{DAILY_SQL}, dm AS (SELECT *, list_avg(list_filter([temp_am_min_c, temp_am_max_c, temp_pm_c], lambda x: x IS NOT NULL)) AS tm, list_avg(list_filter([rh_am_pct, rh_pm_pct], lambda x: x IS NOT NULL)) AS rm FROM dl)"""


@query(
    "w13_rolling_mean_centred",
    f"""WITH {ENV_SQL} SELECT room, day, {R('avg(tm) OVER w')} AS temp_roll_mean_c, {R('avg(rm) OVER w')} AS rh_roll_mean_pct FROM dm
    WINDOW w AS (PARTITION BY room ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
)
def rolling_mean(t):
    d = ts.environment_features(daily_readings(t), ["room"], "day")
    return rounded(d.select("room", "day", "temp_roll_mean_c", "rh_roll_mean_pct"))


@query(
    "w14_rolling_slope_centred",
    f"""WITH {DAILY_SQL}, l AS (SELECT room, day, list(temp_pm_c) FILTER (temp_pm_c IS NOT NULL) OVER (PARTITION BY room ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS y FROM dl),
    k AS (SELECT room, day, y, len(y) AS n FROM l)
    SELECT room, day, CASE WHEN n >= 2 THEN {R('list_sum([(i - 1 - (n - 1) / 2) * y[i] for i in range(1, n + 1)]) / (n * (n * n - 1) / 12)')} END AS slope FROM k""",
)
def slope_centred(t):
    return ts.rolling_slope_centred(daily_readings(t), ["room"], ["day"], "temp_pm_c", "slope").select("room", "day", rnd("slope").alias("slope"))


@query(
    "w14_rolling_slope_trailing",
    f"""WITH {DAILY_SQL}, r AS (SELECT room, day, temp_pm_c, CASE WHEN temp_pm_c IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY room ORDER BY day) AS DOUBLE) END AS rn FROM dl)
    SELECT room, day, {R('covar_samp(temp_pm_c, rn) OVER w / nullif(var_pop(rn) OVER w, 0)')} AS slope FROM r WINDOW w AS (PARTITION BY room ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def slope_trailing(t):
    return ts.rolling_slope_trailing(daily_readings(t), ["room"], "day", "temp_pm_c", "slope").select("room", "day", rnd("slope").alias("slope"))


@query(
    "w15_first_difference_extremes",
    f"""WITH {ENV_SQL}, d AS (SELECT room, day, tm - lag(tm) OVER (PARTITION BY room ORDER BY day) AS rate FROM dm)
    SELECT room, arg_max(day, rate) AS rise_day, {R('max(rate)')} AS rise, arg_min(day, rate) AS crash_day, {R('min(rate)')} AS crash FROM d GROUP BY room""",
)
def extremes(t):
    d = ts.environment_features(daily_readings(t), ["room"], "day")
    rate = F.col("temp_rate_c_per_day")
    return d.groupBy("room").agg(
        F.max_by("day", rate).alias("rise_day"), rnd(F.max(rate)).alias("rise"), F.min_by("day", rate).alias("crash_day"), rnd(F.min(rate)).alias("crash")
    )


@query(
    "w16_environment_derivations",
    f"""WITH {ENV_SQL} SELECT room, day, CAST(day - min(day) OVER (PARTITION BY room) AS INTEGER) AS day_index, {R('tm')} AS temp_day_mean_c, {R('temp_am_max_c - temp_am_min_c')} AS temp_am_range_c,
      {R('temp_pm_c - (temp_am_min_c + temp_am_max_c) / 2')} AS temp_am_pm_swing_c, {R('rm')} AS rh_day_mean_pct, {R('rh_pm_pct - rh_am_pct')} AS rh_am_pm_change_pct,
      {R('tm - lag(tm) OVER w')} AS temp_rate_c_per_day, {R('rm - lag(rm) OVER w')} AS rh_rate_pct_per_day FROM dm WINDOW w AS (PARTITION BY room ORDER BY day)""",
)
def environment(t):
    d = ts.environment_features(daily_readings(t), ["room"], "day")
    cols = ["temp_day_mean_c", "temp_am_range_c", "temp_am_pm_swing_c", "rh_day_mean_pct", "rh_am_pm_change_pct", "temp_rate_c_per_day", "rh_rate_pct_per_day"]
    return rounded(d.select("room", "day", "day_index", *cols))


ADJ_SQL = """SELECT entity, hr, CASE WHEN count(*) OVER o = 24 THEN (avg(v) OVER n - avg(v) OVER o) / (sqrt(var_pop(v) OVER n / 24 + var_pop(v) OVER o / 24) + 1e-9) END AS z FROM flow
  WINDOW n AS (PARTITION BY entity ORDER BY hr ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY entity ORDER BY hr ROWS BETWEEN 48 PRECEDING AND 25 PRECEDING)"""


@query("w17_adjacent_window_z", f"WITH {FLOW}, z AS ({ADJ_SQL}) SELECT entity, hr, {R('z')} AS z FROM z")
def adjacent(t):
    return ts.adjacent_windows_z(t.flow, E, "hr", "v", "z").select("entity", "hr", rnd("z").alias("z"))


@query(
    "w18_centred_window_scores",
    f"""WITH {FLOW}, a AS (SELECT entity, hr, CASE WHEN count(*) OVER w = 24 THEN stddev_pop(v) OVER w END AS s FROM flow WINDOW w AS (PARTITION BY entity ORDER BY hr ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)),
    {interp_sql('a', 's', 'score', 'ip')} SELECT entity, hr, {R('score')} AS score FROM ip""",
)
def centred_windows(t):
    """Spread of the 24 values around each row; ends without a whole window take the nearest score."""
    from sensorgate.functions.arrays import array_sum

    d = ts.window_arrays(t.flow, E, "hr", "v", "win")
    mean = array_sum("win") / 24
    d = d.withColumn("s", F.sqrt(array_sum("win", lambda x: (x - mean) * (x - mean)) / 24)).drop("win")
    return ts.interpolate_time(d, E, "hr", "s", "score").select("entity", "hr", rnd("score").alias("score"))


@query(
    "w19_lag_correlation_profile",
    f"""WITH {MERGED}, b AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY hr) AS rn, aud_level AS u, vid_flow AS w FROM merged WHERE aud_level IS NOT NULL AND vid_flow IS NOT NULL),
    l AS (SELECT CAST(unnest(range(-8, 9)) AS INTEGER) AS lag)
    SELECT x.entity, lag, {R('corr(x.u, y.w)')} AS r, count(*) AS n FROM b y, l JOIN b x ON x.rn = y.rn + lag AND x.entity = y.entity GROUP BY ALL""",
)
def lag_profile(t):
    d = t.merged.dropna(subset=["aud_level", "vid_flow"])
    return rounded(ts.lag_profile(d, E, "hr", "aud_level", "vid_flow"))


@query(
    "w20_rising_edge",
    f"""WITH {FLOW}, x AS (SELECT entity, hr, v > 80 AS l FROM flow) SELECT entity, hr, l AND NOT coalesce(lag(l) OVER (PARTITION BY entity ORDER BY hr), false) AS onset FROM x""",
)
def rising_edge(t):
    return ts.rising(t.flow, E, "hr", F.col("v") > 80, "onset").select("entity", "hr", "onset")


@query(
    "w21_first_hit_delay",
    f"""WITH {FLOW}, x AS (SELECT entity, hr // 24 AS dy, hr, v > 80 AS a FROM flow) SELECT entity, dy, min(CASE WHEN a THEN hr END) AS first_hit, min(CASE WHEN a THEN hr END) - dy * 24 AS delay FROM x GROUP BY entity, dy""",
)
def first_hit(t):
    from sensorgate.operators.backtest import first_hit as hit

    d = t.flow.withColumn("dy", F.expr("hr div 24")).withColumns({"a0": F.col("dy") * 24, "a1": F.col("dy") * 24 + 24, "alarm": F.col("v") > 80})
    return hit(d, ["entity", "dy"], "alarm", "hr")


W22_SQL = """oc AS (SELECT entity, hr, v, hr % 24 AS hod, row_number() OVER (PARTITION BY entity, hr % 24 ORDER BY hr) AS i FROM flow),
ew AS (SELECT entity, hod, i, hr, v, CAST(NULL AS DOUBLE) AS pred, v AS s FROM oc WHERE i = 1
  UNION ALL SELECT o.entity, o.hod, o.i, o.hr, o.v, e.s, 0.8 * e.s + 0.2 * o.v FROM ew e JOIN oc o ON o.entity = e.entity AND o.hod = e.hod AND o.i = e.i + 1)"""


@query("w22_causal_hour_ewma", f"WITH RECURSIVE {FLOW}, {W22_SQL} SELECT entity, hr, {R('pred')} AS prediction, {R('v - pred')} AS residual FROM ew")
def causal_ewma(t):
    d = ts.causal_hour_ewma(t.flow, E, "hr", "v", "prediction")
    return d.select("entity", "hr", rnd("prediction").alias("prediction"), rnd(F.col("v") - F.col("prediction")).alias("residual"))
