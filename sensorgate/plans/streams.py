"""Streaming twins of the causal operators, run over all available input; their oracles are the batch results."""

from pyspark.sql import functions as F

from sensorgate.functions.exprs import rnd
from sensorgate.operators import normalize as nz
from sensorgate.plans.alarms import CUSUM_SQL, EWMA_SQL, PH_H, PH_SQL, ZROWS, Z_SQL, energy, gate_sql, z_rows
from sensorgate.plans.common import EV, FLOW, GRID, R, Tables, query
from sensorgate.plans.series import W22_SQL
from sensorgate.session import scratch_path
from sensorgate.sources.readers import write_parquet
from sensorgate.streaming import stateful as st


def event_stream(t: Tables):
    d = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet")
    return d.withColumns({"ts": F.col("ts").cast("timestamp"), "entity": F.col("user_id") % 4})


def as_stream(t: Tables, df, name: str):
    path = scratch_path(t.spark, name)
    write_parquet(df, path)
    return t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(path)


def run(t: Tables, stream, build, name: str, ts: str = "ts", delay: str = "2 hours"):
    return st.run_to_end(stream, ts, delay, build, scratch_path(t.spark, name), complete=True)


def with_clock(df):
    """Hours since the epoch as the event time."""
    return df.withColumn("ts", F.timestamp_seconds(F.col("hr") * 3600))


@query(
    "t01_stream_hourly_rollup",
    f"""WITH {EV}, h AS (SELECT entity, hr, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM ev GROUP BY ALL)
    SELECT entity, make_timestamp(hr * 3600000000) AS hour, {R('mean')} AS mean, {R('std')} AS std, n FROM h""",
)
def stream_rollup(t):
    """All hours: those that the watermark passed on the way and, at the end of the input, the open ones."""
    rows = event_stream(t).select("entity", "ts", "value")
    d = run(t, rows, lambda s: st.hourly_rollup(s, ["entity"], "ts", "value"), "rollup")
    return d.select("entity", F.col("hour").cast("timestamp_ntz").alias("hour"), rnd("mean").alias("mean"), rnd("std").alias("std"), "n")


@query(
    "t02_stream_gate",
    f"""WITH RECURSIVE {GRID}, {Z_SQL}, en AS (SELECT entity, hr, v, row_number() OVER (PARTITION BY entity ORDER BY hr) - 1 AS i, {energy('(v - med) / (mad + 1e-9) - 1')} AS e FROM grid JOIN s USING (entity)), {gate_sql('en', 'entity')}
    SELECT entity, hr, {R('p')} AS persistence, closed FROM gt JOIN en USING (entity, i) WHERE v IS NOT NULL""",
)
def stream_gate(t):
    """Only hours with readings arrive; hours between them leak the bucket as on the complete grid."""
    z = nz.robust_z(t.flow, ["entity"], ["v"], guard="add").select("entity", "hr", "z_v")
    d = run(t, as_stream(t, with_clock(z), "scores"), lambda s: st.gate_stream(s, ["entity"], "hr", "z_v", two_sided=False), "gate")
    return d.select("entity", "hr", rnd("persistence").alias("persistence"), "closed")


@query("t03_stream_hour_ewma", f"WITH RECURSIVE {FLOW}, {W22_SQL} SELECT entity, hr, {R('pred')} AS prediction FROM ew")
def stream_ewma(t):
    d = as_stream(t, with_clock(t.flow.select("entity", (F.col("hr") % 24).alias("hod"), "hr", "v")), "flow")
    d = run(t, d, lambda s: st.hour_ewma_stream(s, ["entity", "hod"], "hr", "v"), "ewma")
    return d.select("entity", "hr", rnd("prediction").alias("prediction"))


@query(
    "t04_stream_reset_detectors",
    f"""WITH RECURSIVE {FLOW}, {ZROWS}, {EWMA_SQL}, {CUSUM_SQL}, {PH_SQL} SELECT entity, hr, ew.f AS on_ewma, cu.f AS on_cusum, ph.f AS on_page_hinkley
    FROM z JOIN ew USING (entity, i) JOIN cu USING (entity, i) JOIN ph USING (entity, i)""",
)
def stream_detectors(t):
    d = as_stream(t, with_clock(z_rows(t).select("entity", "hr", "z")), "z")
    limits = {"ewma": 1.3, "cusum": 5.1, "page_hinkley": PH_H}
    return run(t, d, lambda s: st.reset_detectors_stream(s, ["entity"], "hr", "z", limits), "detectors")


@query(
    "t05_stream_gap_sessions",
    f"""WITH {EV}, g AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER w >= 21600000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
    s AS (SELECT user_id, us, sum(c) OVER (PARTITION BY user_id ORDER BY us) AS k FROM g), x AS (SELECT user_id, min(us) AS a, max(us) AS b, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT user_id, make_timestamp(a) AS first_ts, make_timestamp(b) AS last_ts, n FROM x""",
)
def stream_sessions(t):
    d = run(t, event_stream(t).select("user_id", "ts"), lambda s: st.gap_sessions(s, ["user_id"], "ts", "6 hours"), "sessions")
    return d.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n")


@query(
    "t06_stream_late_data",
    f"""WITH {EV}, d AS (SELECT * FROM ev WHERE day(ts) > 15), h AS (SELECT entity, hr, count(*) AS n FROM d GROUP BY ALL)
    SELECT entity, make_timestamp(hr * 3600000000) AS hour, n FROM h WHERE (hr + 1) * 3600000 <= (SELECT max(us) // 1000 FROM d) - 7200000""",
)
def late_data(t):
    """The second half of the month arrives first; the first half is then behind the watermark and is dropped."""
    out, state = (scratch_path(t.spark, n) for n in ("late", "late-state"))
    for d in late_arrivals(t):
        table = st.run_to_table(st.hourly_rollup(d.withWatermark("ts", "2 hours"), ["entity"], "ts", "value"), out, state)
    return table.select("entity", F.col("hour").cast("timestamp_ntz").alias("hour"), "n")


def late_arrivals(t: Tables):
    """A stream to which the second half of the month has come, and then the first half too."""
    source = scratch_path(t.spark, "arrivals")
    early = F.dayofmonth("ts") <= 15
    for part in (t.events.filter(~early), t.events.filter(early)):
        part.write.mode("append").parquet(source)
        d = t.spark.readStream.schema(t.events.schema).parquet(source)
        yield d.select((F.col("user_id") % 4).alias("entity"), F.col("ts").cast("timestamp").alias("ts"), "value")


@query(
    "t06_late_row_accounts",
    f"""WITH {EV}, m AS (SELECT entity, max(us) // 1000 AS newest FROM ev WHERE day(ts) > 15 GROUP BY entity),
    a AS (SELECT e.*, day(ts) <= 15 AND (hr + 1) * 3600000 <= newest - 7200000 AS late FROM ev e LEFT JOIN m USING (entity))
    SELECT entity, count(*) AS arrived, count(*) FILTER (NOT coalesce(late, false)) AS kept, count(*) FILTER (late) AS late, min(CASE WHEN late THEN us END) AS first_late_us,
      {R('avg(CASE WHEN NOT coalesce(late, false) THEN value END)')} AS mean_kept FROM a GROUP BY entity""",
)
def late_accounts(t):
    """Late rows by the clock of their own room, in a side table; kept and late rows add up to those that arrived."""
    out, state = (scratch_path(t.spark, n) for n in ("accounts", "accounts-state"))
    for d in late_arrivals(t):
        marked = st.split_late(d, ["entity"], "ts", 2 * st.HOUR_MS)
        st.append_available(marked, out, state, ("late",))
    rows = t.spark.read.schema(marked.schema).parquet(out)
    late = F.col("late")
    return rows.groupBy("entity").agg(
        F.count("*").alias("arrived"), F.count_if(~late).alias("kept"), F.count_if(late).alias("late"),
        F.min(F.when(late, F.unix_micros("ts"))).alias("first_late_us"), rnd(F.avg(F.when(~late, F.col("value")))).alias("mean_kept"),
    )
