"""Registry of queries over the shared test tables, and the sensor views derived from them.

``events`` plays the frame stream of four rooms (``user_id`` modulo four): views and clicks are audio frames,
purchases are video frames (dark below 15), signups and errors are environment readings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgate.functions.exprs import day_index, hour_index, int_div, micros
from sensorgate.operators import align
from sensorgate.session import cut_lineage, prepare
from sensorgate.sources.readers import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` and, where one exists, the SQL that gives the same rows."""

    def wrap(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f

    return wrap


def R(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


class Tables:
    """The given tables and the views on them; everything is lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def ev(self) -> DataFrame:
        return self.table("events").withColumns(
            {"us": micros("ts"), "hr": hour_index("ts"), "dy": day_index("ts"), "entity": F.col("user_id") % 4}
        )

    @cached_property
    def hourly(self) -> DataFrame:
        """The one pass over the raw readings: a row per room and hour, kept in the shared folder.

        Spines, decomposition and gates read this table several times; its size is rooms times hours.
        """
        kind, value = F.col("event_type"), F.col("value")
        audio, video, env = kind.isin("view", "click"), kind == "purchase", kind.isin("signup", "error")
        d = self.ev.groupBy("entity", "hr").agg(
            F.avg(value).alias("v"),
            F.count("*").alias("n"),
            F.avg(F.when(audio, value)).alias("aud_level"),
            F.count_if(audio).alias("aud_n"),
            F.avg(F.when(video & (value >= 15), value)).alias("vid_flow"),
            F.count_if(video).alias("vid_n"),
            F.sum(F.when(env, value)).alias("env_sum"),
            F.count_if(env).alias("env_n"),
        )
        return cut_lineage(d)

    @cached_property
    def trials(self) -> DataFrame:
        """One backtest trial for each monitored user; written once, as every step of a backtest starts from them."""
        return cut_lineage(self.table("events").select(F.col("user_id").alias("trial")).distinct())

    @cached_property
    def aud(self) -> DataFrame:
        return self.hourly.filter(F.col("aud_n") > 0).select("entity", "hr", "aud_level", "aud_n")

    @cached_property
    def vid(self) -> DataFrame:
        return self.hourly.filter(F.col("vid_n") > 0).select("entity", "hr", "vid_flow", "vid_n")

    @cached_property
    def env(self) -> DataFrame:
        """Daily environment, from the hourly sums and counts."""
        d = self.hourly.filter(F.col("env_n") > 0).groupBy("entity", int_div("hr", 24).alias("dy"))
        return d.agg((F.sum("env_sum") / F.sum("env_n")).alias("env_temp"))

    @cached_property
    def merged(self) -> DataFrame:
        """Hourly spine with both modalities and the daily environment."""
        base = align.spine([self.aud, self.vid], ["entity"], "hr")
        d = align.join_all(base, [self.aud, self.vid], ["entity", "hr"])
        return align.daily_to_hourly(d, self.env, ["entity"], "hr", "dy", ["env_temp"])

    @cached_property
    def flow(self) -> DataFrame:
        """One signal per room and hour, rows only where there were readings."""
        return self.hourly.select("entity", "hr", "v", "n")

    @cached_property
    def grid(self) -> DataFrame:
        return align.complete_grid(self.flow, ["entity"], "hr")


# SQL text of the same views.
EV = """ev AS (SELECT event_id, ts, epoch_us(ts) AS us, epoch_us(ts)//3600000000 AS hr, epoch_us(ts)//86400000000 AS dy,
  user_id, user_id % 4 AS entity, event_type, value, props FROM events)"""
MODAL = f"""{EV},
aud AS (SELECT entity, hr, avg(value) AS aud_level, count(*) AS aud_n FROM ev WHERE event_type IN ('view','click') GROUP BY ALL),
vid AS (SELECT entity, hr, avg(CASE WHEN value >= 15 THEN value END) AS vid_flow, count(*) AS vid_n FROM ev
  WHERE event_type = 'purchase' GROUP BY ALL),
env AS (SELECT entity, dy, avg(value) AS env_temp FROM ev WHERE event_type IN ('signup','error') GROUP BY ALL)"""
MERGED = f"""{MODAL},
ends AS (SELECT entity, min(hr) AS lo, max(hr) AS hi FROM (SELECT entity, hr FROM aud UNION ALL SELECT entity, hr FROM vid) GROUP BY entity),
spine AS (SELECT entity, unnest(generate_series(lo, hi)) AS hr FROM ends),
dends AS (SELECT entity, min(dy) AS lo, max(dy) AS hi FROM env GROUP BY entity),
dspine AS (SELECT entity, unnest(generate_series(lo, hi)) AS dy FROM dends),
dfull AS (SELECT entity, dy, last_value(env_temp IGNORE NULLS) OVER (PARTITION BY entity ORDER BY dy) AS env_temp
  FROM dspine LEFT JOIN env USING (entity, dy)),
merged AS (SELECT s.entity, s.hr, s.hr//24 AS dy, aud_level, aud_n, vid_flow, vid_n, env_temp
  FROM spine s LEFT JOIN aud a ON a.entity = s.entity AND a.hr = s.hr LEFT JOIN vid v ON v.entity = s.entity AND v.hr = s.hr
  LEFT JOIN dfull d ON d.entity = s.entity AND d.dy = s.hr//24)"""
FLOW = f"""{EV}, flow AS (SELECT entity, hr, avg(value) AS v, count(*) AS n FROM ev GROUP BY ALL)"""
GRID = f"""{FLOW},
gends AS (SELECT entity, min(hr) AS lo, max(hr) AS hi FROM flow GROUP BY entity),
gspine AS (SELECT entity, unnest(generate_series(lo, hi)) AS hr FROM gends),
grid AS (SELECT entity, hr, v, n FROM gspine LEFT JOIN flow USING (entity, hr))"""
