"""Causal detectors and roll-ups on streams; after the end of the input each equals its batch operator on all rows.

Windows and sessions are Spark's own. Detectors are keyed state on RocksDB: rows wait in the state of their key until
the watermark has passed their hour, then the ready ones move on the charts of ``operators.detectors`` in the order of
time, so files may arrive in any order within the delay. A timer per key wakes keys that get no more rows.

The end of the input is a row of its own, far in the future, which moves the watermark past every open window, session
and waiting hour. Rows behind the watermark are dropped by Spark; ``split_late`` tells them apart before that, by the
clock of their own key, and keeps them in a side table, so that kept and late rows add up to those that arrived.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sensorgate.operators.detectors import CHARTS, GateParams, Latch, Smoothed, follow

HOUR_MS = 3_600_000
END = datetime.datetime(9999, 1, 1)


def hourly_rollup(rows: DataFrame, keys, ts: str, value: str) -> DataFrame:
    """Event-time hour windows of a stream with a watermark; a window comes out once the watermark has passed its end."""
    return (
        rows.groupBy(*keys, F.window(ts, "1 hour").alias("w"))
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))
        .select(*keys, F.col("w.start").alias("hour"), "mean", "std", "n")
    )


def gap_sessions(rows: DataFrame, keys, ts: str, gap: str) -> DataFrame:
    """Sessions closed by inactivity; rows exactly one gap apart belong to different sessions."""
    return (
        rows.groupBy(*keys, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"))
        .select(*keys, F.col("w.start").alias("first_ts"), "last_ts", "n")
    )


class GateFold:
    """Persistence gate; hours without a row leak the bucket."""

    columns = "persistence double, closed boolean"

    def __init__(self, params: GateParams, two_sided: bool):
        self.params, self.two_sided = params, two_sided

    def charts(self) -> list:
        return [Latch(1, np.array([[self.params.close]]), self.params)]

    def run(self, charts, hours: np.ndarray, scores: np.ndarray, last: int | None):
        latch, out = charts[0], np.empty((2, len(hours)))
        size = np.nan_to_num(np.abs(scores) if self.two_sided else scores, nan=0.0)
        rests = np.diff(hours, prepend=hours[0] - 1 if last is None else last) - 1
        for k, (rest, score) in enumerate(zip(rests, size, strict=True)):
            latch.rest(int(rest))
            latch.advance(np.array([[score]]))
            out[:, k] = latch.bucket[0, 0], latch.closed[0, 0]
        return {"persistence": out[0], "closed": out[1].astype(bool)}


class HourMeanFold:
    """Prediction from earlier rows of the key: their exponentially weighted mean, none before the first."""

    columns = "prediction double"

    def __init__(self, rate: float):
        self.rate = rate

    def charts(self) -> list:
        mean = Smoothed((1, 1), self.rate)
        mean.level += np.nan  # nothing seen yet
        return [mean]

    def run(self, charts, hours, scores, last):
        mean, out = charts[0], []
        for score in scores:
            seen = not np.isnan(mean.level[0, 0])
            out.append(float(mean.level[0, 0]) if seen else None)
            if not np.isnan(score):
                mean.level[:] = mean.advance(score) if seen else score
        return {"prediction": pd.Series(out, dtype="object")}


class ChartsFold:
    """Charts that restart where they fire; a missing score counts as 0."""

    def __init__(self, limits: dict[str, float]):
        self.limits = limits
        self.columns = ", ".join(f"on_{n} boolean" for n in limits)

    def charts(self) -> list:
        return [CHARTS[n]((1, 1)) for n in self.limits]

    def run(self, charts, hours, scores, last):
        z = np.nan_to_num(scores, nan=0.0)[:, None]
        return {f"on_{n}": follow(c, z, np.array([[float(h)]]))[:, 0, 0] for c, (n, h) in zip(charts, self.limits.items(), strict=True)}


def cells(charts: list) -> list[np.ndarray]:
    """All arrays of the charts: what the state has to hold."""
    return [a for c in charts for a in vars(c).values() if isinstance(a, np.ndarray)]


class InOrder(StatefulProcessor):
    """Rows of a key in the order of their hours, each as soon as the watermark has passed its hour."""

    def __init__(self, keys: list[str], time: str, value: str, fold):
        self.keys, self.time, self.value, self.fold = keys, time, value, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "hours array<bigint>, scores array<double>")
        self.folded = handle.getValueState("folded", "cells array<double>, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hours, scores = self._waiting()
        for pdf in rows:
            hours.append(pdf[self.time].to_numpy("int64"))
            scores.append(pdf[self.value].to_numpy("float64"))
        yield from self._advance(key, np.concatenate(hours), np.concatenate(scores), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hours, scores = self._waiting()
        yield from self._advance(key, np.concatenate(hours), np.concatenate(scores), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _waiting(self) -> tuple[list, list]:
        if not self.waiting.exists():
            return [np.zeros(0, "int64")], [np.zeros(0)]
        hours, scores = self.waiting.get()
        return [np.asarray(hours, "int64")], [np.asarray(scores, "float64")]

    def _advance(self, key, hours, scores, mark: int) -> Iterator[pd.DataFrame]:
        ready = (hours + 1) * HOUR_MS <= mark
        now = np.flatnonzero(ready)[np.argsort(hours[ready], kind="stable")]
        if len(now):
            charts, last = self.fold.charts(), None
            if self.folded.exists():
                held, last = self.folded.get()
                at = 0
                for a in cells(charts):
                    a.reshape(-1)[:] = held[at : at + a.size]
                    at += a.size
            result = self.fold.run(charts, hours[now], scores[now], last)
            self.folded.update((np.concatenate([a.reshape(-1).astype(float) for a in cells(charts)]).tolist(), int(hours[now[-1]])))
            yield pd.DataFrame({**dict(zip(self.keys, key, strict=True)), self.time: hours[now], **result})
        if ready.all():
            self.waiting.clear()
        else:
            self.waiting.update((hours[~ready].tolist(), scores[~ready].tolist()))
            self.handle.registerTimer(int(hours[~ready].min() + 1) * HOUR_MS)


def _folded(rows: DataFrame, keys, time: str, value: str, fold) -> DataFrame:
    keys = list(keys)
    schema = ", ".join([f"{n} {t}" for n, t in rows.select(*keys, time).dtypes] + [fold.columns])
    return rows.groupBy(*keys).transformWithStateInPandas(InOrder(keys, time, value, fold), schema, "Append", "eventTime")


def gate_stream(rows: DataFrame, keys, time: str, score: str, p: GateParams = GateParams(), two_sided: bool = True) -> DataFrame:
    """Persistence gate state (bucket, latch) of a stream with a watermark; ``time`` counts hours since the epoch."""
    return _folded(rows, keys, time, score, GateFold(p, two_sided))


def hour_ewma_stream(rows: DataFrame, keys, time: str, value: str, rate: float = 0.2) -> DataFrame:
    """Prediction from earlier days; ``keys`` must include the hour of day."""
    return _folded(rows, keys, time, value, HourMeanFold(rate))


def reset_detectors_stream(rows: DataFrame, keys, time: str, score: str, h: dict) -> DataFrame:
    """EWMA, CUSUM and Page-Hinkley with fire-and-reset as one keyed state."""
    return _folded(rows, keys, time, score, ChartsFold(h))


class KeyClock(StatefulProcessor):
    """Marks rows whose hour had ended, ``delay`` before the newest row of the key in earlier micro-batches."""

    def __init__(self, ts: str, delay_ms: int):
        self.ts, self.delay = ts, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.newest.get()[0] if self.newest.exists() else None
        newest = before
        for pdf in rows:
            ms = pdf[self.ts].to_numpy("datetime64[ms]").astype("int64")
            late = np.zeros(len(pdf), bool) if before is None else (ms // HOUR_MS + 1) * HOUR_MS <= before - self.delay
            newest = int(ms.max()) if newest is None else max(newest, int(ms.max()))
            yield pdf.assign(late=late)
        if newest is not None:
            self.newest.update((newest,))

    def close(self) -> None:
        pass


def split_late(stream: DataFrame, keys, ts: str, delay_ms: int) -> DataFrame:
    """All rows of a stream with a column ``late``; observed as ``arrivals`` (arrived, late) in the query's progress."""
    schema = ", ".join([f"{n} {t}" for n, t in stream.dtypes] + ["late boolean"])
    marked = stream.groupBy(*keys).transformWithStateInPandas(KeyClock(ts, delay_ms), schema, "Append", "none")
    return marked.observe("arrivals", F.count("*").alias("arrived"), F.count_if("late").alias("late"))


#: Keyed state with types and timers needs RocksDB, which also keeps it off the executors' heap; a batch stores its changes.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def rocksdb_state(spark: SparkSession):
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def append_available(stream: DataFrame, path: str, checkpoint: str, parts: tuple[str, ...] = ()):
    """Process everything that is available, append to a table, and return the finished query."""
    with rocksdb_state(stream.sparkSession):
        w = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").partitionBy(*parts)
        q = w.trigger(availableNow=True).start(path)
        q.awaitTermination()
    return q


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything that is available, append to a table, and return the table."""
    append_available(stream, path, checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_end(stream: DataFrame, ts: str, delay: str, build: Callable[[DataFrame], DataFrame], path: str, complete: bool = False) -> DataFrame:
    """The whole result of ``build`` on a stream that has come to its end.

    First all available rows are processed, then the end row arrives through a folder of its own, and a second run from
    the same checkpoint emits what is still open. A job that goes on for days would do the second run when its input ends.
    An input that is ``complete`` and read as one micro-batch takes the end row along: the batch after it has no rows and
    emits everything.
    """
    spark, end = stream.sparkSession, f"{path}-end"
    spark.createDataFrame([], stream.schema).write.parquet(end)
    both = stream.unionByName(spark.readStream.schema(stream.schema).parquet(end))
    # The filter names the event time, so it stays behind the watermark, which the end row has to move.
    result = build(both.withWatermark(ts, delay).where(F.col(ts) < F.lit(END)))
    if not complete:
        append_available(result, path, f"{path}-state")
    last = [F.lit(END).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*last).coalesce(1).write.mode("append").parquet(end)
    append_available(result, path, f"{path}-state")
    return spark.read.schema(result.schema).parquet(path)
