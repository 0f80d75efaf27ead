"""Persistence gate and classical sequential detectors.

Linear state (the gate's bucket, running CUSUM) is written as blocked window sums and scales past one task per key.
Detectors that reset when they fire are sequential in time: a task takes many timelines at once and moves all of them,
under all limits, one hour at a time, so the loop has as many steps as a timeline has hours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorgate.functions.exprs import as_col, clip
from sensorgate.operators.scan import carry, decayed_sum
from sensorgate.operators.timeseries import adjacent_windows_z, by_key, rising


@dataclass(frozen=True)
class GateParams:
    """Fixed values of the locked gate."""

    deadband: float = 1.0
    decay: float = 0.85
    close: float = 6.0
    open: float = 2.0
    cap: float = 2.0


def gate(
    df: DataFrame,
    keys,
    position: str,
    score,
    params: GateParams = GateParams(),
    scale=1.0,
    deadband=None,
    close=None,
    two_sided: bool = True,
    prefix: str = "",
    bounded: bool = True,
) -> DataFrame:
    """Leaky bucket with hysteresis: adds ``persistence``, ``closed`` and ``trust``.

    ``position`` is a whole number; positions without a row leak the bucket, so hours since the epoch give the gap
    policy "leak" and a row number gives "skip". ``scale``, ``deadband`` and ``close`` may be columns. Keys with one
    row per hour are ``bounded``; for a denser series of one key, ``bounded=False`` scans it in parallel blocks.
    """
    keys = list(keys)
    s = as_col(score)
    size = F.abs(s) if two_sided else s
    band = params.deadband if deadband is None else deadband
    energy = F.coalesce(clip(size / as_col(scale) - as_col(band), 0.0, params.cap), F.lit(0.0))
    p, c, t = f"{prefix}persistence", f"{prefix}closed", f"{prefix}trust"
    limit = as_col(params.close if close is None else close)
    d = decayed_sum(df.withColumn("_e", energy), keys, position, F.col("_e"), params.decay, p, bounded)
    leaked = (F.col(p) - F.col("_e")) / params.decay
    turn = (
        F.when(F.col(p) >= limit, True)
        .when(F.col(p) <= params.open, False)
        .when(leaked <= params.open - 1e-12, False)  # opened during hours without a row
    )
    if bounded:
        upto = by_key(keys, position).rowsBetween(W.unboundedPreceding, 0)
        d = d.withColumn("_turn", turn).withColumn(c, F.last("_turn", ignorenulls=True).over(upto)).drop("_turn")
    else:
        d = carry(d, keys, [position], turn, c, F.floor(F.col(position) / 4096).cast("long"))
    d = d.withColumn(c, F.coalesce(F.col(c), F.lit(False)))
    ramp = clip((F.col(p) - params.open) / (limit - params.open), 0.0, 1.0)
    return d.withColumn(t, F.when(F.col(c), F.lit(0.0)).otherwise(1.0 - ramp)).drop("_e")


def gate_onsets(df: DataFrame, keys, position: str, score, close, out: str = "onset") -> DataFrame:
    """One-sided gate on a z-score; true at the hour it closes."""
    d = gate(df, keys, position, score, close=close, two_sided=False)
    return rising(d, keys, position, "closed", out)


def static_onsets(df: DataFrame, keys, time: str, score: str, h, out: str = "onset") -> DataFrame:
    return rising(df, keys, time, F.col(score) > as_col(h), out)


def window_shift_onsets(df: DataFrame, keys, time: str, score: str, h, out: str = "onset", w: int = 24) -> DataFrame:
    d = adjacent_windows_z(df, keys, time, score, "_z", w)
    return rising(d, keys, time, F.coalesce(F.col("_z") > as_col(h), F.lit(False)), out).drop("_z")


def cusum_running(df: DataFrame, keys, time: str, value: str, out: str, k: float = 0.5) -> DataFrame:
    """max(0, S + v - k) without reset, in closed form: running sum less its lowest point so far (0 at most)."""
    upto = by_key(keys, time).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("_c", F.sum(F.col(value) - F.lit(k)).over(upto))
    return d.withColumn(out, F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(upto))).drop("_c")


def sigma_flags(df: DataFrame, keys, value: str, k: float = 3.0) -> DataFrame:
    w = W.partitionBy(*keys)
    z = (F.col(value) - F.avg(value).over(w)) / (F.stddev_samp(value).over(w) + F.lit(1e-9))
    return df.withColumn("z", z).withColumn("flag", F.coalesce(F.abs(F.col("z")) > k, F.lit(False)))


def by_groups(df: DataFrame, keys):
    """Grouping for Python folds. A fixed number of partitions, because adaptive execution would merge small inputs
    into one task although the work per row is large."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).groupBy(*keys)


# Charts: the statistic of many timelines (rows) under many limits (columns) moves one hour at a time. ``advance`` takes
# the hour's scores as a column; ``forget`` restarts the cells that fired.


class Smoothed:
    """Exponentially weighted mean with weight 0.3 of the newest score."""

    def __init__(self, shape, weight: float = 0.3):
        self.level, self.weight = np.zeros(shape), weight

    def advance(self, score: np.ndarray) -> np.ndarray:
        self.level += self.weight * (score - self.level)
        return self.level

    def forget(self, cells: np.ndarray) -> None:
        self.level[cells] = 0.0


class SumAbove:
    """One-sided cumulative sum above an allowance of 0.5."""

    def __init__(self, shape, allowance: float = 0.5):
        self.excess, self.allowance = np.zeros(shape), allowance

    def advance(self, score: np.ndarray) -> np.ndarray:
        self.excess += score - self.allowance
        return np.clip(self.excess, 0.0, None, out=self.excess)

    def forget(self, cells: np.ndarray) -> None:
        self.excess[cells] = 0.0


class RiseOverMean:
    """Page-Hinkley: rise of the summed deviations from the running mean, less 0.1 each, over their lowest point."""

    def __init__(self, shape, tolerance: float = 0.1):
        self.count, self.mean, self.walk, self.floor = (np.zeros(shape) for _ in range(4))
        self.tolerance = tolerance

    def advance(self, score: np.ndarray) -> np.ndarray:
        self.count += 1.0
        self.mean += (score - self.mean) / self.count
        self.walk += score - self.mean - self.tolerance
        np.minimum(self.floor, self.walk, out=self.floor)
        return self.walk - self.floor

    def forget(self, cells: np.ndarray) -> None:
        for held in (self.count, self.mean, self.walk, self.floor):
            held[cells] = 0.0


CHARTS = {"ewma": Smoothed, "cusum": SumAbove, "page_hinkley": RiseOverMean}


def chart_fires(chart, scores: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Hours x timelines x limits: where the statistic passes its limit, after which it restarts.

    ``scores`` is hours x timelines, ``limits`` has a row for all timelines or one for each.
    """
    return follow(chart((scores.shape[1], limits.shape[1])), scores, limits)


def follow(state, scores: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The same from the state that a chart is in, which moves on."""
    out = np.empty((len(scores), scores.shape[1], limits.shape[1]), bool)
    for hour, score in enumerate(scores[:, :, None]):
        np.greater(state.advance(score), limits, out=out[hour])
        state.forget(out[hour])
    return out


class Latch:
    """The gate's bucket and its latch for many timelines and closing limits; the bucket does not depend on the limit."""

    def __init__(self, timelines: int, limits: np.ndarray, params: GateParams):
        self.bucket, self.closed = np.zeros((timelines, 1)), np.zeros((timelines, limits.shape[1]), bool)
        self.limits, self.p = limits, params

    def advance(self, score: np.ndarray) -> np.ndarray:
        self.bucket = self.p.decay * self.bucket + np.clip(score - self.p.deadband, 0.0, self.p.cap)
        self.closed = (self.closed & (self.bucket > self.p.open)) | (~self.closed & (self.bucket >= self.limits))
        return self.closed

    def rest(self, hours: int) -> None:
        """Hours without a reading: the bucket only leaks, so the latch can open and not close."""
        if hours > 0:
            self.bucket = self.bucket * self.p.decay**hours
            self.closed = self.closed & (self.bucket > self.p.open)


def gate_closed(scores: np.ndarray, limits: np.ndarray, params: GateParams = GateParams()) -> np.ndarray:
    latch = Latch(scores.shape[1], limits, params)
    return np.stack([latch.advance(score) for score in scores[:, :, None]])


def _edges(level: np.ndarray) -> np.ndarray:
    """First hours of the spans where a level holds."""
    return level & ~np.concatenate([np.zeros_like(level[:1]), level[:-1]])


def window_shift(scores: np.ndarray, w: int = 24) -> np.ndarray:
    """Difference of the means of two adjacent windows before each hour in standard errors; none in the first hours."""
    out = np.full(scores.shape, -np.inf)
    if len(scores) > 2 * w:
        win = np.lib.stride_tricks.sliding_window_view(scores, w, axis=0)
        mean, var = win.mean(-1), win.var(-1)
        out[2 * w :] = (mean[w:-1] - mean[: -w - 1]) / (np.sqrt((var[w:-1] + var[: -w - 1]) / w) + 1e-9)
    return out


# Registry of detectors: scores (hours x timelines) and limits -> onsets (hours x timelines x limits).
DETECTORS = {
    "static": lambda z, h: _edges(z[:, :, None] > h),
    "ewma": lambda z, h: chart_fires(Smoothed, z, h),
    "cusum": lambda z, h: chart_fires(SumAbove, z, h),
    "page_hinkley": lambda z, h: chart_fires(RiseOverMean, z, h),
    "adwin": lambda z, h: _edges(window_shift(z)[:, :, None] > h),
    "gate": lambda z, h: _edges(gate_closed(z, h)),
}

BLOCK_ROWS = 250_000  # rows of whole timelines that a task holds at once


def on_timelines(df: DataFrame, keys, time: str, run, schema, parts: int | None = None) -> DataFrame:
    """``run(rows, line, hour)`` over blocks of whole timelines: rows sorted by keys and time, the number of each row's
    timeline in the block and its place in the timeline. A task holds BLOCK_ROWS rows, or one longer timeline; it sorts
    its share of ``parts`` (by default the shuffle partitions), which should grow with the rows."""
    keys = list(keys)
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def numbered(rows: pd.DataFrame):
        same = (rows[keys] == rows[keys].shift()) | (rows[keys].isna() & rows[keys].shift().isna())
        begins = ~same.all(axis=1).to_numpy()
        begins[0] = True
        line = np.cumsum(begins) - 1
        return line, np.arange(len(rows)) - np.flatnonzero(begins)[line]

    def blocks(batches):
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= BLOCK_ROWS:
                rows = pd.concat(held, ignore_index=True)
                line, hour = numbered(rows)
                last = int(np.searchsorted(line, line[-1]))  # the last timeline may go on in the next batch
                if last:
                    yield run(rows[:last], line[:last], hour[:last])
                held, size = [rows[last:]], 0
        if held and len(rows := pd.concat(held, ignore_index=True)):
            yield run(rows, *numbered(rows))

    return df.repartition(n, *keys).sortWithinPartitions(*keys, time).mapInPandas(blocks, schema)


def as_matrix(values, line: np.ndarray, hour: np.ndarray, missing: float = 0.0) -> np.ndarray:
    """Hours x timelines, 0 (or ``missing``) where there is no value."""
    out, given = np.full((hour.max() + 1, line[-1] + 1), missing), np.asarray(values, float)
    out[hour, line] = given if np.isnan(missing) else np.nan_to_num(given, nan=missing)
    return out


def fold_onsets(df: DataFrame, keys, time: str, score: str, thresholds: dict) -> DataFrame:
    """Fire-and-reset detectors: adds ``on_<name>`` for each of ``{name: h}``; NULL scores count as 0."""
    keys, names = list(keys), list(thresholds)
    d = df.select(*keys, time, score)
    schema = ", ".join([f"`{n}` {t}" for n, t in d.dtypes] + [f"on_{n} boolean" for n in names])

    def run(rows, line, hour):
        z = as_matrix(rows[score], line, hour)
        fires = {f"on_{n}": chart_fires(CHARTS[n], z, np.array([[float(thresholds[n])]]))[hour, line, 0] for n in names}
        return rows.assign(**fires)

    return on_timelines(d, keys, time, run, schema)


def onset_counts(df: DataFrame, keys, time: str, score, detectors, grid, parts: int | None = None) -> DataFrame:
    """Number of onsets per key, detector and threshold of a grid (one pass over the timelines for the whole grid).

    ``score`` may be a list of columns; then a column ``score`` names them."""
    keys, names, h = list(keys), list(detectors), np.asarray(grid, float)
    scores, tag = ([score], "") if isinstance(score, str) else (list(score), "score string, ")
    schema = ", ".join([f"`{n}` {t}" for n, t in df.select(*keys).dtypes] + [f"{tag}detector string, h_index int, h double, n_onsets long"])

    def run(rows, line, hour):
        heads = rows.loc[hour == 0, keys]
        lived = np.bincount(line)  # hours of each timeline; padding is not counted
        made = []
        for c in scores:
            z = as_matrix(rows[c], line, hour)
            inside = (np.arange(len(z))[:, None] < lived)[:, :, None]
            for n in names:
                counts = (DETECTORS[n](z, h[None, :]) & inside).sum(0)
                part = heads.loc[heads.index.repeat(len(h))].reset_index(drop=True)
                part = part.assign(score=c) if tag else part
                made.append(part.assign(detector=n, h_index=np.tile(np.arange(len(h)), len(heads)), h=np.tile(h, len(heads)), n_onsets=counts.reshape(-1)))
        return pd.concat(made)

    return on_timelines(df.select(*keys, time, *scores), keys, time, run, schema, parts)


def onset_hours(df: DataFrame, keys, time: str, score: str | None, limits: dict, parts: int | None = None) -> DataFrame:
    """Sorted onset hours of each timeline, a row for each of ``{detector: limit}``; the timelines are read once for all.

    Without ``score``, ``limits`` has such a dictionary for each score column, and a column ``score`` names them."""
    keys = list(keys)
    tag, plan = ("", {score: limits}) if score else ("score string, ", limits)
    schema = ", ".join([f"`{n}` {t}" for n, t in df.select(*keys).dtypes] + [f"{tag}detector string, hours array<int>"])

    def run(rows, line, hour):
        clock, heads = as_matrix(rows[time], line, hour).astype(int), rows.loc[hour == 0, keys]
        inside = np.arange(len(clock))[:, None] < np.bincount(line)
        made = []
        for c, own_limits in plan.items():
            z, named = as_matrix(rows[c], line, hour), heads.assign(score=c) if tag else heads
            for n, h in own_limits.items():
                own, at = np.nonzero((DETECTORS[n](z, np.array([[float(h)]]))[:, :, 0] & inside).T)
                hours = np.split(clock[at, own], np.cumsum(np.bincount(own, minlength=len(heads)))[:-1])
                made.append(named.assign(detector=n, hours=hours))
        return pd.concat(made)

    return on_timelines(df.select(*keys, time, *plan), keys, time, run, schema, parts)


def alarm_hours(df: DataFrame, keys, time: str, limits: dict, parts: int | None = None) -> DataFrame:
    """Sorted alarm hours ``_at`` of each timeline, two-sided, for each score column: under the gate (``gated``) and where its
    size passes the limit that ``limits`` names for it. The timelines are read once; ``representation`` names the column."""
    keys = list(keys)
    schema = ", ".join([f"`{n}` {t}" for n, t in df.select(*keys).dtypes] + ["representation string, gated boolean, _at array<int>"])
    close = np.array([[GateParams().close]])

    def run(rows, line, hour):
        clock, heads, made = as_matrix(rows[time], line, hour).astype(int), rows.loc[hour == 0, keys], []
        inside = np.arange(len(clock))[:, None] < np.bincount(line)
        for c, h in limits.items():
            z = np.abs(as_matrix(rows[c], line, hour))
            for gated, alarm in ((True, gate_closed(z, close)[:, :, 0]), (False, z > h)):
                own, at = np.nonzero((alarm & inside).T)
                hours = np.split(clock[at, own], np.cumsum(np.bincount(own, minlength=len(heads)))[:-1])
                made.append(heads.assign(representation=c, gated=gated, _at=hours))
        return pd.concat(made)

    return on_timelines(df.select(*keys, time, *limits), keys, time, run, schema, parts)


@dataclass(frozen=True)
class Injection:
    """An amount added to a timeline from its start hour on, for some hours, and the hours that a detection may take.
    None stands for the timeline's own span."""

    label: tuple
    amount: float
    hours: int | None = None
    window: int | None = None


def gate_delays(
    df: DataFrame, keys, time: str, score: str, start: str, stop: str, names: str, injections, close: float = 6.0,
    two_sided: bool = True, parts: int | None = None,
) -> DataFrame:
    """Hours until the gate is closed after each injection, NULL if it is not: a row per timeline and injection.

    Timelines have a row for each hour and are shuffled once; a task moves them under all injections at once. ``names``
    declares the label columns.
    """
    keys, injections = list(keys), list(injections)
    d = df.select(*keys, time, score, start, stop)
    schema = ", ".join([f"`{n}` {t}" for n, t in d.select(*keys).dtypes] + [names, "delay int"])
    labels = [n.split()[0] for n in names.split(",")]
    amount = np.array([x.amount for x in injections])
    params = GateParams(close=close)

    def run(rows, line, hour):
        z, heads = as_matrix(rows[score], line, hour, np.nan), rows[hour == 0]
        begin, span = (heads[c].to_numpy(int)[:, None] for c in (start, stop))
        span = span - begin
        lasts, waits = (np.concatenate([span if n is None else np.full(span.shape, n) for n in ns], axis=1) for ns in ([x.hours for x in injections], [x.window for x in injections]))
        latch = Latch(len(heads), np.full((1, len(injections)), params.close), params)
        delay = np.full(lasts.shape, -1)
        for t, now in enumerate(z[:, :, None]):
            since = t - begin
            moved = now + np.where((since >= 0) & (since < lasts), amount, 0.0)
            shut = latch.advance(np.nan_to_num(np.abs(moved) if two_sided else moved))
            hit = shut & (since >= 0) & (since < waits) & (delay < 0)
            delay = np.where(hit, since, delay)
        out = heads.loc[heads.index.repeat(len(injections)), keys].reset_index(drop=True)
        for k, n in enumerate(labels):
            out[n] = [x.label[k] for x in injections] * len(heads)
        first = delay.reshape(-1)
        return out.assign(delay=pd.arrays.IntegerArray(first.astype("int32"), first < 0))

    return on_timelines(d, keys, time, run, schema, parts)


def spiked_baseline(
    df: DataFrame, keys, time: str, value: str, sign: str, mu0: float, centre: float, scale: float, every, height: float,
    start: int, stop: int, since: int, rate: float = 0.06, warm: int = 60, params: GateParams = GateParams(), parts: int | None = None,
) -> DataFrame:
    """Mean shift of the online baseline towards single-hour spikes, from hour ``since`` on, in spike heights: a row per
    timeline, distance between spikes and gating of the learning. All of them run over one copy of the timelines."""
    keys = list(keys)
    d = df.select(*keys, time, value, sign)
    schema = ", ".join([f"`{n}` {t}" for n, t in d.select(*keys).dtypes] + ["every int, gated boolean, shift double"])
    step, held = np.repeat(np.asarray(every), 2)[None, :], np.tile([True, False], len(every))[None, :]

    def run(rows, line, hour):
        x, heads = as_matrix(rows[value], line, hour)[:, :, None], rows[hour == 0]
        up, lived = heads[sign].to_numpy(float)[:, None], np.bincount(line)[:, None]
        latch = Latch(len(heads), np.full((1, 1), params.close), params)
        mean, total = np.full((len(heads), step.size), float(mu0)), np.zeros((len(heads), step.size))
        for t, now in enumerate(x):
            spike = (start <= t < stop) & ((t - start) % step == 0)
            now = now + np.where(spike, up * height, 0.0)
            shut = latch.advance((np.abs(now - mean) - centre) / scale)
            if t >= warm:
                mean = mean + np.where(held & shut, 0.0, rate * (now - mean))
            if t >= since:
                total += np.where(t < lived, (mean - mu0) * up, 0.0)
        shift = np.divide(total, (lived - since) * height, out=np.full(total.shape, np.nan), where=lived > since)
        out = heads.loc[heads.index.repeat(step.size), keys].reset_index(drop=True)
        return out.assign(every=np.tile(step[0], len(heads)), gated=np.tile(held[0], len(heads)), shift=pd.array(shift.reshape(-1), dtype="Float64"))

    return on_timelines(d, keys, time, run, schema, parts)


def matched_threshold(counts: DataFrame, keys, target: float) -> DataFrame:
    """Threshold per detector whose mean onsets per timeline come closest to the target; the first wins a tie."""
    keys = list(keys)
    d = counts.groupBy(*keys, "detector", "h_index", "h").agg(F.avg("n_onsets").alias("mean_onsets"))
    best = F.min(F.struct(F.round(F.abs(F.col("mean_onsets") - target), 9).alias("gap"), "h_index", "h", "mean_onsets")).alias("b")
    return d.groupBy(*keys, "detector").agg(best).select(*keys, "detector", "b.h_index", "b.h", "b.mean_onsets")


def detector_onsets(df: DataFrame, keys, time: str, score: str, threshold: str, detector: str) -> DataFrame:
    """Onset stream of the registered detector named in a column, at the threshold in another column."""
    keys = list(keys)
    d = df.select(*dict.fromkeys([*keys, time, score, threshold, detector]))
    kinds = dict(d.dtypes)
    schema = ", ".join([f"`{n}` {kinds[n]}" for n in [*keys, time]] + ["onset boolean"])

    def run(rows, line, hour):
        heads = rows[hour == 0]
        z, h, names = as_matrix(rows[score], line, hour), heads[threshold].to_numpy(float)[:, None], heads[detector].to_numpy()
        onset = np.zeros(z.shape, bool)
        for n in set(names):
            own = names == n
            onset[:, own] = DETECTORS[n](z[:, own], h[own])[:, :, 0]
        return rows[[*keys, time]].assign(onset=onset[hour, line])

    return on_timelines(d, keys, time, run, schema)


def gated_baseline(
    df: DataFrame, keys, time: str, value: str, mu0: str, centre: str, scale: str, gated,
    rate: float = 0.06, warm: int = 60, params: GateParams = GateParams(), parts: int | None = None,
) -> DataFrame:
    """Online mean that learns from each hour, and not while its gate is closed (where ``gated``).

    Adds ``score`` (robust distance from the running mean), ``closed`` and ``mu``. ``gated`` names a column, or is a list of
    settings that all run over one copy of the timelines; then a column ``gated`` tells their rows apart.
    """
    keys, column = list(keys), [gated] if isinstance(gated, str) else []
    d = df.select(*dict.fromkeys([*keys, time, value, mu0, centre, scale, *column]))
    kinds = dict(d.dtypes)
    schema = ", ".join([f"`{n}` {kinds[n]}" for n in [*keys, time]] + ["score double, closed boolean, mu double"] + ([] if column else ["gated boolean"]))

    def run(rows, line, hour):
        heads, x = rows[hour == 0], as_matrix(rows[value], line, hour)
        if column:
            return moved(rows, line, hour, heads, x, ~heads[gated].to_numpy(bool))
        return pd.concat([moved(rows, line, hour, heads, x, np.full(len(heads), not g)).assign(gated=g) for g in gated])

    def moved(rows, line, hour, heads, x, free):
        mean, middle, spread = (heads[c].to_numpy(float) for c in (mu0, centre, scale))
        latch = Latch(x.shape[1], np.full((1, 1), params.close), params)
        distance, shut, track = np.empty(x.shape), np.empty(x.shape, bool), np.empty(x.shape)
        for t, now in enumerate(x):
            distance[t] = (np.abs(now - mean) - middle) / spread
            shut[t] = latch.advance(distance[t][:, None])[:, 0]
            if t >= warm:
                mean = mean + np.where(free | ~shut[t], rate * (now - mean), 0.0)
            track[t] = mean
        return rows[[*keys, time]].assign(score=distance[hour, line], closed=shut[hour, line], mu=track[hour, line])

    return on_timelines(d, keys, time, run, schema, parts)


def calibrate_gate(df: DataFrame, keys, stream: str) -> DataFrame:
    """Gate parameters from a clean stream: scale = robust std (at least 1e-9), deadband = its 95th percentile in scales."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(F.percentile(stream, F.lit(0.5)).alias("_m"), F.percentile(stream, F.lit(0.95)).alias("q95"))
    d = df.join(base, keys) if keys else df.withColumn("_m", base.select("_m").scalar())
    mad = d.groupBy(*keys).agg(F.percentile(F.abs(F.col(stream) - F.col("_m")), F.lit(0.5)).alias("_mad"))
    mad = mad.join(base, keys) if keys else mad.withColumn("q95", base.select("q95").scalar())
    scale = F.greatest(F.col("_mad") * 1.4826, F.lit(1e-9))
    return mad.select(*keys, scale.alias("scale"), (F.col("q95") / scale).alias("deadband"), "q95")


GRID_SMOOTHING = [(a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.01, 0.1) for g in (0.1, 0.3)]


def holt_winters(y: np.ndarray, period: int, a: float, b: float, g: float) -> np.ndarray:
    """One-step-ahead values of additive trend and season with given constants; none (NaN) without two whole periods."""
    if len(y) < 2 * period:
        return np.full(len(y), np.nan)
    first, second = y[:period], y[period : 2 * period]
    level, trend = first.mean(), (second.mean() - first.mean()) / period
    season = first - level
    season, out = season.copy(), np.zeros(len(y))
    for t, v in enumerate(y):
        s = season[t % period]
        out[t] = level + trend + s
        old = level
        level = a * (v - s) + (1 - a) * (level + trend)
        trend = b * (level - old) + (1 - b) * trend
        season[t % period] = g * (v - level) + (1 - g) * s
    return out


def local_trend(y: np.ndarray, a: float, b: float) -> np.ndarray:
    """One-step-ahead values of a level and slope with given steady gains."""
    level, slope, out = y[0], 0.0, np.zeros(len(y))
    for t, v in enumerate(y):
        out[t] = level + slope
        err = v - out[t]
        level, slope = out[t] + a * err, slope + b * err
    return out


def forecast_residuals(df: DataFrame, keys, time: str, value: str, period: int = 24) -> DataFrame:
    """Residuals of both forecasters per segment, constants chosen from a grid by squared error.

    Segments are put on an hourly grid and filled in linearly first; they have no long gaps by construction. The seasonal
    model needs two whole periods: shorter segments have NULL as its fitted value and residual.
    """
    keys = list(keys)
    schema = df.select(*keys).schema.add(time, "long").add("model", "string").add("fitted", "double").add("resid", "double")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(time)
        if not len(pdf):
            return pd.DataFrame(columns=[f.name for f in schema])
        t = np.arange(pdf[time].iloc[0], pdf[time].iloc[-1] + 1)
        y = np.interp(t, pdf[time].to_numpy(), pdf[value].to_numpy(float))
        fits = {
            "seasonal": [holt_winters(y, period, *c) for c in GRID_SMOOTHING],
            "local_trend": [local_trend(y, a, b) for a in (0.1, 0.3, 0.6) for b in (0.0, 0.01, 0.1)],
        }
        parts = []
        for name, options in fits.items():
            fit = min(options, key=lambda f: float(((y - f) ** 2).sum()))
            parts.append(pd.DataFrame({time: t, "model": name, "fitted": fit, "resid": y - fit}).astype({"fitted": "Float64", "resid": "Float64"}))
        out = pd.concat(parts)
        for name, v in reversed(list(zip(keys, key))):
            out.insert(0, name, v)
        return out

    return by_groups(df.select(*keys, time, value), keys).applyInPandas(run, schema)
