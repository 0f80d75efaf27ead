"""Gap, session and rolling operators, and the slow/fast decomposition.

Operators on the hourly grid window by key: a key has one row per hour, so its size is bounded by the length of the
record and not by the number of readings. Operators on raw rows use the scans of ``ordered``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorgate.functions.exprs import as_col
from sensorgate.operators.ordered import Changes, First, Last, ordered_scan, tasks_for
from sensorgate.session import cut_lineage

_UP, _DOWN = W.unboundedPreceding, W.unboundedFollowing


def by_key(keys, *order):
    return W.partitionBy(*keys).orderBy(*order)


def step_since_previous(df: DataFrame, keys, time: str, out: str, unit: float = 1.0) -> DataFrame:
    return df.withColumn(out, (F.col(time) - F.lag(time).over(by_key(keys, time))) / unit)


def gap_list(df: DataFrame, keys, time: str, longer_than: int) -> DataFrame:
    """Raw rows -> gaps longer than a limit.

    Two rows of one block (half the limit wide) can never be that far apart, so the first and last time of each
    block are enough; they combine map-side and only the block table is ordered.
    """
    keys = list(keys)
    blk = F.floor(F.col(time) / max(1, longer_than // 2)).cast("long")
    ends = df.groupBy(*keys, blk.alias("_blk")).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    ends = ends.withColumn("gap_start", F.lag("_hi").over(by_key(keys, "_blk")))
    return ends.withColumn("gap", F.col("_lo") - F.col("gap_start")).filter(F.col("gap") > longer_than).select(*keys, "gap_start", "gap")


def segments(df: DataFrame, keys, time: str, longer_than: int, out: str = "segment_id") -> DataFrame:
    """Running count of gaps longer than a limit."""
    d = df.withColumn("_gap", F.col(time) - F.lag(time).over(by_key(keys, time)))
    flag = F.when(F.col("_gap") > longer_than, 1).otherwise(0)
    return d.withColumn(out, F.sum(flag).over(by_key(keys, time).rowsBetween(_UP, 0))).drop("_gap")


def equal_runs(df: DataFrame, keys, order, value: str, out: str) -> DataFrame:
    """Number of the contiguous run of equal values along ``order``; NULL equals NULL."""
    return ordered_scan(df, keys, order, [Changes(out, value, first=1)])


def midnight_rollover(df: DataFrame, keys, order, seconds: str, created_day: str, out: str, run: str | None = None) -> DataFrame:
    """Clock start from a time of day and a base date: each fall of the time of day moves on by one day.

    The base is the first known date of the key; rows without a time of day give NULL and are skipped over. ``run`` adds
    the number of the run of equal dates in the same scan. The scan hands the base on to all rows behind it; only those in
    front of it are joined.
    """
    steps = [Changes("_days", seconds, falls=True, skip_null=True), First("_base", created_day)] + ([Changes(run, created_day, first=1)] if run else [])
    d = ordered_scan(df, keys, order, steps)
    base = d.where("_base IS NOT NULL").groupBy(*keys).agg(F.min("_base").alias("_base"))
    early = d.where("_base IS NULL").drop("_base").alias("a").join(base.alias("b"), _same(keys), "left").select("a.*", "b._base")
    d = d.where("_base IS NOT NULL").unionByName(early)
    day = F.date_add("_base", F.col("_days")).cast("timestamp")
    start = F.timestamp_micros(F.unix_micros(day) + F.round(F.col(seconds) * 1e6).cast("long"))
    return d.withColumn(out, start).drop("_days", "_base")


def _place(order) -> Column:
    """The order as one value; a single column is kept plain, so that a hash table can hold it."""
    return F.struct(*order) if len(order) > 1 else F.col(order[0])


def _same(keys) -> Column:
    return reduce(and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])


def session_checks(rows: DataFrame, keys, order, session: str, start: str, created: str, readable: str):
    """Per session: readable files, creation times, order of starts, long pauses, anomaly flag.

    All but distinct counts come from one aggregation with small buffers. Its tasks take a bounded number of rows: sessions
    that lie within a range of the scan are dealt out whole, and only the others, one for each range at most, are summed in
    parts. Starts that always rise have no equal ones, and a least creation time that is the greatest too is the only one:
    values are counted apart, and joined, only for the other sessions.
    """
    group = [*keys, session]
    ok = F.col(readable)
    t = F.when(ok, F.unix_micros(F.col(start)))
    d = rows.select(*group, *order, F.when(ok, F.col(created)).alias("_made"), ok.alias("_ok"), t.alias("_t"))
    d = ordered_scan(d, group, order, [Last("_pt", "_t", inclusive=False)], opened="_cut")
    pause = F.when(F.col("_t").isNotNull(), (F.col("_t") - F.col("_pt")) / 60e6)
    cut = F.broadcast(d.where("_cut").select(*group).distinct()).alias("b")
    d = d.withColumn("_pause", pause).drop("_pt", "_cut")
    known = F.when(F.col("_t").isNotNull(), _place(order))

    def totals(part: DataFrame) -> DataFrame:
        return part.groupBy(*group).agg(
            F.count("*").alias("n_files"),
            F.count_if("_ok").alias("n_readable"),
            F.min("_made").alias("_least"),
            F.max("_made").alias("_most"),
            F.count_if(F.col("_pause") <= 0).alias("_back"),
            F.count("_t").alias("_n"),
            F.count_if(F.col("_pause") > 90).alias("n_irregular_gaps"),
            F.max("_pause").alias("max_gap_min"),
            F.min_by("_t", known).alias("session_start_us"),
            F.max_by("_t", known).alias("session_end_us"),
        )

    whole = d.alias("a").join(cut, _same(group), "left_anti").repartition(tasks_for(rows.sparkSession, rows.count()), *group)
    s = totals(whole).unionByName(totals(d.alias("a").join(cut, _same(group), "left_semi")))
    s = cut_lineage(s)  # one row per session, read several times

    def distinct(sessions: DataFrame, value: str, out: str) -> DataFrame:
        own = d.where(F.col(value).isNotNull()).alias("a").join(sessions.select(*group).alias("b"), _same(group), "left_semi")
        return own.select(*group, value).distinct().groupBy(*group).agg(F.count("*").alias(out))

    fallen, varied = F.col("_back") > 0, F.coalesce(F.col("_least") < F.col("_most"), F.lit(False))
    falls = distinct(s.where(fallen), "_t", "_nd")
    mixed = distinct(s.where(varied), "_made", "_kinds")
    odd = s.where(fallen | varied).alias("a").join(falls.alias("b"), _same(group), "left").select("a.*", "b._nd")
    odd = odd.alias("a").join(mixed.alias("b"), _same(group), "left").select("a.*", "b._kinds")
    s = s.where(~(fallen | varied)).unionByName(odd, allowMissingColumns=True)
    s = s.withColumn("_nd", F.coalesce("_nd", "_n"))
    kinds = F.coalesce("_kinds", F.col("_least").isNotNull().cast("long"))
    s = s.select(*group, "n_files", "n_readable", kinds.alias("unique_creation_time"), "_back", "_n", "_nd", "n_irregular_gaps", "max_gap_min", "session_start_us", "session_end_us")
    n = F.col("n_readable")
    s = s.withColumn("clock_frozen_as_expected", ((F.col("unique_creation_time") == 1) & (n > 1)) | (n <= 1))
    s = s.withColumn("monotonic", F.col("_back") == 0).withColumn("duplicates", F.col("_n") != F.col("_nd"))
    bad = ~F.col("clock_frozen_as_expected") | ~F.col("monotonic") | F.col("duplicates") | (F.col("n_irregular_gaps") > 0)
    return s.withColumn("anomaly", bad).drop("_back", "_n", "_nd")


def islands(grid: DataFrame, keys, time: str, flag, least: int = 1) -> DataFrame:
    """Runs of rows where ``flag`` holds, on a complete grid: start, end, length."""
    keys = list(keys)
    d = grid.filter(as_col(flag))
    d = d.withColumn("_g", F.col(time) - F.row_number().over(by_key(keys, time)))
    d = d.groupBy(*keys, "_g").agg(F.min(time).alias("run_start"), F.max(time).alias("run_end"), F.count("*").alias("run_hours"))
    return d.filter(F.col("run_hours") >= least).drop("_g")


def rolling_median_time(df: DataFrame, keys, time: str, value: str, out: str, span: int, least: int) -> DataFrame:
    """Centred median over ``span`` time units, ``(t - span/2, t + span/2]``; NULL below ``least`` values."""
    w = by_key(keys, time).rangeBetween(-(span // 2) + 1, span // 2)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w)))


def centred_rows(keys, order, size: int):
    """Rows frame of a centred window of ``size`` rows; an even size reaches one row further back."""
    after = (size - 1) // 2
    return by_key(keys, *order).rowsBetween(-(size - 1 - after), after)


def rolling_median_rows(df: DataFrame, keys, order, value: str, out: str, size: int, least: int) -> DataFrame:
    w = centred_rows(keys, order, size)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w)))


def interpolate_time(df: DataFrame, keys, time: str, value: str, out: str) -> DataFrame:
    """Linear in time between known values, the nearest one beyond the ends."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    back, ahead = by_key(keys, time).rowsBetween(_UP, 0), by_key(keys, time).rowsBetween(0, _DOWN)
    d = df.withColumns({"_p": F.last(known, True).over(back), "_n": F.first(known, True).over(ahead)})
    share = (F.col(time) - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * share
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(F.col("_p").isNull(), F.col("_n.v"))
        .when(F.col("_n").isNull(), F.col("_p.v"))
        .otherwise(line)
    )
    return d.withColumn(out, filled).drop("_p", "_n")


def diurnal_profile(df: DataFrame, keys, hour_of_day: str, value: str, fill: bool, smooth: int = 3) -> DataFrame:
    """Mean by hour of day on all 24 hours, optionally filled over empty hours, circularly smoothed."""
    keys = list(keys)
    got = df.groupBy(*keys, F.col(hour_of_day).cast("int").alias("_h")).agg(F.avg(value).alias("_m"))
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("_h"))
    d = grid.join(got, [*keys, "_h"], "left")
    if fill:
        d = interpolate_time(d, keys, "_h", "_m", "_m2").withColumn("_m", F.col("_m2")).drop("_m2")
    half = smooth // 2
    near = d.select(*keys, "_m", F.explode(F.array(*[(F.col("_h") + 24 + o) % 24 for o in range(-half, half + 1)])).alias(hour_of_day))
    return near.groupBy(*keys, hour_of_day).agg(F.avg("_m").alias("diurnal"))


def slow_fast(df: DataFrame, keys, time: str, value: str, window_hours: int = 168, variant: str = "a") -> DataFrame:
    """Adds trend, diurnal, slow and fast_residual to a table of hours.

    Variant a: rows as they are, median of at least three values, trend interpolated over holes. Variant b: complete
    grid, median of at least a fifth of the window, no interpolation, plus the reconstructed value.
    """
    keys = list(keys)
    least = 3 if variant == "a" else max(3, int(window_hours * 0.2))
    d = df if variant == "a" else complete_hours(df, keys, time)
    d = rolling_median_time(d, keys, time, value, "trend", window_hours, least)
    if variant == "a":
        d = interpolate_time(d, keys, time, "trend", "_t2").withColumn("trend", F.col("_t2")).drop("_t2")
    d = d.withColumn("_hod", (F.col(time) % 24).cast("int")).withColumn("_det", F.col(value) - F.col("trend"))
    profile = diurnal_profile(d, keys, "_hod", "_det", fill=variant == "a")
    d = d.join(profile, [*keys, "_hod"], "left")
    d = d.withColumn("slow", F.col("trend") + F.col("diurnal")).withColumn("fast_residual", F.col(value) - F.col("slow"))
    if variant == "b":
        d = d.withColumn("reconstructed", F.col("slow") + F.col("fast_residual"))
    return d.drop("_hod", "_det")


def complete_hours(df: DataFrame, keys, time: str) -> DataFrame:
    from sensorgate.operators.align import complete_grid

    return complete_grid(df, keys, time)


def rolling_slope_centred(df: DataFrame, keys, order, value: str, out: str, size: int = 7, least: int = 2) -> DataFrame:
    """Least-squares slope of the known values in a centred window against their own position 0..k-1."""
    w = centred_rows(keys, order, size)
    seen = F.filter(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_y"))).over(w)), lambda s: s["_y"].isNotNull())
    d = df.withColumn("_ys", F.transform(seen, lambda s: s["_y"]))
    n = F.size("_ys")
    mid = (n - 1) / 2.0
    num = F.aggregate(F.transform("_ys", lambda y, i: (i - mid) * y), F.lit(0.0), lambda a, x: a + x)
    den = n * (n * n - 1) / 12.0
    return d.withColumn(out, F.when(n >= least, num / den)).drop("_ys")


def rolling_slope_trailing(df: DataFrame, keys, order: str, value: str, out: str, size: int = 7) -> DataFrame:
    """Sample covariance over population variance of the position, trailing window (the daily files' own scaling)."""
    w = by_key(keys, order).rowsBetween(-(size - 1), 0)
    d = df.withColumn("_rn", F.row_number().over(by_key(keys, order)).cast("double"))
    d = d.withColumn("_rn", F.when(F.col(value).isNotNull(), F.col("_rn")))
    return d.withColumn(out, F.covar_samp(value, "_rn").over(w) / F.var_pop("_rn").over(w)).drop("_rn")


def environment_features(daily: DataFrame, keys, day: str) -> DataFrame:
    """Derived columns of daily readings (morning min/max and evening temperature, two humidity readings)."""
    from sensorgate.functions.exprs import row_mean

    k = list(keys)
    d = daily.join(daily.groupBy(*k).agg(F.min(day).alias("_d0")), k)
    d = d.withColumn("day_index", F.datediff(day, "_d0")).drop("_d0")
    d = d.withColumns(
        {
            "temp_day_mean_c": row_mean(["temp_am_min_c", "temp_am_max_c", "temp_pm_c"]),
            "temp_am_range_c": F.col("temp_am_max_c") - F.col("temp_am_min_c"),
            "temp_am_pm_swing_c": F.col("temp_pm_c") - row_mean(["temp_am_min_c", "temp_am_max_c"]),
            "rh_day_mean_pct": row_mean(["rh_am_pct", "rh_pm_pct"]),
            "rh_am_pm_change_pct": F.col("rh_pm_pct") - F.col("rh_am_pct"),
        }
    )
    w, seven = by_key(k, day), centred_rows(k, [day], 7)
    return d.withColumns(
        {
            "temp_rate_c_per_day": F.col("temp_day_mean_c") - F.lag("temp_day_mean_c").over(w),
            "rh_rate_pct_per_day": F.col("rh_day_mean_pct") - F.lag("rh_day_mean_pct").over(w),
            "temp_roll_mean_c": F.avg("temp_day_mean_c").over(seven),
            "rh_roll_mean_pct": F.avg("rh_day_mean_pct").over(seven),
        }
    )


def adjacent_windows_z(df: DataFrame, keys, time: str, value: str, out: str, w: int = 24) -> DataFrame:
    """Mean of the last w values against the w before them in standard errors; NULL for the first 2w rows."""
    new, old = by_key(keys, time).rowsBetween(-w, -1), by_key(keys, time).rowsBetween(-2 * w, -w - 1)
    v = F.col(value)
    se = F.sqrt(F.var_pop(v).over(new) / w + F.var_pop(v).over(old) / w) + F.lit(1e-9)
    z = (F.avg(v).over(new) - F.avg(v).over(old)) / se
    return df.withColumn(out, F.when(F.count("*").over(old) == w, z))


def window_arrays(df: DataFrame, keys, time: str, value: str, out: str, size: int = 24) -> DataFrame:
    """Values of the window placed around each row (half before), only where the window is whole."""
    w = by_key(keys, time).rowsBetween(-(size // 2), size - size // 2 - 1)
    d = df.withColumn("_a", F.collect_list(F.struct(time, value)).over(w))
    return d.withColumn(out, F.when(F.size("_a") == size, F.transform("_a", lambda s: s[value]))).drop("_a")


def lag_profile(df: DataFrame, keys, time: str, u: str, v: str, reach: int = 8) -> DataFrame:
    """Correlation of ``u[t + L]`` with ``v[t]`` by row lag L in -reach..reach; positive L means that v leads.

    Each row looks at its own neighbours through one window, so no self-join is needed.
    """
    w = by_key(keys, time)
    d = df.select(*keys, F.col(v).alias("b"), *[F.lead(u, L).over(w).alias(f"a{L}") for L in range(-reach, reach + 1)])
    d = d.unpivot([*keys, "b"], [f"a{L}" for L in range(-reach, reach + 1)], "lag", "a").withColumn("lag", F.substring("lag", 2, 9).cast("int"))
    d = d.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return d.groupBy(*keys, "lag").agg(F.corr("a", "b").alias("r"), F.count("*").alias("n"))


def rising(df: DataFrame, keys, time: str, level, out: str) -> DataFrame:
    """True only where a level turns on; the first row keeps its value."""
    d = df.withColumn("_l", F.coalesce(as_col(level), F.lit(False)))
    return d.withColumn(out, F.col("_l") & ~F.coalesce(F.lag("_l").over(by_key(keys, time)), F.lit(False))).drop("_l")


def causal_hour_ewma(df: DataFrame, keys, time: str, value: str, out: str, rate: float = 0.2) -> DataFrame:
    """Prediction from strictly earlier days of the same hour; none at the first occurrence.

    The recurrence is linear, so it is a decayed sum over the occurrences of an hour.
    """
    from sensorgate.operators.scan import decayed_sum

    k = [*keys, "_hod"]
    d = df.filter(F.col(value).isNotNull()).withColumn("_hod", F.col(time) % 24)
    d = d.withColumn("_n", (F.row_number().over(by_key(k, time)) - 1).cast("long"))
    gain = F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(F.lit(rate))
    d = decayed_sum(d, k, "_n", F.col(value) * gain, 1 - rate, "_s", bounded=True)
    return d.withColumn(out, F.lag("_s").over(by_key(k, "_n"))).drop("_hod", "_n", "_s")
