"""Roll-ups of frame records to minutes, hours and days, and coverage audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorgate.functions.exprs import as_col, is_true
from sensorgate.operators.quantiles import exact_quantiles

# Behaviour share columns which the video table carries as empty placeholders.
PLACEHOLDERS = (
    "frac_idle", "frac_active", "frac_drinking", "frac_feeding", "frac_preening", "frac_perching", "frac_wing_flapping",
)


def with_quantiles(df: DataFrame, keys, aggs, cols: dict, qs, names=None, bounded: bool = True, stored: bool = False) -> DataFrame:
    """Plain aggregates of each group plus exact quantiles.

    ``bounded`` groups have a known largest size (the frames of a time bin): all comes from one aggregation. Groups of any
    size take the quantile search and a join on the group key; see ``exact_quantiles`` for ``stored``.
    """
    keys, qs = list(keys), list(qs)
    if not bounded:
        return df.groupBy(*keys).agg(*aggs).join(exact_quantiles(df, keys, cols, qs, names, stored), keys, "left")
    names = names or [f"p{round(q * 100):02d}" for q in qs]
    label = lambda n, i: f"{n}_{names[i]}" if n else names[i]
    more = [F.percentile(as_col(c), F.lit(float(q))).alias(label(n, i)) for n, c in cols.items() for i, q in enumerate(qs)]
    return df.groupBy(*keys).agg(*aggs, *more)


def hourly_video(frames: DataFrame, keys, flow="flow_mean", var="flow_var", occ="occupancy", dark="is_dark", file="filepath"):
    """Hourly video statistics: lit frames only for motion and occupancy, all frames for the dark share and files."""
    lit_row = ~F.col(dark)

    def lit(c) -> Column:
        return F.when(lit_row, as_col(c))

    n_lit = F.count(lit(flow))
    aggs = [
        F.avg(lit(flow)).alias("flow_mean_avg"),
        F.stddev_samp(lit(flow)).alias("flow_mean_std"),
        F.min(lit(flow)).alias("flow_mean_min"),
        F.max(lit(flow)).alias("flow_mean_max"),
        F.avg(lit(var)).alias("flow_var_avg"),
        F.avg(lit(occ)).alias("occupancy_avg"),
        F.stddev_samp(lit(occ)).alias("occupancy_std"),
        F.when(F.count_if(lit_row) > 0, n_lit).alias("n_frames_lit"),
        F.avg(F.col(dark).cast("double")).alias("dark_fraction"),
        F.count_distinct(file).alias("file_count"),
    ]
    d = with_quantiles(frames, keys, aggs, {"occupancy": lit(occ)}, [0.5, 0.9], ["p50", "p90"])
    return d.withColumns({c: F.lit(None).cast("double") for c in PLACEHOLDERS})


def descriptor_stats(frames: DataFrame, keys, descriptors, active="voc_active", transient="transient", counted=None):
    """Mean, sample std, p10 and p90 of each descriptor per time bin; empty bins do not appear."""
    counted = counted or descriptors[0]
    aggs = [f(F.col(c)).alias(f"{c}_{n}") for c in descriptors for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    aggs += [
        F.avg(F.col(active).cast("double")).alias("voc_activity_frac"),
        F.avg(F.col(transient).cast("double")).alias("transient_rate"),
        F.count(counted).alias("n_frames"),
    ]
    d = with_quantiles(frames, keys, aggs, {c: F.col(c) for c in descriptors}, [0.1, 0.9])
    return d.filter(F.col("n_frames") > 0)


def motion_tier(frames: DataFrame, keys, motion: str, active_above: float, expected: int) -> DataFrame:
    """One row per time bin from raw frames: mean, population std, max, p95, p05, activity share, coverage."""
    m = F.col(motion)
    aggs = [
        F.avg(m).alias("vid_flow_mag_mean"),
        F.stddev_pop(m).alias("vid_flow_mag_std"),
        F.max(m).alias("vid_flow_mag_max"),
        F.avg((m > active_above).cast("double")).alias("vid_activity_frac"),
        F.count("*").alias("vid_n_frames"),
        F.least(F.count("*") / expected, F.lit(1.0)).alias("vid_coverage"),
    ]
    return with_quantiles(frames, keys, aggs, {"vid_flow_mag": m}, [0.95, 0.05], ["p95", "p05"])


def vector_long(df: DataFrame, keys, vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def vector_stats(df: DataFrame, keys, vector: str) -> DataFrame:
    """Mean and population std of each vector position per group, as partial and final aggregates; long form."""
    return (
        vector_long(df, keys, vector)
        .groupBy(*keys, "dim")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("n"))
    )


def vector_partials(df: DataFrame, keys, vector: str) -> DataFrame:
    """Mergeable state (sum, sum of squares, count) per group and position."""
    return (
        vector_long(df, keys, vector)
        .groupBy(*keys, "dim")
        .agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.count("x").alias("n"))
    )


def merge_partials(parts: DataFrame, keys) -> DataFrame:
    """States of several files or runs -> mean and population std, variance held at or above zero."""
    d = parts.groupBy(*keys, "dim").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))
    return d.select(*keys, "dim", mean.alias("mean"), F.sqrt(var).alias("std"), "n")


def widen(long: DataFrame, keys, cols, n: int, name="mel{:02d}") -> DataFrame:
    """Positions 0..n-1 of a long vector table as columns ``<name>_<col>``."""
    aggs = [F.max(F.when(F.col("dim") == i, F.col(c))).alias(f"{name.format(i)}_{c}") for i in range(n) for c in cols]
    return long.groupBy(*keys).agg(*aggs)


def ordered_array(long: DataFrame, keys, cols) -> DataFrame:
    """Positions gathered back into arrays; their number is the vector length."""
    d = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dim", *cols))).alias("_v"))
    return d.select(*keys, *[F.col("_v")[c].alias(c) for c in cols])


def minute_coverage(minutes: DataFrame, hours: DataFrame, keys, minute_hour: str, n_frames: str) -> DataFrame:
    """Share of the sixty minutes of each hour which hold frames; hours without any give 0."""
    got = minutes.groupBy(*keys, minute_hour).agg((F.count_if(F.col(n_frames) > 0) / 60.0).alias("minute_coverage_frac"))
    return hours.join(got, [*keys, minute_hour], "left").fillna(0.0, ["minute_coverage_frac"])


def day_coverage(sessions: DataFrame, keys, start: str, end: str, files: str, size_mb: str) -> DataFrame:
    """Per key: first and last day, distinct days covered by sessions, and totals.

    Day sets are built as distinct rows, so many overlapping sessions of one key are reduced before the shuffle.
    """
    keys = list(keys)
    totals = sessions.groupBy(*keys).agg(
        F.min(start).alias("earliest"),
        F.max(end).alias("latest"),
        F.count("*").alias("sessions"),
        F.sum(files).cast("long").alias("files"),
        F.round(F.sum(size_mb) / 1024, 2).alias("size_gb"),
        F.count_if(F.col(start).isNull()).alias("undated_sessions"),
    )
    spans = sessions.filter(F.col(start).isNotNull()).select(*keys, start, end).distinct()
    days = spans.select(*keys, F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias("_day")).distinct()
    return totals.join(days.groupBy(*keys).agg(F.count("*").alias("days_covered")), keys, "left").fillna(0, ["days_covered"])


def presence_long(df: DataFrame, keys, hour: str, flags: dict) -> DataFrame:
    """One row per present modality and hour."""
    found = F.array_compact(F.array(*[F.when(is_true(c), F.lit(n)) for n, c in flags.items()]))
    return df.select(*keys, hour, F.explode(found).alias("modality"))


def span_statistics(presence: DataFrame, keys, hour: str, fused: str) -> DataFrame:
    """Per modality: first and last hour, whole days, hours present and expected, missing share, share of fused."""
    keys = list(keys)
    hours = presence.select(*keys, "modality", hour).distinct()
    d = hours.groupBy(*keys, "modality").agg(
        F.min(hour).alias("first_hour"), F.max(hour).alias("last_hour"), F.count("*").alias("hours_present")
    )
    d = d.withColumn("duration_days", F.floor((F.col("last_hour") - F.col("first_hour")) / 24))
    d = d.withColumn("hours_expected", F.col("last_hour") - F.col("first_hour") + 1)
    d = d.withColumn("missing_pct", F.round((1 - F.col("hours_present") / F.col("hours_expected")) * 100, 1))
    base = d.filter(F.col("modality") == fused).select(*keys, F.col("hours_present").alias("_fused"))
    d = d.join(base, keys, "left") if keys else d.withColumn("_fused", base.select("_fused").scalar())
    share = F.round(F.col("hours_present") / F.greatest(F.coalesce("_fused", F.lit(0)), F.lit(1)) * 100, 1)
    return d.withColumn("share_of_fused_pct", F.when(F.col("modality") == fused, 100.0).otherwise(share)).drop("_fused")


def value_counts(df: DataFrame, cols) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def segment_summary(rows: DataFrame, keys, hour: str, coverage: str, min_hours: float, min_density: float) -> DataFrame:
    d = rows.groupBy(*keys).agg(
        F.min(hour).alias("first_hour"),
        F.max(hour).alias("last_hour"),
        F.count("*").alias("n_hours_observed"),
        F.avg(coverage).alias("mean_coverage"),
    )
    d = d.withColumn("span_hours", F.col("last_hour") - F.col("first_hour") + 1)
    d = d.withColumn("density", F.col("n_hours_observed") / F.greatest(F.col("span_hours"), F.lit(1)))
    long_enough, dense = F.col("span_hours") >= min_hours, F.col("density") >= min_density
    reason = F.when(~long_enough, F.lit("too_short")).when(~dense, F.lit("too_sparse")).otherwise(F.lit("ok"))
    return d.withColumns({"eligible": long_enough & dense, "reason": reason})


def metadata_audit(files: DataFrame, readable: str, start: str, created: str) -> DataFrame:
    """Unreadable files, readable files without a start, distinct creation times, frozen-clock flag."""
    ok = F.col(readable)
    d = files.agg(
        F.count("*").alias("n_files"),
        F.count_if(~ok).alias("unreadable"),
        F.count_if(ok & F.col(start).isNull()).alias("no_start"),
        F.count_if(ok).alias("n_readable"),
        F.count_distinct(F.when(ok, F.col(created))).alias("n_creation_times"),
    )
    return d.withColumn("frozen_clock", (F.col("n_creation_times") == 1) & (F.col("n_readable") > 1))
