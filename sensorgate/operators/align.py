"""Spines, alignment joins, deduplication and set operators.

Joins carry no broadcast hint: adaptive execution broadcasts a side whose measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and splits hot keys of a sort-merge join otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorgate.functions.exprs import as_col
from sensorgate.operators.ordered import Last, Sum, ordered_scan, row_index


def spine(sources, keys, time: str, step: int = 1) -> DataFrame:
    """Every step from the first to the last position of the union of the sources, per key."""
    keys = list(keys)
    ends = [s.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi")) for s in sources]
    both = reduce(lambda a, b: a.unionByName(b), ends).groupBy(*keys).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return both.select(*keys, F.explode(F.sequence("_lo", "_hi", F.lit(step).cast("long"))).alias(time))


def join_all(base: DataFrame, tables, keys, how: str = "left") -> DataFrame:
    return reduce(lambda d, t: d.join(t, list(keys), how), tables, base)


def complete_grid(df: DataFrame, keys, time: str) -> DataFrame:
    """Rows for every hour between the first and the last of each key; new rows hold NULL."""
    return spine([df], keys, time).join(df, [*keys, time], "left")


def overlap(a: DataFrame, b: DataFrame, keys, sparse_below: int) -> DataFrame:
    """Number of common rows and whether that is too few to use."""
    return a.join(b, list(keys)).agg(F.count("*").alias("n_overlap")).withColumn("too_sparse", F.col("n_overlap") < sparse_below)


def daily_to_hourly(hourly: DataFrame, daily: DataFrame, keys, hour: str, day: str, cols) -> DataFrame:
    """Attach daily values to hours; days without a reading take the last one, hours outside the range stay NULL."""
    keys = list(keys)
    full = complete_grid(daily, keys, day)
    w = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    full = full.select(*keys, day, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols])
    days = F.floor(F.col(hour) / 24).cast("long")
    return hourly.withColumn(day, days).join(full, [*keys, day], "left")


def asof(left: DataFrame, right: DataFrame, keys, time: str, value: str, backfill: bool = False, tie: str | None = None) -> DataFrame:
    """Latest ``value`` of the right side at or before each left row; ``backfill`` gives leading rows the next one.

    Both sides are stacked and scanned once, so a key may be of any size. A right row at the same time counts as before.
    Of right rows at one time the last one by ``tie`` counts, by value if not given.
    """
    l = left.withColumns({"_side": F.lit(1), "_val": F.lit(None).cast(dict(right.dtypes)[value])})
    r = right.select(*keys, time, F.lit(0).alias("_side"), F.col(value).alias("_val"), F.col(tie or value).alias("_tie"))
    return _after(l.unionByName(r, allowMissingColumns=True), keys, time, value, backfill)


def asof_within(df: DataFrame, is_right: Column, keys, time: str, value: str, out: str, backfill: bool = False) -> DataFrame:
    """As ``asof`` where both sides are rows of one table, read once: the rows that are not right, with the latest ``value`` of a right one."""
    side = F.when(is_right, 0).otherwise(1)
    d = df.withColumns({"_side": side, "_val": F.when(side == 0, F.col(value)), "_tie": F.when(side == 0, F.col(value))})
    return _after(d, keys, time, out, backfill)


def _after(both: DataFrame, keys, time: str, value: str, backfill: bool) -> DataFrame:
    keys = list(keys)
    both = ordered_scan(both, keys, [time, "_side", "_tie"], [Last("_prev", "_val")])
    out = both.filter(F.col("_side") == 1)
    if backfill:  # a row without an earlier value lies before the first one of its key
        first = both.filter(F.col("_val").isNotNull()).groupBy(*keys).agg(F.min_by("_val", F.struct(time, "_tie")).alias("_first"))
        out = out.join(first, keys, "left").withColumn("_prev", F.coalesce("_prev", "_first")).drop("_first")
    return out.withColumn(value, F.col("_prev")).drop("_side", "_val", "_prev", "_tie")


def keep_first(df: DataFrame, keys, order, count: str | None = None) -> DataFrame:
    """First row of each key under ``order``.

    A minimum of structs, so copies are already reduced before the shuffle and a key with very many copies costs
    one row per map task. ``count`` adds how many rows the key had.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    extra = [F.count("*").alias(count)] if count else []
    return df.groupBy(*keys).agg(first, *extra).select(*keys, "_row.*", *([count] if count else []))


def stack(tables) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def missing_days(df: DataFrame, keys, day: str, start=None) -> DataFrame:
    """Days of the calendar months of the data in which a key has no row; nothing before ``start``."""
    keys = list(keys)
    have = df.select(*keys, day).distinct()
    ends = have.groupBy(*keys).agg(F.trunc(F.min(day), "month").alias("_lo"), F.last_day(F.max(day)).alias("_hi"))
    if start is not None:
        ends = ends.withColumn("_lo", F.greatest("_lo", as_col(start)))
    want = ends.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(day))
    return want.join(have, [*keys, day], "left_anti")


def top_k(df: DataFrame, keys, order, k: int) -> DataFrame:
    """First k rows of each key; Spark keeps only k per key on the map side before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


BAND_LEVELS = 12


def _log_place(c, width: float) -> Column:
    return F.ln(F.greatest(as_col(c), F.lit(1e-300))) / width


def _bucket(place: Column, level) -> Column:
    return F.floor(place * F.pow(F.lit(2.0), as_col(level))).cast("long")


def _cover(lo: Column, hi: Column) -> Column:
    """Buckets of falling width which lie wholly between two places and do not overlap: a few per level."""
    none = F.array().cast("array<struct<level:int,bucket:bigint>>")

    def at(level):
        def span(a, b):
            seq = F.transform(F.sequence(a, b), lambda x: F.struct(level.alias("level"), x.alias("bucket")))
            return F.when(a <= b, seq).otherwise(none)

        a, b = _bucket(lo, level) + 1, _bucket(hi, level) - 1
        up_a, up_b = _bucket(lo, level - 1) + 1, _bucket(hi, level - 1) - 1
        sides = F.concat(span(a, up_a * 2 - 1), span(up_b * 2 + 2, b))
        return F.when((level > 0) & (up_a <= up_b), sides).otherwise(span(a, b))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BAND_LEVELS)), at))


def farthest_in_band(
    events: DataFrame, pool: DataFrame, event_id: str, share: float = 0.15, least: int = 5, nearest: int = 20
) -> DataFrame:
    """Pool row of similar norm which is farthest from the expected value of each event.

    ``events(event_id, norm, expected)`` and ``pool(pool_id, pool_norm, w)``. Similar means a norm within ``share``;
    an event with fewer than ``least`` such rows takes its ``nearest`` rows by norm. The farthest row of a set has
    its smallest or largest w, so the pool is reduced to buckets of the log norm at several widths, each with its
    count and both ends. A band is a few whole buckets, and only the two finest buckets at its ends are read by row.
    """
    width = share / 4
    pool = pool.withColumn("_y", _log_place("pool_norm", width))
    levels = F.transform(
        F.sequence(F.lit(0), F.lit(BAND_LEVELS)),
        lambda k: F.struct(k.alias("level"), _bucket(F.col("_y"), k).alias("bucket")),
    )
    ends = pool.withColumn("_k", F.explode(levels)).groupBy("_k.level", "_k.bucket").agg(
        F.count("*").alias("_n"),
        F.min(F.struct("w", "pool_id")).alias("_min"),
        F.max(F.struct(F.col("w"), (-F.col("pool_id")).alias("neg"))).alias("_max"),
    )
    reach = F.col("norm") * share + 1e-9
    e = events.select(event_id, "norm", "expected")
    e = e.withColumns({"_lo": _log_place(F.col("norm") - reach, width), "_hi": _log_place(F.col("norm") + reach, width)})
    gap = lambda w: F.abs(w - F.col("expected"))
    two_ends = F.array(
        F.struct(gap(F.col("_min.w")).alias("far"), F.col("_min.pool_id").alias("pool_id")),
        F.struct(gap(F.col("_max.w")).alias("far"), (-F.col("_max.neg")).alias("pool_id")),
    )
    inner = (
        e.select(event_id, "expected", F.explode(_cover(F.col("_lo"), F.col("_hi"))).alias("_k"))
        .select(event_id, "expected", "_k.level", "_k.bucket")
        .join(ends, ["level", "bucket"])
        .select(event_id, (F.col("_n") / 2).alias("_n"), F.explode(two_ends).alias("c"))
        .select(event_id, "_n", "c.far", "c.pool_id")
    )
    tips = F.array_distinct(F.array(_bucket(F.col("_lo"), BAND_LEVELS), _bucket(F.col("_hi"), BAND_LEVELS)))
    border = (
        e.withColumn("bucket", F.explode(tips))
        .join(pool.withColumn("bucket", _bucket(F.col("_y"), BAND_LEVELS)), "bucket")
        .filter(F.abs(F.col("pool_norm") - F.col("norm")) < reach)
        .select(event_id, F.lit(1.0).alias("_n"), gap(F.col("w")).alias("far"), "pool_id")
    )
    best = (
        inner.unionByName(border)
        .groupBy(event_id)
        .agg(F.sum("_n").alias("n_band"), F.min(F.struct((-F.col("far")).alias("nf"), F.col("pool_id"))).alias("_best"))
        .filter(F.col("n_band") >= least)
        .select(event_id, F.col("_best.pool_id").alias("pool_id"), (-F.col("_best.nf")).alias("far"))
    )
    short = events.join(best, event_id, "left_anti")
    return best.withColumn("widened", F.lit(False)).unionByName(_nearest(short, pool, event_id, nearest))


def _nearest(events: DataFrame, pool: DataFrame, event_id: str, k: int) -> DataFrame:
    """Farthest expected value among the k pool rows nearest by norm, for events whose band is nearly empty.

    The k nearest lie among the k rows before and the k rows after the event in norm order, so each event needs a
    short slice of the ordered pool only.
    """
    both = pool.select(F.col("pool_norm").alias("_x"), F.lit(0).alias("_side"), "pool_id", "w").unionByName(
        events.select(F.col("norm").alias("_x"), F.lit(1).alias("_side"), event_id, "expected"), allowMissingColumns=True
    )
    # One scan numbers the pool rows and tells each event how many lie before it.
    ordered = ordered_scan(both.withColumn("_one", 1 - F.col("_side")), [], ["_x", "_side", "pool_id"], [Sum("_sum", "_one")])
    ordered = ordered.withColumn("_pos0", F.col("_sum").cast("long"))
    from_pool = ordered.filter(F.col("_side") == 0).withColumn("_pos", F.col("_pos0") - 1)
    before = ordered.filter(F.col("_side") == 1)
    slots = before.select(
        event_id, "expected", F.col("_x").alias("_norm"), F.explode(F.sequence(F.col("_pos0") - k, F.col("_pos0") + k - 1)).alias("_pos")
    )
    near = slots.join(from_pool.select("_pos", "pool_id", "w", "_x"), "_pos")
    w = W.partitionBy(event_id).orderBy(F.abs(F.col("_x") - F.col("_norm")), "pool_id")
    near = near.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)
    far = F.abs(F.col("w") - F.col("expected"))
    best = near.groupBy(event_id).agg(F.min(F.struct((-far).alias("nf"), F.col("pool_id"))).alias("_best"))
    return best.select(
        event_id, F.col("_best.pool_id").alias("pool_id"), (-F.col("_best.nf")).alias("far"), F.lit(True).alias("widened")
    )
